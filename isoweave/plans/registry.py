"""All queries outside the llm subpackage."""

from . import chain_queries, core_problems, crosscheck_queries, extract_queries, fixture_queries, quality_queries, relational_queries, routing_queries, scalar_queries, service_queries

_MODULES = (core_problems, scalar_queries, relational_queries, service_queries, crosscheck_queries, chain_queries, extract_queries, fixture_queries, quality_queries, routing_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
