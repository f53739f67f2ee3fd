"""Sinks on parquet tables: append, replace by key, insert or ignore, changed rows only, delete with children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of ``key`` that ``df`` has; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def new_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert: one per key (least by all columns), keys that exist left out; null equals null."""
    on = None
    for k in keys:
        c = df[k].eqNullSafe(existing[k])
        on = c if on is None else on & c
    fresh = df.join(existing, on, "left_anti")
    return fresh.groupBy(*keys).agg(F.min(F.struct(*fresh.columns)).alias("_r")).select("_r.*")


def changed(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``new`` whose fields differ from those in ``old``, nulls compared as values."""
    o = old.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    differs = None
    for f in fields:
        c = ~F.col(f).eqNullSafe(F.col(f"_{f}"))
        differs = c if differs is None else differs | c
    return new.join(o, new[key] == o["_k"], "left").filter(differs | F.col("_k").isNull()).select(*new.columns)


def without_document(tables: dict[str, DataFrame], document_id: str) -> dict[str, DataFrame]:
    """All tables without a document and what hangs on it; findings go if either side cites it."""
    out = {}
    for name, df in tables.items():
        hit = F.lit(False)
        for c in ("document_id", "doc_a_id", "doc_b_id"):
            if c in df.columns:
                hit = hit | F.coalesce(F.col(c) == document_id, F.lit(False))
        if name in ("documents", "project_documents"):
            hit = F.coalesce(F.col("id") == document_id, F.lit(False))
        out[name] = df.filter(~hit)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Structured extraction output as a source; records that do not fit keep nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
