"""Connected components whose labels travel far."""

import random

import pytest

from isoweave.operators import relational as R


def test_components_of_long_paths_in_any_order_of_ids(spark):
    rnd, edges = random.Random(3), [(39, 0), (500, 500)]
    edges += [(i, i + 1) for i in range(1, 39)]
    ids = list(range(1000, 1400))
    rnd.shuffle(ids)
    edges += list(zip(ids, ids[1:]))
    rows = R.components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert len(rows) == len({r.node for r in rows}) == 441
    got = dict(map(tuple, rows))
    assert {got[i] for i in range(40)} == {0} and got[500] == 500 and {got[i] for i in ids} == {1000}


def test_components_raise_at_the_bound(spark):
    with pytest.raises(RuntimeError):
        R.components(spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a int, b int"), rounds=1)
