"""Hooks as table functions and aggregations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import bits
from gridloom.operators import grid
from gridloom.plans import hooks, transform


def test_runs(spark):
    times = {"a": [1, 2, 3, 10, 11, None, 12], "b": [5], "c": [None]}
    rows = spark.createDataFrame([(s, t, "x") for s, ts in times.items() for t in ts], "s string, t long, other string").repartition(3)
    found = hooks.apply(rows, hooks.Runs, ["s"], ["t"], keys="s", time="t", gap=2)
    assert found.columns == ["s", "begin", "end", "n"]
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 3, 3), ("a", 10, 12, 3), ("b", 5, 5, 1)]
    whole = hooks.apply(rows.where("t is not null"), hooks.Runs, [], ["t"], keys="", time="t", gap=4)
    assert sorted(tuple(r) for r in whole.collect()) == [(1, 5, 4), (10, 12, 3)]
    assert hooks.apply(rows.limit(0), hooks.Runs, ["s"], ["t"], keys="s", time="t", gap=2).collect() == []
    with pytest.raises(Exception, match="no columns"):
        hooks.apply(rows, hooks.Runs, ["s"], ["t"], keys="s", time="absent", gap=2).collect()


def test_an_aggregation_in_the_chain(spark):
    @F.pandas_udf("double")
    def median(x: pd.Series) -> float:
        return float(np.median(x))

    hooks.register_aggregate("median_for_test", median, 10.0)
    rows = spark.createDataFrame([(float(x), float(h), x * x + 1000.0 * h, 2 if x == 3 else 1 if 20 <= x < 30 or x == 5 else 0) for x in range(30) for h in (0, 1)], "x double, h double, value double, qc int")
    steps = [{"dim": "x", "method": "median_for_test", "targets": grid.regular(spark, 5.0, 10.0, 4), "chunk": 1000.0}, {"dim": "h", "method": "subsample", "targets": grid.from_values(spark, [0.0, 1.0]), "chunk": 1000.0}]
    got = {(r["x"], r["h"]): r["value"] for r in transform.serial(rows, steps, ["x", "h"]).collect()}
    first, second = float(np.median([x * x for x in range(10) if x != 5])), float(np.median([x * x for x in range(10, 20)]))
    assert {k: v for k, v in got.items() if k[0] < 20} == {(5.0, 0.0): first, (5.0, 1.0): first + 1000, (15.0, 0.0): second, (15.0, 1.0): second + 1000}
    alone = transform.transform(rows.where("h = 0").withColumnRenamed("x", "coord"), grid.regular(spark, 5.0, 10.0, 4), [], "median_for_test", chunk=1.0)
    assert {r["bin"]: r["qc"] for r in alone.collect()} == {0: bits.SOME_BAD | bits.INDETERMINATE, 1: 0, 2: bits.ALL_BAD | bits.BAD | bits.SOME_BAD, 3: bits.OUTSIDE | bits.BAD}
