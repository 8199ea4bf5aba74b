import pytest
from pyspark.sql import functions as F

from gridloom.functions import metadata
from gridloom.plans import retriever
from gridloom.plans.retriever import Group, Wanted


def source(spark, rows, schema, **unit):
    frame = spark.createDataFrame(rows, schema)
    for column, name in unit.items():
        frame = metadata.with_attributes(frame, column, units=name)
    return lambda s: frame


def test_groups(spark):
    first = source(spark, [("x", 1, None, 0), ("x", 2, None, 0), ("y", 1, 1.5, 4), ("y", 50, 9.0, 0)], "site string, t long, v double, qc_v int", v="m")
    second = source(spark, [("x", 1, 200.0), ("y", 1, 300.0)], "site string, t long, w double", w="cm")
    wanted = [Wanted("height", ["v", "w"], "m", "double", system="grid"), Wanted("extra", required=False)]
    group = Group("g", [("none", source(spark, [("x", 1)], "site string, t long")), ("first", first), ("second", second)], wanted, ["site"])
    found = retriever.retrieve_group(spark, group, 0, 10)
    assert found.columns == ["t", "site", "height", "qc_height", "extra", "qc_extra", "source"]
    assert sorted((r["site"], r["t"], r["height"], r["qc_height"], r["source"]) for r in found.collect()) == [("x", 1, 2.0, 0, "second"), ("y", 1, 1.5, 4, "first")]
    assert {k: v.columns for k, v in retriever.by_system(found, group).items()} == {"grid": ["t", "site", "source", "height", "qc_height"], None: ["t", "site", "source", "extra", "qc_extra"]}
    assert [n for n, _ in retriever.compiled(spark, group, 0, 10)] == ["first", "second"]
    # without keys one source serves all; a companion that must be there rules the second one out
    alone = Group("g", group.sources, [Wanted("height", ["v", "w"], "m", companions=True)], end_offset=100)
    assert [r["source"] for r in retriever.retrieve_group(spark, alone, 0, 10).where(F.col("t") == 50).collect()] == ["first"]
    with pytest.raises(ValueError, match="no source"):
        retriever.retrieve_group(spark, Group("g", group.sources, [Wanted("nothing")]), 0, 10)
