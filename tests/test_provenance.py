"""Where values come from: through retrieval, transforms, outputs and stores; comparison of schemas with exclusions; changes of stored attributes."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import metadata
from gridloom.operators import grid, mapping
from gridloom.plans import params, provenance, retriever, transform
from gridloom.sources import store

HOUR = 3_600_000_000


@pytest.fixture
def rows(spark):
    frame = spark.createDataFrame([("a", h * HOUR // 4, float(h), 0) for h in range(40)], "series string, coord long, value double, qc int")
    return metadata.with_attributes(frame, "value", units="m", valid_max=50.0, source_dataset="raw", source_variable="height")


def test_text():
    assert provenance.transform_text("time", "bin_average", width=3600.0, alignment=0.5, std_bad_max=None) == "time: bin_average (width: 3600 alignment: 0.5)"
    assert provenance.transform_text("height", "interpolate") == "height: interpolate" and provenance.transform_text("t", "x", qc_bad=[1, 2]) == "t: x (qc_bad: 1, 2)"


def test_parameters(rows):
    found = transform.by_parameters(rows, ["series"], params.parse(f"value:transform = bin_average; time:interval = {HOUR}; time:start = 0; value:goodfrac_bad_min = 0.5;"), "value", "time", chunk=24 * HOUR)
    assert provenance.cell_transform(found, "value") == f"time: bin_average (width: {HOUR} alignment: 0.5 goodfrac_bad_min: 0.5)"
    assert provenance.source_dataset(found, "value") == "raw" and metadata.attributes(found, "value")["units"] == "m"
    # a second transform is told after the first
    again = transform.by_parameters(found.select("series", "coord", "value", "qc"), ["series"], params.parse(f"time:transform = interpolate; time:interval = {HOUR // 2}; time:range = {HOUR};"), "value", "time", chunk=24 * HOUR)
    assert provenance.cell_transform(again, "value").endswith(f"0.5) time: interpolate (range: {HOUR})") and again.count() > found.count()
    as_is = transform.by_parameters(rows, ["series"], params.parse("time:transform = passthrough;"), "value", "time", chunk=24 * HOUR)
    assert provenance.cell_transform(as_is, "value") is None and provenance.source_variable(as_is, "value") == "height"
    with pytest.raises(ValueError):
        transform.by_parameters(rows, ["series"], params.parse(f"value:transform = bin_average; time:interval = {HOUR};"), "value", "time", chunk=24 * HOUR, default_width=False)


def test_dimensions_one_after_another(spark, rows):
    wide = rows.withColumn("height", (F.col("coord") % 7).cast("double")).withColumnRenamed("coord", "t")
    wide = metadata.with_attributes(wide, "value", units="m", source_variable="height")
    targets = grid.regular(spark, 0, 2 * HOUR, 5)
    found = transform.serial(wide, [{"dim": "t", "targets": targets, "method": "bin_average", "width": 2 * HOUR, "alignment": 0.0, "chunk": 24 * HOUR}], ["series", "height", "t"])
    assert provenance.cell_transform(found, "value") == f"t: bin_average (width: {2 * HOUR} alignment: 0)" and metadata.attributes(found, "value")["units"] == "m"


def test_retrieval(spark):
    one = metadata.with_attributes(spark.createDataFrame([(1, "x", 0.0), (2, "x", 5.0)], "t long, s string, temp double"), "temp", units="degC", valid_min=-10.0, valid_delta=5.0, missing_value=-99.0)
    two = metadata.with_attributes(spark.createDataFrame([(1, "y", 50.0), (2, "y", -99.0)], "t long, s string, tf double"), "tf", units="degF", missing_value=-99.0)
    group = retriever.Group("g", [("first", lambda s: one), ("second", lambda s: two)], [retriever.Wanted("t_air", ["temp", "tf"], unit="K"), retriever.Wanted("rh", required=False)], ["s"])
    found = retriever.retrieve_group(spark, group, 0, 10)
    held = metadata.attributes(found, "t_air")
    assert (held["units"], held["valid_min"], held["valid_delta"]) == ("K", 263.15, 5.0) and provenance.source_variable(found, "t_air") == "temp"
    assert provenance.source_dataset(found, "t_air") == "first, second" and provenance.source_dataset(found, "rh") is None
    assert provenance.lineage(found) == [("t_air", "first, second", "temp", None)]
    # missing values stay what they are
    assert sorted((r["source"], round(r["t_air"], 2)) for r in found.collect()) == [("first", 273.15), ("first", 278.15), ("second", -99.0), ("second", 283.15)]


def test_outputs(rows):
    target = mapping.Target("h", "value", "double", "m", "km", attributes={"long_name": "height"})
    fixed, dynamic = (mapping.map_outputs(rows, ["series", "coord"], [target], dynamic=x) for x in (False, True))
    assert metadata.attributes(fixed, "h") == {"source_dataset": "raw", "source_variable": "height", "long_name": "height", "units": "km", "source": "value"}
    assert metadata.attributes(dynamic, "h") == {**metadata.attributes(fixed, "h"), "valid_max": 0.05}


def test_comparison(spark, rows):
    other = metadata.with_attributes(rows, "value", units="m", valid_max=60.0, source_dataset="raw2").withColumn("more", F.lit(1))
    assert [x[:2] for x in mapping.compare_schemas(rows, other)] == [("more", "added"), ("value", "attributes")]
    assert mapping.compare_schemas(rows, other, {"value": ["valid_max"], **mapping.EXCLUDED}, ["more"]) == []
    assert "source_dataset" not in mapping.compare_schemas(rows, other, mapping.EXCLUDED, ["more"])[0][2]
    assert mapping.compare_schemas(rows, other, {None: ["valid_max", "source_dataset"]}, ["more"]) == []


def test_stored_attributes(spark, tmp_path):
    path = str(tmp_path / "s")

    def part(days, **attributes):
        return metadata.with_attributes(spark.createDataFrame([(d * 24 * HOUR, float(d)) for d in days], "t long, v double"), "v", **attributes)

    store.write(part([0, 1], units="m", serial="a1"), path)
    assert store.changes(spark, path).collect() == []
    store.write(part([2, 3], units="m", serial="b2"), path)
    store.write(part([4], units="m", serial="b2"), path)
    assert metadata.attributes(store.read(spark, path), "v") == {"units": "m", "serial": "b2"}
    assert [tuple(r) for r in store.changes(spark, path).collect()] == [("v", '{"serial": "b2"}', 2 * 24 * HOUR)]
    store.describe(spark, path, {"v": {"serial": None, "comment": "checked"}})
    assert metadata.attributes(store.read(spark, path), "v") == {"units": "m", "comment": "checked"} and store.read(spark, path).count() == 5
    with pytest.raises(ValueError):
        store.describe(spark, path, {"w": {"units": "m"}})
    assert '{"comment": "checked", "serial": null}' in [r["attributes"] for r in store.changes(spark, path).collect()]
    # changes outlive summaries
    for k in range(store.SUMMARY):
        store.write(part([5 + k]), path)
    assert store.changes(spark, path).count() == 2 and metadata.attributes(store.read(spark, path), "v") == {"units": "m", "comment": "checked"}


def test_two_writers_of_attributes(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(0, 1.0)], "t long, v double")
    store.write(rows, path)
    first, second, same = store.Commit(spark, path), store.Commit(spark, path), store.Commit(spark, path)
    first.describe({"v": {"units": "m"}})
    second.describe({"v": {"units": "km"}})
    same.describe({"v": {"units": "m"}})
    first.commit()
    with pytest.raises(store.Conflict):
        second.commit()
    same.commit()
    assert metadata.attributes(store.read(spark, path), "v") == {"units": "m"}
