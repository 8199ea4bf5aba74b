import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import metadata
from gridloom.operators import qc
from gridloom.plans import datasets, process


@pytest.fixture
def rows(spark):
    frame = spark.createDataFrame([(1, 10.0, 0), (2, -9999.0, 1), (3, None, 2), (4, 40.0, 6)], "t long, temp double, qc_temp int")
    frame = metadata.with_attributes(frame, "temp", units="degC", missing_value=[-9999.0], _FillValue=-8888.0, valid_max=35.0, valid_delta=5.0)
    return metadata.with_attributes(frame, "qc_temp", bit_1_assessment="Bad", bit_2_assessment="Indeterminate", bit_3_assessment="Bad")


def test_missing_values(rows):
    assert metadata.missing_values(rows, "temp") == [-9999.0, -8888.0] and metadata.missing_values(rows, "t") == [-9223372036854775806]
    clean = metadata.sentinels_to_null(rows)
    assert [r["temp"] for r in clean.orderBy("t").collect()] == [10.0, None, None, 40.0] and metadata.attributes(clean, "temp")["units"] == "degC"
    assert [r["temp"] for r in metadata.nulls_to_sentinel(clean).orderBy("t").collect()] == [10.0, -9999.0, -9999.0, 40.0]
    assert [r["m"] for r in rows.select("t", metadata.missing_mask(rows, "temp").alias("m")).orderBy("t").collect()] == [False, True, True, False]


def test_masks_and_companions(rows):
    assert metadata.bad_mask(rows, "temp") == 5 and metadata.bad_mask(rows, "temp", indeterminate=True) == 7 and metadata.bad_mask(rows, "temp", bits=[4]) == 13
    wide = rows.withColumn("temp_std", F.lit(1.0)).withColumn("t_bounds", F.struct("t"))
    assert metadata.companions(wide, "temp") == ["qc_temp", "temp_std"] and metadata.bounds_column(wide, "t") == "t_bounds" and metadata.qc_column(wide, "t") is None
    assert datasets.drop_transform_metadata(wide, ["temp"]).columns == ["t", "temp", "t_bounds"]


def test_variables(rows):
    more = datasets.add_variable(rows, "extra", None, "float", units="m", long_name=None)
    assert metadata.attributes(more, "extra") == {"units": "m"} and more.schema["extra"].dataType == T.FloatType()
    flagged = datasets.record_qc_results(more, "extra", 2, F.col("t") > 2, "Indeterminate", "late")
    assert [r["qc_extra"] for r in flagged.orderBy("t").collect()] == [0, 0, 2, 2] and metadata.assessments(flagged, "qc_extra") == {2: "Indeterminate"}
    assert datasets.variables_exist(rows, ["temp", "no"]) == {"temp": True, "no": False}
    warm = datasets.convert_units(rows, "degC", "degF")
    held = metadata.attributes(warm, "temp")
    assert (round(held["valid_max"], 6), held["valid_delta"], held["units"]) == (95.0, 9.0, "degF")
    assert [r["temp"] if r["temp"] is None else round(r["temp"], 6) for r in warm.orderBy("t").collect()] == [50.0, -9999.0, None, 104.0]
    assert datasets.convert_units(rows, "degC", "degF", exclude=["temp"]).schema == rows.schema


def test_union(rows):
    assert datasets.union_observations([rows, rows]).count() == 8
    with pytest.raises(ValueError):
        datasets.union_observations([rows, rows.drop("temp")])


def test_schema_versions(spark):
    registry = datasets.SchemaRegistry()
    registry.add("out", 100, "1.1", T.StructType([T.StructField("n", T.ShortType()), T.StructField("new", T.DoubleType())]))
    registry.add("out", 0, "1.0", T.StructType([T.StructField("n", T.IntegerType())]))
    rows = spark.createDataFrame([(2.5, "x"), (99999.0, "y")], "n double, other string")
    assert registry.at("out", 99)[0] == "1.0" and registry.at("out", 100)[0] == "1.1"
    assert [tuple(r) for r in registry.conform(rows, "out", 5).collect()] == [(3,), (99999,)]
    assert [tuple(r) for r in registry.conform(rows, "out", 500).collect()] == [(3, None), (-32767, None)]
    with pytest.raises(ValueError):
        registry.at("none", 5)


def test_shading_of_cells(spark):
    shades = [qc.Shade(350, 20, 0, 30), qc.Shade(100, 120, 10, 20)]
    cases = [((95.0, 101.0), (5.0, 12.0), True), ((121.0, 125.0), (15.0, 15.0), False), ((95.0, 130.0), (21.0, 25.0), False), ((340.0, 351.0), (1.0, 2.0), True), ((340.0, 10.0), (1.0, 2.0), True), ((21.0, 90.0), (1.0, 2.0), False), ((355.0, 5.0), (31.0, 40.0), False)]
    frame = spark.createDataFrame([(k, *a, *e) for k, (a, e, _) in enumerate(cases)], "k int, a0 double, a1 double, e0 double, e1 double")
    found = frame.select("k", qc.shaded_between((F.col("a0"), F.col("a1")), (F.col("e0"), F.col("e1")), shades).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in found] == [c[2] for c in cases]


def test_observation_intervals():
    assert list(process.observation_intervals([(0, 9), (0, 5), (10, 12), (11, 30), (40, 41)], 0, 40)) == [(0, 9), (10, 12)]
