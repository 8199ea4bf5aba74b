import pytest
from pyspark.sql import functions as F

from gridloom.operators import mapping
from gridloom.plans import process
from gridloom.sources import store

HOUR = 3_600_000_000


@pytest.mark.parametrize("fmt,tz_hours,shift", [("parquet", 0.0, 0), ("csv", -7.0, 1800)])
def test_intervals_shorter_than_the_split(spark, tmp_path, fmt, tz_hours, shift):
    data = spark.range(12).select((F.col("id") * (HOUR // 2) + 20 * HOUR).alias("t"), F.col("id").cast("double").alias("v"), F.lit(0).alias("qc_v"))

    class Mine(process.Process):
        factor = 1.0

        def transform_hook(self, begin, end):
            self.transformed = {"out": self.inputs["in"].withColumn("v", F.col("v") * self.factor)}

    out = process.Output(str(tmp_path / "out"), ["t"], [mapping.Target("v", "v", "double")], tz_hours=tz_hours, fmt=fmt)
    p = Mine(spark, {"in": process.Input([lambda s: data], value="v")}, {"out": out})
    p.shift_processing_interval(shift)
    first = 1 if shift else 0
    assert p.run(20 * HOUR, 26 * HOUR, HOUR) == 6
    read = lambda: sorted(float(r["v"]) for r in store.read(spark, out.path, fmt=fmt).collect())
    assert read() == [float(k) for k in range(first, 12)]
    # one interval run again replaces its own rows only
    p.factor = 100.0
    p.run(21 * HOUR, 22 * HOUR, HOUR)
    again = (2 + first, 3 + first)
    assert read() == sorted(100.0 * k if k in again else float(k) for k in range(first, 12))
