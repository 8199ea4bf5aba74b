"""Queries of the grid, quality and ingest operators on the sample tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bits, metadata, solar, text, times, units
from gridloom.operators import bin_average, chunks, grid, mapping, nearest, objective, outliers, overlap, qc, retrieve
from gridloom.operators.chunks import DAY
from gridloom.plans import datasets, ingest, params, process, retriever, transform
from gridloom.sources import csv_ingest, scratch, store
from gridloom.streaming import pipelines

HOUR = DAY // 24
#: 2024-01-01, the start of the event series, in microseconds.
START = 1_704_067_200_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Events as samples: every 17th value is missing, every 23rd is bad, every 29th uncertain."""
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_id") % 23 == 0, 1).when(F.col("event_id") % 29 == 0, 2).otherwise(0)
    return e.select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("coord"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"), flag.alias("qc"), *more)


OBS = """obs AS (SELECT event_type AS series, epoch_us(ts) AS coord, CASE WHEN event_id % 17 <> 0 THEN value END AS value,
  CASE WHEN event_id % 23 = 0 THEN 1 WHEN event_id % 29 = 0 THEN 2 ELSE 0 END AS qc, event_id, user_id FROM events)"""


def _days(rows: DataFrame, coord: str) -> tuple[int, int]:
    """The whole days that a table's samples are in, as an interval."""
    low, high = rows.agg(F.min(coord), F.max(coord)).first()
    return low // DAY * DAY, (high // DAY + 1) * DAY


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


# --- bin averages -------------------------------------------------------------------------------------------------------------


def _hourly_grid(rows: DataFrame) -> DataFrame:
    return grid.per_series(rows, ["series"], "coord", HOUR, start=F.lit(START))


def _average_sql(bins: str, met: str, keys: str, limits: tuple = ("1e308", "1e308", "-1", "-1")) -> str:
    """The averages of candidates ``met`` (keys, value, qc, share, span, weight) in ``bins``."""
    std_bad, std_ind, frac_bad, frac_ind = limits
    return f"""
marked AS (SELECT *, value IS NOT NULL AND qc & 1 = 0 AS good FROM {met}),
sums AS (SELECT {keys}, count(*) AS n, max(CASE WHEN share > 0 THEN weight END) AS most, max(CASE WHEN share > 0 AND NOT good THEN 1 ELSE 0 END) AS some_bad,
  sum(CASE WHEN share > 0 AND good THEN share * weight ELSE 0 END) AS s0, sum(CASE WHEN share > 0 AND good THEN share * weight * value ELSE 0 END) AS s1,
  sum(CASE WHEN share > 0 AND good THEN share * weight * value * value ELSE 0 END) AS s2, sum(span) AS total,
  sum(CASE WHEN share <= 0 OR good THEN span ELSE 0 END) AS good, bit_or(CASE WHEN share > 0 AND good THEN qc ELSE 0 END) AS q FROM marked GROUP BY {keys}),
state AS (SELECT b.*, n, most, some_bad, s0, s1, s2, total, good, q, n IS NULL AS none, n IS NOT NULL AND coalesce(most, 0) = 0 AS zero,
  n IS NOT NULL AND coalesce(most, 0) <> 0 AND s0 = 0 AS crunched, n IS NOT NULL AND coalesce(most, 0) <> 0 AND s0 <> 0 AS used FROM {bins} b LEFT JOIN sums USING ({keys})),
done AS (SELECT *, CASE WHEN zero THEN 0 WHEN used THEN s1 / s0 END AS v,
  CASE WHEN zero THEN 0 WHEN used THEN CASE WHEN abs((s0 * s2 - s1 * s1) / (s0 * s0)) < 1e-12 THEN 0 WHEN s0 * s2 - s1 * s1 > 0 THEN sqrt((s0 * s2 - s1 * s1) / (s0 * s0)) END END AS sd,
  CASE WHEN used THEN good / total ELSE 0 END AS gf FROM state)
SELECT {{columns}}, round(v, 6) AS value, round(sd, 6) AS value_std, round(gf, 6) AS value_goodfraction,
  (CASE WHEN none THEN 129 ELSE 0 END | CASE WHEN zero THEN 64 ELSE 0 END | CASE WHEN crunched THEN 257 ELSE 0 END | CASE WHEN some_bad = 1 THEN 32 ELSE 0 END
  | CASE WHEN used AND (q & ~1) <> 0 THEN 2 ELSE 0 END | CASE WHEN sd > {std_bad} THEN 512 WHEN sd > {std_ind} THEN 1024 ELSE 0 END
  | CASE WHEN gf < {frac_bad} THEN 2048 WHEN gf < {frac_ind} THEN 4096 ELSE 0 END)::INTEGER AS qc FROM done"""


HOURS = f"hours AS (SELECT series, unnest(generate_series(0, (max(coord) - {START}) // {HOUR})) AS bin FROM obs GROUP BY series)"
_POINTS = f"met AS (SELECT series, (coord - {START}) // {HOUR} AS bin, value, qc, 1.0 AS share, 1.0 AS span, 1.0 AS weight FROM obs)"


@query(f"WITH {OBS}, {HOURS}, {_POINTS}, {_average_sql('hours', 'met', 'series, bin').format(columns=f'series, bin, {START} + bin * {HOUR} AS coord')}")
def bin_average_hourly(spark, sf_dir):
    rows = observations(spark, sf_dir)
    found = bin_average.average_points(rows, _hourly_grid(rows), ["series"], "coord", START, HOUR)
    return rounded(found, "value", "value_std", "value_goodfraction")


_LIMITS = ("20", "10", "0.5", "0.9")


@query(f"WITH {OBS}, {HOURS}, {_POINTS}, {_average_sql('hours', 'met', 'series, bin', _LIMITS).format(columns='series, bin')}")
def bin_average_limits(spark, sf_dir):
    rows = observations(spark, sf_dir)
    limits = bin_average.Limits(*map(float, _LIMITS))
    found = bin_average.average_points(rows, _hourly_grid(rows), ["series"], "coord", START, HOUR, limits=limits).drop("coord")
    return rounded(found, "value", "value_std", "value_goodfraction")


@query(f"""WITH {OBS}, {HOURS}, bins AS (SELECT *, {START} + bin * {HOUR} - {HOUR} AS lo, {START} + bin * {HOUR} + {HOUR} AS hi FROM hours),
met AS (SELECT series, bin, value, qc, 1.0 AS share, 1.0 AS span, 1.0 AS weight FROM bins JOIN obs USING (series) WHERE coord >= lo AND coord < hi),
{_average_sql('bins', 'met', 'series, bin').format(columns='series, bin, lo::DOUBLE AS lo, hi::DOUBLE AS hi')}""")
def bin_average_overlap(spark, sf_dir):
    """Bins two hours wide, one hour apart."""
    rows = observations(spark, sf_dir)
    bins = grid.with_width(_hourly_grid(rows), "coord", F.lit(2.0 * HOUR)).drop("coord")
    points = rows.withColumns({"lo": F.col("coord").cast("double"), "hi": F.col("coord").cast("double")})
    found = bin_average.average_cells(points, bins, ["series"], 2.0 * HOUR)
    return rounded(found, "value", "value_std", "value_goodfraction")


@query(f"""WITH obs AS (SELECT 'all' AS series, epoch_us(l_shipdate) // {DAY} AS coord, l_discount AS value, 0 AS qc, l_quantity AS weight FROM lineitem),
days AS (SELECT series, unnest(generate_series(min(coord), max(coord))) AS bin FROM obs GROUP BY series),
met AS (SELECT series, coord AS bin, value, qc, 1.0 AS share, 1.0 AS span, weight FROM obs), {_average_sql('days', 'met', 'series, bin').format(columns='series, bin')}""")
def bin_average_weighted(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(F.lit("all").alias("series"), F.floor(times.micros(F.col("l_shipdate")) / DAY).alias("coord"), F.col("l_discount").alias("value"), F.lit(0).alias("qc"), "l_quantity")
    days = grid.per_series(rows, ["series"], "coord", 1).withColumn("bin", F.col("coord"))
    found = bin_average.average_points(rows, days, ["series"], "coord", 0, 1, weight=F.col("l_quantity")).drop("coord")
    return rounded(found, "value", "value_std", "value_goodfraction")


@query(f"""WITH daily AS (SELECT o_orderpriority AS series, epoch_us(o_orderdate) // {DAY} AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
obs AS (SELECT series, day::DOUBLE AS i0, day + 1.0 AS i1, value, 0 AS qc FROM daily),
bins AS (SELECT series, bin, 8000.5 + bin * 7.25 AS lo, 8000.5 + bin * 7.25 + 7.25 AS hi FROM (SELECT DISTINCT series FROM obs), (SELECT unnest(generate_series(0, 399)) AS bin)),
met AS (SELECT series, bin, value, qc, 1.0 AS weight, 1 - greatest(0, lo - i0) - greatest(0, i1 - hi) AS share, 1 - greatest(0, lo - i0) - greatest(0, i1 - hi) AS span
  FROM bins JOIN obs USING (series) WHERE i1 >= lo AND i0 < hi), {_average_sql('bins', 'met', 'series, bin').format(columns='series, bin, lo, hi')}""")
def bin_average_widebins(spark, sf_dir):
    """Daily cells into bins of 7.25 days that cut through days."""
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.col("o_orderpriority").alias("series"), F.floor(times.micros(F.col("o_orderdate")) / DAY).alias("day")).agg(F.avg("o_totalprice").alias("value"))
    cells = daily.select("series", F.col("day").cast("double").alias("lo"), (F.col("day") + 1.0).alias("hi"), "value", F.lit(0).alias("qc"))
    points = transform._for_all(cells, grid.regular(spark, 8000.5, 7.25, 400), ["series"])
    bins = grid.with_width(points, "coord", 7.25, 0.0).drop("coord")
    found = bin_average.average_cells(cells, bins, ["series"], 7.25)
    return rounded(found, "value", "value_std", "value_goodfraction")


# --- interpolation, subsampling, choice of method ------------------------------------------------------------------------------

_GOOD_POINTS = f"""{OBS}, {HOURS}, targets AS (SELECT series, bin, ({START} + bin * {HOUR})::DOUBLE AS x FROM hours),
points AS (SELECT series, coord::DOUBLE AS x, value AS y, qc, value IS NOT NULL AND qc & 1 = 0 AS good FROM obs),
g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(qc) OVER w AS pq, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(qc) OVER w AS nq FROM points WHERE good WINDOW w AS (PARTITION BY series ORDER BY x)),
r AS (SELECT *, lag(good) OVER w AS pgood, lag(x) OVER w AS px, lead(good) OVER w AS ngood, lead(x) OVER w AS nx FROM points WINDOW w AS (PARTITION BY series ORDER BY x)),
ends AS (SELECT series, min(x) AS x0, max(x) AS xn FROM points GROUP BY series)"""


@query(f"""WITH {_GOOD_POINTS},
j AS (SELECT t.series, t.bin, t.x, g1.x AS ax, g1.y AS ay, g1.qc AS aq, g1.px, g1.py, g1.pq, g2.x AS bx, g2.y AS by_, g2.qc AS bq, g2.nx, g2.ny, g2.nq,
  r1.x AS rx, r1.good AS rg, r1.pgood AS rpg, r1.px AS rpx, r2.x AS sx, r2.good AS sg, r2.ngood AS sng, r2.nx AS snx, x0, xn
  FROM targets t ASOF LEFT JOIN g g1 ON t.series = g1.series AND t.x >= g1.x ASOF LEFT JOIN g g2 ON t.series = g2.series AND t.x <= g2.x
  ASOF LEFT JOIN r r1 ON t.series = r1.series AND t.x >= r1.x ASOF LEFT JOIN r r2 ON t.series = r2.series AND t.x <= r2.x JOIN ends e ON e.series = t.series),
k AS (SELECT *, CASE WHEN rx IS NULL THEN x0 - x > abs(snx - sx) / 2 WHEN sx IS NULL THEN x - xn > abs(rx - rpx) / 2 ELSE false END AS beyond,
  CASE WHEN rx IS NULL THEN NOT (sg AND sng) WHEN sx IS NULL THEN NOT (rg AND rpg) ELSE NOT (rg AND sg) END AS walked,
  CASE WHEN ax IS NULL THEN bx WHEN bx IS NULL AND sx IS NULL THEN px ELSE ax END AS x1, CASE WHEN ax IS NULL THEN by_ WHEN bx IS NULL AND sx IS NULL THEN py ELSE ay END AS y1,
  CASE WHEN ax IS NULL THEN bq WHEN bx IS NULL AND sx IS NULL THEN pq ELSE aq END AS q1,
  CASE WHEN ax IS NULL THEN nx WHEN bx IS NULL THEN CASE WHEN sx IS NULL THEN ax ELSE px END ELSE bx END AS x2,
  CASE WHEN ax IS NULL THEN ny WHEN bx IS NULL THEN CASE WHEN sx IS NULL THEN ay ELSE py END ELSE by_ END AS y2,
  CASE WHEN ax IS NULL THEN nq WHEN bx IS NULL THEN CASE WHEN sx IS NULL THEN aq ELSE pq END ELSE bq END AS q2 FROM j),
m AS (SELECT *, (x - x1) / (x2 - x1) AS u FROM k)
SELECT series, bin, x AS coord, CASE WHEN NOT beyond THEN round(u * y2 + (1 - u) * y1, 6) END AS value, CASE WHEN NOT beyond THEN x1 - x END AS dist_1, CASE WHEN NOT beyond THEN x2 - x END AS dist_2,
  (CASE WHEN beyond THEN 129 ELSE 0 END | CASE WHEN NOT beyond AND walked THEN 4 ELSE 0 END | CASE WHEN NOT beyond AND (u < 0 OR u > 1) THEN 8 ELSE 0 END
  | CASE WHEN NOT beyond AND (((q1 & ~1) <> 0 AND abs(1 - u) > 1e-5) OR ((q2 & ~1) <> 0 AND abs(u) > 1e-5)) THEN 2 ELSE 0 END)::INTEGER AS qc FROM m""")
def interpolate_grid(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return rounded(nearest.interpolate(rows, _hourly_grid(rows), ["series"], DAY), "value")


_REACH = HOUR // 4


@query(f"""WITH {_GOOD_POINTS},
j AS (SELECT t.series, t.bin, t.x, abs(g1.x - t.x) AS d1, abs(g2.x - t.x) AS d2, g1.x AS x1, g1.y AS y1, g1.qc AS q1, g2.x AS x2, g2.y AS y2, g2.qc AS q2, least(abs(r1.x - t.x), abs(r2.x - t.x)) AS raw, xn
  FROM targets t ASOF LEFT JOIN g g1 ON t.series = g1.series AND t.x >= g1.x ASOF LEFT JOIN g g2 ON t.series = g2.series AND t.x <= g2.x
  ASOF LEFT JOIN r r1 ON t.series = r1.series AND t.x >= r1.x ASOF LEFT JOIN r r2 ON t.series = r2.series AND t.x <= r2.x JOIN ends e ON e.series = t.series),
k AS (SELECT *, d2 IS NULL OR d1 <= d2 AS before FROM j),
m AS (SELECT *, CASE WHEN before THEN d1 ELSE d2 END AS d, CASE WHEN before THEN x1 ELSE x2 END AS nx, CASE WHEN before THEN y1 ELSE y2 END AS ny, CASE WHEN before THEN q1 ELSE q2 END AS nq FROM k)
SELECT series, bin, x AS coord, CASE WHEN d <= {_REACH} THEN ny END AS value, CASE WHEN d <= {_REACH} THEN nx - x END AS dist,
  (CASE WHEN d <= {_REACH} THEN CASE WHEN (nq & ~1) <> 0 THEN 2 ELSE 0 END | CASE WHEN d > raw THEN 16 ELSE 0 END WHEN x - {_REACH} > xn THEN 129 ELSE 257 END)::INTEGER AS qc FROM m""")
def subsample_nearest(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return nearest.subsample(rows, _hourly_grid(rows), ["series"], DAY, reach=float(_REACH))


@query(f"WITH {OBS} SELECT series, coord, value, qc::INTEGER AS qc FROM obs")
def pass_through(spark, sf_dir):
    rows = observations(spark, sf_dir)
    lengths = rows.groupBy("series").agg(F.count("*").alias("length"))
    return nearest.pass_through(rows, ["series"], lengths).select("series", "coord", "value", F.col("qc").cast("int").alias("qc"))


_STEPS = f"""{OBS}, steps AS (SELECT series, abs(coord - lag(coord) OVER (PARTITION BY series ORDER BY coord)) AS step FROM obs),
spans AS (SELECT series, list_sort(list(step) FILTER (step IS NOT NULL)) AS l FROM steps GROUP BY series)"""


@query(f"WITH {_STEPS} SELECT series, l[len(l) // 2 + 1] AS interval FROM spans")
def sampling_interval(spark, sf_dir):
    return grid.sampling_interval(observations(spark, sf_dir), ["series"], "coord", DAY)


@query(f"WITH {_STEPS} SELECT series, CASE WHEN {HOUR} > l[len(l) // 2 + 1] THEN 'bin_average' ELSE 'interpolate' END AS method FROM spans")
def transform_auto(spark, sf_dir):
    found = grid.sampling_interval(observations(spark, sf_dir), ["series"], "coord", DAY)
    method = F.when(F.col("interval") < HOUR, F.lit(transform.choose(1, 2))).otherwise(F.lit(transform.choose(2, 1)))
    return found.select("series", method.alias("method"))


@query(f"""WITH {OBS}, n AS (SELECT series, coord, lag(coord) OVER w AS p, lead(coord) OVER w AS q FROM obs WINDOW w AS (PARTITION BY series ORDER BY coord))
SELECT series, coord, coalesce((coord + p) / 2, coord - (q - coord) / 2) AS lo, coalesce((coord + q) / 2, coord + (coord - p) / 2) AS hi, (coalesce((coord + p) / 2, coord - (q - coord) / 2) + coalesce((coord + q) / 2, coord + (coord - p) / 2)) / 2 AS mid FROM n""")
def bin_edges(spark, sf_dir):
    found = grid.inferred_edges(observations(spark, sf_dir).select("series", "coord"), ["series"], "coord", DAY)
    return found.withColumn("mid", grid.midpoint(F.col("lo"), F.col("hi")))


TWO_HOURS = f"""
# where no object is named, the dimension's own parameters count
value:transform = bin_average;
value:std_bad_max = 20; value:std_ind_max = 10; value:goodfrac_bad_min = 0.5; value:goodfrac_ind_min = 0.9;
time:interval = {2 * HOUR}; time:start = {START}; time:alignment = 0;
"""


@query(f"""WITH {OBS}, bins AS (SELECT series, bin, ({START} + bin * {2 * HOUR})::DOUBLE AS coord FROM (SELECT series, unnest(generate_series(0, (max(coord) - {START}) // {2 * HOUR})) AS bin FROM obs GROUP BY series)),
met AS (SELECT series, (coord - {START}) // {2 * HOUR} AS bin, value, qc, 1.0 AS share, 1.0 AS span, 1.0 AS weight FROM obs), {_average_sql('bins', 'met', 'series, bin', _LIMITS).format(columns='series, bin, coord')}""")
def transform_by_parameters(spark, sf_dir):
    """Grid, method, bins and limits from the text of parameters."""
    rows = observations(spark, sf_dir)
    found = transform.by_parameters(rows, ["series"], params.parse(TWO_HOURS), "value", "time", chunk=DAY)
    return rounded(found.withColumn("coord", F.col("coord").cast("double")), "value", "value_std", "value_goodfraction")


# --- quality checks -----------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_quantity < 5 THEN 2 WHEN l_quantity > 45 THEN 4 ELSE 0 END)::INTEGER AS qc_quantity,
  (CASE WHEN l_discount = 0.0 THEN 1 WHEN l_discount < 0.02 THEN 2 WHEN l_discount > 0.08 THEN 4 ELSE 0 END)::INTEGER AS qc_discount FROM lineitem""")
def qc_limits(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", qc.limits(F.col("l_quantity"), low=5, high=45).alias("qc_quantity"), qc.limits(F.col("l_discount"), missing=[0.0], low=0.02, high=0.08).alias("qc_discount"))


@query(f"WITH {OBS} SELECT event_id, (qc | CASE WHEN value IS NULL THEN 1 ELSE 0 END)::INTEGER AS qc FROM obs")
def qc_missing(spark, sf_dir):
    rows = observations(spark, sf_dir, "event_id")
    return rows.select("event_id", bits.either(F.col("qc"), qc.limits(F.col("value"))).alias("qc"))


@query(f"""WITH {OBS}, p AS (SELECT *, lag(value) OVER w AS pv, lag(qc) OVER w AS pq FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY coord, event_id))
SELECT event_id, (qc | CASE WHEN qc & 7 = 0 AND pq & 7 = 0 AND abs(value - pv) > 15 THEN 8 ELSE 0 END)::INTEGER AS qc FROM p""")
def qc_delta(spark, sf_dir):
    rows = observations(spark, sf_dir, "event_id", "user_id")
    return qc.delta(rows, ["user_id"], ["coord", "event_id"], "value", "qc", 15.0, DAY).select("event_id", "qc")


@query(f"""WITH {OBS}, p AS (SELECT event_id, coord - lag(coord) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM obs)
SELECT event_id, (CASE WHEN step <= 0 THEN 1 WHEN step < {HOUR} THEN 2 WHEN step > {DAY} THEN 4 ELSE 0 END)::INTEGER AS qc FROM p""")
def qc_time(spark, sf_dir):
    rows = observations(spark, sf_dir, "event_id", "user_id").withColumn("qc", F.lit(0))
    return qc.time_steps(rows, ["user_id"], ["event_id"], "coord", "qc", 1000, least=HOUR, most=DAY).select("event_id", "qc")


@query(f"WITH {OBS} SELECT event_id, (CASE WHEN qc & 1 <> 0 THEN 1 WHEN qc <> 0 THEN 2 ELSE 0 END)::INTEGER AS rolled, ((CASE WHEN qc & 1 <> 0 THEN 16 WHEN qc <> 0 THEN 32 ELSE 0 END) | (event_id % 3))::BIGINT AS onto FROM obs")
def qc_rollup(spark, sf_dir):
    rows = observations(spark, sf_dir, "event_id")
    return rows.select("event_id", bits.roll_up(F.col("qc"), 1).alias("rolled"), bits.roll_up(F.col("qc"), 1, 16, 32, onto=F.col("event_id") % 3).alias("onto"))


@query("SELECT event_id, (event_id % 64 & 10) <> 0 AS bad, (CASE WHEN event_id % 64 IN (3, 5, 9) THEN 1 WHEN event_id % 64 <> 0 THEN 2 ELSE 0 END)::INTEGER AS mapped, (event_id % 64 | CASE WHEN value > 20 THEN 64 ELSE 0 END)::BIGINT AS recorded FROM events")
def qc_masks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("code", F.col("event_id") % 64)
    mask = bits.mask_for({1: "Indeterminate", 2: "Bad", 4: "bad"})
    return e.select("event_id", bits.any_of(F.col("code"), mask).alias("bad"), bits.map_codes(F.col("code"), [3, 5, 9]).alias("mapped"), bits.record(F.col("code"), 7, F.col("value") > 20).alias("recorded"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -9999.0 WHEN event_id % 11 = 0 THEN -9999.0 ELSE value END AS value FROM events")
def nan_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return e.select("event_id", qc.nan_to_missing(value, -9999.0).alias("value"))


_WINDOW = 6 * HOUR


def _outlier_sql(centre: str, spread: str, bad: str, ind: str) -> str:
    return f"""WITH {OBS}, m AS (SELECT *, CASE WHEN qc & 1 = 0 THEN value END AS x FROM obs),
w AS (SELECT event_id, qc, x, list_sort(list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY series ORDER BY coord RANGE BETWEEN {_WINDOW // 2} PRECEDING AND {_WINDOW // 2} FOLLOWING)) AS l FROM m),
c AS (SELECT *, {centre} AS c FROM w), s AS (SELECT *, {spread} AS s FROM c)
SELECT event_id, (qc | CASE WHEN x IS NOT NULL AND len(l) < 5 THEN 64 ELSE 0 END | CASE WHEN x IS NOT NULL AND len(l) >= 5 AND abs(x - c) > s * {bad} THEN 16 ELSE 0 END
  | CASE WHEN x IS NOT NULL AND len(l) >= 5 AND abs(x - c) > s * {ind} THEN 32 ELSE 0 END)::INTEGER AS qc FROM s"""


_OUTLIERS = {
    "iqd": ("list_median(l)", "list_median(l[len(l) - len(l) // 2 + 1:]) - list_median(l[:len(l) // 2])", "1.5", "1.1"),
    "mean_dev": ("list_avg(l)", "1", "18.5137", "14.2537"),
    "mean_mad": ("list_avg(l)", "list_avg([abs(v - c) FOR v IN l])", "2.3", "1.7"),
    "median_mad": ("list_median(l)", "list_median([abs(v - c) FOR v IN l])", "2.7", "1.9"),
    "std": ("list_avg(l)", "list_stddev_pop(l)", "2.1", "1.6"),
}


def _add_outliers(method: str) -> None:
    bad, ind = map(float, _OUTLIERS[method][2:])

    def run(spark, sf_dir):
        rows = observations(spark, sf_dir, "event_id")
        return outliers.flag_outliers(rows, ["series"], "coord", "value", "qc", method, _WINDOW, min_points=5, bad_threshold=bad, ind_threshold=ind).select("event_id", "qc")

    run.__name__ = f"outlier_{method}"
    query(_outlier_sql(*_OUTLIERS[method]))(run)


for _method in outliers.METHODS:
    _add_outliers(_method)


@query(f"""WITH {OBS}, dqr AS (SELECT series, k AS report, k % 3 AS code, {START} + k * {DAY} * 2 AS s, {START} + k * {DAY} * 2 + (k + 1) * {HOUR} AS e FROM (SELECT DISTINCT series FROM obs), (SELECT unnest(generate_series(0, 14)) AS k))
SELECT event_id, report, code FROM obs JOIN dqr USING (series) WHERE coord BETWEEN s AND e""")
def dqr_join(spark, sf_dir):
    rows = observations(spark, sf_dir, "event_id")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long")))
    reports = rows.select("series").distinct().select("series", k.alias("report"))
    reports = reports.select("series", "report", (F.col("report") % 3).alias("code"), (F.lit(START) + F.col("report") * (2 * DAY)).alias("start"), (F.lit(START) + F.col("report") * (2 * DAY) + (F.col("report") + 1) * HOUR).alias("end"))
    return qc.with_reports(rows, reports, ["series"], "coord", DAY).select("event_id", "report", "code")


@query(f"WITH {OBS} SELECT event_id, (az >= 300 OR az <= 30) AND el BETWEEN 10 AND 40 OR az BETWEEN 100 AND 120 AND el BETWEEN 0 AND 90 AS shaded FROM (SELECT event_id, event_id * 7 % 360 AS az, event_id * 3 % 90 AS el FROM obs)")
def qc_shading(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", qc.shaded(F.col("event_id") * 7 % 360, F.col("event_id") * 3 % 90, [qc.Shade(300, 30, 10, 40), qc.Shade(100, 120, 0, 90)]).alias("shaded"))


# --- overlap and merging ------------------------------------------------------------------------------------------------------

_TWICE = """twice AS (SELECT event_type AS series, epoch_us(ts) AS coord, value, event_id AS arrival FROM events UNION ALL
  SELECT event_type, epoch_us(ts) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, value + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END, event_id + 20 FROM events WHERE event_id % 5 = 0)"""


def _twice(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("coord"), "value", F.col("event_id").alias("arrival"))
    again = e.where("arrival % 5 = 0")
    again = again.select("series", (F.col("coord") + F.when(F.col("arrival") % 3 == 0, 1).otherwise(0)).alias("coord"), (F.col("value") + F.when(F.col("arrival") % 4 == 0, 1).otherwise(0)).alias("value"), (F.col("arrival") + 20).alias("arrival"))
    return e.unionByName(again)


_MARKS = f"""{_TWICE}, ordered AS (SELECT *, arrival * 2 + (CASE WHEN row_number() OVER (PARTITION BY series, arrival ORDER BY coord) > 1 THEN 0 ELSE 1 END) AS a FROM twice),
late AS (SELECT *, coalesce(coord <= max(coord) OVER (PARTITION BY series ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late,
  row_number() OVER (PARTITION BY series, coord ORDER BY a) AS k, row_number() OVER (PARTITION BY series, coord, value ORDER BY a) AS d FROM ordered),
marks AS (SELECT *, CASE WHEN NOT late THEN 'none' WHEN d > 1 THEN 'duplicate' WHEN k > 1 THEN 'conflict' ELSE 'shift' END AS overlap FROM late)"""


def _ordered_twice(spark, sf_dir) -> DataFrame:
    from pyspark.sql.window import Window

    rows = _twice(spark, sf_dir)
    second = F.row_number().over(Window.partitionBy("series", "arrival").orderBy("coord")) > 1
    return rows.withColumn("a", F.col("arrival") * 2 + F.when(second, 0).otherwise(1))


@query(f"WITH {_MARKS} SELECT series, coord, value, a, overlap FROM marks")
def overlap_marks(spark, sf_dir):
    return overlap.mark_overlaps(_ordered_twice(spark, sf_dir), ["series"], "coord", "a", ["value"], 2000).select("series", "coord", "value", "a", "overlap")


@query(f"WITH {_MARKS} SELECT series, coord, value FROM marks WHERE overlap = 'none'")
def dedup_samples(spark, sf_dir):
    allow = {"duplicate", "conflict", "shift"}
    return overlap.drop_overlaps(_ordered_twice(spark, sf_dir), ["series"], "coord", "a", ["value"], 2000, allow=allow).select("series", "coord", "value")


@query(f"WITH {_TWICE} SELECT series, coord, value FROM twice t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.series AND epoch_us(e.ts) = t.coord AND e.value = t.value)")
def stored_antijoin(spark, sf_dir):
    stored = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("coord"), "value")
    return overlap.not_stored(_twice(spark, sf_dir), stored, ["series", "coord", "value"]).select("series", "coord", "value")


_OBSERVED = f"""o AS (SELECT event_type AS series, epoch_us(ts) AS coord, value, CASE WHEN event_id % 9 = 0 THEN (epoch_us(ts) - {START}) // {DAY} - 1 ELSE (epoch_us(ts) - {START}) // {DAY} END AS obs_id FROM events),
c AS (SELECT *, CASE WHEN obs_id % 4 = 0 THEN NULL ELSE obs_id * 7 % 5 END AS created FROM o)"""


@query(f"""WITH {_OBSERVED}, e AS (SELECT series, obs_id, min(coord) AS s, max(coord) AS e, count(*) AS n, max(created) AS c FROM c GROUP BY 1, 2),
p AS (SELECT *, lag(e) OVER w AS pe, lag(n) OVER w AS pn, lag(c) OVER w AS pc, lead(s) OVER w AS qs, lead(n) OVER w AS qn, lead(c) OVER w AS qc FROM e WINDOW w AS (PARTITION BY series ORDER BY s, e, obs_id)),
k AS (SELECT series, obs_id FROM p WHERE NOT coalesce(s <= pe AND NOT (CASE WHEN pc IS NULL AND c IS NULL THEN n >= pn WHEN pc IS NULL THEN true WHEN c IS NULL THEN false WHEN c > pc THEN n >= 0.75 * pn ELSE NOT pn >= 0.75 * n END), false)
  AND NOT coalesce(qs <= e AND (CASE WHEN c IS NULL AND qc IS NULL THEN qn >= n WHEN c IS NULL THEN true WHEN qc IS NULL THEN false WHEN qc > c THEN qn >= 0.75 * n ELSE NOT n >= 0.75 * qn END), false))
SELECT series, obs_id, coord, value FROM c SEMI JOIN k USING (series, obs_id)""")
def merge_obs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("coord"), "value", "event_id")
    day = F.floor((F.col("coord") - START) / DAY)
    rows = e.withColumn("obs_id", F.when(F.col("event_id") % 9 == 0, day - 1).otherwise(day)).drop("event_id")
    rows = rows.withColumn("created", F.when(F.col("obs_id") % 4 != 0, F.col("obs_id") * 7 % 5))
    return overlap.merge_observations(rows, ["series"], "coord").select("series", "obs_id", "coord", "value")


# --- retrieval ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT user_id, epoch_us(ts) // {HOUR} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
r AS (SELECT DISTINCT user_id, epoch_us(ts) // {HOUR} + event_id % 3 - 1 AS ref FROM events)
SELECT r.user_id, ref, coalesce(max(idx) FILTER (t < ref), -1) AS lt, coalesce(max(idx) FILTER (t <= ref), -1) AS lteq, coalesce(min(idx) FILTER (t > ref), -1) AS gt,
  coalesce(min(idx) FILTER (t >= ref), -1) AS gteq, coalesce(min(idx) FILTER (t = ref), -1) AS eq FROM r JOIN t USING (user_id) GROUP BY 1, 2""")
def find_time_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"hour": F.floor(times.micros(F.col("ts")) / HOUR), "us": times.micros(F.col("ts"))})
    index = chunks.running_sum(e.select("user_id", "hour", "us", "event_id"), ["user_id"], ["us", "event_id"], F.lit(1), "k", DAY)
    index = scratch.written(index.select("user_id", F.col("hour").alias("t"), (F.col("k") - 1).alias("idx")))
    refs = e.select("user_id", (F.col("hour") + F.col("event_id") % 3 - 1).alias("ref"))
    return retrieve.find_index(index, refs, ["user_id"], 24)


@query("SELECT event_type AS series, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS \"end\", count(*) AS n FROM events GROUP BY 1")
def time_range(spark, sf_dir):
    return retrieve.time_range(observations(spark, sf_dir), ["series"], "coord")


@query(f"""WITH {OBS} SELECT series, 'prior' AS kind, max(coord) AS coord FROM obs WHERE coord < {START + 5 * DAY} GROUP BY 1
UNION ALL SELECT series, 'next', min(coord) FROM obs WHERE coord > {START + 5 * DAY} GROUP BY 1 UNION ALL SELECT series, 'between', coord FROM obs WHERE coord BETWEEN {START + 5 * DAY} AND {START + 6 * DAY}""")
def fetch_times(spark, sf_dir):
    rows, at = observations(spark, sf_dir).select("series", "coord"), START + 5 * DAY
    parts = {"prior": (None, at), "next": (at, None), "between": (at, at + DAY)}
    found = [retrieve.samples_between(rows, "coord", a, b, ["series"]).select("series", F.lit(k).alias("kind"), "coord") for k, (a, b) in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {OBS}, a AS (SELECT series, coord, CASE WHEN series NOT IN ('view', 'click') THEN value END AS value, 0 AS source FROM obs),
b AS (SELECT series, coord, value * 2 AS value, 1 AS source FROM obs WHERE series <> 'click'), c AS (SELECT series, coord, value * 3 AS value, 2 AS source FROM obs),
u AS (FROM a UNION ALL FROM b UNION ALL FROM c), f AS (SELECT series, min(source) AS source FROM u WHERE value IS NOT NULL GROUP BY 1)
SELECT series, coord, round(value, 6) AS value, source FROM u SEMI JOIN f USING (series, source)""")
def retrieve_prioritised(spark, sf_dir):
    rows = observations(spark, sf_dir).select("series", "coord", "value")
    rows = retrieve.in_interval(rows, "coord", *_days(rows, "coord"))
    first = rows.withColumn("value", F.when(~F.col("series").isin("view", "click"), F.col("value")))
    second = rows.where("series <> 'click'").withColumn("value", F.col("value") * 2)
    return rounded(retrieve.prioritised([first, second, rows.withColumn("value", F.col("value") * 3)], ["series"], "value"), "value").select("series", "coord", "value", "source")


@query("""WITH a AS (SELECT event_type AS series, epoch_us(ts) AS t, CASE WHEN event_type <> 'view' THEN value * 9 / 5 + 32 END AS temperature, event_id % 4 AS qc_temperature, 'best' AS source FROM events WHERE event_type <> 'click'),
b AS (SELECT event_type AS series, epoch_us(ts) AS t, value AS temperature, 0 AS qc_temperature, 'other' AS source FROM events),
f AS (SELECT DISTINCT series FROM a WHERE temperature IS NOT NULL), u AS (SELECT * FROM a SEMI JOIN f USING (series) UNION ALL SELECT * FROM b ANTI JOIN f USING (series))
SELECT series, t, round(temperature, 6) AS temperature, qc_temperature::INTEGER AS qc_temperature, NULL::SMALLINT AS humidity, 1::INTEGER AS qc_humidity, source FROM u""")
def retriever_groups(spark, sf_dir):
    """A declared group of two sources with other names and units; one of them lacks a series, and values of another."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("t"), "event_id", "value")

    def best(s):
        rows = e.where("series <> 'click'").select("series", "t", F.when(F.col("series") != "view", F.col("value")).alias("temp_c"), (F.col("event_id") % 4).alias("qc_temp_c"))
        return metadata.with_attributes(rows, "temp_c", units="degC")

    def other(s):
        return metadata.with_attributes(e.select("series", "t", F.col("value").alias("temp")), "temp", units="degF")

    wanted = [retriever.Wanted("temperature", ["temp_k", "temp_c", "temp"], "degF", "double"), retriever.Wanted("humidity", ["rh"], "%", "short", required=False)]
    group = retriever.Group("met", [("none", lambda s: e), ("best", best), ("other", other)], wanted, ["series"])
    return rounded(retriever.retrieve_group(spark, group, *_days(e, "t")), "temperature")


@query("SELECT event_id, value AS temperature FROM events")
def alternate_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return retrieve.first_present(e, ["temp", "value", "event_id"], "temperature").select("event_id", "temperature")


@query(f"""WITH {OBS}, p AS (SELECT DISTINCT series, {START} + k * 3 * {DAY} AS since, (k * 10 + length(series))::BIGINT AS width FROM (SELECT DISTINCT series FROM obs), (SELECT unnest(generate_series(0, 9)) AS k))
SELECT event_id, width FROM obs ASOF LEFT JOIN p ON obs.series = p.series AND obs.coord >= p.since""")
def properties_as_of(spark, sf_dir):
    rows = observations(spark, sf_dir, "event_id")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))
    known = rows.select("series").distinct().select("series", k.alias("k")).select("series", (F.lit(START) + F.col("k") * (3 * DAY)).alias("since"), (F.col("k") * 10 + F.length("series")).alias("width"))
    return retrieve.as_of(rows, known, ["series"], "coord", "since", ["width"], DAY).select("event_id", "width")


@query("""WITH p AS (SELECT date_trunc('day', ts) AS day, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'view') AS c, count(*) FILTER (event_type = 'click') AS d FROM events GROUP BY 1)
SELECT day, 'view' AS station, round(a, 6) AS mean, c AS n FROM p UNION ALL SELECT day, 'click', round(b, 6), d FROM p""")
def station_view(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    cells = [f(F.when(F.col("event_type") == s, F.col("value"))).alias(f"{n}@{s}") for s in ("view", "click") for n, f in (("mean", F.avg), ("n", F.count))]
    return rounded(mapping.station_view(e.groupBy("day").agg(*cells), ["day"]), "mean")


# --- units, types, times, text ------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 9 / 5 + 32, 6) AS fahrenheit, round(l_quantity + 273.15, 6) AS kelvin, round(l_quantity / 1000, 6) AS kilometres, round(l_extendedprice / 1852 * 3600, 6) AS knots,
  CASE WHEN l_quantity = 7 THEN 7 ELSE round(l_quantity * 100, 6) END AS pascals, round(l_quantity * 9 / 5, 6) AS fahrenheit_delta,
  round(l_quantity * 3600, 6) AS rain, round(l_quantity / 10, 6) AS flux, round(l_quantity * 1000, 6) AS mixing, round(l_quantity * 1000000, 6) AS number, round(l_quantity * 3.6, 6) AS energy FROM lineitem""")
def unit_convert(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(units.convert(q, "degC", "degF"), 6).alias("fahrenheit"), F.round(units.convert(q, "celsius", "kelvin"), 6).alias("kelvin"), F.round(units.convert(q, "m", "km"), 6).alias("kilometres"),
        F.round(units.convert(p, "m/s", "knot"), 6).alias("knots"), F.round(units.convert(q, "hPa", "Pa", missing=[7.0]), 6).alias("pascals"), F.round(units.convert_delta(q, "degC", "degF"), 6).alias("fahrenheit_delta"),
        F.round(units.convert(q, "kg m-2 s-1", "kg/(m^2 hr)"), 6).alias("rain"), F.round(units.convert(q, "mW/cm2", "kW m**-2") * 10, 6).alias("flux"), F.round(units.convert(q, "kg kg-1", "g/kg"), 6).alias("mixing"),
        F.round(units.convert(q, "1/cm3", "m-3"), 6).alias("number"), F.round(units.convert(q, "kW.h", "MJ"), 6).alias("energy"),
    )


@query("""WITH v AS (SELECT c_custkey, (c_acctbal * 2)::BIGINT / 4.0 AS x FROM customer), h AS (SELECT *, CASE WHEN x < 0 THEN -floor(abs(x) + 0.5) ELSE floor(abs(x) + 0.5) END AS r FROM v)
SELECT c_custkey, r::INTEGER AS whole, (CASE WHEN r < -128 OR r > 127 THEN -127 ELSE r END)::TINYINT AS small, (CASE WHEN r < -32768 OR r > 32767 THEN -1 ELSE r END)::SMALLINT AS middle FROM h""")
def cast_round_half_away(spark, sf_dir):
    x = F.round(F.col("c_acctbal") * 2).cast("long") / 4.0
    return table(spark, sf_dir, "customer").select("c_custkey", units.cast_rounded(x, "int").alias("whole"), units.cast_rounded(x, "byte").alias("small"), units.cast_rounded(x, "short", outside=-1).alias("middle"))


@query("""SELECT event_id, epoch_us(ts) // 3600000000 * 3600000000 AS hourly, (epoch_us(ts) // 86400000000) * 86400000000 + ((epoch_us(ts) % 86400000000 // 3600000000 - 2) // 6 * 6 + CASE WHEN epoch_us(ts) % 86400000000 // 3600000000 < 2 THEN -6 ELSE 0 END + 2) * 3600000000 AS six_hours,
  epoch_us(date_trunc('day', ts)) AS daily, epoch_us(date_trunc('year', ts)) + (dayofyear(ts) - 1) // 7 * 7 * 86400000000 AS weekly, epoch_us(date_trunc('month', ts)) AS monthly, epoch_us(date_trunc('year', ts)) AS yearly,
  epoch_us(date_trunc('day', ts - INTERVAL 7 HOUR)) + 7 * 3600000000 AS local_day FROM events""")
def split_keys(spark, sf_dir):
    t = times.micros(F.col("ts"))
    modes = {"hourly": ("hours",), "six_hours": ("hours", 6, 2), "daily": ("days",), "weekly": ("days", 7), "monthly": ("months",), "yearly": ("years",), "local_day": ("days", 1, 0, -7.0)}
    return table(spark, sf_dir, "events").select("event_id", *[times.split_key(t, *m).alias(k) for k, m in modes.items()])


@query("""SELECT event_id, ts AS a, date_trunc('day', ts) AS b, date_trunc('minute', ts) AS c, date_trunc('second', ts) AS d, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS first FROM events""")
def retime_parse(spark, sf_dir):
    ts = F.col("ts")
    said = {"a": ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "b": (r"day %j of %Y", "'day 'D' of 'yyyy"), "c": (r"(at|on) %d %b %y %H:%M", "'on 'dd MMM yy HH:mm"), "d": (r"\.%0Y%0m%0d\.%0H%0M%0S\.", "'x.'yyyyMMdd.HHmmss'.cdf'")}
    e = table(spark, sf_dir, "events").select("event_id", ts, *[F.date_format(ts, f).alias(k) for k, (_, f) in said.items()])
    mixed = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy.MM.dd")).otherwise(F.date_format(ts, "yyyyMMdd HHmmss"))
    found = e.select("event_id", *[times.TimePattern(p).parse(F.col(k)).alias(k) for k, (p, _) in said.items()], times.first_match([r"%Y\.%m\.%d", "%0Y%0m%0d %0H%0M%0S"], mixed).alias("first"))
    return found.select("event_id", *[times.from_micros(F.col(c)).alias(c) for c in (*said, "first")])


@query("""SELECT event_id, 'seconds since ' || strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') || ' 0:00' AS units, epoch(date_trunc('day', ts))::BIGINT AS base, epoch_us(ts) AS t, strftime(ts, '%Y%m%d.%H%M%S') AS stamp, epoch(date_trunc('day', ts))::BIGINT AS midnight FROM events""")
def time_offsets(spark, sf_dir):
    t = times.micros(F.col("ts"))
    base = times.midnight(F.floor(t / 1_000_000))
    e = table(spark, sf_dir, "events").select("event_id", "ts", base.alias("base0"), ((t - base * 1_000_000) / 1_000_000).alias("offset"))
    e = e.withColumn("units", times.units_text(F.col("base0")))
    return e.select("event_id", "units", times.base_of(F.col("units")).alias("base"), times.offset_to_micros(F.col("base0"), F.col("offset")).alias("t"), times.stamp(F.col("ts")).alias("stamp"), times.midnight(F.floor(times.micros(F.col("ts")) / 1_000_000)).alias("midnight"))


@query("""SELECT o_orderkey, (make_date(y, 1, 1) + (o_orderkey % 365)::INTEGER)::VARCHAR AS day, day(last_day(o_orderdate))::INTEGER AS month_days, (CASE WHEN y2 < 90 THEN y2 + 2000 WHEN y2 < 1990 THEN y2 + 1900 ELSE y2 END)::BIGINT AS full_year,
  (CASE WHEN lon > 0 AND lon - 360 < -180 THEN trunc((lon - 360) / 15.0) + 24 WHEN lon > 0 THEN trunc((lon - 360) / 15.0) WHEN lon < -180 THEN trunc(lon / 15.0) + 24 ELSE trunc(lon / 15.0) END)::INTEGER AS zone
FROM (SELECT *, year(o_orderdate)::BIGINT AS y, o_orderkey % 100 AS y2, o_orderkey % 360 - 180 AS lon FROM orders)""")
def calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    return o.select(
        "o_orderkey", times.month_and_day(y, F.col("o_orderkey") % 365 + 1).cast("string").alias("day"), times.days_in_month(y, F.month("o_orderdate")).alias("month_days"), times.four_digit_year(F.col("o_orderkey") % 100).alias("full_year"),
        times.timezone_offset(F.col("o_orderkey") % 360 - 180).cast("int").alias("zone"),
    )


@query("""SELECT event_id, (event_id % 10)::INTEGER AS w0, -999::INTEGER AS w1, (event_id // 10)::INTEGER AS w2, value AS d0, NULL::DOUBLE AS d1, 2.5::DOUBLE AS d2, (event_id % 10) || ', -999, ' || (event_id // 10) AS back FROM events""")
def string_to_array(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.concat_ws(", ", F.col("event_id") % 10, F.lit("oops"), F.floor(F.col("event_id") / 10))
    v = F.concat_ws(",", F.col("value"), F.lit("-"), F.lit("2.5"))
    return e.select("event_id", text.to_array(n, "int", fill=-999).alias("whole"), text.to_array(v, "double").alias("doubles")).select(
        "event_id", *[F.col("whole")[k].alias(f"w{k}") for k in range(3)], *[F.col("doubles")[k].alias(f"d{k}") for k in range(3)], text.from_array(F.col("whole")).alias("back")
    )


@query("""WITH p AS (SELECT vec_id, embedding AS a, [CASE WHEN i = vec_id % 70 THEN x + 0.5 ELSE x + 0.001 END FOR x, i IN embedding] AS b FROM embeddings)
SELECT vec_id, (CASE WHEN vec_id % 70 BETWEEN 1 AND 64 THEN vec_id % 70 - 1 ELSE -1 END)::BIGINT AS at, vec_id % 70 BETWEEN 1 AND 64 AS differs FROM p""")
def compare_arrays(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    b = F.transform("embedding", lambda x, i: x + F.when(i + 1 == F.col("vec_id") % 70, 0.5).otherwise(0.001))
    return v.select("vec_id", text.first_difference(F.col("embedding"), b, 0.1).alias("at"), text.differ(F.col("embedding"), b, 0.1).alias("differs"))


@query("""WITH n AS (SELECT DISTINCT 'f' || (event_id % 40) || '.v' || (event_id % 12) || '.dat' AS name FROM events)
SELECT name, row_number() OVER (ORDER BY split_part(split_part(name, 'f', 2), '.', 1)::BIGINT, split_part(split_part(name, 'v', 2), '.', 1)::BIGINT, name) AS place FROM n""")
def numeric_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id") % 40, F.lit(".v"), F.col("event_id") % 12, F.lit(".dat")).alias("name")).distinct()
    return chunks.numbered(e, text.numeric_keys(F.col("name")), "place")


@query("""WITH n AS (SELECT DISTINCT event_id % 40 AS f, event_id % 12 AS v FROM events)
SELECT CASE WHEN f % 5 = 0 THEN 'f' || f || '.dat' ELSE 'f' || f || '.v' || max(v) || '.dat' END AS name FROM n GROUP BY f""")
def versioned_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("f"), (F.col("event_id") % 12).alias("v")).distinct()
    names = e.select(F.concat(F.lit("f"), "f", F.lit(".v"), "v", F.lit(".dat")).alias("name"))
    names = names.unionByName(e.where("f % 5 = 0").select(F.concat(F.lit("f"), "f", F.lit(".dat")).alias("name")).distinct())
    return store.highest_versions(names)


@query("""SELECT event_id, 3 AS delimiters, 1::INTEGER AS major, (event_id % 10)::INTEGER AS minor, (event_id % 7)::INTEGER AS micro, (CASE WHEN event_type LIKE 'v%' THEN 0 WHEN event_type LIKE '%k' THEN 1 ELSE -1 END)::INTEGER AS pattern FROM events""")
def text_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit('a,"b,'), F.col("event_type"), F.lit('",'), F.col("event_id"), F.lit(",c"))
    parts = text.version_parts(F.concat(F.lit("1."), F.col("event_id") % 10, F.lit("."), F.col("event_id") % 7))
    return e.select("event_id", text.count_delimiters(line).alias("delimiters"), *[parts[p].alias(p) for p in ("major", "minor", "micro")], text.first_pattern(F.col("event_type"), ["^v", "k$"]).alias("pattern"))


# --- ingest and output --------------------------------------------------------------------------------------------------------

CONF = """
DELIMITER: comma
HEADER: DATE, TIME, RECORD, V1, V2
TIME_COLUMNS:
  DATE: %Y-%m-%d
  TIME: %H:%M:%S
FIELD_MAP:
  temperature: V1, degC, -99
  record: RECORD
  state: V2, , NaN, bad
"""

HEADED_CONF = """
FILE_NAME_PATTERNS: [ab]\\d[.]csv
TIME_COLUMNS:
  Date: %Y-%m-%d
  Time: %H:%M:%S
FIELD_MAP:
  temperature: Temp, degC
  record: Record
"""


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'cells' WHEN event_id % 19 = 0 THEN 'time' END AS rejected, CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS t,
  CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS temperature, CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN NULL ELSE event_id::DOUBLE END AS record,
  CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 OR event_id % 3 < 2 THEN NULL ELSE 2.0 END AS state FROM events""")
def csv_ingest_records(spark, sf_dir):
    conf = csv_ingest.parse_conf(CONF)
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 19 == 0, F.lit("2024-13-01")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    v1 = F.when(F.col("event_id") % 7 == 0, F.lit("-99")).otherwise(F.col("value").cast("string"))
    v2 = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit("NaN")).otherwise(F.lit('"2.0"'))
    line = F.concat_ws(",", day, F.date_format("ts", "HH:mm:ss"), F.col("event_id").cast("string"), v1, v2)
    line = F.when(F.col("event_id") % 13 == 0, F.concat(line, F.lit(",more"))).otherwise(line)
    found = csv_ingest.records(e.select("event_id", line.alias("line")), conf)
    return found.select("event_id", "rejected", F.when(F.col("rejected").isNull(), F.col("t")).alias("t"), *[F.when(F.col("rejected").isNull(), csv_ingest.number(F.col("cells")[f.column], f)).alias(f.name) for f in conf.fields])


@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) AS t, value AS temperature, CASE WHEN event_id % 5 = 0 THEN 'say "a", b' ELSE 'x' END AS remark FROM events""")
def csv_header_lines(spark, sf_dir):
    """Files of two layouts, whose own header lines name their columns, after a line that is no record."""
    conf = csv_ingest.parse_conf(HEADED_CONF)
    e = table(spark, sf_dir, "events").withColumn("remark", F.when(F.col("event_id") % 5 == 0, F.lit('"say ""a"", b"')).otherwise(F.lit("x")))
    a = e.where("event_id % 2 = 0").select(F.lit("/in/a1.csv").alias("file"), F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), "value", "event_id", "remark").alias("line"))
    b = e.where("event_id % 2 = 1").select(F.lit("/in/b1.csv").alias("file"), F.concat_ws(",", "remark", "event_id", "value", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")).alias("line"))
    heads = [("/in/a1.csv", "instrument 7"), ("/in/a1.csv", "Date,Time,Temp,Record,Remark"), ("/in/b1.csv", "instrument 8"), ("/in/b1.csv", "Remark,Record,Temp,Date,Time")]
    lines = a.unionByName(b).unionByName(spark.createDataFrame(heads, "file string, line string"))
    found = csv_ingest.records(lines, conf, file="file").where("rejected is null")
    return found.select(F.col("cells")["Record"].cast("long").alias("event_id"), "t", F.col("cells")["Temp"].cast("double").alias("temperature"), F.col("cells")["Remark"].alias("remark"))


@query(f"""WITH {OBS}, v AS (SELECT *, CASE WHEN value IS NULL THEN -9999 ELSE value END AS x FROM obs), f AS (SELECT *, x = -9999 OR x < 2 OR x > 95 AS bad FROM v),
p AS (SELECT *, lag(x) OVER w AS px, NOT bad AND NOT lag(bad) OVER w AS fine FROM f WINDOW w AS (PARTITION BY series ORDER BY coord, event_id))
SELECT event_id, (CASE WHEN x = -9999 THEN 1 ELSE CASE WHEN x < 2 THEN 2 ELSE 0 END | CASE WHEN x > 95 THEN 4 ELSE 0 END | CASE WHEN fine AND abs(x - px) > 40 THEN 8 ELSE 0 END
  | CASE WHEN x > 60 THEN 256 ELSE 0 END | CASE WHEN fine AND abs(x - px) > 20 THEN 512 ELSE 0 END END)::INTEGER AS qc_value FROM p""")
def standard_checks(spark, sf_dir):
    """All tests that a variable's attributes ask for."""
    rows = observations(spark, sf_dir, "event_id").drop("qc").withColumn("value", F.coalesce("value", F.lit(-9999.0)))
    rows = metadata.with_attributes(rows, "value", missing_value=-9999.0, valid_min=2.0, valid_max=95.0, valid_delta=40.0, warn_max=60.0, warn_delta=20.0)
    return qc.standard_checks(rows, ["value"], ["series"], ["coord", "event_id"], DAY).select("event_id", "qc_value")


@query("""SELECT epoch_us(ts) AS t, round(CASE WHEN event_id % 17 = 0 THEN -9999 ELSE value * 9 / 5 + 32 END, 6) AS temperature, (CASE WHEN event_id % 23 = 0 THEN 1 WHEN event_id % 29 = 0 THEN 2 ELSE 0 END)::INTEGER AS qc_temperature,
  (CASE WHEN event_id % 17 = 0 THEN -1 ELSE floor(value + 0.5) END)::SMALLINT AS count, 0::INTEGER AS qc_count, NULL::DOUBLE AS absent, 1::INTEGER AS qc_absent, epoch_us(ts) - 11500000 AS lo, epoch_us(ts) AS hi FROM events""")
def map_outputs(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumnsRenamed({"coord": "t", "qc": "qc_value"}).withColumn("whole", F.col("value"))
    targets = [mapping.Target("temperature", "value", "double", "degC", "degF", -9999.0, roll_up_mask=1), mapping.Target("count", "whole", "short", missing=-1), mapping.Target("absent", "nothing", "double")]
    out = mapping.with_bounds(mapping.map_outputs(rows, ["t"], targets), "t", -11_500_000, 0)
    out = out.select("*", "t_bounds.lo", "t_bounds.hi").drop("t_bounds")
    return rounded(out, "temperature")


@query(f"WITH {OBS} SELECT event_id, CASE WHEN coord < {START + DAY} THEN 'early' WHEN coord > {START + 25 * DAY} THEN 'future' WHEN coord <= {START + 3 * DAY} THEN 'old' END AS invalid FROM obs")
def valid_times(spark, sf_dir):
    return store.valid_times(observations(spark, sf_dir, "event_id"), "coord", START + DAY, START + 25 * DAY, START + 3 * DAY).select("event_id", "invalid")


# --- datasets, processes and streams ------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -9999 ELSE round(value * 9 / 5 + 32, 6) END AS value, (CASE WHEN value > 30 THEN 4 ELSE 0 END | CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)::INTEGER AS qc_value,
  (event_id % 17 = 0) AS missing, 41.0::DOUBLE AS valid_min, 5::INTEGER AS mask, 'degF' AS units FROM events""")
def dataset_variables(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 17 == 0, -9999.0).otherwise(F.col("value")).alias("value"), F.col("value").alias("plain"))
    rows = metadata.with_attributes(rows, "value", units="degC", missing_value=-9999.0, valid_min=5.0)
    rows = datasets.record_qc_results(rows, "value", 3, F.col("plain") > 30, description="above 30")
    rows = datasets.record_qc_results(rows, "value", 1, metadata.missing_mask(rows, "value"))
    rows = datasets.convert_units(rows, "degC", "degF")
    held = metadata.attributes(rows, "value")
    extra = [metadata.missing_mask(rows, "value").alias("missing"), F.lit(held["valid_min"]).alias("valid_min"), F.lit(metadata.bad_mask(rows, "value")).alias("mask"), F.lit(held["units"]).alias("units")]
    return rounded(rows.select("event_id", "value", "qc_value", *extra), "value")


@query("""SELECT epoch_us(ts) AS t, event_id, round(value * 3.6, 6) AS speed, (CASE WHEN value > 20 THEN 2 ELSE 0 END)::INTEGER AS qc_speed FROM events""")
def process_run(spark, sf_dir):
    """Intervals of ten days of a process over the table's whole days, stored by month and read again: several intervals share a split."""

    class Speeds(process.Process):
        def transform_hook(self, begin, end):
            self.transformed = {"speeds": process.add_quality(self.inputs["winds"], "value", (2, F.col("value") > 20))}

    def source(s):
        return table(s, sf_dir, "events").select(times.micros(F.col("ts")).alias("t"), "event_id", "value")

    path = scratch.folder(spark, "speeds")
    out = process.Output(path, ["t", "event_id"], [mapping.Target("speed", "value", "double", "m/s", "km/h")], split_mode="months")
    begin, end = _days(source(spark), "t")
    # whole intervals only are run, so the last one ends at or after the last sample
    Speeds(spark, {"winds": process.Input([source])}, {"speeds": out}).run(begin, begin - (begin - end) // (10 * DAY) * 10 * DAY, 10 * DAY)
    return rounded(store.read(spark, path), "speed")


@query("""SELECT epoch_us(date_trunc('second', ts)) AS t, event_id AS record, round(value * 9 / 5 + 32, 6) AS temperature, (CASE WHEN value * 9 / 5 + 32 > 150 THEN 4 ELSE 0 END)::INTEGER AS qc_temperature FROM events WHERE event_id % 13 <> 0""")
def csv_ingest_process(spark, sf_dir):
    """Raw files with header lines and broken records, ingested twice: what is stored already isn't stored again."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("h"), "value")
    line = F.concat_ws(",", "d", "h", "value", "event_id")
    line = F.when(F.col("event_id") % 13 == 0, F.concat(line, F.lit(",?"))).otherwise(line).alias("value")
    path, raw = scratch.folder(spark, "ingested"), scratch.folder(spark, "raw")
    # every task writes a file of its own; the lower bits of the number are a row's place in it
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    for k in range(2):
        rows = e.where(F.col("event_id") % 2 == k).select(first.alias("first"), line)
        rows.select(F.explode(F.when(F.col("first"), F.array(F.lit("Date,Time,Temp,Record"), "value")).otherwise(F.array("value"))).alias("value")).write.text(f"{raw}/{k}")
    conf = csv_ingest.parse_conf(HEADED_CONF)
    conf.file_patterns = ("part-.*[.]txt",)
    attributes = {"valid_max": 150.0}
    target = mapping.Target("temperature", "temperature", "double", "degC", "degF")

    class Mine(ingest.CsvIngest):
        def filtered(self, name, rows):
            return super().filtered(name, metadata.with_attributes(rows, "temperature", **attributes))

    process_of = Mine(spark, conf, process.Output(path, ["t", "record"], [target], standard_checks=True, split_mode="months"))
    for part in (f"{raw}/0", f"{raw}/*", f"{raw}/1"):
        process_of.ingest(part)
    found = store.read(spark, path).select("t", F.col("record").cast("long").alias("record"), "temperature", "qc_temperature")
    return rounded(found, "temperature")


@query("SELECT event_id, epoch_us(ts) AS t, event_type, value FROM events")
def csv_roundtrip(spark, sf_dir):
    """Samples written as delimited text, split by month, and read again."""
    rows = table(spark, sf_dir, "events").select("event_id", times.micros(F.col("ts")).alias("t"), "event_type", "value")
    path = scratch.folder(spark, "text")
    store.write(rows, path, mode="months", fmt="csv")
    back = store.read(spark, path, fmt="csv")
    return back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


def _stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value", F.lit(0).alias("qc"), "event_id")


def _finished(spark, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what there is and reads what it wrote."""
    path = scratch.folder(spark, name)
    pipelines.sink(stream, pipelines.to_folder(path), f"{path}-state").awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query("""WITH w AS (SELECT event_type AS series, date_trunc('hour', ts) AS h, value FROM events)
SELECT series, epoch_us(h) AS start, round(avg(value), 6) AS value, round(stddev_pop(value), 6) AS value_std, 1.0::DOUBLE AS value_goodfraction, 0::INTEGER AS qc FROM w
GROUP BY series, h HAVING h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 72 HOUR FROM events)""")
def stream_averages(spark, sf_dir):
    """Hourly averages of a stream: those that are final 72 hours before its latest sample."""
    rows = _finished(spark, pipelines.averages(_stream(spark, sf_dir), ["series"], "1 hour"), "averages")
    return rounded(rows.select("series", F.unix_micros("start").alias("start"), "value", "value_std", "value_goodfraction", "qc"), "value", "value_std")


@query("SELECT event_type AS series, epoch_us(ts) AS t, value FROM events")
def stream_distinct(spark, sf_dir):
    """A stream that delivers every sample twice."""
    both = _stream(spark, sf_dir).unionByName(_stream(spark, sf_dir))
    rows = _finished(spark, pipelines.distinct_samples(both, ["series", "ts", "value"]), "distinct")
    return rows.select("series", F.unix_micros("ts").alias("t"), "value")


@query("""WITH p AS (SELECT event_type AS series, ts, value, lag(value) OVER w AS pv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT series, epoch_us(ts) AS t, value, (CASE WHEN step <= 0 THEN 16 WHEN step < 60000000 THEN 32 WHEN step > 7200000000 THEN 64 ELSE 0 END | CASE WHEN abs(value - pv) > 25 THEN 8 ELSE 0 END)::INTEGER AS qc FROM p""")
def stream_step_checks(spark, sf_dir):
    path = scratch.folder(spark, "steps")
    limits = {"most_delta": 25.0, "least_step": 60.0, "most_step": 7200.0}
    pipelines.start_step_checks(_stream(spark, sf_dir), ["series"], pipelines.to_folder(path), f"{path}-last", f"{path}-state", ties=["event_id"], **limits).awaitTermination()
    return spark.read.parquet(path).select("series", F.unix_micros("ts").alias("t"), "value", "qc")


_SUN = """WITH a AS (SELECT event_id, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 / 86400.0 - 10957.5 AS n FROM events),
b AS (SELECT *, 357.528 + 0.9856003 * n AS g0, 280.460 + 0.9856474 * n AS l0, radians(23.439 - 0.0000004 * n) AS tilt, 18.697374558 + 24.06570982441908 * n AS st FROM a),
c AS (SELECT *, radians(g0 - floor(g0 / 360) * 360) AS g, l0 - floor(l0 / 360) * 360 AS l, st - floor(st / 24) * 24 AS gst, radians(36.6) AS lat FROM b),
d AS (SELECT *, l + 1.915 * sin(g) + 0.020 * sin(2 * g) AS ec0 FROM c), e AS (SELECT *, radians(ec0 - floor(ec0 / 360) * 360) AS ec FROM d),
f AS (SELECT *, atan2(cos(tilt) * sin(ec), cos(ec)) AS ra, asin(sin(tilt) * sin(ec)) AS de FROM e), h AS (SELECT *, gst * 15 - 97.5 - degrees(ra) + 180 AS ha0 FROM f),
i AS (SELECT *, radians(ha0 - floor(ha0 / 360) * 360 - 180) AS ha FROM h),
j AS (SELECT *, asin(sin(de) * sin(lat) + cos(de) * cos(lat) * cos(ha)) AS alt, degrees(atan2(-cos(de) * sin(ha), sin(de) * cos(lat) - cos(de) * cos(ha) * sin(lat))) AS az FROM i),
k AS (SELECT *, degrees(alt) AS h, degrees(ra) / 15 AS r FROM j),
m AS (SELECT *, CASE WHEN h >= 19.225 THEN 0.00452 * 3.51561 / tan(alt) WHEN h > -0.766 THEN 3.51561 * (0.1594 + 0.0196 * h + 0.00002 * h * h) / (1 + 0.505 * h + 0.0845 * h * h) ELSE 0 END AS bent FROM k)
SELECT event_id, round(az - floor(az / 360) * 360, 6) AS azimuth, round(h, 6) AS altitude, round(bent, 6) AS refraction, round(h + bent, 6) AS elevation, round(degrees(de), 6) AS declination,
  round(r - floor(r / 24) * 24, 6) AS right_ascension, round(1.00014 - 0.01671 * cos(g) - 0.00014 * cos(2 * g), 6) AS distance FROM m"""


@query(_SUN)
def solar_position(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (times.micros(F.col("ts")) / 1_000_000).alias("s"))
    sun = solar.position(F.col("s"), F.lit(36.6), F.lit(-97.5))
    return rounded(e.select("event_id", *[v.alias(k) for k, v in sun.items()]), *sun)


_K = f"{(objective.METRES_PER_DEGREE / 100_000) ** 2!r}"
_METRES = f"{objective.METRES_PER_DEGREE} * sqrt(pow({{0}}.lat - {{1}}.lat, 2) + pow(({{0}}.lon - {{1}}.lon) * cos(radians(({{0}}.lat + {{1}}.lat) / 2)), 2))"


@query(f"""WITH RECURSIVE st AS (
  SELECT epoch_us(ts) // {6 * HOUR} AS hour, user_id AS station, 36 + user_id % 13 / 10.0::DOUBLE AS lat, -98 + user_id % 17 / 10.0::DOUBLE AS lon, avg(value) AS v, user_id % 11 = 0 AS bad FROM events GROUP BY 1, 2),
good AS (SELECT *, count(*) OVER (PARTITION BY hour) AS n FROM st WHERE NOT bad),
pairs AS (SELECT *, w / sum(w) OVER (PARTITION BY hour, i) AS share FROM (
  SELECT a.hour, a.station AS i, a.v, b.station AS j, exp(-pow({_METRES.format('a', 'b')} / 100000, 2)) AS w FROM good a JOIN good b USING (hour) WHERE a.n >= 15)),
passes AS (
  SELECT hour, station, v AS c, 1 AS k FROM good WHERE n >= 15
  UNION ALL SELECT p.hour, p.i, sum(CASE WHEN p.i = p.j THEN q.c END) + any_value(p.v) - sum(p.share * q.c), any_value(q.k) + 1
  FROM passes q JOIN pairs p ON p.hour = q.hour AND p.j = q.station WHERE q.k < 16 GROUP BY p.hour, p.i),
places AS (SELECT (36 + n_nationkey / 20.0)::DOUBLE AS lat, (-98 + n_nationkey * 7 % 25 / 20.0)::DOUBLE AS lon FROM nation),
onto AS (SELECT *, -2 * {_K} * ((lat - s_lat) - pow(lon - s_lon, 2) * sin(2 * mid) * radians(0.25)) * w AS dy, -2 * {_K} * (lon - s_lon) * pow(cos(mid), 2) * w AS dx FROM (
  SELECT g.lat, g.lon, a.lat AS s_lat, a.lon AS s_lon, a.hour, p.c, radians((g.lat + a.lat) / 2) AS mid, exp(-pow({_METRES.format('g', 'a')} / 100000, 2)) AS w
  FROM places g, good a JOIN passes p ON p.hour = a.hour AND p.station = a.station AND p.k = 16)),
field AS (SELECT hour, lat, lon, sum(w * c) / sum(w) AS value, sum(dy * c) / sum(w) - sum(w * c) * sum(dy) / pow(sum(w), 2) AS deriv_lat,
  sum(dx * c) / sum(w) - sum(w * c) * sum(dx) / pow(sum(w), 2) AS deriv_lon FROM onto GROUP BY ALL),
hours AS (SELECT hour, count(*) AS n_all, count(*) FILTER (NOT bad) AS n FROM st GROUP BY 1)
SELECT hour, lat, lon, round(value, 5) AS value, round(deriv_lat, 4) AS deriv_lat, round(deriv_lon, 4) AS deriv_lon, n::INTEGER AS nstat,
  (CASE WHEN n < 15 THEN CASE WHEN n = 0 THEN 257 ELSE 33 END WHEN n < n_all THEN 32 ELSE 0 END)::INTEGER AS qc
FROM hours CROSS JOIN places LEFT JOIN field USING (hour, lat, lon)""")
def objective_analysis(spark, sf_dir):
    """Station values of every six hours (users as stations), and their slopes, onto a grid of points (nations) in parts."""
    e = table(spark, sf_dir, "events")
    where = e.select(F.floor(times.micros(F.col("ts")) / (6 * HOUR)).alias("hour"), F.col("user_id").alias("station"), "value")
    rows = where.groupBy("hour", "station").agg(F.avg("value").alias("value"))
    rows = rows.select("hour", "station", (36 + F.col("station") % 13 / 10.0).alias("lat"), (-98 + F.col("station") % 17 / 10.0).alias("lon"), "value", F.when(F.col("station") % 11 == 0, 1).otherwise(0).alias("qc"))
    points = table(spark, sf_dir, "nation").select((36 + F.col("n_nationkey") / 20).alias("lat"), (-98 + F.col("n_nationkey") * 7 % 25 / 20).alias("lon"))
    found = objective.objective_analysis(rows, ["hour"], points, min_stations=15)
    return found.withColumns({"value": F.round("value", 5), "deriv_lat": F.round("deriv_lat", 4), "deriv_lon": F.round("deriv_lon", 4)})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gridloom import store_queries  # noqa: F401  adds its own to QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
