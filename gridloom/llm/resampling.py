"""Importance resampling towards a target distribution of hashed word n-grams.

A word is a run of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased. The features of a text are all
runs of 1 to ``max_n`` words joined by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.

Every task counts the buckets of its documents in DuckDB: SQL splits and unnests the words, a window puts words together, and
``crc32_of``, zlib's CRC registered as a vectorised function, gives the bucket. The counts of each document go to Parquet in the
shared folder. Spark sums them over all documents and over the target (at most ``buckets`` sums each, which come to the driver), scores
every document from its stored counts, so texts are read once, and draws the highest scores by one global sort of slim rows:
a row's rank is its place in its partition and the rows of the partitions before, so no task sees more than a share.

Memory: a query of DuckDB gets at most ``SLICE_CHARS`` characters; longer texts are cut between words, each piece with the words that
features across the cut need. DuckDB runs in memory, with one thread and no folder of its own.

Defined results: a null text has no words; a document without words has weight 0; documents of fewer than ``min_words`` words are never
drawn, but are returned; an empty target or an empty table leaves gains of the formula's counts of zero; a null doc_id is hashed as an
empty string and comes last among equal scores; rows that repeat a doc_id are documents of their own, ties among them going by
n_features, then weight; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, bounded_batches, checkpointed, scratch_path, str_texts

BUCKETS = 10_000
MAX_N = 1
#: Percent of the documents with MIN_WORDS words or more that are drawn.
SHARE = 10
MIN_WORDS = 20
SEED = 2024
SLICE_CHARS = 1 << 22

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())
_CUT = re.compile(f"[{re.escape(_SEPARATORS)}\0]")


def _crc32(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, data = column.cast(pa.large_binary()).buffers()[1:]
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data, start, ends, crc32 = data.to_pybytes() if data else b"", ends[:-1].tolist(), ends[1:].tolist(), zlib.crc32
    return pa.array([crc32(data[a:b]) for a, b in zip(start, ends)], pa.uint32())


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    con.create_function("crc32_of", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(column: str) -> str:
    """SQL for the words of a column, with empty strings between adjoining separators."""
    plain = _literal(_UPPER.lower() + " " * (len(_SEPARATORS) + 1))
    return f"string_split(translate({column}, {_literal(_UPPER + _SEPARATORS)} || chr(0), {plain}), ' ')"


def count_sql(max_n: int, buckets: int) -> str:
    """SQL over ``slice`` (doc, piece, text, tail) for (doc, n: words in a feature, bucket, times)."""
    if max_n == 1:
        features = f"SELECT doc, 1 AS n, word AS feature FROM (SELECT doc, unnest({_words('text')}) AS word FROM slice) WHERE word <> ''"
    else:
        runs = ["word"] + [f"{{}} || ' ' || lead(word, {k}) OVER w" for k in range(1, max_n)]
        for k in range(1, max_n):
            runs[k] = runs[k].format(runs[k - 1])
        features = f"""
            SELECT doc, unnest({list(range(1, max_n + 1))}) AS n, unnest([{', '.join(f'f{k}' for k in range(max_n))}]) AS feature FROM (
              SELECT doc, own, {', '.join(f'{x} AS f{k}' for k, x in enumerate(runs))} FROM (
                SELECT doc, piece, TRUE AS own, unnest({_words('text')}) AS word, unnest(range(len({_words('text')}))) AS nth FROM slice
                UNION ALL SELECT doc, piece, FALSE, unnest({_words('tail')}), unnest(range(len({_words('tail')}))) FROM slice)
              WHERE word <> '' WINDOW w AS (PARTITION BY doc, piece ORDER BY own DESC, nth))
            WHERE own"""
    return f"SELECT doc, n, crc32_of(feature) % {buckets} AS bucket, count(*) AS times FROM ({features}) WHERE feature IS NOT NULL GROUP BY ALL"


def _pieces(text: str, max_n: int) -> Iterator[tuple[str, str]]:
    """The text cut between words, each piece with the max_n - 1 words after it."""
    start = 0
    while True:
        cut = _CUT.search(text, start + SLICE_CHARS) if len(text) - start > SLICE_CHARS else None
        stop, tail, at = cut.start() if cut else len(text), [], cut.end() if cut else len(text)
        while len(tail) < max_n - 1 and at < len(text):
            found = _CUT.search(text, at)
            end = found.start() if found else len(text)
            if end > at:
                tail.append(text[at:end])
            at = end + 1
        yield text[start:stop], " ".join(tail)
        if not cut:
            return
        start = cut.end()


def _slices(texts: list[str], max_n: int) -> Iterator[pa.Table]:
    rows, held = [], 0
    for doc, text in enumerate(texts):
        for number, (piece, tail) in enumerate(_pieces(text, max_n)):
            if rows and held + len(piece) > SLICE_CHARS:
                yield pa.table(dict(zip(("doc", "piece", "text", "tail"), map(list, zip(*rows)))))
                rows, held = [], 0
            rows.append((doc, number, piece, tail))
            held += len(piece)
    if rows:
        yield pa.table(dict(zip(("doc", "piece", "text", "tail"), map(list, zip(*rows)))))


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


def _counter(max_n: int, buckets: int):
    sql = count_sql(max_n, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connection() as con:
            for batch in batches:
                n, found = batch.num_rows, []
                for table in _slices(str_texts(batch.column(1)), max_n):
                    con.register("slice", table)
                    got = con.execute(sql).fetchnumpy()
                    found.append(np.stack([got[c].astype(np.int64) for c in ("doc", "n", "bucket", "times")]))
                    con.unregister("slice")
                doc, size, bucket, times = np.concatenate(found or [np.zeros((4, 0), np.int64)], axis=1)
                total = lambda keep: np.bincount(doc[keep], times[keep], n).astype(np.int64)
                # pieces of a text, and features of several lengths, meet in a bucket
                cell, place = np.unique(doc * buckets + bucket, return_inverse=True)
                offsets = np.searchsorted(cell // buckets, np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in ((cell % buckets).astype(np.int32), np.bincount(place, times, len(cell)).astype(np.int64))]
                yield batch_of(_COUNTS, [batch.column(0), total(size == 1), total(size > 0), *(x.cast(f.type) for x, f in zip(lists, list(_COUNTS)[3:]))])

    return run


def bucket_counts(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, times, salt) of each document of (doc_id, text), from Parquet in the shared folder.

    The salt only tells equal rows apart, so that a sort can deal them over partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(_counter(max_n, buckets), "doc_id long, n_words long, n_features long, buckets array<int>, times array<long>")
    folder = scratch_path(spark, "buckets")
    found.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).write.parquet(folder)
    return spark.read.parquet(folder)


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all documents."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "times")).alias("x")).groupBy("x.buckets").agg(F.sum("x.times").alias("n"))
    found = np.zeros(buckets, np.int64)
    for row in each.collect():  # one row for each bucket at most
        found[row["buckets"]] = row["n"]
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandths of each bucket's log ratio of smoothed shares, target against raw."""
    m, s, t = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(float(target[b] + 1) * s / (float(raw[b] + 1) * t))) for b in range(m)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """The floored thousandths of a document's Gumbel draw, by a hash of its doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(counts: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, salt) of each document."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score", "salt")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, n_words, n_features, bucket, times, salt = batch.columns
            sums = np.concatenate([[0], np.cumsum(gain[bucket.flatten().to_numpy()] * times.flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bucket])])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            score = weight + np.array([gumbel(x, seed) for x in doc_id.to_pylist()], np.int64)
            yield batch_of(schema, [doc_id, n_words, n_features, pa.array(weight), pa.array(score), salt])

    return counts.mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))


def drawn(scores: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank numbers the highest scores, ``share`` percent of the documents with min_words words."""
    fit = F.col("n_words") >= min_words
    order = [fit.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "salt"]
    rows = checkpointed(scores.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_place", 33), "_at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each partition
    parts = rows.where(fit).groupBy("_part").agg(F.count("*").alias("_rows"))
    w = Window.orderBy("_part")
    parts = parts.select("_part", (F.sum("_rows").over(w) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.col("_at") + 1
    chosen = F.when(fit & (rank <= F.floor(F.col("_all") * share / 100)), rank)
    return rows.join(F.broadcast(parts), "_part", "left").select("doc_id", "n_features", "weight", "score", chosen.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank); rank is null where it isn't drawn.

    ``docs`` has (doc_id, text), ``target`` (text).
    """
    counts = bucket_counts(docs, max_n, buckets)
    wanted = bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), max_n, buckets)
    gain = gains(totals(counts, buckets), totals(wanted, buckets))
    return drawn(scored(counts, gain, seed), share, min_words)


#: zlib's CRC-32 of each distinct word, byte by byte.
ORACLE = r"""
WITH RECURSIVE step AS (
  SELECT k, 0 AS i, k AS c FROM range(256) r(k)
  UNION ALL SELECT k, i + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8),
word AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
byte AS (SELECT word, [('0x' || hex(encode(word))[i * 2 + 1 : i * 2 + 2])::BIGINT FOR i IN range(octet_length(encode(word)))] AS b FROM (SELECT DISTINCT word FROM word)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM byte, crc),
own AS (SELECT side, doc_id, bucket FROM word JOIN hashed USING (word)),
total AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM own GROUP BY bucket),
both_ AS (SELECT count(*) FILTER (side = 'd') + 10000 AS s, count(*) FILTER (side = 'b') + 10000 AS t FROM own),
gain AS (SELECT bucket, floor(1000 * ln((total.t + 1)::DOUBLE * both_.s::DOUBLE / ((total.s + 1)::DOUBLE * both_.t::DOUBLE)))::BIGINT AS gain FROM total, both_),
weight AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM own JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weight w ON w.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank FROM ranked
"""
