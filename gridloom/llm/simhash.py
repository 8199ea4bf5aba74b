"""SimHash near-duplicates with pigeonring filtering.

A document's 64-bit fingerprint takes the majority of each bit over the XXH64 hashes of its 3-word
shingles. Two fingerprints link at ``MAX_DISTANCE`` = 2 or fewer differing bits, and a component
is what links reach.

Pigeonring: the 64 bits are cut into a ring of three segments. If two fingerprints differ in at most
2 bits, some segment starts a chain whose first segment differs by 0 bits, whose first two segments
differ by at most 1 and whose three segments differ by at most 2 (cumulative budget l * 2 / 3 after l
segments). So fingerprints meet in the bucket of an equal first segment; the second budget prunes the
pairs and the full Hamming check decides.

Copies share a fingerprint and are collapsed before anything is paired. A bucket that holds more than
``BUCKET_LIMIT`` different fingerprints is never paired: its members emit their *midpoints*, i.e.
themselves and every flip of one bit outside the equal segment. Two members differ by at most 2 bits
exactly if they share a midpoint, and a midpoint has at most 44 different members, so links are
emitted as stars and the work is linear however large the bucket is.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and link like any
other; texts of one or two words hash the whole word sequence; null doc_ids take part, but are never a
component_id unless a component has no other; repeated rows stay repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, bounded_batches, checkpointed, packed, release_shuffles, unpacked, utf8_texts

MAX_DISTANCE = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
#: (first bit, width) of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets with more different fingerprints than this take the midpoint path.
BUCKET_LIMIT = 128
#: Words hashed at a time, so that memory doesn't follow the length of a text.
BLOCK_WORDS = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for start in range(0, max(1, len(words) - SHINGLE_WORDS + 1), BLOCK_WORDS):
        block = words[start : start + BLOCK_WORDS + SHINGLE_WORDS - 1]
        grams = map(b" ".join, zip(*(block[k:] for k in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in utf8_texts(batch.column(2))), np.uint64, batch.num_rows)
        yield batch_of(_FINGERPRINTS, [batch.column(0), batch.column(1), pa.array(values.view(np.int64))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document; text_hash tells rows of one doc_id apart."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp long")


def _popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def within(differ: np.ndarray, segments: tuple[tuple[int, int], ...], distance: int) -> np.ndarray:
    """Which differences of fingerprints have ``distance`` or fewer bits: first, from some segment of the ring on, all chains keep their
    cumulative budgets (distance / segments for each segment); then the full count decides."""
    counts = [_popcount(differ & np.uint64(((1 << width) - 1) << first)).astype(np.int64) for first, width in segments]
    n, keep = len(segments), np.zeros(len(differ), bool)
    for ring in range(n):
        chain, ok = np.zeros(len(differ), np.int64), np.ones(len(differ), bool)
        for length in range(1, n):
            chain = chain + counts[(ring + length - 1) % n]
            ok &= chain * n <= length * distance
        keep |= ok
    at = np.flatnonzero(keep)
    keep[at] = _popcount(differ[at]) <= distance
    return keep


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _chain_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each (bounded) bucket that pass the chain budgets and the Hamming check."""
    masks = [np.uint64(((1 << width) - 1) << first) for first, width in SEGMENTS]
    for batch in batches:
        left, right = [], []
        for ring, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            fps = np.sort(members.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            i, j = np.triu_indices(len(fps), 1)
            differ = fps[i] ^ fps[j]
            chain = np.zeros(len(differ), np.int64)
            for length in range(1, len(SEGMENTS) + 1):
                chain = chain + _popcount(differ & masks[(ring + length - 1) % len(SEGMENTS)])
                keep = chain * len(SEGMENTS) <= length * MAX_DISTANCE
                i, j, differ, chain = i[keep], j[keep], differ[keep], chain[keep]
            keep = _popcount(differ) <= MAX_DISTANCE
            left.append(fps[i[keep]].view(np.int64))
            right.append(fps[j[keep]].view(np.int64))
        yield batch_of(_EDGES, [np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``fps`` (fp, distinct) with all links' connectivity.

    Every pair of cold buckets within the distance is there; hot buckets give stars around shared
    midpoints, which connect exactly the same fingerprints.
    """
    ring = F.explode(
        F.array(*[F.struct(F.lit(k).alias("ring"), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)).alias("seg")) for k, (first, width) in enumerate(SEGMENTS)])
    )
    members = fps.select("fp", ring.alias("key")).select("fp", "key.ring", "key.seg")
    sizes = members.groupBy("ring", "seg").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(members.join(sizes, ["ring", "seg"]))
    cold = members.where(F.col("size") <= BUCKET_LIMIT).groupBy("ring", "seg").agg(F.collect_list("fp").alias("fps"))
    pairs = cold.select("ring", "fps").mapInArrow(_chain_pairs, "a long, b long")
    hot = members.where(F.col("size") > BUCKET_LIMIT)
    flips = F.lit(None).cast("array<long>")
    for k, (first, width) in enumerate(SEGMENTS):
        free = [b for b in range(64) if not first <= b < first + width]
        flips = F.when(F.col("ring") == k, F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) * (b == 63))) for b in free])).otherwise(flips)
    stars = (
        hot.select("fp", "ring", F.explode(flips).alias("midpoint"))
        .groupBy("ring", "midpoint")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
    )
    return pairs.unionByName(stars).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until every node but the roots has one neighbour, its root; no node's neighbours are ever
    gathered in one row. A round moves the edges four times: all its groupings, joins and distinct rows go by one column.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").repartition("u").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if low.where("m < u and n > 1").isEmpty():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition("u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").repartition("u").distinct())
        release_shuffles(edges.sparkSession)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their fingerprint, and (fp, root) for the fingerprints that have links."""
    docs_fp = checkpointed(fingerprints(docs))
    return docs_fp, connected_components(links(docs_fp.select("fp").distinct()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    docs_fp, roots = _grouped(docs)
    per_fp = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    per_fp = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    component = per_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    named = per_fp.join(component, "root").select("fp", "component_id")
    return docs_fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` with one document of each component: that of the smallest doc_id.

    Ties (one doc_id with several texts in a component) go to the smallest text hash; of rows that
    repeat doc_id and text one stays. A null doc_id is kept only where its component has no other.
    """
    return keep_first(docs, *_grouped(docs))


def keep_first(docs: DataFrame, docs_fp: DataFrame, roots: DataFrame) -> DataFrame:
    """One document of each component, given each row's (doc_id, text_hash, fp) and the (node, root) of the fps with links."""
    root = docs_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("text_hash"))
    winners = root.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_hash"))
    # the same plain keys for the join and for repeated rows, so that the texts are moved once
    keys = ["_known", "_number", "_text_hash"]
    named = lambda doc_id: {"_known": F.col(doc_id).isNotNull(), "_number": F.coalesce(F.col(doc_id).cast("long"), F.lit(0))}
    winners = winners.withColumns({**named("_id"), "_text_hash": F.col("_hash")}).select(*keys)
    keyed = packed(docs, "doc_id", "text").withColumns({**named("doc_id"), "_text_hash": F.xxhash64("text")})
    kept = keyed.join(winners.hint("merge"), keys, "left_semi")
    return unpacked(kept.dropDuplicates(keys), docs.columns, ["doc_id", "text"])
