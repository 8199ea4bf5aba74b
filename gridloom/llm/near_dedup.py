"""SimHash near-duplicates of the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A Hamming bound wide enough for 0.8 leaves SimHash segments too narrow to look up, so candidates are texts that share a shingle at
the front of one common order (common shingles last, then by hash). Of two sets that similar, the first n - ceil(0.8 n) + 1 shingles
always share one, whatever the order is, and all of them are taken. Which shingles are common is counted over all documents, by
``COUNT_BITS`` bits of their hashes, so that the counts are of bounded size; it settles the work only, never the result.

Candidates of similar size that pass op 8's pigeonring filter and Hamming check at ``MAX_DISTANCE`` of 64 bits (texts with a similarity of 0.8 differ
in 10 bits, with a standard deviation of 3; others in 32) are compared first, by whole sets, which decides. Where the smaller set has fewer than
``FEW`` shingles, whose majorities say little, the filter isn't asked. The bound is no proof: pairs beyond it are compared too, unless links connect them by then.
Before either, a pair must share as many shingles of its sketches as ``need`` shows that a similar one does.

Texts of one set are collapsed before anything is paired. Buckets with more than ``HOT_BUCKET`` members first
link them to a pivot, in ``PIVOT_ROUNDS`` rounds; after that only pairs that no links connect yet are compared, but all of those: a bucket is cut into
blocks of bounded size, and every two blocks meet in a task of their own, to which each set is moved once for all of its pairs there.

Defined results: words are lower-cased (ASCII) and separated by ASCII white space, as in op 8; a text of one to four words has
one shingle, the whole sequence; texts without words (null ones too) are copies of each other; which document of a group stays is as in
simhash.keep_first; other columns, whatever their names, pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.common import batch_of, bounded_batches, checkpointed, release_shuffles, utf8_texts

SHINGLE_WORDS = 5
#: Least Jaccard similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
HOT_BUCKET = 256
PIVOT_ROUNDS = 1
#: Members, and shingles of all of them, that a block of a hot bucket has on average at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 19
MAX_DISTANCE = 24
FEW = 20
#: (first bit, width) of the ring's segments for the wide bound.
SEGMENTS = tuple((16 * k, 16) for k in range(4))
#: Shingles are counted by so many leading bits of their hashes, over all documents; the counts move in rows of 2 ** ROW_BITS.
COUNT_BITS, ROW_BITS = 20, 12
#: Without effect since all documents are counted; tests set it.
SAMPLE_DOCS = None


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, simhash.HASH_SEED) for g in grams), np.uint64))


def buckets(found: np.ndarray) -> np.ndarray:
    """The bucket of each shingle in the counts."""
    return (found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def sketch(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which a similar set has one in its own sketch. common: buckets of common shingles, in order."""
    if not len(found):
        return found
    length = len(found) - -(-SIMILAR[0] * len(found) // SIMILAR[1]) + 1
    order = np.zeros(len(found), np.int64)
    if len(common):
        own = buckets(found)
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        order = np.where(common[at] == own, counts[at], 0)
    return found[np.lexsort((found, order))[:length]]


def fingerprint(found: np.ndarray) -> int:
    """The majority of each bit over a set of hashes."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])


def _lists(values: list[np.ndarray], element: type = np.int64) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, element), *(v.view(element) for v in values)])))


def _sets(rows: DataFrame, element: str = "bigint") -> DataFrame:
    """(node, shingles) of rows (node, text); as int, 32 bits stand for a shingle, which are enough within a pair and half to move."""
    kind = np.int32 if element == "int" else np.int64
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.from_numpy_dtype(kind)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in utf8_texts(batch.column(1))]
            if kind is np.int32:
                found = [np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in found]
            yield batch_of(schema, [batch.column(0), _lists(found, kind).cast(schema.field(1).type)])

    return rows.mapInArrow(run, f"node long, shingles array<{element}>")


_COUNTS = pa.schema([("row", pa.int32()), ("counts", pa.list_(pa.int64()))])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's sets have a shingle in each bucket (sets with several there count as several)."""
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        found = [shingles(text) for text in utf8_texts(batch.column(0))]
        total += np.bincount(buckets(np.concatenate([np.zeros(0, np.uint64), *found])), minlength=len(total))
    if total.any():
        rows = total.reshape(-1, 1 << ROW_BITS)
        yield batch_of(_COUNTS, [np.arange(len(rows)), _lists(list(rows)).cast(_COUNTS.field(1).type)])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            totals[row] = totals.get(row, 0) + counts.values.to_numpy()
    yield batch_of(_COUNTS, [list(totals), _lists(list(totals.values())).cast(_COUNTS.field(1).type)])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, in order, that stand out from the others by the shingles of all documents, and their counts."""
    fields = "row int, counts array<long>"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_count_batches, fields)
    rows = parts.repartition("row").mapInArrow(_add_counts, fields).toArrow()
    total = np.zeros((1 << COUNT_BITS - ROW_BITS, 1 << ROW_BITS), np.int64)
    for row, counts in zip(rows["row"].to_pylist(), rows["counts"], strict=True):
        total[row] = counts.values.to_numpy()
    total, usual = total.reshape(-1), total.mean()
    common = np.flatnonzero(total > usual + 6 * np.sqrt(usual) + 2)
    return common, total[common]


def _nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, n, sim, sketch) of each document: fp stands for its set of n shingles, sim is the set's SimHash."""
    common, counts = _common(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sim", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, sims, sketches = [], [], [], []
            for text in utf8_texts(batch.column(2)):
                found = shingles(text)
                fps.append(xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0)
                sizes.append(len(found))
                sims.append(fingerprint(found))
                sketches.append(sketch(found, common, counts))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield batch_of(schema, [batch.column(0), batch.column(1), fps, sizes, sims, _lists(sketches).cast(schema.field(5).type)])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, n int, sim long, sketch array<long>")


def _may_be_similar(m: str, x: str, n: str, y: str) -> Column:
    """Whether the sizes m and n and the SimHashes x and y allow the similarity."""
    t, u = SIMILAR
    sizes = F.least(m, n).cast("long") * u >= F.greatest(m, n).cast("long") * t
    return sizes & ((F.least(m, n) < FEW) | (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MAX_DISTANCE))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_CANDIDATES = _PAIRS.append(pa.field("near", pa.bool_())).append(pa.field("need", pa.int32()))
#: Pairs judged at a time.
PAIRS_AT_ONCE = 1 << 19


@lru_cache(maxsize=HOT_BUCKET)
def _corner(size: int) -> np.ndarray:
    return np.stack(np.triu_indices(size, 1)).astype(np.int32)


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles the sketches of similar sets of n and m share at least: what both share lacks no more than lies beyond one sketch."""
    t, u = SIMILAR
    both = -(-t * (n.astype(np.int64) + m) // (t + u))
    return np.maximum(1, both + 1 - -(-t * np.maximum(n, m).astype(np.int64) // u))


def _cold_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each (bounded) bucket that may be similar by size, whether they may by pigeonring and Hamming distance, and how many buckets they need."""
    t, u = SIMILAR
    for batch in batches:
        lists = batch.column(0)
        node, n, sim = (lists.values.field(k).to_numpy() for k in range(3))

        def judged(held: list[np.ndarray]) -> pa.RecordBatch:
            i, j = np.concatenate([np.zeros((2, 0), np.int32), *held], axis=1)
            keep = np.minimum(n[i], n[j]).astype(np.int64) * u >= np.maximum(n[i], n[j]).astype(np.int64) * t
            i, j = i[keep], j[keep]
            near = (np.minimum(n[i], n[j]) < FEW) | simhash.within(sim[i].view(np.uint64) ^ sim[j].view(np.uint64), SEGMENTS, MAX_DISTANCE)
            return batch_of(_CANDIDATES, [np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), near, need(n[i], n[j]).astype(np.int32)])

        held, size = [], 0
        bounds = lists.offsets.to_pylist()
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(_corner(stop - start) + np.int32(start))
            size += held[-1].shape[1]
            if size >= PAIRS_AT_ONCE:
                yield judged(held)
                held, size = [], 0
        yield judged(held)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    return both.where((F.size("set_a") + F.size("set_b") - F.col("shared")) * SIMILAR[0] <= F.col("shared") * SIMILAR[1]).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that links don't connect yet."""
    named = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    return named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that links don't connect as a whole yet, with their root."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("shingle")
    return checkpointed(rooted.join(mixed, "shingle"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) over the similar sets among ``nodes``; ``docs`` has their texts."""
    return _links(docs, _whole(nodes))


def _whole(nodes: DataFrame) -> DataFrame:
    """The sets of ``nodes``, once each, with a text that each comes from."""
    return checkpointed(nodes.where("n > 0").groupBy("fp").agg(F.min(F.struct("text_hash", "doc_id")).alias("of"), *[F.first(c).alias(c) for c in ("n", "sim", "sketch")]))


def _links(docs: DataFrame, whole: DataFrame) -> DataFrame:
    members = whole.select(F.explode("sketch").alias("shingle"), F.col("fp").alias("node"))
    shared = members.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1")
    members = members.join(shared, "shingle").join(whole.select(F.col("fp").alias("node"), "n", "sim"), "node")
    members = checkpointed(members.select("shingle", "size", "node", "n", "sim"))

    hot = members.where(F.col("size") > HOT_BUCKET)
    grouped = members.where(F.col("size") <= HOT_BUCKET).groupBy("shingle").agg(F.collect_list(F.struct("node", "n", "sim")).alias("x"))
    cold = grouped.select("x").mapInArrow(_cold_pairs, "a long, b long, near boolean, need int")
    # a pair that shares a hot bucket too may be short of its number here: it is found there
    cold = checkpointed(cold.groupBy("a", "b", "near", "need").agg(F.count("*").alias("found")).where("found >= need").select("a", "b", "near"))
    wanted = cold.select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct()
    # one text for each set: repeated rows go where rows are moved by the same keys for the join
    keys = lambda doc_id, text_hash: [F.col(doc_id).isNotNull().alias("_known"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_number"), F.col(text_hash).alias("_text_hash")]
    names = ["_known", "_number", "_text_hash"]
    texts = whole.join(wanted, F.col("fp") == F.col("node"), "left_semi").select(F.col("fp").alias("node"), F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash"))
    texts = texts.select("node", *keys("_id", "_hash"))
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_h"), F.col("text").cast("string")).select("text", *keys("doc_id", "_h"))
    sets = checkpointed(_sets(rows.dropDuplicates(names).join(texts.hint("merge"), names).select("node", "text"), "int"))
    release_shuffles(docs.sparkSession)

    near, far = (cold.where(c).select("a", "b") for c in ("near", "not near"))
    edges = checkpointed(_similar(near, sets))
    roots = checkpointed(simhash.connected_components(edges))
    if hot.isEmpty():
        return simhash.connected_components(edges.unionByName(_similar(_apart(far, roots), sets)))
    for turn in range(PIVOT_ROUNDS):
        rooted = _rooted(hot, roots)
        pivots = rooted.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "sim", "root")).alias("p"))
        pairs = rooted.join(pivots, "shingle").where((F.col("root") != F.col("p.root")) & _may_be_similar("n", "sim", "p.n", "p.sim"))
        # one pivot for each set and round: the same few serve most buckets of a group
        pairs = pairs.groupBy("node").agg(F.min_by("p.node", "p.o").alias("pivot"))
        pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        edges = checkpointed(edges.unionByName(_similar(pairs, sets)))
        roots = checkpointed(simhash.connected_components(edges))
        release_shuffles(docs.sparkSession)
    edges = edges.unionByName(_similar(_apart(far, roots), sets))
    return simhash.connected_components(edges.unionByName(_block_links(_rooted(hot, roots), sets)))


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share."""
    n = len(sets)
    found = np.zeros((n, n), np.float32)
    element, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    where, count = np.unique(element, return_inverse=True, return_counts=True)[1:]
    # an element of one set only is shared by none; a set's own size isn't asked for
    place = np.cumsum(count > 1) - 1
    held = count[where] > 1
    place, row = place[where[held]], row[held]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, (start, start + columns))
        part = np.zeros((n, columns), np.float32)
        part[row[a:b], place[a:b] - start] = 1
        found += part @ part.T
    return found


def _linked(table: pa.Table) -> pa.Table:
    """The similar pairs (a, b) of different roots between two blocks, or within one."""
    t, u = SIMILAR
    node, n, root, block = (table[c].to_numpy() for c in ("node", "n", "root", "block"))
    sets = [x.values.to_numpy() for x in table["shingles"]]
    one = bool((table["i"].to_numpy() == table["j"].to_numpy()).all())
    i, j = np.triu_indices(len(node), 1)
    keep = (root[i] != root[j]) & ((block[i] != block[j]) | one) & (np.minimum(n[i], n[j]).astype(np.int64) * u >= np.maximum(n[i], n[j]).astype(np.int64) * t)
    i, j = i[keep], j[keep]
    if len(i):
        shared, size = shared_counts(sets)[i, j].astype(np.int64), np.array([len(x) for x in sets])
        keep = (size[i] + size[j] - shared) * t <= shared * u
        i, j = i[keep], j[keep]
    return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}, schema=_PAIRS)


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar pairs (a, b) of each bucket that have different roots."""
    blocks = members.groupBy("shingle").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = members.select("shingle", "node", "n", "root").join(blocks, "shingle").withColumn("block", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    # a block meets each block, itself too, under the smaller and the larger number of the two
    rows = rows.withColumn("_with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("block", "_with"), "j": F.greatest("block", "_with")})
    rows = rows.drop("_with", "blocks").join(sets, "node")
    return rows.groupBy("shingle", "i", "j").applyInArrow(_linked, "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` with one document of each component of similar texts, as simhash.keep_first chooses it."""
    bounded_batches(docs.sparkSession)
    nodes = checkpointed(_nodes(docs))
    # the sketches are long: from here on those of the different sets are enough, and the others' files may go
    whole, nodes = _whole(nodes), checkpointed(nodes.select("doc_id", "text_hash", "fp"))
    release_shuffles(docs.sparkSession)
    return simhash.keep_first(docs, nodes, _links(docs, whole))
