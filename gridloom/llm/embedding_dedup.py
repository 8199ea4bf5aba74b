"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors link if their labels are equal and their cosine, in double precision, is ``SIMILAR`` or more; a component is what links reach.

Exact copies are collapsed first, and count as often as they occur. Vectors are turned by the principal components of a bounded
sample of ``SAMPLE_VALUES`` values (which settles the speed only, not the results), so that leading dimensions tell most. A range
partitioning by label and first component cuts them into tiles of about ``TILE_VALUES`` values, so a frequent label has many tiles. Each tile
keeps the bounds of its leading dimensions; two tiles meet only if their boxes are as near as linked unit vectors can be. A tile's
vectors stay in one task while the tiles that visit it stream past in chunks. Products of the leading quarter of the dimensions come first;
the rest of a product is at most the product of the norms of the two suffixes (Cauchy-Schwarz), so pairs whose sum stays below the
threshold stop there; the others take more dimensions, and what is left gets the exact cosine of the original vectors.

No pair leaves a task: each gives counts of links, and a forest that connects what its links connect, at most one row a vector of
either. Counts are summed, forests united by large-star/small-star steps. Time for vectors without structure in their leading dimensions grows
with the square of a label's different vectors, cut by the early stop; memory and rows sent don't depend on the number of links.

Defined results: null, empty and zero vectors and those with null or non-finite components, and rows with a null label, link with nothing; vectors of
different lengths never link; rows that repeat vec_id and vector are vectors of their own and link with each other; a null vec_id
takes part, but isn't a component_id unless there is no other, and kept is then false; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, bounded_batches, checkpointed, scratch_path
from gridloom.llm.simhash import connected_components

SIMILAR = 0.98
#: Components of vectors in the sample that the rotation is fitted to, and in a tile.
SAMPLE_VALUES, TILE_VALUES = 1 << 18, 1 << 17
#: Leading dimensions that a tile keeps the bounds of.
BOX = 8
#: Vectors of a visiting tile that are compared at a time.
CHUNK = 256
#: Rounding of partial products and rotations stays far below this.
SLACK = 1e-9


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The vectors as doubles, None for those that link with nothing."""
    ends, values = column.offsets.to_numpy(), column.values
    missing = values.is_null().to_numpy(zero_copy_only=False)
    values = values.to_numpy(zero_copy_only=False).astype(np.float64)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for ok, a, b in zip(known, ends[:-1], ends[1:]):
        x = values[a:b] + 0.0  # no negative zeros
        yield x if ok and b > a and not missing[a:b].any() and np.isfinite(x).all() and x.any() else None


_KEYED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("key", pa.binary()), ("vector", pa.list_(pa.float64()))])


def _keyed(embeddings: DataFrame, with_vectors: bool) -> DataFrame:
    """(vec_id, label, dim, key, vector); key, a hash of the vector, is null for rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, label, column = batch.columns
            found = [None if name is None else x for x, name in zip(_vectors(column), label.to_pylist())]
            keys = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            vectors = found if with_vectors else [None] * len(found)
            yield batch_of(_KEYED, [vec_id, label, [None if x is None else len(x) for x in found], keys, vectors])

    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, key binary, vector array<double>")


def rotation(nodes: DataFrame) -> tuple[int, np.ndarray | None]:
    """The most frequent number of dimensions, and its principal components as columns, fitted to a bounded sample by hash."""
    top = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return 0, None
    dim = top["dim"]
    sample = nodes.where(F.col("dim") == dim).orderBy("key", "label").limit(max(1, SAMPLE_VALUES // dim)).select("vector").toArrow()
    x = sample["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    x = unit(x)
    return dim, np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tile:
    """Vectors of one tile, or of a chunk that visits it."""

    def __init__(self, raw: np.ndarray, turned: np.ndarray | None):
        dim = raw.shape[1]
        self.unit = unit(raw)
        self.turned = self.unit if turned is None else self.unit @ turned
        self.cuts = sorted({max(1, dim // 4), max(1, dim // 2), dim})
        self.suffix = [np.sqrt(np.maximum(0, (self.turned[:, c:] ** 2).sum(axis=1))) for c in self.cuts]

    def links(self, other: Tile, similar: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (in self, in other) of the pairs whose cosine is ``similar`` or more."""
        first = self.cuts[0]
        part = self.turned[:, :first] @ other.turned[:, :first].T
        i, j = np.nonzero(part + self.suffix[0][:, None] * other.suffix[0] >= similar - SLACK)
        part = part[i, j]
        for k in range(1, len(self.cuts)):
            a, b = self.cuts[k - 1 : k + 1]
            part = part + np.einsum("pd,pd->p", self.turned[i, a:b], other.turned[j, a:b])
            keep = part + self.suffix[k][i] * other.suffix[k][j] >= similar - SLACK
            i, j, part = i[keep], j[keep], part[keep]
        keep = np.einsum("pd,pd->p", self.unit[i], other.unit[j]) >= similar
        return i[keep], j[keep]


class Forest:
    """Which members of a tile are connected: each has the place of the first member of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, group: np.ndarray, member: np.ndarray, groups: int) -> np.ndarray:
        """Connects members that share a group (of ``groups``); the label of each group, or the number of members where it has none."""
        n = len(self.label)
        while True:
            own = self.label[member]
            low = np.full(groups, n)
            np.minimum.at(low, group, own)
            root = np.arange(n)
            np.minimum.at(root, own, low[group])
            if (root[own] == own).all():
                return low
            self.label = root[self.label]


_FOUND = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


class _Home:
    """A tile at home in a task: what its links within, and with its visitors, give."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, raw: np.ndarray, turned: np.ndarray | None, similar: float):
        self.nodes, self.copies, self.turned, self.similar = nodes, copies, turned, similar
        self.tile, self.forest, self.count = Tile(raw, turned), Forest(len(nodes)), np.zeros(len(nodes), np.int64)
        n = len(nodes)
        for start in range(0, n, CHUNK):
            part = Tile(raw[start : start + CHUNK], turned)
            i, j = part.links(self.tile, similar)
            i = i + start
            i, j = i[i != j], j[i != j]
            self.count += np.bincount(i, copies[j], n).astype(np.int64)
            # a pair is a group of two
            pair = np.arange(len(i))
            self.forest.join(np.concatenate([pair, pair]), np.concatenate([i, j]), len(i))

    def visit(self, nodes: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(nodes), CHUNK):
            own, weight = nodes[start : start + CHUNK], copies[start : start + CHUNK]
            i, j = Tile(raw[start : start + CHUNK], self.turned).links(self.tile, self.similar)
            if not len(i):
                continue
            self.count += np.bincount(j, weight[i], len(self.nodes)).astype(np.int64)
            low = self.forest.join(i, j, len(own))
            held = low < len(self.nodes)
            links = np.bincount(i, self.copies[j], len(own)).astype(np.int64)
            yield batch_of(_FOUND, [own[held], self.nodes[low[held]], links[held]])

    def result(self) -> pa.RecordBatch:
        held = (self.count > 0) | (self.forest.label != np.arange(len(self.nodes)))
        return batch_of(_FOUND, [self.nodes[held], self.nodes[self.forest.label[held]], self.count[held]])


def _compared(rows: DataFrame, dim: int, turned: np.ndarray | None, similar: float) -> DataFrame:
    """(node, other, links): parts of the nodes' counts of links, and edges that connect what links connect.

    ``rows`` are sorted by (label, dim, part, visits), so that a tile comes before those that visit it.
    """
    held = rows.sparkSession.sparkContext.broadcast(turned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, key, members = None, None, []
        stack = lambda parts: tuple(np.concatenate(x) for x in zip(*parts))
        settle = lambda: _Home(*stack(members), held.value if key[1] == dim else None, similar)
        for batch in batches:
            label, dims, part = (batch.column(c).to_pylist() for c in range(3))
            visits = batch.column(3).to_numpy(zero_copy_only=False)
            node, copies, vectors = (batch.column(c) for c in (4, 5, 6))
            ends = vectors.offsets.to_numpy()
            keys = list(zip(label, dims, part, visits.tolist()))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                own = (node[a:b].to_numpy(), copies[a:b].to_numpy(), vectors.values[ends[a] : ends[b]].to_numpy().reshape(b - a, -1))
                if keys[a][:3] != key:
                    if members:
                        yield (home or settle()).result()
                    home, key, members = None, keys[a][:3], []
                if not visits[a]:
                    members.append(own)
                else:
                    home = home or settle()
                    yield from home.visit(*own)
        if members:
            yield (home or settle()).result()

    return rows.select("label", "dim", "part", "visits", "node", "copies", "vector").mapInArrow(run, "node long, other long, links long")


def _tiles(nodes: DataFrame, dim: int, turned: np.ndarray | None) -> DataFrame:
    """nodes with their part (tile) and leading dimensions, from Parquet in the shared folder."""
    spark = nodes.sparkSession
    held = spark.sparkContext.broadcast(turned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros((batch.num_rows, BOX))
            for k, x in enumerate(_vectors(batch.column(batch.schema.get_field_index("vector")))):
                x = unit(x[None])[0]
                x = (x @ held.value[:, :BOX] if len(x) == dim else x[:BOX]) if turned_any else x[:BOX]
                lead[k, : len(x)] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(lead.ravel(), BOX).cast(pa.list_(pa.float64()))], [*batch.schema.names, "lead"])

    turned_any = turned is not None
    values = nodes.agg(F.sum("dim")).first()[0] or 0
    rows = nodes.mapInArrow(run, "node long, label string, dim int, key binary, vector array<double>, copies long, low long, lead array<double>")
    order = ["label", "dim", F.col("lead")[0], "node"]
    rows = rows.repartitionByRange(max(1, -(-values // TILE_VALUES)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    folder = scratch_path(spark, "tiles")
    rows.select("label", "dim", "part", "node", "copies", "vector", "lead").write.parquet(folder)
    return spark.read.parquet(folder)


def _visits(tiles: DataFrame, similar: float) -> DataFrame:
    """(label, dim, part, home): which tiles visit which, where their boxes are near enough for a link."""
    bounds = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(BOX) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = checkpointed(tiles.groupBy("label", "dim", "part").agg(*bounds))
    other = boxes.select("label", "dim", *[F.col(c).alias(f"_{c}") for c in boxes.columns[2:]])
    apart = [F.greatest(F.col(f"low{k}") - F.col(f"_high{k}"), F.col(f"_low{k}") - F.col(f"high{k}"), F.lit(0.0)) for k in range(BOX)]
    near = sum((x * x for x in apart[1:]), apart[0] * apart[0]) <= 2 - 2 * similar + SLACK
    # of two tiles the smaller visits the larger one or the other way round, in turn, so that homes have equal loads
    one = F.when(F.col("part") < F.col("_part"), (F.col("part") + F.col("_part")) % 2 == 0).otherwise((F.col("part") + F.col("_part")) % 2 == 1)
    met = boxes.join(other, ["label", "dim"]).where((F.col("part") != F.col("_part")) & near & one)
    return met.select("label", "dim", "part", F.col("_part").alias("home"))


def near_duplicates(embeddings: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    keys = ["label", "dim", "key"]
    nodes = _keyed(embeddings, True).where("key is not null").groupBy(*keys).agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    folder = scratch_path(spark, "nodes")
    nodes.withColumn("node", F.monotonically_increasing_id()).write.parquet(folder)
    nodes = spark.read.parquet(folder).select("node", *keys, "vector", "copies", "low")
    dim, turned = rotation(nodes)

    tiles = _tiles(nodes, dim, turned)
    members = tiles.select("label", "dim", "part", F.lit(False).alias("visits"), "node", "copies", "vector")
    visitors = tiles.join(checkpointed(_visits(tiles, similar)), ["label", "dim", "part"]).select("label", "dim", F.col("home").alias("part"), F.lit(True).alias("visits"), "node", "copies", "vector")
    place = ["label", "dim", "part"]
    both = members.unionByName(visitors).repartition(*place).sortWithinPartitions(*place, "visits")
    found = checkpointed(_compared(both, dim, turned, similar))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    slim = nodes.select("node", *keys, "copies", "low").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = slim.groupBy("root").agg(F.min("low").alias("component_id"))
    per_node = checkpointed(slim.join(component, "root").select(*keys, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))

    rows = _keyed(embeddings, False).select("vec_id", *keys).join(per_node, keys, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = f"""
WITH RECURSIVE own AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings),
fit AS (SELECT * FROM own WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r, b.r AS s FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= {SIMILAR}),
reach AS (SELECT r, r AS s FROM own UNION SELECT reach.r, link.s FROM reach JOIN link ON reach.s = link.r),
component AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN own o ON o.r = reach.s GROUP BY reach.r),
degree AS (SELECT r, count(*) AS n FROM link GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept FROM own JOIN component USING (r) LEFT JOIN degree USING (r)
"""
