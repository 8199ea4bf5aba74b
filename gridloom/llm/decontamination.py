"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of lower-cased words. Karp-Rabin hashes of all runs of
``MIN_MATCH`` words (seeds) join documents with the items that share some; for each such pair tiling marks the longest
match that is still unmarked on both sides, again and again. Of matches of one length the first in the document goes first, then
the first in the item. An item is found in a document if the tiles cover ``min_coverage`` of its words, in
whatever order its parts come.

Every step is a join or a pass in tasks. A Bloom filter of the items' seeds, whose size is bounded whatever the benchmark's size, tells
the scan of the documents which seeds to keep; only those, not texts, are moved. An item needs so many of its seeds in a
document that one of its rarest must be among them (prefix filtering), so frequent seeds join nothing. Texts that
repeat are tiled once.

A seed is two independent 64-bit hashes; seeds are equal if both are.

Defined results: null and empty texts contain nothing; items with fewer than ``MIN_MATCH`` words are never found; a
repeated item_id or doc_id gives rows of its own; an empty benchmark gives an empty result; other columns, whatever their
names, pass through drop_contaminated().
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, bounded_batches, checkpointed, packed, unpacked

MIN_MATCH = 5
MIN_COVERAGE = 0.8
#: Bits of the Bloom filter for each seed, and its least and greatest size as powers of two (2 ** 29 bits are 64 MB).
BLOOM_BITS, BLOOM_LEAST, BLOOM_MOST = 24, 16, 29
_WORD = re.compile(r"[^\W_]+")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MEMO_WORDS = 1 << 18


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Memo(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Memo()


def word_codes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_CODES.__getitem__, found), np.uint64, len(found))


def seeds(codes: np.ndarray, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Karp-Rabin hash of each run of MIN_MATCH words, given the words' hashes."""
    n = len(codes) - MIN_MATCH + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(MIN_MATCH if n > 0 else 0):
        out = out * base + codes[k : k + n]
    return out


def needed(n_words: int, min_coverage: float) -> int:
    """Seeds of an item of n words that a document must have: tiles of MIN_MATCH words give one seed each, longer ones more for their length."""
    covered = next((c for c in range(n_words + 1) if c >= min_coverage * n_words), n_words + 1)
    return max(1, -(-covered // MIN_MATCH))


# --- tiling --------------------------------------------------------------------------------------------------------------------


class _Automaton:
    """Suffix automaton of the free runs of an item's seeds; knows where each substring ends first."""

    def __init__(self, runs: list[tuple[int, list]]):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        for start, run in runs:
            last = 0
            for k, symbol in enumerate(run):
                last = self._extend(last, symbol, start + k)

    def _state(self, length: int, first: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state of the shorter substrings of q, which p reaches."""
        clone = self._state(self.length[p] + 1, self.first[q], self.next[q].copy())
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, symbol, end: int) -> int:
        q = self.next[p].get(symbol)
        if q is not None:
            # only for a run after the first: what stands there already
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        new = self._state(self.length[p] + 1, end, {})
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def matches(self, start: int, run: list) -> Iterator[tuple[int, int, int]]:
        """(length, start in run, start in item) of the longest match that ends at each place where it can't go on."""
        state, n = 0, 0
        for k, symbol in enumerate(run):
            before, at = n, state
            while state and symbol not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(symbol, 0)
            n = n + 1 if state else 0
            if before and n != before + 1:
                yield before, start + k - before, self.first[at] - before + 1
        if n:
            yield n, start + len(run) - n, self.first[state] - n + 1


def _free_runs(places: list[int], symbols: list, taken: set[int]) -> list[tuple[int, list]]:
    """Runs of seeds at consecutive places none of whose words is taken: (first place, seeds)."""
    runs: list[tuple[int, list]] = []
    before = -2
    for place, symbol in zip(places, symbols, strict=True):
        if taken and any(place + k in taken for k in range(MIN_MATCH)):
            continue
        if place != before + 1:
            runs.append((place, []))
        runs[-1][1].append(symbol)
        before = place
    return runs


def tile(places: list[int], doc: list, item: list) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, words).

    doc: a document's seeds that may match, at the given places; item: all seeds of the item.
    """
    in_doc, in_item, tiles = set(), set(), []
    wanted = set(item)
    kept = [(p, s) for p, s in zip(places, doc, strict=True) if s in wanted]
    places, doc = [p for p, _ in kept], [s for _, s in kept]
    while True:
        automaton = _Automaton(_free_runs(list(range(len(item))), item, in_item))
        heap = [(-n, d, i) for start, run in _free_runs(places, doc, in_doc) for n, d, i in automaton.matches(start, run)]
        if not heap:
            return tiles
        heapq.heapify(heap)
        # lengths only shrink as words are taken, so the first of the heap is the longest match while it is free;
        # once it isn't, what is left of it is found anew
        while heap:
            n, d, i = heapq.heappop(heap)
            n = MIN_MATCH - 1 - n
            doc_words, item_words = range(d, d + n), range(i, i + n)
            if not (in_doc.isdisjoint(doc_words) and in_item.isdisjoint(item_words)):
                break
            tiles.append((d, i, n))
            in_doc.update(doc_words)
            in_item.update(item_words)
        else:
            return tiles


# --- joins ---------------------------------------------------------------------------------------------------------------------

def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def _items(benchmark: DataFrame, min_coverage: float) -> DataFrame:
    """(item, item_id, item_words, needed, a, b): an item's seeds as two arrays; item is a number of its own for each row."""
    schema = pa.schema([("item_id", pa.int64()), ("item_words", pa.int32()), ("needed", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = word_codes(text)
                if len(codes) >= MIN_MATCH:
                    rows.append((item_id, len(codes), needed(len(codes), min_coverage), *(_signed(seeds(codes, base)) for base in _BASES)))
            yield batch_of(schema, list(zip(*rows, strict=True)) or [[]] * 5)

    found = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, item_words int, needed int, a array<long>, b array<long>")
    return checkpointed(found.withColumn("item", F.monotonically_increasing_id()))


def _bloom(items: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each seed's first hash, in 64-bit words, and the shift that gives a hash's place. Its size follows the seeds up to 2 ** BLOOM_MOST bits."""
    total = items.agg(F.sum(F.size("a").cast("long")).alias("n")).first()["n"] or 0
    power = min(max((total * BLOOM_BITS).bit_length(), BLOOM_LEAST), BLOOM_MOST)
    places = items.select(F.explode("a").alias("h")).select(F.expr(f"shiftrightunsigned(h, {64 - power})").alias("place"))
    by_word = places.groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    found = by_word.toArrow()
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64), 64 - power


def _hits(docs: DataFrame, bits: np.ndarray, shift: int) -> DataFrame:
    """(key, places, a, b) of each different text: its seeds that may be an item's. key stands for the text."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("key", pa.binary()), ("places", pa.list_(pa.int32())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = word_codes(text)
                found = seeds(codes)
                at = found >> np.uint64(shift)
                places = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                if len(places):
                    rows.append((key, places.astype(np.int32), _signed(found[places]), _signed(seeds(codes, _BASES[1])[places])))
            yield batch_of(schema, list(zip(*rows, strict=True)) or [[]] * 4)

    rows = docs.where("text is not null").select(_key(), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "key binary, places array<int>, a array<long>, b array<long>")
    return checkpointed(found.groupBy("key").agg(F.first(F.struct("places", "a", "b")).alias("x")).select("key", "x.*"))


def _key():
    return F.unhex(F.md5(F.col("text").cast("string"))).alias("key")


def _seeds(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each seed of the arrays a and b."""
    return rows.select(*columns, F.posexplode(F.arrays_zip("a", "b")).alias("place", "seed"))


def _candidates(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item): the pairs that may share enough seeds."""
    of_docs = _seeds(hits, "key").select("key", "seed").distinct()
    often = of_docs.groupBy("seed").agg(F.count("*").alias("often"))
    of_items = _seeds(items, "item", "item_words", "needed").join(often, "seed")
    # places whose seed is in no document can't be among those needed, so they count as the rarest, first
    lost = F.col("item_words") - (MIN_MATCH - 1) - F.size("x")
    rarest = of_items.groupBy("item", "item_words", "needed").agg(F.sort_array(F.collect_list(F.struct("often", "seed", "place"))).alias("x"))
    length = F.col("item_words") - (MIN_MATCH - 1) - F.col("needed") + 1 - lost
    rarest = rarest.where(length > 0).select("item", F.explode(F.slice("x", F.lit(1), length)).alias("x")).select("item", "x.seed").distinct()
    return of_docs.join(rarest, "seed").select("key", "item").distinct()


_TILED = "key binary, item_id long, item_words int, covered_words int, tiles int"


def _found(docs: DataFrame, benchmark: DataFrame, min_coverage: float) -> DataFrame:
    """(key, item_id, item_words, covered_words, tiles) of every different text and item that is found in it."""
    bounded_batches(docs.sparkSession)
    items = _items(benchmark, min_coverage)
    hits = _hits(docs, *_bloom(items))
    pairs = _candidates(hits, items).join(items.withColumnsRenamed({"a": "item_a", "b": "item_b"}), "item").join(hits, "key")
    pairs = pairs.select("key", "item_id", "item_words", "places", "a", "b", "item_a", "item_b")
    schema = pa.schema([("key", pa.binary()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()), ("tiles", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                key, item_id, n, places, a, b, item_a, item_b = (batch.column(c)[k].as_py() for c in range(8))
                tiles = tile(places, list(zip(a, b, strict=True)), list(zip(item_a, item_b, strict=True)))
                covered = sum(t[2] for t in tiles)
                if covered >= min_coverage * n:
                    rows.append((key, item_id, n, covered, len(tiles)))
            yield batch_of(schema, list(zip(*rows, strict=True)) or [[]] * 5)

    return checkpointed(pairs.mapInArrow(run, _TILED))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per document and item that is found in it."""
    found = _found(docs, benchmark, min_coverage)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _key())
    return rows.join(found, "key").select("doc_id", "item_id", "item_words", "covered_words", "tiles", (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents of ``docs`` in which no item is found; all columns stay."""
    found = _found(docs, benchmark, min_coverage).select("key").distinct()
    rows = packed(docs, "text").withColumn("_key", F.coalesce(_key(), F.lit(b"")))
    return unpacked(rows.join(found, F.col("_key") == F.col("key"), "left_anti"), docs.columns, ["text"])
