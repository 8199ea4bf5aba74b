"""Token ids as a compact binary table: an adaptive context-mixing range coder.

Format. A table of ids is a folder of Parquet files whose rows are *pages*. A page holds a run of whole
documents in ascending doc_id order, up to ``PAGE_IDS`` ids, or a piece of a longer document: part and page number, the position of its first id within the part,
the documents' ids and lengths, for pieces their number and the position of the document's first id (otherwise null), and ``payload``. A payload starts with ``MAGIC``, the bits of an id and the number of
blocks (little-endian uint32 each), then per block its ids, bytes and CRC-32 (of the ids as
little-endian uint32), then the blocks. A block has up to ``BLOCK_IDS`` ids and decodes on its own: every model starts anew in it. It holds
the lengths of its lanes' streams in words (little-endian uint16), then the streams (little-endian uint32).

Model. An id's share is mixed from three orders: what followed the same two ids, the same id, and any ids, by how often each id did in the block so far. A pair of ids that
is frequent has a table of its own, which counts as order 2 with the shares of order 1 as ``_VIRTUAL_IDS`` ids more. What a table leaves, the more the more different ids
it has for its count, is shared out by order 0, and there a share is left for ids that are new to the block, all of equal shares. All of it is integer arithmetic.

A block is coded in up to ``STEPS`` steps, in each of which all its lanes, runs of ``STEPS`` ids, code an id as NumPy vectors. Before the steps ``ROUNDS``
both sides make the tables anew from all ids of the steps before. The number of lanes is bounded by the page, whatever a document's length.

Words are found, and looked up by their distinct values, for a batch of texts at once.

Defined results: a null text has only the end id; rows with one doc_id are ordered by a hash of the text; null doc_ids
come first; a damaged block raises ValueError.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import BLOCK_CHARS, Codec, codec
from gridloom.llm.common import bounded_batches, str_texts

MAGIC = b"GLR3"
#: Ids of a block at most, the steps it is coded in, and those before which the tables are made anew.
BLOCK_IDS, STEPS, ROUNDS = 1 << 21, 512, (2, 8, 32, 128)
#: Ids of a page at most; a longer document takes pages of its own.
PAGE_IDS = 1 << 21
END_ID = 1
#: A code has 63 bits in a register, at least 31 of which are left for an id.
MOST_BITS = 26
#: Bits of the shares in a table and in order 0.
_BITS, _BITS0 = 12, 14
#: Ids, by count, with shares in tables and in order 0; tables of order 1 and of order 2.
_KNOWN, _KNOWN0, _TABLES1, _TABLES2 = 1 << 12, 1 << 13, 1 << 11, 1 << 11
#: How often an id or a pair comes that has a table of its own.
_OFTEN1, _OFTEN2 = 64, 1024
_VIRTUAL_IDS = 16
_U = np.uint64
_LOW, _WORD = _U(1 << 31), _U(32)
#: Rows of steps whose shares the encoder holds at a time.
_ROWS = 64

# The split pattern of the lower-case vocabulary, restricted to the characters of Latin-1.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
WORD_PATTERN = re.compile(f"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_S}{_L}{_N}]+")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KINDS = bytes(next((k for k, chars in ((_LETTER, _L), (_NUMBER, _N), (_SPACE, _S)) if re.match(f"[{chars}]", chr(b))), _OTHER) for b in range(256))
_SPACES = bytes(b for b in range(256) if _KINDS[b] == _SPACE)
#: Words in each of the two generations of a memo.
MEMO_WORDS = 1 << 18


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of WORD_PATTERN in a lower-case Latin-1 text start, and where they do with all white space taken out."""
    kinds = np.frombuffer(text.translate(_KINDS), np.uint8)
    seen = kinds != _SPACE
    begins = np.ones(len(kinds), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= kinds == _NUMBER
    begins &= seen
    # 's, 't, 're, 've, 'm, 'll and 'd, unless another sign comes just before
    codes = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((codes == ord("'")) & begins)
    at = at[at + 1 < len(codes)]
    one, two = codes[at + 1], np.where(at + 2 < len(codes), codes.take(at + 2, mode="clip"), 0)
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(np.isin(one, list(b"stmd")), 2, np.where(long, 3, 0))
    at, size = at[size > 0], size[size > 0]
    begins[at + 1] = False
    after = (at + size)[at + size < len(codes)]
    begins[after] = seen[after]
    starts = np.flatnonzero(begins)
    return starts, (np.cumsum(seen, dtype=np.int32)[starts] - 1).astype(np.int32)


class _Words(dict):
    """The ids of words as bytes. Of two generations the older is dropped when the younger is full, so that words in use stay."""

    def __init__(self, tool: Codec):
        self.tokenize, self.kind, self.older = tool.model.tokenize, tool.kind.char, {}
        self.shown = ["".join(tool.shown[b] for b in chr(c).encode()) for c in range(256)]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            shown = word.decode() if word.isascii() and word.isalpha() else "".join(map(self.shown.__getitem__, word))
            ids = array(self.kind, [t.id for t in self.tokenize(shown)]).tobytes()
        if len(word) < 256:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _words(tool: Codec) -> _Words:
    return _Words(tool)


def encode_texts(tool: Codec, words: _Words, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with an end id, and where each text's ids end."""
    odd = []
    try:
        latin = "\n".join(texts).lower().encode("latin-1")
    except UnicodeEncodeError:
        latin = b""
    if not latin or any(s.lower().encode() in latin for s in tool.specials):
        odd = [k for k, text in enumerate(texts) if not _plain(text, tool.specials)]
        plain = texts.copy()
        for k in odd:
            plain[k] = ""
        latin = "\n".join(plain).lower().encode("latin-1")
    else:
        plain = texts
    starts, places = word_bounds(latin)
    data = latin.translate(None, _SPACES)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(places, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    _, bounds, distinct = found.dictionary.buffers()
    bounds, distinct = np.frombuffer(bounds, np.int32, len(found.dictionary) + 1).tolist(), (distinct or b"") and distinct.to_pybytes()
    ids = [words[distinct[a:b]] for a, b in pairwise(bounds)]
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)) // tool.kind.itemsize, out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), tool.kind))).take(found.indices)
    ends = lists.offsets.to_numpy()[np.searchsorted(starts, np.cumsum([len(text) + 1 for text in plain]))]
    values = np.insert(lists.values.to_numpy(), ends, tool.kind.type(end_id))
    ends = ends + np.arange(1, len(texts) + 1)
    if odd:
        parts = np.split(values, ends[:-1])
        for k in odd:
            parts[k] = np.append(tool.encode(texts[k]), tool.kind.type(end_id))
        values, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    return values, ends


def _plain(text: str, specials: list[str]) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(s in text for s in specials)


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each comes."""
    keys = np.sort(keys)
    at = _begins(keys)
    return keys[at], np.diff(at, append=len(keys))


class _Tables:
    """Shares of ids, by the steps of a block so far.

    Ids have numbers by their count. Table 0 is for all rare ids, the next ones are for the frequent ids, and then come those for pairs of them. A table's entries are in the
    order of their ids' numbers; the last one, of number _KNOWN, is what it leaves to order 0.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.number = np.zeros(1 << bits, np.int32)  # one more than it; 0: none
        self.ids = np.zeros(0, np.int32)
        self.learn(np.zeros((0, 1), np.int32))

    def learn(self, grid: np.ndarray) -> None:
        """Makes all tables from a row of ids for each step."""
        self.number[self.ids] = 0
        if self.bits <= 18:
            counts = np.bincount(grid.ravel(), minlength=1 << self.bits)
            ids = np.flatnonzero(counts)
            counts = counts[ids]
        else:
            ids, counts = _runs(grid.ravel())
        order = np.argsort(-counts, kind="stable")[:_KNOWN0]
        self.ids, counts = ids[order].astype(np.int32), counts[order]
        known = len(order)
        self.number[self.ids] = np.arange(1, known + 1)
        # order 0; the last share is that of new ids
        once = (1 << _BITS0) // 2 * int((counts == 1).sum()) // max(1, grid.size)
        share = 1 + counts * ((1 << _BITS0) - 64 - known - min(once, 1 << (_BITS0 - 2))) // max(1, grid.size)
        self.start0 = np.concatenate([[0], np.cumsum(share)]).astype(_U)
        self.share0 = np.append(share, (1 << _BITS0) - share.sum()).astype(_U)
        self.contexts = min(_TABLES1, int(np.searchsorted(-counts, -_OFTEN1, "right")))
        row = self.numbers(grid)
        first = self.first(row)
        self.second = np.zeros((self.contexts + 1) * (self.contexts + 1), np.int16)
        usual = row[1:] < _KNOWN
        key, n = _runs((first[:-1] * np.int32(_KNOWN) + row[1:])[usual & (first[:-1] > 0)])
        context, succ = key // _KNOWN, key % _KNOWN
        total = np.bincount(first[:-1].ravel(), minlength=self.contexts + 1) + np.bincount(context, minlength=self.contexts + 1)
        share = n * ((1 << _BITS) - 1) // total[context]
        often = np.flatnonzero((n >= _OFTEN2) & (succ < self.contexts))
        often = often[np.argsort(-n[often], kind="stable")[:_TABLES2]]
        if len(often):
            self.second[context[often] * (self.contexts + 1) + succ[often] + 1] = np.arange(1, len(often) + 1)
            pair = self.second.take(first[:-2] * np.int32(self.contexts + 1) + first[1:-1])
            found = (pair > 0) & usual[1:]
            key2, n2 = _runs((pair * np.int32(_KNOWN) + row[2:])[found])
            # with the shares of order 1, which count as some ids more
            unit = (1 << _BITS) // _VIRTUAL_IDS
            ends = np.searchsorted(context, np.arange(self.contexts + 2))
            own = succ[often] + 1
            size = ends[own + 1] - ends[own]
            place = np.arange(size.sum()) + np.repeat(ends[own] - np.cumsum(size) + size, size)
            mixed = np.concatenate([key2, np.repeat(np.arange(1, len(often) + 1), size) * _KNOWN + succ[place]])
            weight = np.concatenate([n2 * unit, share[place]])
            order = np.argsort(mixed, kind="stable")
            at = _begins(mixed[order])
            mixed, weight = mixed[order][at], np.add.reduceat(weight[order], at)
            total = np.bincount(pair.ravel(), minlength=len(often) + 1) * unit + (1 << _BITS)
            share2 = weight * ((1 << _BITS) - 1) // total[mixed // _KNOWN]
            context, succ, share = np.append(context, mixed // _KNOWN + self.contexts), np.append(succ, mixed % _KNOWN), np.append(share, share2)
        kept = share > 0
        context, succ, share = context[kept], succ[kept], share[kept]
        n = self.contexts + 1 + len(often)
        rest = (1 << _BITS) - np.bincount(context, share, n).astype(np.int64)
        ends = np.searchsorted(context, np.arange(n), "right")
        self.table, self.succ = np.insert(context, ends, np.arange(n)), np.insert(succ, ends, _KNOWN)
        self.rest = ends + np.arange(n)
        share = np.insert(share, ends, rest)
        self.share = share.astype(_U)
        self.start = (np.cumsum(share) - share - (self.table << _BITS)).astype(_U)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """The ids' numbers; that of order 0's last share for new ones."""
        found = self.number.take(ids) - 1
        found[found < 0] = len(self.ids)
        return found

    def first(self, numbers: np.ndarray) -> np.ndarray:
        """The tables of order 1 after ids of these numbers."""
        return np.where(numbers < self.contexts, numbers + 1, 0)

    def after(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The tables after two ids, by the tables of order 1 after each of them."""
        pair = self.second.take(before * (self.contexts + 1) + last).astype(np.int32)
        return np.where(pair > 0, pair + self.contexts, last)


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps and the last lane's steps of a block of n ids."""
    lanes = -(-n // STEPS)
    return lanes, min(n, STEPS), n - (lanes - 1) * STEPS


def _rounds(steps: int) -> Iterator[tuple[int, int]]:
    edges = [0, *(r for r in ROUNDS if r < steps), steps]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _shares(tables: _Tables, entries: np.ndarray, grid: np.ndarray, begun: int, ended: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and width of the shares of the ids of some steps, and which of them are new. entries: one more than the entry, by table and number."""
    numbers = tables.numbers(grid[max(0, begun - 2) : ended])
    first = tables.first(numbers)
    first = np.concatenate([np.zeros((max(0, 2 - begun), grid.shape[1]), first.dtype), first])
    numbers = numbers[min(2, begun) :]
    table = tables.after(first[:-2], first[1:-1])
    entry = entries.take(table * _KNOWN + np.minimum(numbers, _KNOWN - 1)) - 1
    missed = (entry < 0) | (numbers >= _KNOWN)
    entry[missed] = tables.rest[table[missed]]
    start, share = tables.start.take(entry) << _U(_BITS0), tables.share.take(entry)
    left, number = share[missed], numbers[missed]
    share <<= _U(_BITS0)
    start[missed] += tables.start0.take(number) * left
    share[missed] = tables.share0.take(number) * left
    return start, share, numbers == len(tables.ids)


def _encode_block(ids: np.ndarray, bits: int) -> bytes:
    lanes, steps, last = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, _U), np.full(lanes, 1 << 63, _U)
    width = steps * (_BITS + _BITS0 + bits) // 32 + 8
    out, place = np.zeros(lanes * width, "<u4"), np.arange(lanes) * width

    def emit(at: np.ndarray) -> None:
        word, to = low[at] >> _U(31), place[at]
        out[to] = word.astype(np.uint32)
        place[at] = to + 1
        to = to[word > _U(0xFFFFFFFF)]
        while len(to):
            # a carry into the words before
            to = to - 1
            out[to] += np.uint32(1)
            to = to[out[to] == 0]
        low[at] = (low[at] & (_LOW - _U(1))) << _WORD
        span[at] <<= _WORD

    tables = _Tables(bits)
    for begun, ended in _rounds(steps):
        if begun:
            tables.learn(grid[:begun])
        entries, own = np.zeros(len(tables.rest) * _KNOWN, np.int32), np.flatnonzero(tables.succ < _KNOWN)
        entries[tables.table[own] * _KNOWN + tables.succ[own]] = own + 1
        for t in range(begun, ended):
            row = (t - begun) % _ROWS
            if not row:
                start, share, fresh = _shares(tables, entries, grid, t, min(t + _ROWS, ended))
            n = lanes if t < last else lanes - 1
            unit = span[:n] >> _U(_BITS + _BITS0)
            low[:n] += unit * start[row, :n]
            np.multiply(unit, share[row, :n], out=span[:n])
            emit(np.flatnonzero(span[:n] < _LOW))
            new = np.flatnonzero(fresh[row, :n])
            if len(new):
                unit = span[new] >> _U(bits)
                low[new] += unit * grid[t, new].astype(_U)
                span[new] = unit
                emit(new[unit < _LOW])
    # one word more tells the streams' ends
    low += _LOW - _U(1)
    emit(np.arange(lanes))
    sizes = place - np.arange(lanes) * width
    return sizes.astype("<u2").tobytes() + out.reshape(lanes, width)[np.arange(width) < sizes[:, None]].tobytes()


def encode_ids(ids: np.ndarray, bits: int) -> bytes:
    """The payload of a run of ids below 2 ** bits."""
    if bits > MOST_BITS:
        raise ValueError(f"ids need more than {MOST_BITS} bits")
    ids = np.asarray(ids)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << bits:
        raise ValueError(f"an id is outside 0 to {(1 << bits) - 1}")
    parts = [ids[at : at + BLOCK_IDS].astype("<u4") for at in range(0, len(ids), BLOCK_IDS)]
    streams = [_encode_block(part.astype(np.int32), bits) for part in parts]
    index = b"".join(struct.pack("<III", len(part), len(s), zlib.crc32(part)) for s, part in zip(streams, parts, strict=True))
    return MAGIC + struct.pack("<II", bits, len(parts)) + index + b"".join(streams)


def _decode_block(stream: bytes, n_ids: int, bits: int) -> np.ndarray:
    lanes, steps, last = _shape(n_ids)
    sizes = np.frombuffer(stream, "<u2", lanes).astype(np.int64)
    if 2 * lanes + 4 * int(sizes.sum()) != len(stream):
        raise ValueError("a block of ids is damaged")
    width = int(sizes.max()) + 3
    words = np.zeros((lanes, width), _U)
    words[np.arange(width) < sizes[:, None]] = np.frombuffer(stream, "<u4", -1, 2 * lanes)
    # a register has 63 bits, so all words after the first are taken a bit late
    code = (words[:, 0] << _U(31)) | (words[:, 1] >> _U(1))
    words = words.ravel()
    words[:-1] = ((words[:-1] & _U(1)) << _U(31)) | (words[1:] >> _U(1))
    span, place = np.full(lanes, 1 << 63, _U), np.arange(lanes) * width + 1
    grid = np.zeros((steps, lanes), np.int32)

    def take(at: np.ndarray) -> None:
        to = place[at]
        code[at] = (code[at] << _WORD) | words.take(to, mode="clip")
        span[at] <<= _WORD
        place[at] = to + 1

    def value(code: np.ndarray, unit: np.ndarray, bits: int) -> np.ndarray:
        # beyond the shares only in a damaged block; its checksum tells
        return np.minimum(code // unit, _U((1 << bits) - 1))

    tables, before, first = _Tables(bits), np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for begun, ended in _rounds(steps):
        if begun:
            tables.learn(grid[:begun])
            before, first = (tables.first(tables.numbers(row)) for row in grid[begun - 2 : begun])
        slots = np.repeat(np.arange(len(tables.share), dtype=np.int32), tables.share.astype(np.int64))
        slots0 = np.repeat(np.arange(len(tables.share0), dtype=np.int32), tables.share0.astype(np.int64))
        ids, rest = np.append(tables.ids, np.int32(0)), tables.succ == _KNOWN
        entry_ids, entry_first = ids.take(np.where(rest, 0, tables.succ)), tables.first(tables.succ).astype(np.int32)
        for t in range(begun, ended):
            n = lanes if t < last else lanes - 1
            unit = span[:n] >> _U(_BITS + _BITS0)
            found = value(code[:n], unit, _BITS + _BITS0)
            entry = slots.take(tables.after(before[:n], first[:n]) * (1 << _BITS) + (found >> _U(_BITS0)).astype(np.int32))
            start, share = tables.start.take(entry) << _U(_BITS0), tables.share.take(entry) << _U(_BITS0)
            row, now = entry_ids.take(entry), entry_first.take(entry)
            missed = np.flatnonzero(rest.take(entry))
            left = share[missed] >> _U(_BITS0)
            number = slots0.take(((found[missed] - start[missed]) // left).astype(np.int32))
            start[missed] += tables.start0.take(number) * left
            share[missed] = tables.share0.take(number) * left
            row[missed], now[missed] = ids.take(number), tables.first(number)
            code[:n] -= unit * start
            np.multiply(unit, share, out=span[:n])
            take(np.flatnonzero(span[:n] < _LOW))
            new = missed[number == len(tables.ids)]
            if len(new):
                unit = span[new] >> _U(bits)
                found = value(code[new], unit, bits)
                row[new] = found.astype(np.int32)
                code[new] -= unit * found
                span[new] = unit
                take(new[unit < _LOW])
            grid[t, :n] = row
            before, first = first, now
    return grid.T.reshape(-1)[:n_ids]


def decode_ids(payload: bytes) -> np.ndarray:
    """The ids of a payload; raises ValueError where a block's checksum fails."""
    if payload[:4] != MAGIC or len(payload) < 12:
        raise ValueError("not a payload of this format")
    bits, count = struct.unpack_from("<II", payload, 4)
    at, found = 12 + 12 * count, [np.zeros(0, np.int32)]
    if bits > MOST_BITS or at + sum(struct.unpack_from("<I", payload, k)[0] for k in range(16, min(at, len(payload) - 4), 12)) != len(payload):
        raise ValueError("the blocks of a payload are damaged")
    for k in range(count):
        n, size, crc = struct.unpack_from("<III", payload, 12 + 12 * k)
        if n > BLOCK_IDS:
            raise ValueError("a block of ids is damaged")
        ids = _decode_block(payload[at : at + size], n, bits)
        at += size
        if zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("a block of ids is damaged")
        found.append(ids)
    return np.concatenate(found)


_PAGES = "part int, page int, start long, doc_ids array<long>, lengths array<int>, piece int, first long, payload binary"
_PAGES_ARROW = pa.schema(
    [("part", pa.int32()), ("page", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("piece", pa.int32()), ("first", pa.int64()), ("payload", pa.binary())]
)


def _page_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, WORD_PATTERN, True)
        bits = max(1, int(tool.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        part, page, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def row(doc_ids: list, parts: list[np.ndarray], piece: int | None = None, first: int | None = None) -> pa.RecordBatch:
            nonlocal page, start
            payload, lengths = encode_ids(np.concatenate(parts), bits), [len(p) for p in parts]
            values = [[part], [page], [start], [doc_ids], [lengths], [piece], [first], [payload]]
            page, start = page + 1, start + sum(lengths)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _PAGES_ARROW, strict=True)], schema=_PAGES_ARROW)

        for batch in filter(len, batches):
            values, ends = encode_texts(tool, _words(tool), str_texts(batch.column(1)), end_id)
            for doc_id, ids in zip(batch.column(0).to_pylist(), np.split(values, ends[:-1]), strict=True):
                if parts and held + len(ids) > PAGE_IDS:
                    yield row(doc_ids, parts)
                    doc_ids, parts, held = [], [], 0
                if len(ids) > PAGE_IDS:
                    first = start
                    for piece, at in enumerate(range(0, len(ids), PAGE_IDS)):
                        yield row([doc_id], [ids[at : at + PAGE_IDS]], piece, first)
                    continue
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield row(doc_ids, parts)

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encodes the texts with the vocabulary file ``path`` and writes their ids to ``folder``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ordered.mapInArrow(_page_batches(path, end_id), _PAGES).write.mode("errorifexists").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of a written folder; start counts the ids of all documents before."""
    pages = spark.read.parquet(folder)
    # one total per written part comes to the driver
    totals = pages.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    offsets, at = [], 0
    for row in totals:
        offsets.append((row["part"], at))
        at += row["n"]
    parts = spark.createDataFrame(offsets, "part int, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, lengths, piece, payload in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = decode_ids(payload)
                ends = np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise ValueError("a page's lengths don't match its ids")
                bounds = np.concatenate([[0], ends])
                step = 0
                while step < len(doc_ids):
                    stop = max(step + 1, int(np.searchsorted(bounds, bounds[step] + BLOCK_CHARS, "right")) - 1)
                    stop = min(stop, len(doc_ids))
                    lists = pa.ListArray.from_arrays(pa.array((bounds[step : stop + 1] - bounds[step]).astype(np.int32)), pa.array(ids[bounds[step] : bounds[stop]]))
                    columns = [pa.array(doc_ids[step:stop], pa.int64()), pa.array(first + bounds[step:stop], pa.int64()), pa.array([piece] * (stop - step), pa.int32()), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "piece", "ids"])
                    step = stop

    def decoded(chosen: DataFrame) -> DataFrame:
        placed = chosen.join(parts, "part").select((F.coalesce("first", "start") + F.col("offset")).alias("start"), "doc_ids", "lengths", "piece", "payload")
        return placed.mapInArrow(run, "doc_id long, start long, piece int, ids array<int>")

    pieces = decoded(pages.where("piece is not null")).groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("x"))
    long = pieces.select("doc_id", "start", F.flatten("x.ids").alias("ids"))
    return decoded(pages.where("piece is null")).select("doc_id", "start", "ids").unionByName(long)


def digest(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_ids gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, offsets = column.values.to_numpy().astype("<u4"), column.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return ids.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
