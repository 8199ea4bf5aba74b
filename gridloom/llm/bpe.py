"""BPE encoding and decoding with tree concatenation of long texts.

Encoding gives the ids that the tokenizers library gives for the whole text with a byte-level BPE
vocabulary file and no special tokens added. Words recur, so the library's result for a pre-token is
kept in a bounded per-task memo; texts outside Latin-1 or with special token strings go to the library whole.

Texts above ``LONG_CHARS`` are cut into leaves which are encoded as rows of their own in parallel and
then concatenated. Between a non-space and a space every pre-tokenisation has a boundary, so a cut there
needs no further work. Text that has no such place for ``LEAF_CHARS`` ("unsplit") is cut in half, and in
half again; the halves' ids are joined bottom-up: a window around the join is encoded again and grown
until its tokens agree with two neighbouring tokens of the left half and with two of the right half. A
sequence is the BPE encoding of its text if every neighbouring pair is, so the splice through
the agreed pairs is exact.

Defined results: a null text counts as empty and has no ids, null ids decode to an empty text; repeated rows stay repeated rows; columns other than
the text pass through whatever their names, but those named ids and decoded, which are replaced. A text that holds the string of a special token gets that token's id, as in the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, ddl, packed, quoted, unpacked

LONG_CHARS = 1 << 15
LEAF_CHARS = 1 << 14
#: Bytes on each side of a join in the first window.
FIRST_WINDOW = 64
MEMO_WORDS = 1 << 18
#: Text handed to the library, and put into one Arrow batch, at a time.
BLOCK_CHARS = 1 << 18

# The byte-level pre-token pattern, restricted to the characters of Latin-1.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_PATTERN = re.compile(f" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_SPLIT = re.compile(r"(?<=\S)(?=\s)")


class Codec:
    """One vocabulary file.

    ``pattern`` must give the pre-tokens of Latin-1 texts (lower-cased first if ``lower``) just as the file's own rules do.
    """

    def __init__(self, path: str, pattern: re.Pattern = LATIN_PATTERN, lower: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.pattern, self.lower = pattern, lower
        self.specials = [t["content"] for t in json.loads(self.library.to_str())["added_tokens"]]
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.model = self.library.model
        self.shown = dict(enumerate(_byte_chars()))
        byte_of = {c: b for b, c in self.shown.items()}
        self.pieces = [b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in self.library.id_to_token(i) or "") for i in range(size)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = _Memo(self._word)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token, by the library's model alone: its characters stand for bytes already."""
        shown = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.model.tokenize(shown)], self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        try:
            text.encode("latin-1")
            plain = not any(s in text for s in self.specials)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return self._whole(text)
        words = self.pattern.findall(text.lower() if self.lower else text)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), self.kind)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64).tolist()
        try:
            return b"".join(map(self.pieces.__getitem__, ids)).decode()
        except (UnicodeDecodeError, IndexError):
            return self.library.decode(ids, skip_special_tokens=False)


class _Memo(dict):
    """The ids of words as bytes, so that a text's ids are one join."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self.make(word)
        if len(word) < 256:
            self[word] = ids
        return ids


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def codec(path: str, pattern: re.Pattern = LATIN_PATTERN, lower: bool = False) -> Codec:
    return Codec(path, pattern, lower)


def leaves(text: str, specials: list[str], size: int) -> list[tuple[str, bool]]:
    """Pieces of ``text`` of about ``size`` characters, each with whether its left edge cuts unsplit text."""
    found: list[tuple[str, bool]] = []
    start = 0
    for held in _runs(text, specials, size):
        found += _halves(text[start:held], specials, size, False)
        start = held
    return found + _halves(text[start:], specials, size, False)


def _runs(text: str, specials: list[str], size: int) -> Iterator[int]:
    """Safe cuts, at least ``size`` characters apart where the text allows."""
    at = size
    while at < len(text):
        m = _SPLIT.search(text, at)
        if not m:
            return
        cut = m.start()
        if not any(_inside(text, cut, s) for s in specials):
            yield cut
            at = cut + size
        else:
            at = cut + 1


def _inside(text: str, cut: int, special: str) -> bool:
    found = text.find(special, max(0, cut - len(special) + 1), cut + len(special) - 1)
    return 0 <= found < cut


def _halves(text: str, specials: list[str], size: int, cut: bool) -> list[tuple[str, bool]]:
    if len(text) <= 2 * size:
        return [(text, cut)]
    middle = len(text) // 2
    for s in specials:
        if _inside(text, middle, s):
            middle = text.find(s, max(0, middle - len(s) + 1))
    if not 0 < middle < len(text):
        return [(text, cut)]
    return _halves(text[:middle], specials, size, cut) + _halves(text[middle:], specials, size, True)


def join_halves(left: list[int], right: list[int], lengths: np.ndarray, pieces: list[bytes], encode: Callable[[str], list[int]], window: int = FIRST_WINDOW) -> list[int]:
    """Ids of the concatenated text, given the ids of its halves."""
    if not left or not right:
        return left + right
    lefts = np.concatenate([[0], np.cumsum(lengths[left])])
    rights = lefts[-1] + np.concatenate([[0], np.cumsum(lengths[right])])
    seam, end = int(lefts[-1]), int(rights[-1])
    while True:
        i = max(0, int(np.searchsorted(lefts, seam - window, "right")) - 1)
        while i and pieces[left[i]][0] & 0xC0 == 0x80:
            i -= 1
        j = min(len(right), int(np.searchsorted(rights, seam + window)))
        while j < len(right) and pieces[right[j]][0] & 0xC0 == 0x80:
            j += 1
        again = encode(b"".join(pieces[t] for t in chain(left[i:], right[:j])).decode())
        starts = int(lefts[i]) + np.concatenate([[0], np.cumsum(lengths[again])])
        at = {int(s): k for k, s in enumerate(starts)}
        from_left = (i, 0) if i == 0 else next(((k, at[s]) for k in range(len(left) - 1, i, -1) if (n := at.get(s := int(lefts[k]))) and again[n - 1 : n + 1] == left[k - 1 : k + 1]), None)
        to_right = (j, len(again)) if j == len(right) else next(((k, at[s]) for k in range(1, j) if (n := at.get(s := int(rights[k]))) and again[n - 1 : n + 1] == right[k - 1 : k + 1]), None)
        if from_left and to_right and from_left[1] <= to_right[1]:
            return left[: from_left[0]] + again[from_left[1] : to_right[1]] + right[to_right[0] :]
        if i == 0 and j == len(right):
            return again
        window = min(2 * window, end)


def concatenate(parts: list[np.ndarray], cuts: list[bool], tool: Codec, window: int = FIRST_WINDOW) -> list[int]:
    """Joins neighbouring leaves pairwise, level by level. cuts: whether a leaf's left edge cuts unsplit text."""
    parts = [np.asarray(p).tolist() for p in parts]
    own = lambda text: tool.encode(text).tolist()
    while len(parts) > 1:
        merged, edges = [], []
        for k in range(0, len(parts), 2):
            if k + 1 == len(parts):
                merged.append(parts[k])
            elif cuts[k + 1]:
                merged.append(join_halves(parts[k], parts[k + 1], tool.lengths, tool.pieces, own, window))
            else:
                merged.append(parts[k] + parts[k + 1])
            edges.append(cuts[k])
        parts, cuts = merged, edges
    return parts[0] if parts else []


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ids (array<int>) in place of the text column.

    path: the vocabulary file; every worker must be able to read it there.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    rows = packed(docs, text).select("_row", F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("_text"))
    short = _map_text(rows.where(F.length("_text") <= LONG_CHARS), lambda tool, t: tool.encode(t), path)
    long = rows.where(F.length("_text") > LONG_CHARS).withColumn("_key", F.monotonically_increasing_id())
    cut = long.mapInArrow(_leaf_batches(path), f"_key long, _leaf int, _cut boolean, _text string, _row {_row_type(rows)}")
    cut = cut.repartition(F.col("_key"), F.col("_leaf"))
    encoded = cut.mapInArrow(_encode_leaves(path), f"_key long, _leaf int, _cut boolean, ids array<int>, _row {_row_type(rows)}")
    whole = encoded.groupBy("_key").applyInArrow(_join_leaves(path), f"ids array<int>, _row {_row_type(rows)}")
    return unpacked(short.unionByName(whole), kept, [], "ids")


def _row_type(rows: DataFrame) -> str:
    return ddl(rows.schema["_row"].dataType)


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK_CHARS of text each."""
    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= BLOCK_CHARS:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _ids_array(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


def _map_text(rows: DataFrame, act: Callable[[Codec, str], list[int]], path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in blocks(batch, 1):
                ids = _ids_array([act(tool, t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids, part.column(0)], ["ids", "_row"])

    return rows.mapInArrow(run, f"ids array<int>, _row {_row_type(rows)}")


def _leaf_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = codec(path).specials
        for batch in batches:
            for k in range(batch.num_rows):
                found = leaves(batch.column("_text")[k].as_py(), specials, LEAF_CHARS)
                n = len(found)
                key, row = batch.column("_key").take([k] * n), batch.column("_row").take([k] * n)
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(range(n), pa.int32()), pa.array([c for _, c in found]), pa.array([t for t, _ in found], pa.string()), row], ["_key", "_leaf", "_cut", "_text", "_row"]
                )

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in blocks(batch, 3):
                ids = _ids_array([tool.encode(t) for t in part.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_leaf"), part.column("_cut"), ids, part.column("_row")], ["_key", "_leaf", "_cut", "ids", "_row"])

    return run


def _join_leaves(path: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_leaf").combine_chunks()
        ids = concatenate(_lists(table.column("ids").chunk(0)), table.column("_cut").to_pylist(), codec(path))
        return pa.Table.from_arrays([_ids_array([np.array(ids, np.int32)]), table.column("_row").slice(0, 1)], ["ids", "_row"])

    return run


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded (string) appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [tool.decode(x) for x in _lists(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["_ids", "_row", "decoded"])

    rows = packed(encoded, ids).select(F.coalesce(F.col(quoted(ids)), F.array().cast("array<int>")).alias("_ids"), "_row")
    decoded = rows.mapInArrow(run, f"_ids array<int>, _row {_row_type(rows)}, decoded string").withColumnRenamed("_ids", ids)
    return unpacked(decoded, encoded.columns, [ids], "decoded")


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = decode_documents(encode_documents(docs.select("doc_id", "text"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
