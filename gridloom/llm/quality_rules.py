"""Quality rules: simple counts and a hashed n-gram log-likelihood ratio.

The base rules count words, symbols, repeated lines and repeated 8-word windows. Documents that pass
them are judged by importance: every byte n-gram is hashed to one of ``BUCKETS`` buckets, one
multinomial is estimated over the trusted documents (labelled quality 1) and one over the whole corpus, and a
document scores the mean over its n-grams of log(trusted probability / corpus probability). It is
kept if that mean is at least ``THRESHOLD``; the same document always gets the same verdict for the same corpus.

Both multinomials come from every n-gram of every document: partial counts per task, summed by
bucket, so the driver sees one number pair per bucket whatever the corpus size.

Defined results: a null text has no words; a document without n-grams scores 0; base_failed implies
not kept; without trusted documents the two multinomials are taken as equal, so all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, bounded_batches, utf8_texts

BUCKETS = 1 << 18
NGRAM_BYTES = 3
SMOOTHING = 1.0
THRESHOLD = -0.65
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: Bytes taken at a time, so that memory doesn't follow the length of a text.
BLOCK_BYTES = 1 << 20


def ngram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all overlapping byte n-grams, block by block."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - NGRAM_BYTES + 1, BLOCK_BYTES):
        block = data[start : start + BLOCK_BYTES + NGRAM_BYTES - 1].astype(np.uint32)
        code = np.zeros(len(block) - NGRAM_BYTES + 1, np.uint32)
        for k in range(NGRAM_BYTES):
            code = (code << np.uint32(8)) | block[k : k + len(code)]
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - 18)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("trusted", pa.int64())])
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, trusted in zip(utf8_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for buckets in ngram_buckets(text):
                # a short text touches few buckets
                if len(buckets) < BUCKETS // 16:
                    found, count = np.unique(buckets, return_counts=True)
                    totals[0, found] += count
                    if trusted:
                        totals[1, found] += count
                else:
                    count = np.bincount(buckets, minlength=BUCKETS)
                    totals[0] += count
                    if trusted:
                        totals[1] += count
    found = np.flatnonzero(totals[0])
    yield batch_of(schema, [found.astype(np.int32), totals[0][found], totals[1][found]])


def ngram_ratio(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(trusted / corpus) per bucket. ``trusted``: doc_ids of the trusted documents."""
    bounded_batches(docs.sparkSession)
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    # a merge join at every size: the trusted ids grow with the corpus and are never broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids.hint("merge"), "doc_id", "left")
    counts = rows.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_count_batches, "bucket int, raw long, trusted long")
    totals = np.zeros((2, BUCKETS))
    for row in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toLocalIterator():
        totals[:, row["bucket"]] = row["raw"], row["trusted"]
    if not totals[1].sum():
        return np.zeros(BUCKETS, np.float32)
    smooth = totals + SMOOTHING
    share = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return (share[1] - share[0]).astype(np.float32)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = text.split()
    chars = len(text) - sum(text.count(bytes([c])) for c in _SPACES) - _continuation_bytes(text)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words)


def _continuation_bytes(text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((data & 0xC0) == 0x80))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) == len(words):
        return 0
    code = np.zeros(n, np.uint64)
    for k in range(WINDOW_WORDS):
        code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ ((ids[k : k + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    # equal codes are compared word by word before they count
    first, second = order[:-1][same], order[1:][same]
    equal = np.ones(len(first), bool)
    for k in range(WINDOW_WORDS):
        equal &= ids[first + k] == ids[second + k]
    starts = np.zeros(len(words) + 1, np.int64)
    marked = np.unique(np.concatenate([first[equal], second[equal]]))
    np.add.at(starts, marked, 1)
    np.add.at(starts, marked + WINDOW_WORDS, -1)
    return int(np.count_nonzero(np.cumsum(starts[:-1])))


_RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
_RULES_ARROW = pa.schema(
    [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())]
)


def log_ratio(text: bytes, ratio: np.ndarray) -> float:
    total, count = 0.0, 0
    for buckets in ngram_buckets(text):
        total += float(ratio[buckets].sum(dtype=np.float64))
        count += len(buckets)
    return total / count if count else 0.0


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the mean log ratio llr."""
    ratio = docs.sparkSession.sparkContext.broadcast(ngram_ratio(docs, trusted))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8_texts(batch.column(1)):
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                score = log_ratio(text, ratio.value)
                rows.append((*counts, failed, not failed and score >= threshold, score))
            yield batch_of(_RULES_ARROW, [batch.column(0), *(list(zip(*rows, strict=True)) or [[]] * 8)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, _RULES)
