"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, drops combining marks, maps homoglyphs of other scripts and letter-like forms (full
width, mathematical) to Latin letters and the digits and signs used in their place to those letters (i, l, 1 and |
fold to one letter); every other character that isn't a letter becomes a space. Accented letters stay: they tell words apart. Entries are whole words or word beginnings. Hits inside an exception
phrase don't count, and of entries that start at one place only the longest counts.

The lexicon is ``SEED`` plus entries learnt from labelled documents: words and word beginnings that stand
in at least ``MIN_CONTEXTS`` different contexts (neighbouring words) of toxic documents, so copies of one
document don't make an entry, and are over-represented there by ``MIN_LOG_ODDS``. Of those words the ``MAX_CANDIDATES`` with most contexts are
weighed, and the ``MAX_ENTRIES`` heaviest are kept: both bound the model, which goes to every task. Exception phrases are ``EXCEPTIONS`` plus
entries with the word before or after them that stand in ``MIN_CLEAN`` clean training documents or more and in no toxic one. A document's weight
is the sum over its entries of the entry's log-odds times 1 + log(its hits), divided by 1 + log(1 +
words / ``LENGTH_UNIT``); a logistic curve fitted on the same documents turns it into a score.

``TRAIN_DOCS`` bounds the labelled sample that the lexicon and the curve are fitted on; everything else covers all documents.

Defined results: null and empty texts score as texts without hits; without toxic training documents only SEED
counts, with ``SEED_WEIGHT``; documents keep their rows and order of columns; columns named score or hits are replaced, others of
any name pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed, map_rows, packed, training_texts, unpacked

TRAIN_DOCS = 8000
MIN_CONTEXTS = 8
MIN_LOG_ODDS = 4.5
MAX_ENTRIES = 5000
MAX_CANDIDATES = 50_000
PREFIX_CHARS = (4, 5, 6, 7, 8)
LENGTH_UNIT = 1000
#: A word beginning is an entry only if it has so many times the contexts of its commonest word.
BEGINNING_GAIN = 1.3
SEED_WEIGHT = 6.0
THRESHOLD = 0.7

MIN_CLEAN = 3

# Insults to start from, and phrases in which they are harmless.
SEED = ("asshole", "bastard", "bitch", "cretin", "dipshit", "douchebag", "dumbass", "fuckwit", "idiot", "imbecile", "jackass", "moron", "motherfucker", "scumbag", "shithead", "slut", "wanker", "whore")
EXCEPTIONS = ("bastard file", "bastard sword", "bastard wing", "idiot board", "idiot light", "idiot proof", "idiot savant", "jackass penguin")
# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe"}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "|": "i", "l": "i"}


class _Fold(dict):
    """Translation of one code point, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        char = HOMOGLYPHS.get(char, char)
        if len(char) == 1 and ord(char) > 127:
            char = "".join(HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKC", char).lower())
        char = "".join(LEET.get(c, c) for c in char)
        combining = unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf"
        self[code] = "" if combining else "".join(c if c.isalpha() else " " for c in char) or " "
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(_FOLD)


def spaced(text: str | None) -> str:
    """The folded text with single spaces between words and around it."""
    return re.sub(" +", " ", f" {fold(text or '')} ")


def _entries_of(word: str) -> Iterator[str]:
    """What a word gives as candidates: itself between spaces, and its beginnings."""
    yield f" {word} "
    for n in PREFIX_CHARS:
        if len(word) > n:
            yield f" {word[:n]}"


def _contexts(text: str) -> Iterator[tuple[str, int]]:
    words = ["", *fold(text).split(), ""]
    for before, word, after in zip(words, words[1:], words[2:]):
        if len(word) >= 4:
            yield word, zlib.crc32(f"{before} {after}".encode())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for word, context in _contexts(text or ""):
                seen.update((e, context) for e in _entries_of(word))
    entries, contexts = zip(*seen, strict=True) if seen else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(contexts, pa.int64())], ["entry", "context"])


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Entries and weights. train: (doc_id, text, label), a bounded sample."""
    lexicon = {f" {fold(w)} ": SEED_WEIGHT for w in SEED}
    toxic, clean = train.where("label = 1"), train.where("label = 0")
    found = toxic.select("text").mapInArrow(_candidates, "entry string, context long").distinct().groupBy("entry").agg(F.count("*").alias("n"))
    counts = {r["entry"]: r["n"] for r in found.where(F.col("n") >= MIN_CONTEXTS).orderBy(F.desc("n"), "entry").limit(MAX_CANDIDATES).collect()}
    if not counts:
        return lexicon
    held = train.sparkSession.sparkContext.broadcast(counts)

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = defaultdict(int)
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word, _ in _contexts(text or ""):
                    total += 1
                    for e in _entries_of(word):
                        if e in held.value:
                            seen[e] += 1
        seen[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    def totals(rows: DataFrame) -> dict[str, int]:
        return {r["entry"]: r["n"] for r in rows.select("text").mapInArrow(elsewhere, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect()}

    there, others = totals(toxic), totals(clean)
    base = math.log((others.get("", 0) + 1) / (there.get("", 0) + 1))
    weights = {e: math.log((n + 0.5) / (others.get(e, 0) + 0.5)) + base for e, n in counts.items()}
    commonest: dict[str, int] = defaultdict(int)
    for e, n in counts.items():
        if e[-1] == " ":
            for k in range(2, len(e) - 1):
                commonest[e[:k]] = max(commonest[e[:k]], n)
    for e in sorted((e for e, w in weights.items() if w >= MIN_LOG_ODDS), key=lambda e: (len(e), e)):
        if e[-1] != " " and counts[e] < BEGINNING_GAIN * commonest[e]:
            continue
        # a longer entry adds nothing to a beginning of it that is as telling
        if not any(k in lexicon and lexicon[k] >= weights[e] - 1 for k in (e[:n] for n in range(2, len(e)))):
            lexicon[e] = weights[e]
    return dict(sorted(lexicon.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES])


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.weights = lexicon
        self.automaton = ahocorasick.Automaton()
        for e in lexicon:
            self.automaton.add_word(e, (e, False))
        for e in exceptions:
            if (phrase := f" {fold(e)} ") not in lexicon:
                self.automaton.add_word(phrase, (phrase, True))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """(start, entry) of what counts in a folded text: the longest entry at each place that is inside no exception."""
        longest: dict[int, tuple[int, str]] = {}
        # the furthest end of the exceptions that start so far
        starts, reach = [], []
        excused: list[tuple[int, int]] = []
        for end, (entry, exception) in self.automaton.iter(folded):
            start = end + 1 - len(entry)
            if exception:
                excused.append((start, end))
            elif len(entry) > longest.get(start, (0, ""))[0]:
                longest[start] = (len(entry), entry)
        for start, end in sorted(excused):
            starts.append(start)
            reach.append(max(end, reach[-1] if reach else end))
        found = []
        for start, (_, entry) in longest.items():
            at = bisect_right(starts, start) - 1
            if at < 0 or start + len(entry.strip()) > reach[at]:
                found.append((start, entry))
        return found

    def weight(self, text: str | None) -> tuple[float, int]:
        """The length-normalised weight and the number of hits of a text."""
        folded = spaced(text)
        hits: dict[str, int] = defaultdict(int)
        for _, entry in self.hits(folded):
            hits[entry] += 1
        total = sum(self.weights[e] * (1 + math.log(n)) for e, n in hits.items())
        return total / (1 + math.log1p((folded.count(" ") - 1) / LENGTH_UNIT)), sum(hits.values())


def fit_curve(weights: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a small ridge."""
    x = np.column_stack([weights, np.ones(len(weights))])
    beta = np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - 1e-2 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """A lexicon with its exceptions and curve; small enough to go to every task."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, slope: float = 2.0, intercept: float = -2.0):
        self.lexicon, self.exceptions, self.slope, self.intercept = lexicon, exceptions, slope, intercept


def learn_exceptions(train: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Phrases of two words, one of which an entry hits, that stand in clean documents only. train: (doc_id, text, label), a bounded sample."""
    held = train.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, ())
        for batch in batches:
            found = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, own = spaced(text), set()
                for start, _ in matcher.hits(folded):
                    stop = folded.index(" ", start + 1)
                    word, before = folded[start + 1 : stop], folded[folded.rfind(" ", 0, start) + 1 : start]
                    after = folded[stop + 1 : max(stop + 1, folded.find(" ", stop + 1))]
                    own |= {f"{before} {word}"} if before else set()
                    own |= {f"{word} {after}"} if after else set()
                found += [(p, label) for p in sorted(own)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], ["phrase", "label"])

    rows = train.select("text", "label").mapInArrow(phrases, "phrase string, label int")
    counts = rows.groupBy("phrase").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic"))
    return tuple(r["phrase"] for r in counts.where((F.col("clean") >= MIN_CLEAN) & (F.col("toxic") == 0)).orderBy("phrase").collect())


def train_model(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """labels: (doc_id, toxic); only training rows are used."""
    train = checkpointed(training_texts(docs, labels, "toxic", bound))
    lexicon = learn_lexicon(train)
    exceptions = (*EXCEPTIONS, *learn_exceptions(train, lexicon))
    held = docs.sparkSession.sparkContext.broadcast((lexicon, exceptions))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matcher.weight(t)[0] for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["weight", "label"])

    rows = train.select("text", "label").mapInArrow(weigh, "weight double, label int").groupBy("weight", "label").count().orderBy("weight", "label").collect()
    if not any(r["label"] for r in rows):
        return Model(lexicon, exceptions)
    each = np.array([(r["weight"], r["label"]) for r in rows for _ in range(r["count"])], float)
    return Model(lexicon, exceptions, *fit_curve(each[:, 0], each[:, 1]))


def _weights(held):
    def make():
        lexicon, exceptions, slope, intercept = held.value
        matcher = Matcher(lexicon, exceptions)

        def act(texts: pa.Array) -> list[pa.Array]:
            found = [matcher.weight(t) for t in texts.to_pylist()]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, slope * w + intercept)))) for w, _ in found]
            return [pa.array(scores, pa.float64()), pa.array([n for _, n in found], pa.int64())]

        return act

    return make


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, if ``keep_text`` is off) with the columns score (double) and hits (long) appended."""
    held = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.exceptions, model.slope, model.intercept))
    scored = map_rows(packed(docs, "text"), _weights(held), "score double, hits long", keep_text=keep_text)
    return unpacked(scored, [c for c in docs.columns if keep_text or c != "text"], ["text"], "score", "hits")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` that score below the threshold; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.exceptions, model.slope, model.intercept))
    scored = map_rows(packed(docs, "text"), _weights(held), "score double, hits long")
    return unpacked(scored.where(F.col("score") < threshold), docs.columns, ["text"])
