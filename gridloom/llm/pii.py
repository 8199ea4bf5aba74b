"""Personal data by fixed base patterns and a semi-Markov conditional random field.

The base patterns of ``base_spans`` always count. The random field looks for what they miss (telephone numbers without a plus
sign, addresses written with "at" and "dot", numbers with other separators). Every start and end at the edges of digit groups
and of address parts that is plausible for a kind is a candidate segment, overlapping ones too, up to ``MAX_CHARS`` long. Whole-span
features (digit groups, separators, check digit, neighbouring characters and words) score a segment as its kind, and
dynamic programming over all candidates, with the kind before as state, chooses boundaries and kinds jointly; everything
else is skipped at score 0. Base spans are compulsory segments of every path. A decoded segment is added if its posterior log-odds,
from the forward and backward sums over all paths, are ``MARGIN`` or more.

The kind before counts within ``GAP`` characters; areas of digits longer than ``AREA_CHARS`` are cut there, and paths are
independent beyond ``PART_CHARS``, so time is linear in the text and memory doesn't follow its length.

The field is fitted by gradient ascent on its exact likelihood over a bounded sample: stretches of
``TRAIN_DOCS`` documents that have digits or @, in which the base spans are the truth; copies in which those spans are
rewritten in other forms, alone and in lists; and the fixed ``CLEAN`` stretches without personal data. Every document is searched.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; without training spans the field adds nothing;
repeated rows stay repeated rows; columns named like an appended one are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, map_rows, packed, unpacked

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: In place of a kind: nothing before.
NONE = len(KINDS)
TRAIN_DOCS = 4000
MAX_CHARS = 96
#: Posterior log-odds that a segment of the best path must have.
MARGIN = 0.0
GAP = 64
AREA_CHARS = 4096
PART_CHARS = 4096
_CONTEXT = 24

# The parts of the base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\bdot\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    """Whether a group of digits, of any length, is 255 at most."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    before, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > before and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            before = m.end()
        at = text.find("@", max(at + 1, before))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    found = []
    if "@" in text:
        found += [(s, EMAIL, e) for s, e in _emails(text)]
    if "." in text:
        found += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), CARD, m.end()))
    if "+" in text:
        found += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- candidate segments and their features: numbers of weights, PER_KIND for each kind ----------------------------------------

PER_KIND = 48
_SEPARATED = r"[ ()\[\]./_-]{0,5}"
_AREA = re.compile(rf"[0-9](?:{_SEPARATED}[0-9]){{3,{AREA_CHARS}}}")
_GROUP = re.compile("[0-9]+")
_IP_SEPARATOR = re.compile(r" ?(?:\[\.\]|\(\.\)|\.) ?")
_DOT_WORD = r"\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s"
_DOT = rf"(?:{_DOT_WORD}|\.)"
_AT = re.compile(rf"(\s?[\[({{<]\s?at\s?[\])}}>]\s?|\sat\s|\s?[\[({{<]@[\])}}>]\s?|@)([A-Za-z0-9-]{{1,40}})((?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,4}})", re.IGNORECASE)
_LABEL = re.compile(rf"({_DOT})([A-Za-z0-9-]{{2,24}})", re.IGNORECASE)
_BEFORE_AT = re.compile(rf"([A-Za-z0-9_%+-]{{1,24}}(?:{_DOT_WORD}))?([A-Za-z0-9._%+-]{{1,48}})$", re.IGNORECASE)
# Words that announce a kind, and words before "at" that are no names.
_CUES = (
    ("mail", "contact", "write", "reach", "address"),
    ("ip", "host", "server", "addr", "login"),
    ("card", "visa", "credit", "debit", "pay", "account"),
    ("tel", "phone", "call", "mobile", "fax", "contact", "whatsapp"),
)
_NO_NAMES = frozenset("a an and are arrive at be been hosted is it look looking me meet met now of or seen start stay stop that the them there this us was were you".split())


def _words_before(text: str, start: int) -> list[str]:
    return re.findall("[a-z]+", text[max(0, start - _CONTEXT) : start].lower())[-3:]


def _around(text: str, start: int, kind: int, end: int, words: list[str]) -> list[int]:
    """Features of what is beside a segment."""
    found = [0]
    if any(w.startswith(_CUES[kind]) for w in words):
        found.append(1)
    if start and text[start - 1] in "#$%=_/.:-":
        found.append(2)
    if end < len(text) and text[end] in "%_=/":
        found.append(3)
    return found


def _numbers(text: str) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind, end, features) of ip, card and phone segments, by start."""
    for area in _AREA.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, area.start(), area.end())]
        for i, (start, first_end) in enumerate(groups):
            if start and text[start - 1].isalnum():
                continue
            opened = start > 0 and text[start - 1] == "("
            own, total, seps, found, words = [], 0, [], [], None
            for j in range(i, len(groups)):
                s, e = groups[j]
                total += e - s
                if total > 19 or e - start > MAX_CHARS:
                    break
                if j > i:
                    seps.append(text[groups[j - 1][1] : s])
                own.append(text[s:e])
                if e < len(text) and text[e].isalnum():
                    continue
                if total >= 9 or len(own) == 4:
                    for kind, s0 in _kinds(own, seps, total, opened, start):
                        words = _words_before(text, start) if words is None else words
                        found.append((s0, kind, e, _shape(text, s0, kind, e, own, seps, total, i > 0, j + 1 < len(groups), words)))
            yield from sorted(found)


def _kinds(own: list[str], seps: list[str], total: int, opened: bool, start: int) -> Iterator[tuple[int, int]]:
    if len(own) == 4 and all(len(g) <= 3 and _byte(g) for g in own) and all(map(_IP_SEPARATOR.fullmatch, seps)):
        yield IP, start
    if 13 <= total <= 19 and all(len(x) <= 2 and not set(x) - set(" ./_-") for x in seps):
        yield CARD, start
    if 9 <= total <= 15 and len(own) <= 6 and all(len(x) <= 3 and not set(x) - set(" ().-/") for x in seps):
        closing = next((x for x in seps if "(" in x or ")" in x), "")
        if not opened or not closing.startswith(")"):
            if closing == "" or closing.lstrip(" .-/").startswith("("):
                yield PHONE, start
        else:
            yield PHONE, start - 1


def _shape(text: str, start: int, kind: int, end: int, own: list[str], seps: list[str], total: int, left: bool, right: bool, words: list[str]) -> tuple[int, ...]:
    x = _around(text, start, kind, end, words)
    n = len(own)
    sizes = [len(g) for g in own]
    first, last = own[0], sizes[-1]
    every = "".join(seps)
    tests = (
        left, right, n == 1, n == 2, n == 3, n == 4, n > 4, total < 10, total == 10, total == 11, total == 12, total == 13, total in (14, 15), total == 16, total > 16,
        total >= 13 and luhn("".join(own)), n > 1 and all(s == 4 for s in sizes), n > 2 and all(s == 4 for s in sizes[:-1]) and last != 4, last == 4, last < 3, sizes[0] == 3,
        first[0] == "0", first[:2] == "00", text[start] == "(", any(g[0] == "0" and len(g) > 2 for g in own[1:]), "(" in every, sizes[0] == 4 and first[:2] in ("19", "20") and n > 1,
        len(set(seps)) == 1, len(set(seps)) > 1, "/" in every, "." in every, "_" in every, sizes == [3, 3, 4], sizes[-3:] == [3, 3, 4] and n == 4, kind == IP and every != "...",
        any(s < 3 for s in sizes[1:-1]), first in own[1:], "  " in every, n > 1 and sizes[0] > 5, n > 1 and sum(s > 4 for s in sizes) > 1,
    )
    return tuple(kind * PER_KIND + f for f in (*x, *(4 + k for k, test in enumerate(tests) if test)))


def _addresses(text: str) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind, end, features) of e-mail segments, by start."""
    places = set()
    for sign in ("@", " at ", " At ", " AT ", *(w + b for w in ("at", "At", "AT") for b in ("]", ")", "}", ">", " ]", " )", " }", " >"))):
        at = text.find(sign)
        while at >= 0:
            places.update((at,) if sign[0] == " " else range(max(0, at - 3), at + 1))
            at = text.find(sign, at + 1)
    done = -1
    for at in sorted(places):
        m = at > done and _AT.match(text, at)
        local = m and _BEFORE_AT.search(text[max(0, at - 76) : at])
        if not local:
            continue
        done = m.start(2)
        starts = [at - len(local[2])]
        if local[1]:
            starts.insert(0, starts[0] - len(local[1]))
        inner = max((k for k in range(len(local[2]) - 1) if local[2][k] in ".-_"), default=None)
        if inner is not None:
            starts.append(at - len(local[2]) + inner + 1)
        labels = [(x.group(1), x.group(2), m.start(3) + x.end()) for x in _LABEL.finditer(m[3])]
        for start in starts:
            for k in range(len(labels)):
                if labels[k][2] - start <= MAX_CHARS:
                    yield start, EMAIL, labels[k][2], _address(text, start, at, m[1], labels[: k + 1], starts, k + 1 < len(labels))


def _address(text: str, start: int, at: int, sign: str, labels: list, starts: list[int], more: bool) -> tuple[int, ...]:
    x = _around(text, start, EMAIL, labels[-1][2], _words_before(text, start))
    sign, name = sign.strip().lower(), text[start:at]
    dots = [d.strip().lower() for d, _, _ in labels]
    last = labels[-1][1]
    tests = (
        more, sign == "at", sign == "@", len(sign) > 2, any(len(d) > 3 for d in dots), "dot" in dots, all(d == "." for d in dots), len(dots) == 1, len(dots) == 2, len(dots) > 2,
        last.isalpha() and len(last) < 4, last.isalpha() and len(last) == 4, not last.isalpha(), start == starts[-1], start == starts[0], len(starts) > 1, len(name) < 2, name.lower() in _NO_NAMES,
        len(name) > 4, sign == "at" and all(d == "." for d in dots), start > 0 and text[start - 1].isalnum(), " " in name,
    )
    return tuple(f for f in (*x, *(4 + k for k, test in enumerate(tests) if test)))


def candidates(text: str) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind, end, features) of all candidate segments, by start."""
    return heapq.merge(_addresses(text), _numbers(text))


# --- the field -------------------------------------------------------------------------------------------------------------------


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Part:
    """Candidate segments that paths are chosen from, between two kinds (NONE: nothing there)."""

    def __init__(self, left: int = NONE):
        self.segments: list[tuple[int, int, int, tuple[int, ...]]] = []
        self.left, self.right = left, NONE


def parts(text: str, fixed: list[tuple[int, int, int]]) -> Iterator[Part]:
    """The candidates that touch no fixed segment, in parts whose paths don't depend on each other."""
    # fixed segments that overlap are one block; paths enter it by the first kind and leave it by the last
    blocks: list[list[int]] = []
    for s, k, e in sorted(fixed):
        if blocks and s < blocks[-1][1]:
            blocks[-1][1], blocks[-1][3] = max(blocks[-1][1], e), k
        else:
            blocks.append([s, e, k, k])
    starts = [b[0] for b in blocks]
    part, first, reach, gap = None, 0, 0, -1
    for segment in candidates(text):
        s, _, e, _ = segment
        after = bisect_right(starts, s)
        if after and blocks[after - 1][1] > s or after < len(blocks) and starts[after] < e:
            continue
        if part and (after != gap or s - reach > GAP or s - first > PART_CHARS and s >= reach):
            if after != gap and gap < len(blocks) and starts[gap] - reach <= GAP:
                part.right = blocks[gap][2]
            yield part
            part = None
        if part is None:
            part = Part(blocks[after - 1][3] if after and s - blocks[after - 1][1] <= GAP else NONE)
            first, reach, gap = s, e, after
        part.segments.append(segment)
        reach = max(reach, e)
    if part:
        if gap < len(blocks) and starts[gap] - reach <= GAP:
            part.right = blocks[gap][2]
        yield part


class Field:
    """Weights of features and of one kind following another (the last row: nothing before)."""

    def __init__(self, weights: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.weights = np.zeros(PER_KIND * len(KINDS)) if weights is None else weights
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS))) if follow is None else follow

    def scores(self, part: Part) -> list[float]:
        w = self.weights.tolist()
        return [sum(map(w.__getitem__, x)) for *_, x in part.segments]

    def _ends(self, part: Part) -> list[float]:
        """What a path gets for its last kind (the last: an empty path)."""
        if part.right == NONE:
            return [0.0] * (NONE + 1)
        last = [float(self.follow[k, part.right]) for k in range(NONE)]
        return [*last, float(self.follow[part.left, part.right])]

    def path(self, part: Part) -> list[int]:
        """Numbers of the segments of the best path."""
        segments, scores, follow = part.segments, self.scores(part), self.follow.tolist()
        # a segment changes three transitions at most; one whose score can't make up for them is on no best path
        bound = 3 * float(np.abs(self.follow).max())
        order = sorted((i for i in range(len(segments)) if scores[i] + bound > 0), key=lambda i: (segments[i][2], segments[i][0], segments[i][1]))
        if not order:
            return []
        ends = [segments[i][2] for i in order]
        # best[m][kind]: (score, segment) of the best path of that last kind among the first m segments by end
        best, before = [[(-math.inf, -1)] * NONE], [-1] * len(segments)
        for m, i in enumerate(order):
            s, k, _, _ = segments[i]
            known = best[bisect_right(ends, s, 0, m)]
            top, before[i] = follow[part.left][k], -1
            for c in range(NONE):
                if known[c][0] + follow[c][k] > top:
                    top, before[i] = known[c][0] + follow[c][k], known[c][1]
            row = best[-1].copy()
            if top + scores[i] > row[k][0]:
                row[k] = (top + scores[i], i)
            best.append(row)
        last = self._ends(part)
        top, at = last[NONE], -1
        for c in range(NONE):
            if best[-1][c][0] + last[c] > top:
                top, at = best[-1][c][0] + last[c], best[-1][c][1]
        found = []
        while at >= 0:
            found.append(at)
            at = before[at]
        return found[::-1]

    def sums(self, part: Part) -> tuple[list[float], list[float], float]:
        """Log sums over all paths: up to and including a segment, after it, in all."""
        segments, scores, follow = part.segments, self.scores(part), self.follow.tolist()
        n = len(segments)
        order = sorted(range(n), key=lambda i: segments[i][2])
        ends = [segments[i][2] for i in order]
        upto, alpha = [[-math.inf] * NONE], [0.0] * n
        for m, i in enumerate(order):
            s, k, _, _ = segments[i]
            total = follow[part.left][k]
            for c, x in enumerate(upto[bisect_right(ends, s, 0, m)]):
                if x > -math.inf:
                    total = _add(total, x + follow[c][k])
            alpha[i] = scores[i] + total
            row = upto[-1].copy()
            row[k] = _add(row[k], alpha[i])
            upto.append(row)
        last = self._ends(part)
        total = last[NONE]
        for c in range(NONE):
            total = _add(total, upto[-1][c] + last[c])
        # segments come by start: later[m] sums the paths that begin with one of the last m of them
        starts = [x[0] for x in segments]
        later, beta = [[-math.inf] * NONE], [0.0] * n
        for i in reversed(range(n)):
            _, k, e, _ = segments[i]
            beta[i] = _add(last[k], later[n - bisect_left(starts, e, i)][k])
            row = [_add(x, follow[c][k] + scores[i] + beta[i]) for c, x in enumerate(later[-1])]
            later.append(row)
        return alpha, beta, total

    def odds(self, part: Part, of: list[int]) -> list[float]:
        """Posterior log-odds of segments."""
        alpha, beta, total = self.sums(part)
        inside = [min(alpha[i] + beta[i] - total, -1e-12) for i in of]
        return [x - math.log(-math.expm1(x)) for x in inside]

    def best(self, text: str, fixed: list[tuple[int, int, int]], margin: float | None = MARGIN) -> list[tuple[int, int, int]]:
        """The segments of the best path besides the fixed ones, and of those the ones with enough log-odds."""
        found = []
        for part in parts(text, fixed):
            chosen = self.path(part)
            if chosen and margin is not None:
                chosen = [i for i, odds in zip(chosen, self.odds(part, chosen), strict=True) if odds >= margin]
            found += [part.segments[i][:3] for i in chosen]
        return found


class Examples:
    """Parts with nothing fixed beside them and the numbers of their true segments, padded to one width, for the gradient of all at once."""

    def __init__(self, examples: list[tuple[Part, set[int]]]):
        examples = sorted(examples, key=lambda x: -len(x[0].segments))
        n, width = len(examples), len(examples[0][0].segments)
        self.sizes = np.array([len(part.segments) for part, _ in examples])
        self.kind, self.gold = np.zeros((n, width), np.int64), np.zeros((n, width))
        # by end: which segment it is and how many end where it starts or before; by start: how many start where it ends or after
        self.order, self.place, self.after = (np.zeros((n, width), np.int64) for _ in range(3))
        self.steps = np.zeros((NONE + 1, NONE))
        owner, feature = [], []
        for p, (part, gold) in enumerate(examples):
            segments = part.segments
            order = sorted(range(len(segments)), key=lambda i: segments[i][2])
            starts, ends = [x[0] for x in segments], [segments[i][2] for i in order]
            last = NONE
            for m, i in enumerate(order):
                self.order[p, m], self.place[p, m] = i, bisect_right(ends, segments[i][0], 0, m)
            for i, (_, k, e, x) in enumerate(segments):
                self.kind[p, i], self.after[p, i] = k, len(segments) - bisect_left(starts, e, i)
                owner += [p * width + i] * len(x)
                feature += x
                if i in gold:
                    self.gold[p, i] = 1
                    self.steps[last, k] += 1
                    last = k
        self.owner, self.feature = np.array(owner, np.int64), np.array(feature, np.int64)

    def gradient(self, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the paths of the true segments, and its gradients."""
        n, width = self.kind.shape
        follow, rows = field.follow, np.arange(n)
        scores = np.bincount(self.owner, field.weights[self.feature], n * width).reshape(n, width)
        upto, later = (np.full((n, width + 1, NONE), -np.inf) for _ in range(2))
        alpha, beta = np.zeros((n, width)), np.zeros((n, width))
        before = np.full((n, width, NONE + 1), -np.inf)
        for m in range(width):
            r = rows[: np.count_nonzero(self.sizes > m)]
            i = self.order[r, m]
            k = self.kind[r, i]
            own = follow[:, k].T.copy()
            own[:, :NONE] += upto[r, self.place[r, m]]
            before[r, i] = own
            alpha[r, i] = scores[r, i] + np.logaddexp.reduce(own, axis=1)
            upto[r, m + 1] = upto[r, m]
            upto[r, m + 1, k] = np.logaddexp(upto[r, m, k], alpha[r, i])
        total = np.logaddexp(0.0, np.logaddexp.reduce(upto[rows, self.sizes], axis=1))
        for m in range(width):
            r = rows[: np.count_nonzero(self.sizes > m)]
            i = self.sizes[r] - 1 - m
            k = self.kind[r, i]
            beta[r, i] = np.logaddexp(0.0, later[r, self.after[r, i], k])
            later[r, m + 1] = np.logaddexp(later[r, m], follow[:NONE, k].T + (scores[r, i] + beta[r, i])[:, None])
        held = np.arange(width) < self.sizes[:, None]
        share = np.where(held, np.exp(alpha + beta - total[:, None]), 0.0)
        grad = np.bincount(self.feature, (self.gold - share).ravel()[self.owner], len(field.weights))
        flow = np.exp(before + (scores + beta - total[:, None])[:, :, None])[held]
        trans = self.steps.copy()
        np.subtract.at(trans.T, self.kind[held], flow)
        likelihood = float((scores * self.gold).sum() + (self.steps * follow).sum() - total.sum())
        return likelihood, grad, trans


# --- training --------------------------------------------------------------------------------------------------------------------

# Stretches without personal data.
CLEAN = (
    "on 2021-03-04 at 10:15 and 2021-03-05 at 11:30", "published 12/05/2019, updated 2020.01.31", "pages 120-134 and 250-261", "in 1990 1991 1992 1993 and 1994", "version 2.0.13.4 of 2019",
    "version 10.2.1 build 20190412", "ISBN 978-3-16-148410-0", "ISBN 0-306-40615-2 (1997)", "a total of 1 234 567 890 people", "order 2019 000 123 456", "3.14159265358979", "0.000123456789",
    "id 20240101123000", "scores 12 14 15 18 20 22 25 30", "lines 100 200 300 400 500", "matrix 1 0 0 0 1 0 0 0 1", "at 100 200 300", "temperatures -12 -14 -15 18 20 22", "sections 1.2.3.4 and 1.2.3.5",
    "look at example.com today", "we met at noon. the next day", "it is hosted at site.org now", "the shop at main street dot the end", "a map at scale 1.500 and more", "isotope 120 121 122 123 124 125 126",
    "12345 67890 12345 67890 12345", "2019-2020 2020-2021 2021-2022", "1 000 000 000 000 bytes", "UTC 1609459200 1609459260", "89 90 91 92 93 94 95 96 97 98 99", "2018 2019 2020 2021", "1.5 2.5 3.5 4.5 5.5 6.5",
)

_DATES = ("2021-03-04", "12/05/2019", "2020.01.31 10:15", "1998")


def rewritten(kind: int, span: str, form: int) -> str:
    """A base span in one of the forms that training uses, by number."""
    if kind == EMAIL:
        local, _, domain = span.partition("@")
        at, dot = ((" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", "."))[form % 3]
        return local + at + domain.replace(".", dot)
    if kind == IP:
        return span.replace(".", ("[.]", " . ", "(.)")[form % 3])
    digits = _digits(span)
    if kind == CARD:
        return (".", "/", "  ")[form % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return (f"({a}) {b}-{c}", f"00{digits[:-10] or '1'} {a} {b} {c}", f"{a}.{b}.{c}", f"0{a} {b}{c}")[form % 4]


def _examples(stretches: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their true spans."""
    spans = []
    for stretch in stretches:
        found = base_spans(stretch)
        yield stretch, found
        held = [x for k, x in enumerate(found) if all(x[0] >= y[2] for y in found[:k])]
        for form in range(4 if held else 0):
            out, at, moved = "", 0, []
            for s, k, e in held:
                span = rewritten(k, stretch[s:e], form)
                out += stretch[at:s]
                moved.append((len(out), k, len(out) + len(span)))
                out, at = out + span, e
            yield out + stretch[at:], moved
        spans += [(k, stretch[s:e]) for s, k, e in held]
    # two of a kind beside each other, in the same form, and one beside a date
    for kind in range(len(KINDS)):
        own = sorted({x for k, x in spans if k == kind})[:60]
        for n, (a, b) in enumerate(zip(own, own[1:])):
            for between in (" ", ", ", " - "):
                x, y = rewritten(kind, a, n), rewritten(kind, b, n)
                yield f"lists {x}{between}{y} end", [(6, kind, 6 + len(x)), (6 + len(x) + len(between), kind, 6 + len(x) + len(between) + len(y))]
            date = _DATES[n % len(_DATES)]
            yield f"{x} {date}", [(0, kind, len(x))]
            yield f"{date} {y}", [(len(date) + 1, kind, len(date) + 1 + len(y))]
    if spans:
        yield from ((text, []) for text in CLEAN)


def fit(stretches: list[str], steps: int = 80, rate: float = 0.5, decay: float = 0.004) -> Field:
    """A field fitted to stretches whose base spans are the truth."""
    examples, any_gold = [], False
    for text, gold in _examples(sorted(set(stretches))):
        wanted = set(gold)
        # base spans are candidates here too where their shape is one
        for part in parts(text, []):
            held = {i for i, x in enumerate(part.segments) if x[:3] in wanted}
            any_gold |= bool(held)
            examples.append((part, held))
    field = Field()
    if not any_gold:
        field.weights[::PER_KIND] = -10
        return field
    scale = [np.full_like(field.weights, 1e-8), np.full_like(field.follow, 1e-8)]
    held, shrink = Examples(examples), decay * len(examples) / 100
    for _ in range(steps):
        _, grad, trans = held.gradient(field)
        grad, trans = grad - shrink * field.weights, trans - shrink * field.follow
        for value, slope, total in ((field.weights, grad, scale[0]), (field.follow, trans, scale[1])):
            total += slope**2
            value += rate * slope / np.sqrt(total)
    return field


def stretches(text: str) -> Iterator[str]:
    """Parts of a text around digits and @, for training; each at most 400 characters."""
    at = 0
    while m := _ANY.search(text, at):
        start, end = max(at, m.start() - 60), min(len(text), m.end() + 80)
        while (n := _ANY.search(text, end - 40, min(len(text), end))) and end - start < 340:
            end = min(len(text), max(end, n.end() + 60))
            if end >= len(text) or not _ANY.search(text, end - 40, end):
                break
        yield text[start:end]
        at = end


MAX_STRETCHES = 600


def train_field(docs: DataFrame, bound: int = TRAIN_DOCS, most: int = MAX_STRETCHES) -> Field:
    """Fits the field on stretches of at most ``bound`` documents, ``most`` stretches in all, chosen by hash."""
    bounded_batches(docs.sparkSession)
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s for t in batch.column(0).to_pylist() for s in stretches(t)], pa.string())], ["stretch"])

    found = rows.mapInArrow(cut, "stretch string").distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(most)
    return fit([r["stretch"] for r in found.collect()])


_COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, field: Field, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text, if ``keep_text`` is off) with the counts and the digest of the base spans, all spans, and the number of added ones."""
    held = docs.sparkSession.sparkContext.broadcast((field.weights, field.follow))

    def make():
        own = Field(*held.value)

        def act(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for text in texts.to_pylist():
                base = base_spans(text or "")
                added = own.best(text or "", base)
                counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            return [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]

        return act

    rows = packed(docs, "text")
    appended = [part.split()[0] for part in _COLUMNS.split(", ")]
    found = map_rows(rows, make, _COLUMNS, keep_text=keep_text)
    return unpacked(found, [c for c in docs.columns if keep_text or c != "text"], ["text"], *appended)
