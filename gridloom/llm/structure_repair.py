"""Conversation structure repair by shortest paths.

A conversation is well formed if its roles' initials match ``(s?(ua)+)?``. The edits of its rows are arcs of a graph whose nodes are
(rows done, state of that expression): Keep (0), Rerole to user or assistant (3), Delete (4) and Insert an empty turn of either (3);
a truncated row that isn't deleted adds 3. Costs are small integers, so Dial's bucket queue, started at the accepting nodes, records
every node's distance to the end. Arcs that lose exactly their cost are tight; walking them from the start, each time by the
smallest initial (D < I < K < R), gives the cheapest audit that is least in ASCII. Each initial leads to one node, so the audit settles
the repaired turns too. Blank and duplicate rows must be deleted: they cost 4 on every path and aren't nodes, and as D is the
smallest initial, it comes as soon as such a row is reached.

Conversations of at most ``SHORT_ROWS`` rows and ``SHORT_CHARS`` characters are sorted by conversation and repaired as they stream
through the tasks. Longer ones are cut into segments by a range partitioning of (conversation, turn, role, text), so no task holds
one: first occurrences of texts are found by a grouping on role and hash; each segment gives the distances between its states at entry
and exit; these small matrices are composed per conversation from its end; each segment is walked from every state at entry, and the
walks are chained. Only the audit, which is one value of the result, and the hash of the repaired turns, which is sequential, pass
through one task, as a stream of pieces.

Defined results: null conv_id is a conversation as others; null role and text are one space; rows go by turn (null first), then role, then
text; an empty role has no legal place and has to be reroled or deleted; repeated rows are duplicates; a conversation without rows after
damage has zeros, an empty audit and the hash of the empty string; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, checkpointed, ddl, scratch_path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SHORT_ROWS, SHORT_CHARS = 2000, 1 << 22
#: Rows of a segment, about.
SEGMENT_ROWS = 20_000
FAR = 1 << 60

# states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
START, STATES, ACCEPTING = 0, range(4), (0, 3)
ROLES = {2: "user", 3: "assistant"}
_AFTER_NEW = (2, 2, 3, 2)
_AFTER_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_BEFORE_NEW = tuple(tuple(p for p in STATES if _AFTER_NEW[p] == s) for s in STATES)
_BEFORE_KEPT = {x: tuple(tuple(p for p in STATES if after[p] == s) for s in STATES) for x, after in _AFTER_KEPT.items()}
_NOWHERE = ((), (), (), ())
_LEGAL = {"su", "ua", "au"}


def distances(rows: list[tuple[str, bool]], end: list[int]) -> list[int]:
    """The distance to the end of each node (at 4 * rows done + state), given those of the nodes after the last row.

    ``rows`` has (initial, truncated) of the rows that needn't be deleted.
    """
    n = len(rows)
    dist = [FAR] * (4 * n + 4)
    known = [d for d in end if d < FAR]
    if not known:
        return dist
    first, spread = min(known), max(known) - min(known)
    turns = REROLE + TRUNCATED + spread + 1
    buckets: list[list[int]] = [[] for _ in range(turns)]
    waiting, at = 0, first
    for s, d in enumerate(end):
        if d < FAR:
            dist[4 * n + s] = d
            buckets[d % turns].append(4 * n + s)
            waiting += 1
    while waiting:
        bucket = buckets[at % turns]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != at:
                continue
            i, s = divmod(node, 4)
            arcs = [(4 * i + p, INSERT) for p in _BEFORE_NEW[s]]
            if i:
                initial, cut = rows[i - 1]
                more, row = TRUNCATED * cut, 4 * (i - 1)
                arcs.append((row + s, DELETE))
                arcs += [(row + p, KEEP + more) for p in _BEFORE_KEPT.get(initial, _NOWHERE)[s]]
                arcs += [(row + p, REROLE + more) for p in _BEFORE_NEW[s]]
            for before, cost in arcs:
                if at + cost < dist[before]:
                    dist[before] = at + cost
                    buckets[(at + cost) % turns].append(before)
                    waiting += 1
        at += 1
    return dist


def walk(rows: list[tuple[str, bool]], dist: list[int], state: int, last: bool) -> tuple[list[str], int]:
    """For each row that needn't go the edits up to and with its own, and one more for those at the end; then the state at the end.

    Inserts after the last row of a segment belong to the next segment, if there is one.
    """
    edits, own, i, n = [], "", 0, len(rows)
    while True:
        here = dist[4 * i + state]
        if i == n:
            if last and here:  # nothing else is left to do
                own, state = own + "I", _AFTER_NEW[state]
                continue
            return [*edits, own], state
        initial, cut = rows[i]
        more, below = TRUNCATED * cut, 4 * (i + 1)
        kept = _AFTER_KEPT[initial][state] if initial in _AFTER_KEPT else None
        if dist[below + state] + DELETE == here:
            own += "D"
        elif dist[4 * i + _AFTER_NEW[state]] + INSERT == here:
            own, state = own + "I", _AFTER_NEW[state]
            continue
        elif kept is not None and dist[below + kept] + KEEP + more == here:
            own, state = own + "K", kept
        else:
            own, state = own + "R", _AFTER_NEW[state]
        edits.append(own)
        own, i = "", i + 1


def audit_of(forced: Iterable[bool], edits: list[str]) -> str:
    """The audit: a row that must go is deleted before anything else is done at its place."""
    found, own = [], iter(edits)
    for gone in forced:
        found.append("D" if gone else next(own))
    return "".join(found) + next(own)


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of each turn that an audit leaves, given the state before it."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            state = _AFTER_NEW[state]
            yield f"{ROLES[state]}:{text}"
        elif edit == "K":
            state = _AFTER_KEPT[role[0]][state]
            yield f"{role}:{text}"


def _long(value: int) -> int:
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def _gaps(turns: set[int]) -> int:
    return _long(max(turns) - min(turns) + 1 - len(turns)) if turns else 0


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, blank, truncated, _salt) of each row after damage; a dropped row has 0 copies and no text."""
    role, text, turn = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.col("turn").cast("long")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm.isin(0, 1), "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumns(
        {"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "truncated": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "_salt": F.monotonically_increasing_id()}
    )


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def repair(rows: list[tuple]) -> tuple:
    """The result's values for the sorted (turn, role, text, copies, blank, truncated) of one conversation."""
    own = [r for r in rows for _ in range(r[3])]
    seen, forced, free, counts = set(), [], [], [0, 0, 0]
    for _, role, text, _, blank, cut in own:
        again = not blank and (role, text) in seen
        seen.add((role, text))
        for k, fault in enumerate((blank, again, cut and not blank and not again)):
            counts[k] += fault
        forced.append(blank or again)
        if not forced[-1]:
            free.append((role[:1], cut))
    dist = distances(free, [0 if s in ACCEPTING else FAR for s in STATES])
    audit = audit_of(forced, walk(free, dist, START, True)[0])
    turns = "\n".join(repaired(((r[1], r[2]) for r in own), audit, START))
    return (
        _gaps({r[0] for r in own if r[0] is not None}), *counts, _illegal([r[1][:1] for r in own]), DELETE * sum(forced) + dist[START], audit,
        hashlib.sha256(turns.encode()).hexdigest(),
    )


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with equal first columns, over batches too."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[:keys] != key:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batched(found: Iterator[tuple], schema: pa.Schema, rows: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(rows: DataFrame, act, schema: str) -> DataFrame:
    """``rows`` through ``act``, from an iterator of batches to one of tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(lambda batches: _batched(act(batches), kept), schema)


def _short(rows: DataFrame, kind: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text", "copies", "blank", "truncated"]
    order = ["conv_id", "turn", "role", "text"]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions(*order)
    return _mapped(ordered, lambda batches: ((*key, *repair(own)) for key, own in _grouped(batches, 1)), f"conv_id {kind}, {_RESULT}")


def _summary(own: list[tuple]) -> tuple:
    """Of a segment's (at, initial, copies, blank, truncated, again): its matrix, row by row, counts and the initials at its edges."""
    forced, free, counts, initials = _faults(own)
    ends = [distances(free, [0 if s == q else FAR for s in STATES]) for q in STATES]
    return [ends[q][p] for p in STATES for q in STATES], counts, DELETE * sum(forced), _illegal(initials), initials[:1] + initials[-1:]


def _faults(own: list[tuple]) -> tuple[list[bool], list[tuple[str, bool]], list[int], list[str]]:
    forced, free, counts, initials = [], [], [0, 0, 0], []
    for _, initial, copies, blank, cut, again in own:
        for copy in range(copies):
            repeated = not blank and (again or copy > 0)
            for k, fault in enumerate((blank, repeated, cut and not blank and not repeated)):
                counts[k] += fault
            forced.append(blank or repeated)
            initials.append(initial)
            if not forced[-1]:
                free.append((initial, cut))
    return forced, free, counts, initials


def _potentials(own: list[tuple]) -> Iterator[tuple]:
    """(segment, distances at its end, whether it is the last) from the end on, and then the totals under segment -1."""
    end, cost, counts, illegal, edge = [0 if s in ACCEPTING else FAR for s in STATES], 0, [0, 0, 0], 0, ""
    for k, (segment, matrix, faults, forced, inner, edges) in enumerate(reversed(own)):
        yield segment, end, k == 0, None
        end = [min(FAR, *(matrix[4 * p + q] + end[q] for q in STATES)) for p in STATES]
        cost, counts, illegal = cost + forced, [a + b for a, b in zip(counts, faults)], illegal + inner
        if k and edges:
            illegal += edges[-1] + edge not in _LEGAL
        edge = edges[0] if edges else edge
    yield -1, end, False, [*counts, illegal, cost + end[START]]


def _long_conversations(rows: DataFrame, kind: str, total: int) -> DataFrame:
    """The results of conversations too long for a task; ``total``: their rows."""
    spark = rows.sparkSession
    parts = max(1, -(-total // SEGMENT_ROWS))
    order = ["conv_id", "turn", "role", "text", "_salt"]
    place = F.monotonically_increasing_id()
    ranged = rows.where("copies > 0").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", place)
    folder = scratch_path(spark, "segments")
    ranged.select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", F.shiftright("_place", 33).alias("segment"), F.col("_place").alias("at"), F.md5("text").alias("_text")).write.parquet(folder)
    ranged = spark.read.parquet(folder)

    texts = ["conv_id", "role", "_text"]
    first = ranged.where("not blank").groupBy(*texts).agg(F.min("at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = checkpointed(first).select(*[F.col(c).alias(f"{c}_") for c in texts], "_first")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("_text") == F.col("_text_"))
    slim = ranged.select("conv_id", "segment", "at", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "truncated", "role", "_text").join(first, same, "left")
    slim = slim.select("conv_id", "segment", "at", "initial", "copies", "blank", "truncated", F.coalesce(F.col("_first") < F.col("at"), F.lit(False)).alias("again"))
    slim = checkpointed(slim.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at"))

    matrix = "matrix array<long>, counts array<long>, forced long, illegal long, edges array<string>"
    each = _mapped(slim, lambda batches: ((*key, *_summary(own)) for key, own in _grouped(batches, 2)), f"conv_id {kind}, segment long, {matrix}")
    each = each.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    ends = checkpointed(_mapped(each, lambda batches: ((*key, *row) for key, own in _grouped(batches, 1) for row in _potentials(own)), f"conv_id {kind}, segment long, end array<long>, last boolean, totals array<long>"))

    known = ends.where("segment >= 0").select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "end", "last")
    joined = slim.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment"))).select(*slim.columns, "end", "last")
    joined = joined.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, own in _grouped(batches, 2):
            end, last = own[0][6:]
            forced, free, _, _ = _faults([r[:6] for r in own])
            dist = distances(free, end)
            found = [walk(free, dist, s, last) if dist[s] < FAR else ([], s) for s in STATES]
            yield *key, [audit_of(forced, edits) if edits else "" for edits, _ in found], [s for _, s in found]

    walks = checkpointed(_mapped(joined, walked, f"conv_id {kind}, segment long, audits array<string>, exits array<int>"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, own in _grouped(batches, 1):
            state = START
            for segment, exits in own:
                yield *key, segment, state
                state = exits[state]

    states = _mapped(walks.select("conv_id", "segment", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "segment"), chained, f"conv_id {kind}, segment long, state int")
    states = states.toDF("_conv", "_segment", "state")
    at = lambda own: F.col(f"{own}.conv_id").eqNullSafe(F.col("s._conv")) & (F.col(f"{own}.segment") == F.col("s._segment"))
    audits = checkpointed(walks.alias("w").join(states.alias("s"), at("w")).select("w.conv_id", "w.segment", F.get("w.audits", F.col("s.state")).alias("audit"), "s.state"))

    audit_rows = audits.select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), F.col("audit").alias("role"), F.lit("").alias("text"), F.col("state").alias("copies"))
    text_rows = ranged.select("conv_id", "segment", "at", "role", "text", "copies")
    both = text_rows.unionByName(audit_rows).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, own in _grouped(batches, 2):
            (_, audit, _, state), *turns = own
            for line in repaired(((r[1], r[2]) for r in turns for _ in range(r[3])), audit, state):
                yield *key, line

    pieces = _mapped(both, lines, f"conv_id {kind}, segment long, line string").withColumn("at", F.monotonically_increasing_id())
    pieces = audits.select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), F.col("audit").alias("line")).unionByName(pieces.select("conv_id", "segment", "at", "line"))
    totals = ends.where("segment < 0").select("conv_id", "totals")
    turns = ranged.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held = None
        for conv_id, _, at, line in rows:
            if held is None or held[0] != conv_id:
                if held:
                    yield held[0], "".join(held[1]), held[2].hexdigest()
                held = [conv_id, [], hashlib.sha256(), False]
            if at < 0:
                held[1].append(line)
            else:
                held[2].update(("\n" + line if held[3] else line).encode())
                held[3] = True
        if held:
            yield held[0], "".join(held[1]), held[2].hexdigest()

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "at").select("conv_id", "segment", "at", "line")
    result = _mapped(ordered, hashed, f"conv_id {kind}, audit string, repaired_sha256 string")
    null_safe = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    joined = result.alias("r").join(totals.alias("t"), null_safe("r", "t")).join(turns.alias("n"), null_safe("r", "n"))
    gaps = F.expr("cast(coalesce(pmod(cast(n.high as decimal(38)) - n.low + 1 - n.n + 9223372036854775808BD, 18446744073709551616BD) - 9223372036854775808BD, 0) as bigint)")
    named = [F.get("t.totals", F.lit(k)).alias(c) for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost"))]
    return joined.select("r.conv_id", gaps.alias("gaps"), *named, "r.audit", "r.repaired_sha256")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after damage."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = damaged(conversations)
    kind = ddl(conversations.schema["conv_id"].dataType)
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("rows"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    folder = scratch_path(spark, "long")
    sizes.where((F.col("rows") > SHORT_ROWS) | (F.col("chars") > SHORT_CHARS)).write.parquet(folder)
    long = spark.read.parquet(folder)
    total = long.agg(F.sum("rows")).first()[0]
    if total is None:
        return _short(rows, kind)
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    named = long.select(F.col("conv_id").alias("_conv"))
    return _short(rows.join(named, same, "left_anti"), kind).unionByName(_long_conversations(rows.join(named, same, "left_semi"), kind, int(total)))


def _oracle() -> str:
    """Recursive SQL: from each conversation's last row back, the least (cost in 10 digits, audit) to the end from each of the four states."""
    add = lambda cost, edit, v: f"lpad(({v}[1:10]::BIGINT + {cost})::VARCHAR, 10, '0') || '{edit}' || {v}[11:]"
    more = f"({TRUNCATED} * cut::INT)"
    options = []
    for s in STATES:
        kept = " ".join(f"WHEN '{x}' THEN {add(more, 'K', f'v{after[s]}')}" for x, after in _AFTER_KEPT.items() if after[s] is not None)
        delete, rerole = add(DELETE, "D", f"v{s}"), add(f"({REROLE} + {more})", "R", f"v{_AFTER_NEW[s]}")
        options.append(f"CASE WHEN forced THEN {delete} ELSE least({delete}, {rerole}, coalesce(CASE initial {kept} END, '~')) END AS b{s}")
    new = "CASE WHEN s = 2 THEN 3 ELSE 2 END"
    return rf"""
WITH RECURSIVE step AS (
  SELECT k, 0 AS i, k AS c FROM range(256) r(k)
  UNION ALL SELECT k, i + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT key, xor(list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(key, '')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS harm FROM (SELECT DISTINCT key FROM plain), crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM plain JOIN hashed USING (key) WHERE harm > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ends_open,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before
  FROM placed),
own AS (SELECT *, blank OR again AS forced, ends_open AND NOT blank AND NOT again AS cut FROM judged),
conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM own GROUP BY conv_id),
best AS (
  SELECT conv_id, n AS i, '0000000000' AS v0, '0000000006II' AS v1, '0000000003I' AS v2, '0000000000' AS v3 FROM conv
  UNION ALL
  SELECT conv_id, i, least(b0, {add(INSERT, 'I', 'w2')}), least(b1, {add(INSERT, 'I', 'w2')}), w2, least(b3, {add(INSERT, 'I', 'b2')})
  FROM (SELECT *, least(b2, {add(INSERT, 'I', 'b3')}) AS w2 FROM (
    SELECT o.conv_id, best.i - 1 AS i, {', '.join(options)} FROM best JOIN own o ON o.conv_id IS NOT DISTINCT FROM best.conv_id AND o.i = best.i))),
audit AS (SELECT conv_id, v0[1:10]::BIGINT AS cost, v0[11:] AS audit FROM best WHERE i = 0),
made AS (
  SELECT conv_id, audit, 1 AS pos, 1 AS i, 0 AS s, []::VARCHAR[] AS lines FROM audit
  UNION ALL
  SELECT m.conv_id, audit, pos + 1, CASE WHEN audit[pos] = 'I' THEN m.i ELSE m.i + 1 END,
    CASE WHEN audit[pos] IN ('I', 'R') THEN {new} WHEN audit[pos] = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE s END,
    CASE audit[pos] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN audit[pos] = 'R' THEN text ELSE '' END) END
  FROM made m LEFT JOIN own o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.i = m.i WHERE pos <= length(audit)),
hashes AS (SELECT conv_id, audit, sha256(array_to_string(lines, chr(10))) AS h FROM made WHERE pos = length(audit) + 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(a.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN conv c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN audit a ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
