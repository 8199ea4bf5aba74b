"""Line deduplication by content-defined chunks of lines, with DataFrame operations only.

A text is split at newlines. A chunk ends after a line if a rolling hash over the last two line hashes
says so (one time in two), if the line or the next one is long (``LONG_LINE`` characters: a paragraph is a
chunk of its own), or if the text ends. As a boundary depends on two lines only, a passage is cut in
the same way wherever it stands, whatever is before it.

Lines that aren't blank are grouped over all documents by their text, i.e. compared byte by byte; the place of a line's first occurrence
(smallest doc_id, then text hash, then position) stands for it from then on, so chunks whose lines have equal
places are equal byte by byte. A line is *later* if it isn't its text's first occurrence. Around each repeated chunk the
passage is extended line by line as long as lines are later, for its first and last lines may share chunks with
their neighbours. Such a run of later lines, with the blank lines inside it, goes if it holds

* a chunk of two or more lines with ``MIN_CHARS`` characters that stands at an earlier place too,
* a long line, or
* ``MIN_WORDS`` words in all (a passage of a few short lines may hold no whole chunk).

So a common short line alone is never touched, and every line's first occurrence always stays.

Defined results: a null text stays null; a text whose lines are all removed becomes empty, its row stays; null
doc_ids come first; rows that repeat doc_id and text are one document and keep the same lines; words are what single spaces and
tabs separate; other columns, whatever their names, pass through, but those named like an appended one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import checkpointed, packed, unpacked

LONG_LINE = 200
MIN_CHARS = 60
MIN_WORDS = 50

#: After line j (from 1): the text's last line, a long line on either side, or the rolling hash.
_ENDS = f"""filter(sequence(1, size(_lines)), j ->
    j = size(_lines) or length(get(_lines, j - 1)) >= {LONG_LINE} or length(get(_lines, j)) >= {LONG_LINE}
    or substr(md5(concat(coalesce(get(_hashes, j - 2), ''), get(_hashes, j - 1))), 1, 1) < '8')"""
_BLANK = "length(trim(BOTH ' \t\r' FROM {}))"
#: The lines of chunk k that aren't blank, each with their number. array() and the inner transform evaluate them once.
_MEMBERS = f"""transform(array(filter(
    transform(sequence(coalesce(get(_ends, k - 2), 0) + 1, get(_ends, k - 1)), j -> struct(j, get(_lines, j - 1) as line, get(_hashes, j - 1) as hash)),
    x -> {_BLANK.format("x.line")} > 0)), own -> transform(own, x -> struct(x.j, k, size(own) as n, x.line, x.hash)))"""


def _lines(docs: DataFrame) -> DataFrame:
    """(_id, _key, _place, j, k, n, chars, words, line, hash, hash2) of every line that isn't blank; _place orders all of them, m those of a text."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    # explode(array(x)) evaluates x once, where a projection would repeat it for each use
    for name, value in (("_lines", "split(text, '\\n')"), ("_hashes", "transform(_lines, x -> md5(x))"), ("_ends", _ENDS)):
        rows = rows.withColumn(name, F.explode(F.expr(f"array({value})")))
    lines = rows.select("_id", "_key", F.posexplode(F.expr(f"flatten(flatten(transform(sequence(1, size(_ends)), k -> {_MEMBERS})))")).alias("m", "x"))
    # one number for (doc_id, text hash, position): hash aggregation can take its minimum
    place = F.expr(
        "(coalesce(cast(_id as decimal(19, 0)), cast(-9223372036854775809 as decimal(19, 0))) * cast(2147483648 as decimal(10, 0))"
        " + cast(pmod(_key, 2147483648) as decimal(10, 0))) * cast(1000000000 as decimal(10, 0)) + cast(x.j as decimal(10, 0))"
    )
    line = F.col("x.line")
    words = F.length(line) - F.length(F.translate(line, " \t", "")) + 1
    # 192 bits stand for a line where its text needn't be moved
    hashes = [F.unhex("x.hash").alias("hash"), F.xxhash64(line).alias("hash2")]
    return lines.select("_id", "_key", place.cast("decimal(38,0)").alias("_place"), "m", "x.j", "x.k", "x.n", F.length(line).alias("chars"), words.alias("words"), line.alias("line"), *hashes)


def _repeated(lines: DataFrame) -> DataFrame:
    """The occurrences of lines that stand at several places, with the place of the first one."""
    found = lines.groupBy("line").agg(F.min("_place").alias("first"), F.max("_place").alias("last")).where("first < last")
    # the text was compared above; its hashes stand for it here, so that it isn't moved again
    found = found.select(F.unhex(F.md5("line")).alias("hash"), F.xxhash64("line").alias("hash2"), "first")
    return lines.drop("line").join(found, ["hash", "hash2"]).drop("hash", "hash2")


def _repeated_chunks(members: DataFrame) -> DataFrame:
    """(_id, _key, m) of the first line of each chunk of several lines that stands at an earlier place too."""
    chunks = members.where("n > 1").groupBy("_id", "_key", "k", "n").agg(F.sort_array(F.collect_set(F.struct("j", "first", "m", "chars"))).alias("x"), F.min("_place").alias("_at"))
    chars = F.aggregate("x", F.lit(0), lambda a, x: a + x["chars"]) + F.col("n") - 1
    # blank lines have no place: the gaps that they leave in j stand for them
    lines = F.transform("x", lambda x: F.struct((x["j"] - F.col("x")[0]["j"]).alias("j"), x["first"].alias("first")))
    chunks = chunks.where((F.size("x") == F.col("n")) & (chars >= MIN_CHARS)).select("_id", "_key", "_at", F.col("x")[0]["m"].alias("m"), lines.alias("lines"))
    seen = chunks.groupBy("lines").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where("_first < _last")
    return chunks.join(seen.drop("_last"), "lines").where("_at > _first").select("_id", "_key", "m")


def _removed(members: DataFrame) -> DataFrame:
    """(_id, _key, _removed): the numbers of the lines that go."""
    none = [F.lit(None).cast("int").alias(c) for c in ("j", "words")]
    later = members.where("_place > first").select("_id", "_key", "m", "j", "words", (F.col("chars") >= LONG_LINE).alias("anchor"))
    marks = later.unionByName(_repeated_chunks(members).select("_id", "_key", "m", *none, F.lit(True).alias("anchor")))
    marks = marks.withColumn("run", F.col("m") - F.dense_rank().over(Window.partitionBy("_id", "_key").orderBy("m")))
    lines = F.collect_set(F.when(F.col("j").isNotNull(), F.struct("j", "words")))
    runs = marks.groupBy("_id", "_key", "run").agg(F.max("anchor").alias("anchor"), F.min("j").alias("low"), F.max("j").alias("high"), lines.alias("x"))
    runs = runs.where(F.col("low").isNotNull() & (F.col("anchor") | (F.aggregate("x", F.lit(0), lambda a, x: a + x["words"]) >= MIN_WORDS)))
    return runs.groupBy("_id", "_key").agg(F.flatten(F.collect_list(F.sequence("low", "high"))).alias("_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text cleaned and the columns n_lines and n_lines_removed (long) appended."""
    removed = _removed(checkpointed(_repeated(_lines(docs))))
    keyed = packed(docs, "doc_id", "text").withColumns({"_doc": F.col("doc_id").cast("long"), "_text_key": F.xxhash64("text")})
    joined = keyed.join(removed, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left").drop("_id", "_key", "_doc", "_text_key")
    cut = joined.withColumn("_lines", F.explode(F.expr("array(case when _removed is not null then split(text, '\\n') end)")))
    clean = F.expr("array_join(transform(array_except(sequence(1, size(_lines)), _removed), j -> get(_lines, j - 1)), '\\n')")
    lines = F.when(F.col("text").isNotNull(), F.length("text") - F.length(F.translate("text", "\n", "")) + 1).otherwise(0)
    lost = F.when(F.col("_removed").isNotNull(), F.size("_removed")).otherwise(0)
    done = cut.withColumns({"text": F.when(F.col("_removed").isNotNull(), clean).otherwise(F.col("text")), "n_lines": lines.cast("long"), "n_lines_removed": lost.cast("long")})
    return unpacked(done, docs.columns, ["doc_id", "text"], "n_lines", "n_lines_removed")


ORACLE = f"""
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents),
split AS (SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM doc WHERE text IS NOT NULL),
hashed AS (
  SELECT *, lead(line) OVER w AS next_line, coalesce(lag(md5(line)) OVER w, '') AS before FROM split WINDOW w AS (PARTITION BY doc_id, whole ORDER BY j)),
marked AS (
  SELECT *, CASE WHEN length(line) >= {LONG_LINE} OR length(coalesce(next_line, '')) >= {LONG_LINE} OR md5(before || md5(line))[1] < '8' THEN 1 ELSE 0 END AS ends FROM hashed),
numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, whole ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
    length(trim(line, ' ' || chr(9) || chr(13))) = 0 AS blank FROM marked),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) > 1 AS later, count(*) OVER (PARTITION BY line) > 1 AS often,
    row_number() OVER (PARTITION BY doc_id, whole ORDER BY j) AS m, length(line) - length(replace(replace(line, ' ', ''), chr(9), '')) + 1 AS words
  FROM numbered WHERE NOT blank),
chunks AS (
  SELECT doc_id, whole, k, bool_and(often) AND count(*) > 1 AND sum(length(line)) + count(*) - 1 >= {MIN_CHARS} AS big, list({{'j': j - low, 'line': line}} ORDER BY j) AS own
  FROM lines JOIN (SELECT doc_id, whole, k, min(j) AS low FROM lines GROUP BY ALL) USING (doc_id, whole, k) GROUP BY doc_id, whole, k),
anchors AS (SELECT doc_id, whole, k, row_number() OVER (PARTITION BY own ORDER BY doc_id, k) > 1 AS again FROM chunks WHERE big),
runs AS (
  SELECT l.*, coalesce(again, false) AS again, sum(CASE WHEN later THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, whole ORDER BY m) AS run
  FROM lines l LEFT JOIN anchors USING (doc_id, whole, k)),
judged AS (
  SELECT doc_id, whole, min(j) AS low, max(j) AS high FROM runs WHERE later GROUP BY doc_id, whole, run
  HAVING bool_or(again) OR bool_or(length(line) >= {LONG_LINE}) OR sum(words) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, whole, unnest(generate_series(low, high)) AS j FROM judged),
done AS (
  SELECT doc_id, whole, coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (g.j IS NULL), '') AS text,
    count(*)::BIGINT AS n_lines, count(g.j)::BIGINT AS n_lines_removed FROM split s LEFT JOIN gone g USING (doc_id, whole, j) GROUP BY doc_id, whole)
SELECT d.doc_id, coalesce(x.text, d.text) AS text, coalesce(x.n_lines, 0)::BIGINT AS n_lines, coalesce(x.n_lines_removed, 0)::BIGINT AS n_lines_removed
FROM documents d LEFT JOIN done x ON d.doc_id = x.doc_id AND d.text = x.whole
"""
