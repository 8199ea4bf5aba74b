"""Chat formatting with cumulative-snapshot collapse.

A chat service that logs a conversation after every turn stores each of its prefixes. Turns are put in order
(turn, role, MD5 of the text), and every prefix of a conversation gets a rolling hash: the exclusive-or of the 128-bit hashes
of (position, role, MD5) up to it. A conversation whose whole hash is the hash of a proper prefix of another one is
dropped by an anti-join on (length, hash); of equal conversations the smallest conv_id stays. What is left is maximal and
is rendered with the ``TEMPLATE`` of its turns.

Texts are hashed in the scan and moved once, to be rendered; everything else moves hashes only. Turns are windowed in chunks of ``CHUNK``
turn numbers, so the order of a conversation of any length isn't one task's work.

Defined results: null roles and texts count as empty; turns without a number come first; a row with a null conv_id is a conversation of its
own, of one turn; repeated rows are turns of their own; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import checkpointed

TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")
CHUNK = 1024
_HASHES = ("h0", "h1")


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashed(rows: DataFrame, place: str) -> DataFrame:
    return rows.withColumns({"h0": F.xxhash64(place, "role", "md5"), "h1": F.xxhash64("md5", F.lit("second"), "role", place)})


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, h0, h1): the prefixes of the conversations with an id."""
    key = ["conv_id", "_chunk"]
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where("conv_id is not null").select("conv_id", F.floor(F.col("turn") / CHUNK).alias("_chunk"), "turn", "role", F.unhex(F.md5("text")).alias("md5"))
    # a chunk of null turns comes first and joins as any other
    rows = checkpointed(rows.withColumn("_chunk", F.coalesce("_chunk", F.lit(-(1 << 62)))))
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    counts = counts.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    order = Window.partitionBy(*key).orderBy("turn", "role", "md5")
    placed = rows.withColumn("_own", F.row_number().over(order)).join(counts, key)
    placed = _hashed(placed.withColumn("place", F.col("_before") + F.col("_own")), "place").select(*key, "_own", "place", "n_turns", *_HASHES)
    within = Window.partitionBy(*key).orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = placed.groupBy(*key).agg(*[F.bit_xor(h).alias(f"_{h}") for h in _HASHES])
    chunks = chunks.select(*key, *[F.coalesce(F.bit_xor(f"_{h}").over(before), F.lit(0)).alias(f"_{h}") for h in _HASHES])
    running = placed.withColumns({h: F.bit_xor(h).over(within) for h in _HASHES}).join(chunks, key)
    return running.select("conv_id", "place", "n_turns", *[F.col(h).bitwiseXOR(F.col(f"_{h}")).alias(h) for h in _HASHES])


def _alone(rows: DataFrame) -> DataFrame:
    """The rows without conv_id, as conversations of one turn."""
    return _hashed(rows.where("conv_id is null").select("conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("md5"), F.lit(1).cast("long").alias("n_turns")), "n_turns")


def _maximal(rows: DataFrame) -> DataFrame:
    turns = checkpointed(_turns(rows))
    columns = ["conv_id", "n_turns", *_HASHES]
    whole = turns.where("place = n_turns").select(*columns).unionByName(_alone(rows).select(*columns))
    whole = whole.groupBy("n_turns", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    prefixes = turns.where("place < n_turns").select(F.col("place").alias("n_turns"), *_HASHES).distinct()
    return checkpointed(whole.join(prefixes, ["n_turns", *_HASHES], "left_anti"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another one."""
    return _maximal(_rows(conversations)).select("conv_id", "n_turns")


def format_conversations(conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, text): every maximal conversation, rendered."""
    rows = _rows(conversations)
    kept = _maximal(rows)
    start, middle, end = (F.lit(x) for x in template)
    named = rows.where("conv_id is not null").join(kept.where("conv_id is not null").select("conv_id", "n_turns"), "conv_id")
    turn = F.struct("turn", "role", F.unhex(F.md5("text")).alias("md5"), "text")
    whole = named.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    alone = _alone(rows).join(kept.where("conv_id is null").select("n_turns", *_HASHES), ["n_turns", *_HASHES], "left_semi").dropDuplicates(["role", "md5"])
    whole = whole.unionByName(alone.select("conv_id", "n_turns", F.array(turn).alias("t")))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda t: F.concat(start, t["role"], middle, t["text"], end)), "").alias("text"))


ORACLE = """
WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
conv AS (
  SELECT conv_id, alone, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, md5(text)) AS turns
  FROM own GROUP BY conv_id, alone)
SELECT conv_id, n AS n_turns,
  array_to_string(['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) FOR t IN turns], '') AS text
FROM conv a WHERE NOT EXISTS (
  SELECT 1 FROM conv b WHERE (b.conv_id IS DISTINCT FROM a.conv_id OR b.alone IS DISTINCT FROM a.alone) AND b.turns[1] = a.turns[1] AND b.n >= a.n AND b.turns[1:a.n] = a.turns
    AND (b.n > a.n OR (b.conv_id IS NOT NULL AND (a.conv_id IS NULL OR b.conv_id < a.conv_id)) OR (b.conv_id IS NULL AND a.conv_id IS NULL AND b.alone < a.alone)))
"""
