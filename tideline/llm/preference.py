"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Built from DataFrame functions alone.  Both conversations' turns are grouped by (pair,
turn, role, text); the first turn with a row that only one side has is where they part.
Turns before it are the longest common prefix and are rendered once, as the prompt; the
other turns of each side are its completion.  A turn is rendered as

    <|role|>\\n text <|end|>\\n

and a completion's spans (start:length in characters, comma-joined) are those to train
on: text and end of assistant turns; headers and other roles are masked.

Groups are of one pair and ``SEGMENT`` turn numbers, so that a conversation of any length
is rendered in pieces of bounded length, one row each (``segment`` 0 holds all of nearly
every conversation); spans count from the start of the whole completion, that is of the
pieces of all segments one after the other.

A null turn counts as -1, null roles and texts are empty, rows that repeat within a
conversation count once, and several rows of one turn are ordered by role and text.  A row
with a null pair belongs to none: each such row that differs is a pair of one turn.  If one side is missing, its completion is empty; if both
sides are alike, all is prompt and ``differs`` is false.  An empty table gives an empty
table.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEGMENT = 1_024
END_MARK = "<|end|>\n"


def turns(table: DataFrame, key: str) -> DataFrame:
    """pair_id, turn, role and text without nulls in the last three."""
    turn, role, text = F.coalesce(F.col("turn").cast("long"), F.lit(-1)), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return table.select(F.col(key).cast("long").alias("pair_id"), turn.alias("turn"), role.alias("role"), text.alias("text"))


def format_pairs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows``: pair_id, turn, role, text, chosen and rejected (whether the side has the row)."""
    flags = rows.groupBy("pair_id", "turn", "role", "text").agg(F.max("chosen").alias("chosen"), F.max("rejected").alias("rejected"))
    flags = scratch.keep(flags, "turns")
    alone = F.col("pair_id").isNull()
    parts = flags.filter(~(F.col("chosen") & F.col("rejected")) & ~alone).groupBy("pair_id").agg(F.min("turn").alias("parted"))
    parts = scratch.keep(parts.withColumnRenamed("pair_id", "p"), "parts")
    known = flags.join(parts, F.col("pair_id") == F.col("p"), "left")
    parted = F.when(alone, F.when(~(F.col("chosen") & F.col("rejected")), F.col("turn"))).otherwise(F.col("parted"))
    known = known.withColumns({"parted": parted, "segment": F.floor(F.col("turn") / SEGMENT), "lone": F.when(alone, F.struct("turn", "role", "text"))})
    common = F.col("parted").isNull() | (F.col("turn") < F.col("parted"))
    row = F.struct("turn", "role", "text", common.alias("common"), "chosen", "rejected")
    grouped = known.groupBy("pair_id", "segment", "lone").agg(F.sort_array(F.collect_list(row)).alias("t"), F.max(F.col("parted").isNotNull()).alias("differs"))

    # what a later segment's spans begin at: the sizes of the segments before
    size = F.length("role") + F.length("text") + F.lit(len("<||>\n") + len(END_MARK))
    sizes = known.filter(~common & ~alone).groupBy(F.col("pair_id").alias("p"), F.col("segment").alias("g")).agg(*[F.sum(F.when(F.col(c), size).otherwise(0)).alias(c) for c in ("chosen", "rejected")])
    before = Window.partitionBy("p").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("p", "g", *[F.sum(c).over(before).alias(f"{c}_base") for c in ("chosen", "rejected")]).filter("chosen_base is not null")
    grouped = grouped.join(bases, (F.col("pair_id") == F.col("p")) & (F.col("segment") == F.col("g")), "left")

    head = lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))
    body = lambda x: F.concat(x["text"], F.lit(END_MARK))
    render = lambda a: F.array_join(F.transform(a, lambda x: F.concat(head(x), body(x))), "")

    def spans(a, base):
        start = F.struct(F.coalesce(base, F.lit(0)).cast("long").alias("at"), F.array().cast("array<string>").alias("s"))

        def step(acc, x):
            first, size = acc["at"] + F.length(head(x)), F.length(body(x))
            more = F.when(x["role"] == "assistant", F.array(F.concat_ws(":", first.cast("string"), size.cast("string")))).otherwise(F.array().cast("array<string>"))
            return F.struct((first + size).alias("at"), F.concat(acc["s"], more).alias("s"))

        return F.aggregate(a, start, step, lambda acc: F.array_join(acc["s"], ","))

    side = {"chosen": F.filter("t", lambda x: ~x["common"] & x["chosen"]), "rejected": F.filter("t", lambda x: ~x["common"] & x["rejected"])}
    prompt = F.filter("t", lambda x: x["common"])
    return grouped.select(
        "pair_id", "segment", "differs", F.size(prompt).cast("long").alias("prompt_turns"), render(prompt).alias("prompt"),
        render(side["chosen"]).alias("chosen"), spans(side["chosen"], F.col("chosen_base")).alias("chosen_spans"), render(side["rejected"]).alias("rejected"), spans(side["rejected"], F.col("rejected_base")).alias("rejected_spans"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, scratch: Scratch, key: str = "pair_id") -> DataFrame:
    """Formats the pairs of two tables of turns (key, turn, role, text)."""
    sides = [turns(t, key).withColumns({"chosen": F.lit(c), "rejected": F.lit(not c)}) for t, c in ((chosen, True), (rejected, False))]
    return format_pairs(sides[0].unionByName(sides[1]), scratch)


def swapped_replies(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows for ``format_pairs`` made of plain conversations.

    Chosen is a conversation as it is.  Rejected is what comes before its last assistant
    turn, then the last assistant turn of its neighbour (ids 2k and 2k+1 are neighbours);
    nothing if the neighbour has none.  Without an assistant turn both are alike.
    """
    rows = turns(conversations, "conv_id")
    last = rows.filter("role = 'assistant' and pair_id is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("l"))
    last = scratch.keep(last.select(F.col("pair_id").alias("p"), F.col("l.turn").alias("last_turn"), F.col("l.text").alias("reply")), "last")
    kept = rows.join(last.select("p", "last_turn"), F.col("pair_id") == F.col("p"), "left")
    kept = kept.select("pair_id", "turn", "role", "text", F.lit(True).alias("chosen"), (F.col("last_turn").isNull() | (F.col("turn") < F.col("last_turn"))).alias("rejected"))
    other = last.select(F.col("p").bitwiseXOR(F.lit(1)).alias("q"), F.col("reply").alias("other"))
    swapped = last.join(other, F.col("p") == F.col("q")).select(F.col("p").alias("pair_id"), F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"), F.lit(False).alias("chosen"), F.lit(True).alias("rejected"))
    return kept.unionByName(swapped)


SWAPPED_SQL = """
WITH c AS (SELECT DISTINCT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT pair_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) AS k FROM c WHERE role = 'assistant' AND pair_id IS NOT NULL) WHERE k = 1),
rejected AS (
  SELECT c.* FROM c LEFT JOIN last l ON c.pair_id = l.pair_id WHERE l.turn IS NULL OR c.turn < l.turn
  UNION ALL SELECT l.pair_id, l.turn, 'assistant', o.text FROM last l JOIN last o ON l.pair_id = xor(o.pair_id, 1)),
flags AS (
  SELECT pair_id, turn, role, text, bool_or(ch) AS ch, bool_or(rj) AS rj
  FROM (SELECT *, true AS ch, false AS rj FROM c UNION ALL SELECT *, false, true FROM rejected) GROUP BY ALL),
parts AS (SELECT pair_id, min(turn) AS parted FROM flags WHERE NOT (ch AND rj) GROUP BY pair_id),
known AS (
  SELECT f.*, CAST(floor(f.turn / 1024) AS BIGINT) AS segment, p.parted IS NOT NULL AS differs, p.parted IS NULL OR f.turn < p.parted AS common,
    CASE WHEN f.pair_id IS NULL THEN row_number() OVER (ORDER BY f.pair_id, f.turn, role, text) END AS lone, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM flags f LEFT JOIN parts p ON f.pair_id = p.pair_id),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN ch AND NOT common THEN length(head || body) END) OVER w, 0) AS ca, coalesce(sum(CASE WHEN rj AND NOT common THEN length(head || body) END) OVER w, 0) AS ra
  FROM known WINDOW w AS (PARTITION BY pair_id, lone ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, segment, bool_or(differs) AS differs, count(*) FILTER (common) AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (ch AND NOT common), '') AS chosen,
  coalesce(string_agg((ca + length(head)) || ':' || length(body), ',' ORDER BY turn, role, text) FILTER (ch AND NOT common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || body, '' ORDER BY turn, role, text) FILTER (rj AND NOT common), '') AS rejected,
  coalesce(string_agg((ra + length(head)) || ':' || length(body), ',' ORDER BY turn, role, text) FILTER (rj AND NOT common AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id, segment, lone
"""
