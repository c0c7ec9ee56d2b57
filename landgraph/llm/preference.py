"""Preference formatting: paired completions behind a prompt rendered once.

Two conversations, a chosen and a rejected one, are compared turn by turn.  Their longest common
prefix is rendered once, as the prompt; what follows in either is its completion.  Each side comes
with the spans of its text that are learned from: the contents of assistant turns behind the
prompt, so headers, other roles and the prompt are masked.

Turns are gathered by conversation, joined to their pair and compared, all with DataFrame
functions; no group is larger than a conversation, and no pairs are made but those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import need, stage

#: Fixed strings around a turn; roles and contents stand between.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"
LEARNED = "assistant"
#: Contents that hold OPEN have this instead, so that none can pass for a turn.
ESCAPED = "<\\|"
PART, MERGE = 200, 64


def transcripts(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row (id, turns) for each conversation: its (role, text) in the order of turn, role, text.

    Null roles and texts count as empty; rows that repeat a turn are both kept, and turns of equal number
    go by role and text; rows without an id belong to no conversation.  ``OPEN`` in a role or text becomes
    ``ESCAPED``.
    """
    need(turns, id_column, turn_column, role_column, text_column)
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit(ESCAPED))
    one = F.struct(F.col(turn_column).alias("turn"), safe(role_column).alias("role"), safe(text_column).alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    return turns.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def consecutive_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs (chosen, rejected, same_opening) of conversations that open alike: in each group of equal first
    turns each with the next one, by a hash of the id; the one that may be left over of a group is paired
    with that of another, as a pair without a common prompt (``same_opening`` is false).  All but one
    conversation at most have a mate.  Conversations without turns open alike.

    A group may hold much of the table: it is paired in parts of some ``PART`` rows, and what is left over
    of ``MERGE`` parts, one of each at most, is paired in the next round, until one part is left.
    """
    parts = max(1, -(-conversations.count() // PART))
    opening = F.xxhash64(F.try_element_at("turns", F.lit(1)))
    left = conversations.select("id", opening.alias("opening"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("part"))
    made = []

    def pair(rows: DataFrame, *keys: str) -> DataFrame:
        """Note the pairs of neighbours; return the odd rows, one for each group at most."""
        order = W.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        ranked = rows.withColumns({"rank": F.row_number().over(order), "mate": F.lead("id").over(order)}).where("rank % 2 = 1")
        ranked = stage(ranked, "pairs")
        made.append(ranked.where("mate is not null").select(F.col("id").alias("chosen"), F.col("mate").alias("rejected"), F.lit("opening" in keys).alias("same_opening")))
        return ranked.where("mate is null").select("id", "opening", "part")

    for keys in (("opening", "part"), ("part",)):
        n = parts
        while True:
            left = pair(left, *keys)
            if n == 1:
                break
            n = -(-n // MERGE)
            left = left.withColumn("part", F.floor(F.col("part") / MERGE))
        left = left.withColumn("part", F.pmod(F.xxhash64("opening"), F.lit(parts)))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """(start, end) in characters of the assistant contents in the rendered ``turns``."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    sized = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), (F.length(t["role"]) + head).alias("head"), F.length(t["text"]).alias("body")))
    none = F.array().cast("array<struct<role:string,start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["body"] + tail).alias("at"),
        F.concat(acc["spans"], F.array(F.struct(t["role"].alias("role"), (acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end")))).alias("spans"),
    )
    learned = F.filter(F.aggregate(sized, zero, step)["spans"], lambda s: (s["role"] == LEARNED) & (s["end"] > s["start"]))
    return F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def format_preferences(turns: DataFrame, pairs: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Render the ``pairs`` (chosen, rejected: ids of conversations in ``turns``).

    Returns ``chosen_id``, ``rejected_id``, ``common_turns``, ``prompt``, ``chosen``, ``rejected``
    (the completions) and ``chosen_spans``, ``rejected_spans`` (what of them is learned from).
    Equal conversations have two empty completions; a pair with an unknown id gives no row, a
    repeated pair a row each.
    """
    need(pairs, "chosen", "rejected")
    whole = transcripts(turns, id_column, turn_column, role_column, text_column)
    return render_pairs(whole, pairs)


def render_pairs(whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """``format_preferences`` of ``transcripts``; other columns of ``pairs`` are carried along."""
    rest_of = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    both = pairs.select(F.col("chosen").alias("chosen_id"), F.col("rejected").alias("rejected_id"), F.struct(F.lit(0), *rest_of).alias("_pair"))
    for side in ("chosen", "rejected"):
        both = both.join(whole.select(F.col("id").alias(f"{side}_id"), F.col("turns").alias(f"{side}_turns")), f"{side}_id")
    differ = F.filter(F.transform(F.arrays_zip("chosen_turns", "rejected_turns"), lambda p, i: F.when(F.coalesce(p["chosen_turns"] == p["rejected_turns"], F.lit(False)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    both = both.withColumn("common_turns", F.coalesce(F.try_element_at(differ, F.lit(1)), F.least(F.size("chosen_turns"), F.size("rejected_turns"))))
    rest = lambda side: F.slice(F.col(f"{side}_turns"), F.col("common_turns") + 1, F.greatest(F.size(f"{side}_turns"), F.lit(1)))
    return both.select(
        "chosen_id",
        "rejected_id",
        "common_turns",
        _render(F.slice(F.col("chosen_turns"), F.lit(1), F.col("common_turns"))).alias("prompt"),
        _render(rest("chosen")).alias("chosen"),
        _render(rest("rejected")).alias("rejected"),
        _spans(rest("chosen")).alias("chosen_spans"),
        _spans(rest("rejected")).alias("rejected_spans"),
        *(F.col("_pair").getField(c).alias(c) for c in rest_of),
    )


def op3_preference_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, in pairs that open alike as far as there are any; the others are marked."""
    whole = stage(transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    out = render_pairs(whole, consecutive_pairs(whole))
    return out.select(
        "chosen_id",
        "rejected_id",
        F.col("common_turns").cast("long").alias("common_turns"),
        "same_opening",
        *(F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")),
        *(F.aggregate(f"{s}_spans", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long").alias(f"{s}_learned") for s in ("chosen", "rejected")),
    )
