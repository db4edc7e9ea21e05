"""Chat formatting of preference pairs (operator 3).

Turns are gathered into conversations; a chosen and a rejected conversation share their longest
common turn prefix, which is rendered once as the prompt, and the rest of each is rendered as a
completion with a mask: the spans of what the assistant says, end mark included.

``preference_pairs`` makes pairs of conversations that begin with the same turn: in the order of
conv_id, the first with the second, the third with the fourth and so on, so a first turn shared by a third
of all conversations still gives one row for two conversations.  The one with more assistant characters is
chosen, ties by the smaller conv_id.  Numbers within a first turn are counted in two levels, by blocks of
``BLOCK`` conv_ids and then over the blocks, so no task holds all conversations of one first turn.

Defined results: a conversation without a partner is rendered against the empty one (rejected_conv null,
prompt ''); two equal conversations have the whole text as prompt and empty completions; turns are
ordered by turn, role, text, nulls first, and exact repeats of a row count once; null roles and texts are
empty; rows without a conv_id are left out; the marks ``<|`` in a text are written ``< |`` so that no text
forges a turn; empty tables give no rows; offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

BLOCK = 1024
_TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text)."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def preference_pairs(convs: DataFrame) -> DataFrame:
    """chosen_conv, chosen_turns, rejected_conv, rejected_turns of conversations that begin alike."""
    first = F.sha2(F.concat(F.col("turns")[0]["role"], F.lit("\0"), F.col("turns")[0]["text"]), 256)
    weight = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    keyed = convs.select("conv_id", "turns", first.alias("first"), weight.alias("weight"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    sizes = keyed.groupBy("first", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("first").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("first", "block", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(W.partitionBy("first", "block").orderBy("conv_id")) - 1
    placed = keyed.withColumn("at", at).join(offsets, ["first", "block"]).withColumn("at", F.col("at") + F.col("before"))
    member = F.struct((-F.col("weight")).alias("weight"), "conv_id", "turns")
    pairs = placed.groupBy("first", F.floor(F.col("at") / 2).alias("pair")).agg(F.array_sort(F.collect_list(member)).alias("two"))  # one or two members
    return pairs.select(
        F.col("two")[0]["conv_id"].alias("chosen_conv"),
        F.col("two")[0]["turns"].alias("chosen_turns"),
        F.try_element_at("two", F.lit(2))["conv_id"].alias("rejected_conv"),
        F.coalesce(F.try_element_at("two", F.lit(2))["turns"], F.array().cast(_TURNS)).alias("rejected_turns"),
    )


def common_turns(a: Column, b: Column) -> Column:
    """How many turns, from the first on, two conversations share."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render_turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(t["role"]), F.lit("|>\n"), _safe(t["text"]), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def mask(turns: Column) -> Column:
    """start:end of the assistant's texts with their end marks, comma-joined, in the rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_safe(t["role"])) + 5
        end = begin + F.length(_safe(t["text"])) + 7
        span = F.concat(F.when(state["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], F.when(t["role"] == "assistant", span).otherwise(F.lit(""))).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs rendered: prompt, completions and their masks."""
    found = pairs.withColumn("n_common", common_turns(F.col("chosen_turns"), F.col("rejected_turns")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    chosen, rejected = rest("chosen_turns"), rest("rejected_turns")
    return found.select(
        "chosen_conv",
        "rejected_conv",
        "n_common",
        render(F.slice("chosen_turns", 1, F.col("n_common"))).alias("prompt"),
        render(chosen).alias("chosen"),
        mask(chosen).alias("chosen_mask"),
        render(rejected).alias("rejected"),
        mask(rejected).alias("rejected_mask"),
    )


def preferences(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to rendered preference pairs."""
    return format_pairs(preference_pairs(conversations(turns)))
