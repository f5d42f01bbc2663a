"""Operator 6: preference pairs from chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows on either
side is rendered as a completion with the character spans to train on (assistant turns and
their end mark).  Column expressions only; one shuffle, on the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def _mask(turns: Column, role: str) -> Column:
    """[first, end) character spans of what follows the head of each turn of ``role``."""
    kind = "struct<at:int,spans:array<struct<first:int,end:int>>>"

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(_head(t))
        end = first + F.length(_tail(t))
        more = F.array(F.struct(first.alias("first"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans")).cast(kind)
    return F.aggregate(turns, start, step)["spans"]


def format_preferences(chosen: DataFrame, rejected: DataFrame, train: str = "assistant") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both inputs hold the turns of conversations as pair_id, turn, role, text.  Turns are ordered
    by (turn, role, text); a null role or text is rendered as empty and equals only a null.  Rows
    without a pair_id are ignored, a pair that lacks one side gets an empty conversation there,
    and equal sides give two empty completions.  Extra columns are ignored."""
    cols = ["pair_id", "turn", "role", "text"]
    both = chosen.select(*cols, F.lit(0).alias("side")).unionByName(rejected.select(*cols, F.lit(1).alias("side"))).where(F.col("pair_id").isNotNull())
    turn = F.struct("turn", "role", "text")
    sides = both.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == i, turn))).alias(x) for i, x in enumerate(("c", "r"))])
    same = F.transform(F.arrays_zip("c", "r"), lambda x: x["c"].isNotNull() & x["r"].isNotNull() & x["c"]["role"].eqNullSafe(x["r"]["role"]) & x["c"]["text"].eqNullSafe(x["r"]["text"]))
    cut = sides.withColumn("differ", F.array_position(same, False)).withColumn("k", F.when(F.col("differ") > 0, F.col("differ") - 1).otherwise(F.size("c")).cast("int"))
    rest = cut.select("pair_id", F.col("k").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("k")).alias("p"), *[F.slice(x, F.col("k") + 1, F.greatest(F.size(x) - F.col("k"), F.lit(0))).alias(x) for x in ("c", "r")])
    return rest.select("pair_id", "n_prompt_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c"), train).alias("chosen_mask"), _mask(F.col("r"), train).alias("rejected_mask"))
