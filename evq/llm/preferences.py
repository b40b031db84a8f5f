"""Preference pairs of conversations: the common prompt once, and two completions with loss masks.

The prompt is the longest common prefix of turns (same role, same text) of the chosen and the rejected conversation. It is
rendered once; the turns after it are the completions. A mask is a list of runs (length in code points, trained): the text
and end mark of an assistant turn are trained, headers and other turns are not. ``usable`` says that both completions have
a trained turn.

Turns are in the order of their number; equal numbers are ordered by role and text. A null text is empty, a null role is
rendered as "unknown". A pair whose conversation has no turns gets empty parts; a pair with a null id is dropped. A
conversation is one row of the result and must fit in a row; other groups are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns (role, text) in order."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), one.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Two runs per turn: its header, and its text with the end mark."""
    def runs(t: Column) -> Column:
        head = F.struct((F.length(t["role"]) + len(OPEN) + len(MIDDLE)).alias("length"), F.lit(False).alias("trained"))
        body = F.struct((F.length(t["text"]) + len(CLOSE)).alias("length"), (t["role"] == "assistant").alias("trained"))
        return F.array(head, body)

    return F.flatten(F.transform(turns, runs))


def format_pairs(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns", key: str = "pair_id") -> DataFrame:
    """key, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable for pairs of turn arrays."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    one = pairs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.coalesce(F.col(chosen), none).alias("c"), F.coalesce(F.col(rejected), none).alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(0), both - 1), lambda i: F.get("c", i).eqNullSafe(F.get("r", i)))
    first = F.when(both > 0, F.array_position(same, False)).otherwise(0)  # of the first turn that differs, from 1
    two = one.select("*", F.when(first > 0, first - 1).otherwise(both).cast("int").alias("n"))
    three = two.select("key", "n", F.slice("c", 1, F.col("n")).alias("p"),
                       *(F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))).alias(x) for x in ("c", "r")))
    trained = [F.exists(x, lambda t: t["role"] == "assistant") for x in ("c", "r")]
    return three.select(
        F.col("key").alias(key), F.col("n").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"),
        (trained[0] & trained[1]).alias("usable"))
