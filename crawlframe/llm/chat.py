"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two is rendered once as the prompt; what
follows in each is its completion, with the spans that a loss would count (an
assistant's text and its end mark). Spark SQL functions only.

Rendering of a turn: ``<|role|>\\ntext<|end|>\\n``. ``<|`` within a text is
written ``< |``, so that a text can't open a turn.

Defined cases: turns go by (turn, role, text), nulls first; equal rows of one
conversation count once; a null role is user, a null text is empty; rows
without id are left out, as they belong to no pair; a side that is missing is
a conversation without turns; a pair is usable if the completions differ and
each has a turn of the assistant. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = "struct<turn: bigint, role: string, text: string>"


def _turns(side: Column) -> Column:
    """The sorted distinct turns where side holds; collect_set is combined before the shuffle."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return F.array_sort(F.collect_set(F.when(side, turn)), _by_turn)


def _by_turn(a: Column, b: Column) -> Column:
    def compare(x: Column, y: Column, otherwise: Column) -> Column:
        return (
            F.when(x.eqNullSafe(y), otherwise)
            .when(x.isNull(), F.lit(-1)).when(y.isNull(), F.lit(1))
            .when(x < y, F.lit(-1)).otherwise(F.lit(1))
        )

    return compare(a["turn"], b["turn"], compare(a["role"], b["role"], compare(a["text"], b["text"], F.lit(0))))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """``start-end`` of each assistant's text and end mark in the rendered turns, in characters, joined by commas."""
    state = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<string>)").alias("spans")),
        lambda acc, turn: F.struct(
            (acc["at"] + F.length(_rendered(turn))).alias("at"),
            F.when(
                turn["role"] == "assistant",
                F.array_append(
                    acc["spans"],
                    F.concat_ws(
                        "-",
                        (acc["at"] + F.length(turn["role"]) + 5).cast("string"),
                        (acc["at"] + F.length(_rendered(turn)) - 1).cast("string"),
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.array_join(state["spans"], ",")


def preference(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """Rows (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, usable).

    pair: the pair that a row (turn, role, text) belongs to; chosen: whether to its chosen side.
    """
    sides = (
        turns.select(pair.alias("pair_id"), chosen.alias("is_chosen"), "turn", "role", "text")
        .where("pair_id IS NOT NULL AND is_chosen IS NOT NULL")
        .groupBy("pair_id")
        .agg(_turns(F.col("is_chosen")).alias("c"), _turns(~F.col("is_chosen")).alias("r"))
    )
    # the first place where the two differ; past the shorter one's end there is a null
    differs = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("c"), F.size("r"))),
        lambda i: ~(
            F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
        ),
    )
    n = F.coalesce(F.get(differs, F.lit(0)), F.size("c"))
    parts = sides.withColumn("n", n).select(
        "pair_id",
        "n",
        F.slice("c", F.lit(1), F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.greatest(F.size("c") - F.col("n"), F.lit(0))).alias("c"),
        F.slice("r", F.col("n") + 1, F.greatest(F.size("r") - F.col("n"), F.lit(0))).alias("r"),
    )
    speaks = lambda side: F.exists(side, lambda t: t["role"] == "assistant")
    return parts.select(
        "pair_id",
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        _text(F.col("p")).alias("prompt"),
        _text(F.col("c")).alias("chosen"),
        _text(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"),
        (speaks("c") & speaks("r")).alias("usable"),
    )
