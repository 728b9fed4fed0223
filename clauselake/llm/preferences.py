"""Preference pairs: one shared prompt and two masked completions.

Both conversations of a pair are numbered turn by turn and matched by position; the
first position at which they differ ends the common prefix. Everything works on turn
rows, so a long conversation is spread over tasks until its text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.running import running_total

# fixed values: the turn markers of the rendered text
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn as text; a null role or text is empty."""
    blank = F.lit("")
    return F.concat(
        F.lit(OPEN), F.coalesce(role, blank), F.lit("\n"), F.coalesce(text, blank), F.lit(CLOSE)
    )


def preference_turns(turns: DataFrame) -> DataFrame:
    """``pair_id, side, turn, role, text`` -> ``pair_id, part, place, role, text, trained``.

    ``side`` is ``chosen`` or ``rejected``. Turns are placed by ``turn``, then role and
    text; repeated turn rows are turns of their own. Positions agree when role and text
    are equal (two nulls are equal). The longest common prefix comes once, as part
    ``prompt``; what follows is part ``chosen`` or ``rejected``. Turns of the assistant in
    a completion are ``trained``. Rows with a null pair or another side are left out.
    """
    slim = turns.select("pair_id", "side", "turn", "role", "text").filter(
        F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")
    )
    placed = running_total(
        slim, ["pair_id", "side"], ["turn", "role", "text"], F.lit(1), "place"
    ).drop("turn")
    matched = (
        placed.groupBy("pair_id", "place")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(_signature()).alias("low"),
            F.max(_signature()).alias("high"),
        )
        .filter((F.col("n") != 2) | (F.col("low") != F.col("high")))
        .groupBy("pair_id")
        .agg(F.min("place").alias("fork"))
    )
    inside = F.col("fork").isNull() | (F.col("place") < F.col("fork"))
    return (
        placed.join(matched, "pair_id", "left")
        .filter(~(inside & (F.col("side") == "rejected")))
        .select(
            "pair_id",
            F.when(inside, "prompt").otherwise(F.col("side")).alias("part"),
            "place",
            "role",
            "text",
            F.coalesce(~inside & (F.col("role") == "assistant"), F.lit(False)).alias("trained"),
        )
    )


def _signature() -> Column:
    """Digest of a turn that tells null from empty."""
    marked = [F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in ("role", "text")]
    return F.sha2(F.concat(F.length(marked[0]).cast("string"), F.lit(":"), *marked), 256)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: ``pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    Masks list the trained runs of a completion as ``(start, end)`` in characters of that
    completion; the prompt is never trained. A side without turns of its own is empty. A
    pair is one training example, and its text is as long as its conversation.
    """
    piece = F.struct("place", rendered(F.col("role"), F.col("text")).alias("text"), "trained")
    sides = [
        F.sort_array(F.collect_list(F.when(F.col("part") == part, piece))).alias(f"_{part}")
        for part in ("prompt", "chosen", "rejected")
    ]
    grouped = preference_turns(turns).groupBy("pair_id").agg(*sides)

    def joined(part: str) -> Column:
        return F.array_join(F.transform(f"_{part}", lambda t: t["text"]), "")

    def mask(part: str) -> Column:
        step = F.aggregate(
            f"_{part}",
            F.struct(
                F.lit(0).cast("long").alias("at"),
                F.array().cast("array<struct<start:bigint,end:bigint>>").alias("runs"),
            ),
            lambda s, t: F.struct(
                (s["at"] + F.length(t["text"])).alias("at"),
                F.when(
                    t["trained"],
                    F.concat(
                        s["runs"],
                        F.array(
                            F.struct(
                                s["at"].alias("start"),
                                (s["at"] + F.length(t["text"])).alias("end"),
                            )
                        ),
                    ),
                )
                .otherwise(s["runs"])
                .alias("runs"),
            ),
        )
        return step["runs"]

    return grouped.select(
        "pair_id",
        F.size("_prompt").alias("prompt_turns"),
        joined("prompt").alias("prompt"),
        joined("chosen").alias("chosen"),
        joined("rejected").alias("rejected"),
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )
