"""Suggested edits as tracked redlines.

Clauses: ``clause_id, text``. Edits: ``clause_id, edit_no, original_text,
revised_text``. Edits of a clause come from one finding's answer, so the fold
stays in the row of its clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import let

SEGMENT = "struct<kind:string,edit_no:int,text:string>"


def edits_by_clause(edits: DataFrame) -> DataFrame:
    """Ordered edits per clause; edits without a clause are dropped."""
    edit = F.struct("edit_no", "original_text", "revised_text")
    return (
        edits.filter("clause_id is not null")
        .groupBy("clause_id")
        .agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    )


def _segment(kind: str, edit_no: Column, text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), edit_no.cast("int").alias("edit_no"), text.alias("text")
    )


def _step(acc: Column, edit: Column) -> Column:
    """One edit against the remaining text; a miss is a comment only."""

    def at(place: Column) -> Column:
        before = F.substring(acc["remaining"], F.lit(1), place - 1)
        after = F.substring(
            acc["remaining"], place + F.length(edit["original_text"]), F.length(acc["remaining"])
        )
        hit = F.struct(
            after.alias("remaining"),
            F.concat(
                acc["segments"],
                F.filter(
                    F.array(
                        _segment("kept", F.lit(None), before),
                        _segment("deleted", edit["edit_no"], edit["original_text"]),
                        _segment("inserted", edit["edit_no"], edit["revised_text"]),
                    ),
                    lambda s: s["text"] != "",
                ),
            ).alias("segments"),
            (acc["tracked"] + 1).alias("tracked"),
            acc["comment_only"].alias("comment_only"),
        )
        miss = F.struct(
            acc["remaining"].alias("remaining"),
            acc["segments"].alias("segments"),
            acc["tracked"].alias("tracked"),
            (acc["comment_only"] + 1).alias("comment_only"),
        )
        return F.when(place > 0, hit).otherwise(miss)

    return let(F.instr(acc["remaining"], edit["original_text"]), at)


def apply_edits(clauses: DataFrame, edits: DataFrame) -> DataFrame:
    """``segments`` (kept, deleted, inserted) and the counts of tracked and comment-only edits."""
    joined = clauses.join(edits_by_clause(edits), "clause_id", "left")
    start = F.struct(
        F.col("text").alias("remaining"),
        F.array().cast(f"array<{SEGMENT}>").alias("segments"),
        F.lit(0).alias("tracked"),
        F.lit(0).alias("comment_only"),
    )
    folded = joined.withColumn(
        "_f", F.when(F.col("edits").isNull(), start).otherwise(F.aggregate("edits", start, _step))
    )
    tail = F.filter(
        F.array(_segment("kept", F.lit(None), F.col("_f.remaining"))), lambda s: s["text"] != ""
    )
    return folded.select(
        *clauses.columns,
        F.concat("_f.segments", tail).alias("segments"),
        F.col("_f.tracked").alias("tracked"),
        F.col("_f.comment_only").alias("comment_only"),
    )


def _joined(kinds: list[str]) -> Column:
    kept = F.filter("segments", lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(kept, lambda s: s["text"]), "")


def accept_all(redlines: DataFrame) -> DataFrame:
    return redlines.withColumn("accepted_text", _joined(["kept", "inserted"]))


def reject_all(redlines: DataFrame) -> DataFrame:
    """Must give back the clause as it was."""
    return redlines.withColumn("rejected_text", _joined(["kept", "deleted"]))


def redline_segments(redlines: DataFrame) -> DataFrame:
    rows = redlines.select("clause_id", F.posexplode_outer("segments").alias("_pos", "_s"))
    return rows.filter("_pos is not null").select(
        "clause_id", (F.col("_pos") + 1).alias("segment_no"), "_s.*"
    )
