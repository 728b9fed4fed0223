"""Extraction quality, language and state audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.text import strip

def coverage_gate(extractions: DataFrame) -> DataFrame:
    """Adds ``coverage`` (ok, partial, empty, needs_ocr), ``extraction_ok`` and ``extraction_note``.

    Input: ``source_format, text, available_chars, pages, bytes``. A PDF with some
    text is partial and is not sent to OCR; an image that fails loses its text.
    """
    fmt, n = F.col("source_format"), F.length("_text")
    floor_pages = F.greatest(F.lit(K.MIN_CHARS), F.lit(K.MIN_CHARS_PER_PAGE) * F.col("pages"))
    floor_image = F.greatest(
        F.lit(1.0),
        F.least(F.lit(float(K.MIN_CHARS)), F.lit(K.MIN_CHARS_PER_KB) * F.col("bytes") / 1024),
    )
    available = F.col("available_chars")
    enough = (
        F.when(
            fmt == "docx",
            (n >= K.MIN_CHARS) & (available > 0) & (n >= available * K.MIN_COVERAGE_RATIO),
        )
        .when(fmt.isin("pdf_text", "pdf_image"), n >= floor_pages)
        .when(fmt == "image", n >= floor_image)
    )
    blank = strip(F.col("_text")) == ""
    coverage = (
        F.when(F.col("_ok"), "ok")
        .when(blank & (fmt == "pdf_text"), "needs_ocr")
        .when(blank | (fmt == "image"), "empty")
        .otherwise("partial")
    )
    partial_note = (
        F.when(
            fmt == "docx",
            F.format_string(
                K.PARTIAL_NOTES["docx"],
                n,
                available,
            ),
        )
        .when(
            fmt == "pdf_text",
            F.format_string(
                K.PARTIAL_NOTES["pdf_text"],
                n,
                "pages",
            ),
        )
        .otherwise(
            F.format_string(
                K.PARTIAL_NOTES["ocr"],
                n,
                "pages",
            )
        )
    )
    empty_note = F.coalesce(*[F.when(fmt == k, v) for k, v in K.EMPTY_NOTES.items()])
    note = F.when(F.col("coverage") == "partial", partial_note).when(
        F.col("coverage") == "empty", empty_note
    )
    text = F.coalesce("text", F.lit(""))
    return (
        extractions.withColumn("_text", F.when(fmt == "image", strip(text)).otherwise(text))
        .withColumn("_ok", F.coalesce(enough, F.lit(False)))
        .withColumn("coverage", coverage)
        .withColumn("extraction_note", note)
        .withColumn("extraction_ok", F.col("_ok"))
        .withColumn("text", F.when((fmt == "image") & ~F.col("_ok"), "").otherwise(F.col("_text")))
        .drop("_text", "_ok")
    )


def coverage_note(extractions: DataFrame) -> DataFrame:
    """Only what separates empty from partial from sufficient text."""
    return coverage_gate(extractions).select("version_id", "coverage", "extraction_note")


def language_bucket(df: DataFrame, column: str = "lang") -> DataFrame:
    """``id``, ``en`` or ``mixed``; ``id`` when nothing was detected."""
    c = F.col(column)
    bucket = F.when(c.isNull(), "id").when(c.isin("id", "en"), c).otherwise("mixed")
    return df.withColumn("language", bucket)


def detect_language(texts: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Language whose profile words occur most often in the whole text, null without any.

    The profiles are short word lists, so scoring stays in the row. The first
    profile wins a tie.
    """
    words = F.split(F.lower("text"), r"[^\p{L}]+", -1)
    listed = texts.withColumn("_w", words)
    scores = F.array(
        *[
            F.struct(
                F.size(_hits(ws)).alias("score"),
                F.lit(-i).alias("order"),
                F.lit(lang).alias("lang"),
            )
            for i, (lang, ws) in enumerate(profiles.items())
        ]
    )
    best = F.array_max(scores)
    return listed.withColumn("_best", best).select(
        *texts.columns,
        F.when(F.col("_best.score") > 0, F.col("_best.lang")).alias("detected"),
        F.col("_best.score").alias("score"),
    )


def _hits(words: list[str]) -> Column:
    return F.filter("_w", lambda w: w.isin(*words))


def accuracy_warning(df: DataFrame) -> DataFrame:
    """Warning text for OCR formats only."""
    text = F.coalesce(*[F.when(F.col("source_format") == k, v) for k, v in K.OCR_WARNINGS.items()])
    return df.withColumn("accuracy_warning", text)


def vocabulary_audit(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Values outside their vocabulary with row counts, all rules in one pass; null passes."""
    found = [
        F.when(
            F.col(c).isNotNull() & ~F.col(c).isin(allowed),
            F.struct(F.lit(c).alias("rule"), F.col(c).cast("string").alias("value")),
        )
        for c, allowed in rules.items()
    ]
    hits = df.select(F.explode(F.array_compact(F.array(*found))).alias("_h")).select("_h.*")
    return hits.groupBy("rule", "value").agg(F.count("*").alias("rows"))


def joint_state_audit(diffs: DataFrame) -> DataFrame:
    """Rows whose status and value contradict: failed needs null, answered needs a valid value."""
    value, status = F.col("materiality"), F.col("classification_status")
    honest = F.when(status == "failed", value.isNull()).when(
        status.isin("ok", "low_confidence"), F.coalesce(value.isin(K.MATERIALITIES), F.lit(False))
    )
    return diffs.filter(~F.coalesce(honest, F.lit(False)))


def stage_status(df: DataFrame) -> DataFrame:
    """Status of the revision and the comment layer: null (not applicable), ok, failed.

    Input: ``source_format, extraction_ok, tc_readable, comments_readable``.
    """
    applies = (F.col("source_format") == "docx") & F.col("extraction_ok")
    state = lambda c: F.when(
        applies, F.when(F.coalesce(F.col(c), F.lit(False)), "ok").otherwise("failed")
    )
    return df.withColumns(
        {
            "tc_parse_status": state("tc_readable"),
            "comments_parse_status": state("comments_readable"),
        }
    )


def ingest_verdict(df: DataFrame) -> DataFrame:
    """A storage failure fails the job, an extraction failure ends it with its note, the rest go on."""
    verdict = (
        F.when(F.col("status") == "failed", "failed")
        .when(~F.coalesce("extraction_ok", F.lit(False)), "done_with_note")
        .otherwise("continue")
    )
    return df.withColumn("verdict", verdict)
