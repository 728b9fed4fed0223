"""Personal data to stable, reversible tokens.

The pattern cascade is folded inside the row of one version: each pattern sees
the tokens of the earlier ones, equal originals share a token, and numbering
continues from the highest index the version already has. Long mapping tables
(``version_id, token, original``) appear only at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.text import every_second, let, matches_in_turn
from clauselake.sources.writes import insert_first_wins

MATCH = "struct<type:string,original:string,token:string>"


# what a match begins with, looked at before the costlier tests of a place's neighbours
_BEGINS = {"NIK": r"(?=\d{16})", "PHONE": "(?=[+60])", "ADDR": "(?i)(?=[jgr])"}


def patterns(strict_phone: bool = False) -> list[tuple[str, str]]:
    """The ordered cascade; the strict phone needs more than a lone two-digit group."""
    return [
        (kind, _BEGINS.get(kind, "") + (K.STRICT_PHONE if strict_phone and kind == "PHONE" else pattern))
        for kind, pattern in K.PII_PATTERNS
    ]


def may_hold(text: Column, kind: str) -> Column:
    """False only where no pattern of this kind can match; cheaper than the search itself."""
    return F.contains(text, F.lit("@")) if kind == "EMAIL" else F.lit(True)


def _java(pattern: str) -> str:
    return "(?dU)" + pattern


def _state(text: Column, originals: Column, tokens: Column, found: Column) -> Column:
    return F.struct(
        text.alias("text"),
        originals.alias("originals"),
        tokens.alias("tokens"),
        found.alias("found"),
    )


def initial_state(text: Column, originals: Column | None = None, tokens: Column | None = None):
    none = F.array().cast("array<string>")
    return _state(
        text,
        none if originals is None else originals,
        none if tokens is None else tokens,
        F.array().cast(f"array<{MATCH}>"),
    )


def _highest(tokens: Column, kind: str) -> Column:
    """The highest index among existing tokens of one type, 0 when there is none."""
    index = F.transform(
        tokens, lambda t: F.regexp_extract(t, rf"^\[{kind}_(\d+)\]$", 1).try_cast("int")
    )
    return F.coalesce(F.array_max(index), F.lit(0))


def _one_pattern(state: Column, kind: str, pattern: str) -> Column:
    """Replace every match of one pattern in the running text."""

    def replaced(outside: Column, matches: Column) -> Column:
        def with_known(known: Column) -> Column:
            token = lambda m: F.get(
                known["tokens"], F.array_position(known["originals"], m).cast("int") - 1
            )

            def rebuilt(tokens: Column) -> Column:
                text = F.array_join(
                    F.zip_with(outside, tokens, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))),
                    "",
                )
                hits = F.zip_with(
                    matches,
                    tokens,
                    lambda m, t: F.struct(
                        F.lit(kind).alias("type"), m.alias("original"), t.alias("token")
                    ),
                )
                return _state(
                    text, known["originals"], known["tokens"], F.concat(state["found"], hits)
                )

            return let(F.transform(matches, token), rebuilt)

        fresh = F.array_except(matches, state["originals"])
        minted = lambda base, new: F.transform(
            new,
            lambda _, i: F.concat(
                F.lit(f"[{kind}_"), (base + i + 1).cast("string"), F.lit("]")
            ),
        )
        known = let(
            fresh,
            lambda new: F.struct(
                F.concat(state["originals"], new).alias("originals"),
                F.concat(
                    state["tokens"],
                    let(_highest(state["tokens"], kind), lambda base: minted(base, new)),
                ).alias("tokens"),
            ),
        )
        return let(known, with_known)

    def found(pieces: Column) -> Column:
        done = let(every_second(pieces, 1), lambda matches: replaced(every_second(pieces, 0), matches))
        return F.when(F.size(pieces) > 1, done).otherwise(state)

    searched = let(matches_in_turn(state["text"], _java(pattern)), found)
    return F.when(may_hold(state["text"], kind), searched).otherwise(state)


def cascade(state: Column, strict_phone: bool = False) -> Column:
    """All patterns in order over one state."""

    def bound(kind: str, pattern: str):
        return lambda s: _one_pattern(s, kind, pattern)

    for kind, pattern in patterns(strict_phone):
        state = let(state, bound(kind, pattern))
    return state


def redacted(texts: DataFrame, strict_phone: bool = False) -> DataFrame:
    """``texts`` plus ``redaction``: the final text, the mapping and every match.

    Optional input columns ``originals`` and ``tokens`` carry an existing mapping.
    """
    known = {"originals", "tokens"} <= set(texts.columns)
    start = initial_state(
        F.col("text"), *((F.col("originals"), F.col("tokens")) if known else ())
    )
    return texts.withColumn("redaction", cascade(start, strict_phone))


def _rows(entries: Column | str) -> Column:
    """Explode with the outer form: for the plain one the planner adds a size test on its
    input, and pushing that test down would run the whole cascade again."""
    return F.posexplode_outer(entries).alias("_pos", "_m")


def detect_pii(texts: DataFrame, strict_phone: bool = False) -> DataFrame:
    """One row per match, in cascade order: type, original, token."""
    rows = redacted(texts, strict_phone).select("version_id", _rows("redaction.found"))
    return rows.filter("_pos is not null").select(
        "version_id", (F.col("_pos") + 1).alias("match_no"), "_m.*"
    )


def redact(texts: DataFrame, strict_phone: bool = False) -> DataFrame:
    return redacted(texts, strict_phone).select(
        "version_id", F.col("redaction.text").alias("redacted_text")
    )


def assign_tokens(texts: DataFrame, strict_phone: bool = False) -> DataFrame:
    """The mapping a text gives rise to, long form, in order of creation."""
    pairs = F.arrays_zip("redaction.tokens", "redaction.originals")
    rows = redacted(texts, strict_phone).select("version_id", _rows(pairs))
    return rows.filter("_pos is not null").select(
        "version_id",
        (F.col("_pos") + 1).alias("token_no"),
        F.col("_m.tokens").alias("token"),
        F.col("_m.originals").alias("original"),
    )


def mapping_arrays(mapping: DataFrame) -> DataFrame:
    """One row per version. The entries are the originals of one text, so they fit its row."""
    entry = F.struct("token", "original")
    packed = mapping.groupBy("version_id").agg(F.array_sort(F.collect_set(entry)).alias("_e"))
    return packed.select(
        "version_id",
        F.col("_e.token").alias("tokens"),
        F.col("_e.original").alias("originals"),
    )


def redact_with_mapping(
    texts: DataFrame, mapping: DataFrame, strict_phone: bool = False
) -> DataFrame:
    """Redact with the tokens a version already has; new ones continue the numbering."""
    none = F.array().cast("array<string>")
    known = texts.join(mapping_arrays(mapping), "version_id", "left")
    known = known.withColumns(
        {c: F.coalesce(F.col(c), none) for c in ("tokens", "originals")}
    )
    return redacted(known, strict_phone).select(
        *texts.columns,
        F.col("redaction.text").alias("redacted_text"),
        F.arrays_zip("redaction.tokens", "redaction.originals").alias("mapping"),
    )


def expand(redacted_texts: DataFrame, mapping: DataFrame, creation_order: bool = False) -> DataFrame:
    """Put the originals back.

    Addresses are found last and may contain an earlier token, so entries are
    applied from the last type to the first; that makes the round trip exact.
    ``creation_order`` applies them first to last and leaves such inner tokens.
    """
    rank = {kind: i for i, (kind, _) in enumerate(K.PII_PATTERNS)}
    kind = F.regexp_extract("token", r"^\[([A-Z]+)_", 1)
    place = F.coalesce(*[F.when(kind == k, i) for k, i in rank.items()], F.lit(len(rank)))
    index = F.regexp_extract("token", r"_(\d+)\]$", 1).try_cast("int")
    entries = mapping.groupBy("version_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (place if creation_order else -place).alias("place"),
                    (index if creation_order else -index).alias("idx"),
                    "token",
                    "original",
                )
            )
        ).alias("_entries")
    )
    restored = F.aggregate(
        F.coalesce(F.col("_entries"), F.array().cast(entries.schema["_entries"].dataType)),
        F.col("redacted_text"),
        lambda t, e: F.replace(t, e["token"], e["original"]),
    )
    return redacted_texts.join(entries, "version_id", "left").select(
        *redacted_texts.columns, restored.alias("text")
    )


def merge_mapping(base: DataFrame, new: DataFrame) -> DataFrame:
    """Add tokens; a token that exists keeps its first original."""
    return insert_first_wins(base, new, ["version_id", "token"])


def residual_pii_audit(outbound: DataFrame) -> DataFrame:
    """Versions whose outbound text still matches a pattern, with counts per type.

    Placeholders are blanked first: an index such as ``_620`` is not a finding. A text that
    leaves several times comes once, with their number in the column ``times``.
    """
    shared = "times" in outbound.columns
    clean = F.regexp_replace("text", r"\[[A-Z]+_\d+\]", "[]")
    counts = [
        F.struct(
            F.lit(kind).alias("type"),
            F.when(may_hold(F.col("_clean"), kind), F.regexp_count(F.col("_clean"), F.lit(_java(pattern))))
            .otherwise(F.lit(0))
            .alias("matches"),
        )
        for kind, pattern in patterns()
    ]
    times = ["times"] if shared else []
    rows = outbound.select("version_id", *times, clean.alias("_clean")).select(
        "version_id", *times, F.inline(F.array(*counts))
    )
    found = rows.filter("matches > 0")
    return found.select("version_id", "type", (F.col("matches") * F.col("times")).alias("matches")) if shared else found


def pii_profile(matches: DataFrame, by: list[str]) -> DataFrame:
    """Matches and distinct originals per group; the per-original counts combine map-side."""
    per_original = matches.groupBy(*by, "type", "original").agg(F.count("*").alias("n"))
    return per_original.groupBy(*by, "type").agg(
        F.sum("n").alias("matches"), F.count("*").alias("distinct_originals")
    )
