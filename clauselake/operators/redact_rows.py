"""One mapping for all texts of a version, without gathering the version.

Clauses and comments are redacted row by row, in stages of pattern types. In a stage every
row marks its own matches; the distinct originals of a version, in the order of their first
places, are numbered by running totals over ranges of rows, and the tokens are joined back to
the rows that hold matches. Only matches move, so a version with a third of all clauses
spans as many tasks as any other rows.

A stage ends where later patterns could see the numbers of earlier tokens: the phone
pattern can match inside an index, and the length of an address counts its characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.running import running_total
from clauselake.functions.text import every_second, let, matches_in_turn
from clauselake.operators.redact import _java, may_hold, patterns
from clauselake.session import discard, stored

_STAGES = (("NIK", "NPWP", "EMAIL"), ("PHONE", "BANK"), ("ADDR",))
_MARK = "\ue000"  # private use: stands between type and number until the token is known
_OWN = _MARK + "\ue001"  # the text's own mark, where it has one
_PLACEHOLDER = rf"\[[A-Z]+{_MARK}\d+\]"
_FOUND = "array<struct<kind:string,no:int,original:string>>"


def _marked(text: Column, stage: list[tuple[str, str]]) -> Column:
    """(text with a placeholder for every match, the matches in order) of one row."""
    state = F.struct(text.alias("text"), F.array().cast(_FOUND).alias("found"))

    def cut(s: Column, kind: str, pattern: str) -> Column:
        holder = lambda i: F.concat(F.lit(f"[{kind}{_MARK}"), i.cast("string"), F.lit("]"))

        def replaced(outside: Column, matches: Column) -> Column:
            holders = F.transform(matches, lambda m, i: holder(i))
            rows = F.transform(
                matches, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), m.alias("original"))
            )
            joined = F.zip_with(outside, holders, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
            return F.struct(F.array_join(joined, "").alias("text"), F.concat(s["found"], rows).alias("found"))

        def found(pieces: Column) -> Column:
            done = let(every_second(pieces, 1), lambda matches: replaced(every_second(pieces, 0), matches))
            return F.when(F.size(pieces) > 1, done).otherwise(s)

        return let(matches_in_turn(s["text"], _java(pattern)), found)

    def bound(kind: str, pattern: str):
        return lambda s: cut(s, kind, pattern)

    for kind, pattern in stage:
        state = let(state, bound(kind, pattern))
    return state


def _with_tokens(text: Column, tokens: Column) -> Column:
    """Placeholders replaced by ``tokens`` (a map by ``kind + number``); unknown ones stay."""
    name = lambda h: F.translate(h, f"[{_MARK}]", "")

    def filled(holders: Column) -> Column:
        found = F.transform(holders, lambda h: F.coalesce(F.element_at(tokens, name(h)), h))
        pieces = F.split(text, _PLACEHOLDER, -1)
        return F.array_join(F.zip_with(pieces, found, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")

    return let(F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(0)), filled)


def _numbered(hits: DataFrame, known: DataFrame) -> DataFrame:
    """``version_id, token, original`` of the originals that have no token yet."""
    first = hits.groupBy("version_id", "kind", "original").agg(F.min(F.struct("place", "no")).alias("_f"))
    fresh = first.join(known.select("version_id", "original"), ["version_id", "original"], "left_anti")
    placed = running_total(
        fresh.select("version_id", "kind", "_f.place", "_f.no", "original"),
        ["version_id", "kind"],
        ["place", "no"],
        F.lit(1),
        "_n",
    )
    index = F.regexp_extract("token", r"^\[[A-Z]+_(\d+)\]$", 1).try_cast("bigint")
    highest = (
        known.select("version_id", F.regexp_extract("token", r"^\[([A-Z]+)_\d+\]$", 1).alias("kind"), index.alias("_i"))
        .filter("kind <> ''")
        .groupBy("version_id", "kind")
        .agg(F.max("_i").alias("_base"))
    )
    number = F.coalesce("_base", F.lit(0)) + F.col("_n")
    return placed.join(highest, ["version_id", "kind"], "left").select(
        "version_id",
        F.concat(F.lit("["), "kind", F.lit("_"), number.cast("string"), F.lit("]")).alias("token"),
        "original",
    )


def redact_rows(
    rows: DataFrame, mapping: DataFrame, strict_phone: bool = False, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Redacted ``version_id, place, text`` and the mapping that they extend.

    ``place`` is a row's place in its version (unique there, and what orders new tokens);
    ``mapping`` is ``version_id, token, original``. An original that has a token keeps it,
    the first by name if it has several; new ones are numbered per type from the highest
    index on, in the order of their first places. A null text counts as empty. Columns to
    ``keep`` come along with their rows, before the text. Both results are stored tables;
    what is stored on the way goes when the next step is stored.
    """
    spark = rows.sparkSession
    cascade = dict(patterns(strict_phone))
    text = F.coalesce("text", F.lit(""))
    personal = F.lit(False)
    for kind, pattern in cascade.items():
        personal = personal | (may_hold(F.col("text"), kind) & F.regexp_like(F.col("text"), F.lit(_java(pattern))))
    own = ["version_id", "place", *keep]
    rows = rows.select(*own, F.replace(text, F.lit(_MARK), F.lit(_OWN)).alias("text"))
    given, before, names = [], [], []
    known = stored(mapping.select("version_id", "token", "original"), "mapping", names)
    # where no pattern matches the text itself, none matches later: such rows stay as they are
    state = stored(rows.withColumn("_personal", personal), "rows", given)
    plain, state = state.filter("NOT _personal").drop("_personal"), state.filter("_personal").drop("_personal")
    for stage in _STAGES:
        past, before, old = before, [], names
        names = []
        cut = state.select(*own, _marked(F.col("text"), [(k, cascade[k]) for k in stage]).alias("_s"))
        cut = stored(cut.select(*own, "_s.text", "_s.found"), "marked", before)
        hits = cut.select("version_id", "place", F.inline("found"))
        known = stored(known.unionByName(_numbered(hits, known)), "mapping", names)
        discard(spark, past + old)
        first = known.groupBy("version_id", "original").agg(F.min("token").alias("token"))
        entry = F.struct(F.concat("kind", F.col("no").cast("string")).alias("k"), F.col("token").alias("t"))
        tokens = (
            hits.join(first, ["version_id", "original"])
            .groupBy("version_id", "place")
            .agg(F.map_from_entries(F.collect_list(entry)).alias("_tokens"))  # one row's matches
        )
        state = cut.join(tokens, ["version_id", "place"], "left").select(
            *own,
            F.when(F.col("_tokens").isNull(), F.col("text"))
            .otherwise(_with_tokens(F.col("text"), F.col("_tokens")))
            .alias("text"),
        )
    as_was = lambda c: F.replace(c, F.lit(_OWN), F.lit(_MARK)).alias(c)
    done = stored(plain.unionByName(state).select(*own, as_was("text")), "redacted")
    discard(spark, given + before)
    return done, known.select("version_id", "token", as_was("original"))


def redact_clauses(
    clauses: DataFrame, mapping: DataFrame, strict_phone: bool = False, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``version_id, ordinal, redacted_text`` of clauses, and the version's extended mapping.

    A personal datum that only shows up inside a clause gets a token that no other clause of
    the version uses. ``ordinal`` is unique in a version. Columns to ``keep`` come along.
    """
    texts, known = redact_rows(clauses.withColumnRenamed("ordinal", "place"), mapping, strict_phone, keep)
    return texts.toDF("version_id", "ordinal", *keep, "redacted_text"), known
