"""Contract text to numbered clauses with character offsets.

Everything happens inside the row of one version: the text is cut in front of
every marker, offsets are running lengths of the pieces, and one generator turns
the finished array into rows. There is no shuffle and no window, so a very long
contract costs its own row only.

Input ``texts``: ``version_id``, ``text``. Output clauses: ``version_id``,
``ordinal``, ``heading_path``, ``text``, ``char_start``, ``char_end`` (offsets
count characters of the original text, end exclusive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import running_total
from clauselake.functions.text import (
    count_matches,
    leading_blanks,
    let,
    running_starts,
    split_before,
    starts_with,
    strip,
)

def _clause(heading: Column, text: Column, start: Column, end: Column) -> Column:
    return F.struct(
        heading.cast("string").alias("heading_path"),
        text.alias("text"),
        start.cast("bigint").alias("char_start"),
        end.cast("bigint").alias("char_end"),
    )


def _located(pieces: Column) -> Column:
    """Pieces of a cut text as (piece, start) pairs."""
    return let(
        pieces,
        lambda ps: F.arrays_zip(
            ps.alias("piece"), running_starts(F.transform(ps, F.length)).alias("start")
        ),
    )


def _marked(located: Column, pattern: str) -> Column:
    """Pieces that begin with the marker; text before the first one belongs to none."""
    return F.filter(located, lambda p, i: (i > 0) | starts_with(p["piece"], pattern))


def _by_marker(located: Column, pattern: str, label) -> Column:
    return F.transform(
        _marked(located, pattern),
        lambda p: _clause(
            label(p["piece"]), strip(p["piece"]), p["start"], p["start"] + F.length(p["piece"])
        ),
    )


def _first_group(pattern: str):
    return lambda piece: F.regexp_extract(piece, "(?dU)" + pattern, 1)


def _heading_label(piece: Column) -> Column:
    pattern = "(?dU)" + K.HEADING
    return F.concat_ws(" ", F.regexp_extract(piece, pattern, 1), F.regexp_extract(piece, pattern, 2))


def subitem_clauses(section: Column, heading: Column, start: Column) -> Column:
    """Clauses of one stripped section: numbered sub-items, else lettered; null without either."""
    numbered = count_matches(section, K.PARENTHESISED) >= 2
    lettered = count_matches(section, K.LETTERED) >= 2
    pieces = F.when(numbered, split_before(section, K.PARENTHESISED)).when(
        lettered, split_before(section, K.LETTERED)
    )
    # a piece of either kind begins with its marker; the text before the first one does not
    items = F.filter(
        _located(pieces),
        lambda p, i: (i > 0)
        | starts_with(p["piece"], K.PARENTHESISED)
        | (starts_with(p["piece"], K.LETTERED) & ~numbered),
    )
    label = lambda piece: F.regexp_extract(piece, r"^(\([^)]*\))", 1)
    return F.transform(
        items,
        lambda p: _clause(
            F.concat(heading, F.lit(f" > {K.SUBITEM_LABEL} "), label(p["piece"])),
            strip(p["piece"]),
            start + p["start"],
            start + p["start"] + F.length(p["piece"]),
        ),
    )


def _heading_clauses(located: Column) -> Column:
    def section_clauses(piece: Column, start: Column) -> Column:
        whole = F.array(
            _clause(_heading_label(piece), strip(piece), start, start + F.length(piece))
        )
        nested = let(strip(piece), lambda s: subitem_clauses(s, _heading_label(piece), start))
        return F.coalesce(nested, whole)

    return F.flatten(
        F.transform(
            _marked(located, K.HEADING), lambda p: section_clauses(p["piece"], p["start"])
        )
    )


def _dotted_clauses(located: Column) -> Column:
    return _by_marker(located, K.DOTTED, _first_group(K.DOTTED))


def _numbered_clauses(located: Column) -> Column:
    number = _first_group(K.NUMBERED)
    return _by_marker(located, K.NUMBERED, lambda piece: F.concat(number(piece), F.lit(".")))


def _parenthesised_clauses(located: Column) -> Column:
    number = _first_group(K.PARENTHESISED)
    return _by_marker(
        located, K.PARENTHESISED, lambda piece: F.concat(F.lit("("), number(piece), F.lit(")"))
    )


def _paragraph_clauses(located: Column) -> Column:
    stripped = F.transform(
        located,
        lambda p: let(
            p["start"] + leading_blanks(p["piece"]),
            lambda start: _clause(
                F.lit(None), strip(p["piece"]), start, start + F.length(strip(p["piece"]))
            ),
        ),
    )
    return F.filter(stripped, lambda c: c["text"] != "")


def strategy(text: Column) -> Column:
    """The first marker family that yields clauses; null for blank text."""
    return (
        F.when(text.isNull() | (strip(text) == ""), F.lit(None).cast("string"))
        .when(count_matches(text, K.HEADING) >= 1, "heading")
        .when(count_matches(text, K.DOTTED) >= 2, "dotted")
        .when(count_matches(text, K.NUMBERED) >= 2, "numbered")
        .when(count_matches(text, K.PARENTHESISED) >= 2, "parenthesised")
        .otherwise("paragraphs")
    )


# name: (marker or None, clauses from the located pieces)
_BRANCHES = {
    "heading": (K.HEADING, _heading_clauses),
    "dotted": (K.DOTTED, _dotted_clauses),
    "numbered": (K.NUMBERED, _numbered_clauses),
    "parenthesised": (K.PARENTHESISED, _parenthesised_clauses),
    "paragraphs": (None, _paragraph_clauses),
}


def _pieces(text: Column, marker: str | None) -> Column:
    return split_before(text, marker) if marker else F.split(text, r"(?<=\n\n)(?!\n)", -1)


def _choose(name: Column, values: dict[str, Column]) -> Column:
    chain = F
    for key, value in values.items():
        chain = chain.when(name == key, value)
    return chain


def _cut(texts: DataFrame) -> DataFrame:
    """``strategy`` and the located pieces of each text; both null for a blank one.

    There is no filter on the strategy: pushed below, it would compute the text twice.
    """
    named = texts.withColumn("strategy", strategy(F.col("text")))
    pieces = _choose(
        F.col("strategy"), {k: _pieces(F.col("text"), m) for k, (m, _) in _BRANCHES.items()}
    )
    return named.withColumn("_located", _located(pieces))


def _clauses() -> Column:
    return _choose(
        F.col("strategy"), {k: build(F.col("_located")) for k, (_, build) in _BRANCHES.items()}
    )


def _number(df: DataFrame, clauses: Column, keep: list[str]) -> DataFrame:
    """Reading order across the version, after sub-items are flattened."""
    rows = df.select(*keep, F.posexplode(clauses).alias("_pos", "_c"))
    return rows.select(
        *keep, (F.col("_pos") + 1).cast("int").alias("ordinal"), F.col("_c.*")
    )


def segment(texts: DataFrame) -> DataFrame:
    """Cut every text by its own strategy. Blank text yields nothing, other text at least one."""
    return _number(_cut(texts), _clauses(), [c for c in texts.columns if c != "text"])


def segment_strategy(texts: DataFrame) -> DataFrame:
    return texts.select("version_id", strategy(F.col("text")).alias("strategy"))


def segment_by(texts: DataFrame, name: str, minimum: int = 1) -> DataFrame:
    """One strategy on its own; texts with fewer than its minimum of markers yield nothing."""
    marker, build = _BRANCHES[name]
    text = F.col("text")
    clauses = build(_located(_pieces(text, marker)))
    if marker:
        clauses = F.when(count_matches(text, marker) >= minimum, clauses)
    return _number(texts, clauses, [c for c in texts.columns if c != "text"])


def segment_headings(texts: DataFrame) -> DataFrame:
    return segment_by(texts, "heading", 1)


def segment_dotted(texts: DataFrame) -> DataFrame:
    return segment_by(texts, "dotted", 2)


def segment_numbered(texts: DataFrame) -> DataFrame:
    return segment_by(texts, "numbered", 2)


def segment_parenthesised(texts: DataFrame) -> DataFrame:
    return segment_by(texts, "parenthesised", 2)


def segment_paragraphs(texts: DataFrame) -> DataFrame:
    return segment_by(texts, "paragraphs")


def heading_sections(texts: DataFrame) -> DataFrame:
    """Whole sections as cut by their headings: ``version_id, heading_path, text, char_start``."""
    located = _located(_pieces(F.col("text"), K.HEADING))
    rows = texts.select(
        "version_id", F.inline(_marked(located, K.HEADING)).alias("text", "char_start")
    )
    return rows.select(
        "version_id", _heading_label(F.col("text")).alias("heading_path"), "text", "char_start"
    )


def segment_subitems(sections: DataFrame) -> DataFrame:
    """Sub-items of given sections (``version_id``, ``heading_path``, ``text``, ``char_start``)."""
    items = let(
        strip(F.col("text")),
        lambda s: subitem_clauses(s, F.col("heading_path"), F.col("char_start")),
    )
    rows = sections.select("version_id", F.posexplode(items).alias("_pos", "_c"))
    return rows.select(
        "version_id", (F.col("_pos") + 1).cast("int").alias("item_no"), F.col("_c.*")
    )


def number_clauses(pieces: DataFrame) -> DataFrame:
    """Ordinals by ``char_start`` for clauses that arrive as rows without one."""
    offsets = pieces.select("version_id", "char_start")
    ordinal = running_total(offsets, ["version_id"], ["char_start"], F.lit(1), "ordinal")
    return pieces.join(
        ordinal.withColumn("ordinal", F.col("ordinal").cast("int")), ["version_id", "char_start"]
    )


def uncovered_text(texts: DataFrame) -> DataFrame:
    """Spans of each text that no clause covers (preambles, text before a first sub-item)."""
    size = F.length("text").cast("bigint")
    gaps = let(
        _clauses(),
        lambda a: F.zip_with(
            F.concat(F.array(F.lit(0).cast("bigint")), F.transform(a, lambda x: x["char_end"])),
            F.concat(F.transform(a, lambda x: x["char_start"]), F.array(size)),
            lambda s, e: F.struct(s.alias("gap_start"), e.alias("gap_end")),
        ),
    )
    rows = _cut(texts).select("version_id", F.inline(gaps))
    return rows.filter("gap_end > gap_start")


def clause_ref(df: DataFrame) -> DataFrame:
    """Heading path, else the label with the ordinal; an empty heading counts as missing."""
    return df.withColumn("clause_ref", reference(F.col("heading_path"), F.col("ordinal")))


def reference(heading: Column, ordinal: Column) -> Column:
    return F.coalesce(
        F.nullif(heading, F.lit("")), F.concat(F.lit(f"{K.CLAUSE_LABEL} "), ordinal.cast("string"))
    )


def linearize_table(cells: DataFrame) -> DataFrame:
    """Reading order of paragraphs and tables: row-major, merged cells once, blanks dropped.

    Input ``doc_id, block, row, col, cell_id, text``; a paragraph is a block with
    one cell. Output is one row per line, numbered ``line_no`` through the document by its
    place (block, row, col), so a long document stays a set of rows.
    """
    first = F.min(F.struct("col", F.col("text").alias("line"))).alias("_cell")
    lines = (
        cells.withColumn("text", strip(F.col("text")))
        .groupBy("doc_id", "block", "row", "cell_id")
        .agg(first)
        .select("doc_id", "block", "row", "_cell.col", "_cell.line")
        .filter("line <> ''")
    )
    return running_total(lines, ["doc_id"], ["block", "row", "col"], F.lit(1), "line_no")
