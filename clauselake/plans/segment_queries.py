"""Registered queries for clause segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import segment as S
from clauselake.plans import fixtures as X
from clauselake.plans.fixtures import BLANKS
from clauselake.session import stored

HEAD = r"(?m)^((?:PASAL|Pasal|ARTICLE|Article)\s+\d+[A-Z]?\b)"
DOT = r"(?m)^(\d+\.\d+(?:\.\d+)*\s+)"
NUM = r"(?m)^(\d+\.\s+)"
PAR = r"(?m)^(\(\d+\)\s+)"
LET = r"(?m)^(\([a-z]\)\s+)"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _mark(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '{pattern}', chr(1) || '\\1', 'g')"


CLAUSES = (
    X.CONTRACT_TEXTS
    + f""",
chosen AS (SELECT *, CASE WHEN trim(text, '{BLANKS}') = '' THEN NULL
    WHEN {_count('text', HEAD)} >= 1 THEN 'heading' WHEN {_count('text', DOT)} >= 2 THEN 'dotted'
    WHEN {_count('text', NUM)} >= 2 THEN 'numbered' WHEN {_count('text', PAR)} >= 2 THEN 'parenthesised'
    ELSE 'paragraphs' END AS strategy FROM contracts),
cut AS (SELECT version_id, strategy, string_split(CASE strategy
    WHEN 'heading' THEN {_mark('text', HEAD)} WHEN 'dotted' THEN {_mark('text', DOT)}
    WHEN 'numbered' THEN {_mark('text', NUM)} WHEN 'parenthesised' THEN {_mark('text', PAR)}
    ELSE regexp_replace(text, '(\\n\\n+)', '\\1' || chr(1), 'g') END, chr(1)) AS l
    FROM chosen WHERE strategy IS NOT NULL),
piece AS (SELECT version_id, strategy, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM cut),
located AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY version_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM piece),
section AS MATERIALIZED (SELECT *, trim(piece, '{BLANKS}') AS t,
    regexp_extract(piece, '^(PASAL|Pasal|ARTICLE|Article)', 1) || ' ' ||
    regexp_extract(piece, '^(?:PASAL|Pasal|ARTICLE|Article)\\s+(\\d+[A-Z]?)', 1) AS h
    FROM located WHERE strategy = 'heading' AND i > 1),
kind AS (SELECT *, CASE WHEN {_count('t', PAR)} >= 2 THEN 'P' WHEN {_count('t', LET)} >= 2 THEN 'L'
    ELSE '' END AS sub FROM section),
subcut AS (SELECT version_id, i, s, h, string_split(CASE sub WHEN 'P' THEN {_mark('t', PAR)}
    ELSE {_mark('t', LET)} END, chr(1)) AS l FROM kind WHERE sub <> ''),
subpiece AS (SELECT version_id, i, s, h, unnest(l) AS piece, generate_subscripts(l, 1) AS k FROM subcut),
subitem AS MATERIALIZED (SELECT *, s + coalesce(sum(length(piece)) OVER (PARTITION BY version_id, i
    ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs FROM subpiece),
found AS (
  SELECT version_id, h || ' > Ayat ' || regexp_extract(piece, '^(\\([0-9a-z]+\\))', 1) AS heading_path,
    trim(piece, '{BLANKS}') AS text, cs AS char_start, cs + length(piece) AS char_end
    FROM subitem WHERE k > 1
  UNION ALL SELECT version_id, h, t, s, s + length(piece) FROM kind WHERE sub = ''
  UNION ALL SELECT version_id, CASE strategy WHEN 'dotted' THEN regexp_extract(piece, '^[\\d.]+')
    WHEN 'numbered' THEN regexp_extract(piece, '^\\d+\\.') ELSE regexp_extract(piece, '^\\(\\d+\\)') END,
    trim(piece, '{BLANKS}'), s, s + length(piece)
    FROM located WHERE strategy IN ('dotted', 'numbered', 'parenthesised') AND i > 1
  UNION ALL SELECT version_id, NULL, trim(piece, '{BLANKS}'),
    s + length(piece) - length(ltrim(piece, '{BLANKS}')),
    s + length(piece) - length(ltrim(piece, '{BLANKS}')) + length(trim(piece, '{BLANKS}'))
    FROM located WHERE strategy = 'paragraphs' AND trim(piece, '{BLANKS}') <> ''),
clauses AS MATERIALIZED (SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id
    ORDER BY char_start) AS INTEGER) AS ordinal, heading_path, text,
    CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM found)"""
)


def clauses(spark, sf_dir):
    return S.segment(X.contract_texts(spark, sf_dir))


def clause_table(spark, sf_dir):
    """The clauses as a written table, for queries that read them several times."""
    return stored(clauses(spark, sf_dir), "clauses")


def _one_strategy(name, fn):
    def run(spark, sf_dir):
        return fn(X.contract_texts(spark, sf_dir))

    return run


def _single_sql(pattern: str, minimum: int, label: str) -> str:
    return (
        f"WITH {X.CONTRACT_TEXTS}, cut AS (SELECT version_id, string_split({_mark('text', pattern)}, chr(1)) AS l"
        f" FROM contracts WHERE {_count('text', pattern)} >= {minimum}),"
        " piece AS (SELECT version_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM cut),"
        " located AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY version_id ORDER BY i"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM piece)"
        f" SELECT version_id, CAST(i - 1 AS INTEGER) AS ordinal, regexp_extract(piece, '{label}') AS heading_path,"
        f" trim(piece, '{BLANKS}') AS text, CAST(s AS BIGINT) AS char_start,"
        " CAST(s + length(piece) AS BIGINT) AS char_end FROM located WHERE i > 1"
    )


def _headings(spark, sf_dir):
    return S.segment_headings(X.contract_texts(spark, sf_dir))


def _strategy(spark, sf_dir):
    return S.segment_strategy(X.contract_texts(spark, sf_dir))


def _sections(spark, sf_dir):
    """Sections as cut by their headings, before sub-items are looked for."""
    return S.heading_sections(X.contract_texts(spark, sf_dir))


def _subitems(spark, sf_dir):
    return S.segment_subitems(_sections(spark, sf_dir))


def _numbered_rows(spark, sf_dir):
    rows = clause_table(spark, sf_dir).drop("ordinal")
    return S.number_clauses(rows).select("version_id", "ordinal", "char_start", "char_end")


def _uncovered(spark, sf_dir):
    return S.uncovered_text(X.contract_texts(spark, sf_dir))


def _refs(spark, sf_dir):
    return S.clause_ref(clauses(spark, sf_dir)).select("version_id", "ordinal", "clause_ref")


def cells(spark, sf_dir):
    """Every fourth block of four lines is a table of two rows, the rest paragraphs between tables."""
    rows = X.line_rows(spark, sf_dir)
    block = F.floor((F.col("pos") - 1) / 4)
    table = block % 4 == 3
    col = ((F.col("pos") - 1) % 4).cast("int")
    return rows.select(
        "doc_id",
        F.when(table, block * 4 + 1).otherwise(F.col("pos")).cast("int").alias("block"),
        F.when(table, F.floor(col / 2)).otherwise(0).cast("int").alias("row"),
        F.when(table, col % 2).otherwise(0).cast("int").alias("col"),
        F.when(table & (F.col("pos") % 3 == 0), F.concat(F.lit("m"), block.cast("string")))
        .otherwise(F.concat(F.lit("c"), F.col("pos").cast("string")))
        .alias("cell_id"),
        F.when(F.col("pos") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "line")).alias("text"),
    )


CELLS = (
    X.LINES
    + """,
cells AS (SELECT doc_id, CASE WHEN t THEN b * 4 + 1 ELSE pos END AS block,
  CASE WHEN t THEN c // 2 ELSE 0 END AS "row", CASE WHEN t THEN c % 2 ELSE 0 END AS col,
  CASE WHEN t AND pos % 3 = 0 THEN 'm' || b ELSE 'c' || pos END AS cell_id,
  CASE WHEN pos % 11 = 0 THEN '  ' ELSE ' ' || line END AS text
  FROM (SELECT *, (pos - 1) // 4 AS b, (pos - 1) // 4 % 4 = 3 AS t, (pos - 1) % 4 AS c FROM lines))"""
)


def _table_lines(spark, sf_dir):
    return S.linearize_table(cells(spark, sf_dir))


QUERIES = {
    "segment": clauses,
    "segment_strategy": _strategy,
    "segment_headings": _headings,
    "segment_subitems": _subitems,
    "segment_dotted": _one_strategy("dotted", S.segment_dotted),
    "segment_numbered": _one_strategy("numbered", S.segment_numbered),
    "segment_parenthesised": _one_strategy("parenthesised", S.segment_parenthesised),
    "segment_paragraphs": _one_strategy("paragraphs", S.segment_paragraphs),
    "number_clauses": _numbered_rows,
    "uncovered_text": _uncovered,
    "clause_ref": _refs,
    "linearize_table": _table_lines,
}

_HEADING_CLAUSES = CLAUSES.replace("FROM chosen WHERE strategy IS NOT NULL", "FROM chosen WHERE strategy = 'heading'")

ORACLES = {
    "segment": f"WITH {CLAUSES} SELECT * FROM clauses",
    "segment_strategy": f"WITH {CLAUSES} SELECT version_id, strategy FROM chosen",
    "segment_headings": f"WITH {_HEADING_CLAUSES} SELECT * FROM clauses",
    "segment_subitems": f"WITH {CLAUSES} SELECT version_id, CAST(k - 1 AS INTEGER) AS item_no,"
    " h || ' > Ayat ' || regexp_extract(piece, '^(\\([0-9a-z]+\\))', 1) AS heading_path,"
    f" trim(piece, '{BLANKS}') AS text, CAST(cs AS BIGINT) AS char_start,"
    " CAST(cs + length(piece) AS BIGINT) AS char_end FROM subitem WHERE k > 1",
    "segment_dotted": _single_sql(DOT, 2, r"^[\d.]+"),
    "segment_numbered": _single_sql(NUM, 2, r"^\d+\."),
    "segment_parenthesised": _single_sql(PAR, 2, r"^\(\d+\)"),
    "segment_paragraphs": "WITH "
    + X.CONTRACT_TEXTS
    + f""", cut AS (SELECT version_id, string_split(regexp_replace(text, '(\\n\\n+)', '\\1' || chr(1), 'g'), chr(1)) AS l
  FROM contracts), piece AS (SELECT version_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM cut),
located AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY version_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) - length(ltrim(piece, '{BLANKS}')) AS s FROM piece)
SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY i) AS INTEGER) AS ordinal,
  CAST(NULL AS VARCHAR) AS heading_path, trim(piece, '{BLANKS}') AS text, CAST(s AS BIGINT) AS char_start,
  CAST(s + length(trim(piece, '{BLANKS}')) AS BIGINT) AS char_end FROM located WHERE trim(piece, '{BLANKS}') <> ''""",
    "number_clauses": f"WITH {CLAUSES} SELECT version_id, ordinal, char_start, char_end FROM clauses",
    "uncovered_text": f"""WITH {CLAUSES}, edge AS (
  SELECT version_id, char_start AS s, char_end AS e FROM clauses
  UNION ALL SELECT version_id, length(text), length(text) FROM contracts),
gap AS (SELECT version_id, coalesce(lag(e) OVER (PARTITION BY version_id ORDER BY s, e), 0) AS gap_start, s AS gap_end FROM edge)
SELECT version_id, CAST(gap_start AS BIGINT) AS gap_start, CAST(gap_end AS BIGINT) AS gap_end FROM gap WHERE gap_end > gap_start""",
    "clause_ref": f"WITH {CLAUSES} SELECT version_id, ordinal, coalesce(nullif(heading_path, ''), 'Klausul ' || ordinal) AS clause_ref FROM clauses",
    "linearize_table": f"""WITH {CELLS} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, "row", col) AS line_no FROM (SELECT doc_id, block, "row", min(col) AS col, arg_min(line, col) AS line
  FROM (SELECT *, trim(text) AS line FROM cells) GROUP BY doc_id, block, "row", cell_id HAVING arg_min(line, col) <> '')""",
}
