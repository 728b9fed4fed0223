"""Registered queries for personal-data redaction, over whole texts with planted values."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import redact as R
from clauselake.operators import redact_rows as RR
from clauselake.plans import fixtures as X
from clauselake.session import stored

# planted values follow from the document number; the whole text stays in front
_PLANTED = [
    ("str", "\nNIK "),
    ("pad", ("'32'", "doc_id % 50", 14)),
    ("str", " NPWP 01.234."),
    ("pad", ("''", "doc_id % 40 + 100", 3)),
    ("str", ".5-678.900 mail a"),
    ("num", "doc_id % 30"),
    ("str", "@example.org call 0812-"),
    ("num", "doc_id % 9000 + 1000"),
    ("str", "-77, account 1"),
    ("num", "doc_id % 700 + 4000000000"),
    ("str", " again a"),
    ("num", "doc_id % 30"),
    ("str", "@example.org. Jl. Merdeka no "),
    ("num", "doc_id % 90 + 10"),
    ("str", " blok B\nend of text"),
]


def _expression(parts) -> str:
    """The same SQL text runs in both engines."""
    out = []
    for kind, value in parts:
        if kind == "str":
            out.append("'" + value.replace("\n", "' || chr(10) || '") + "'")
        elif kind == "num":
            out.append(f"CAST({value} AS STRING)")
        else:
            prefix, number, width = value
            out.append(f"{prefix} || lpad(CAST({number} AS STRING), {width}, '0')")
    return " || ".join(out)


PLANTED = _expression(_PLANTED)
SECOND = _expression(
    [
        ("str", "mail a"),
        ("num", "doc_id % 30"),
        ("str", "@example.org or b"),
        ("num", "doc_id % 3"),
        ("str", "@example.org call 0813-"),
        ("num", "doc_id % 9000 + 1000"),
        ("str", "-12 or 0812-"),
        ("num", "doc_id % 9000 + 1000"),
        ("str", "-77 end"),
    ]
)


def pii_texts(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("version_id"), F.expr(f"text || {PLANTED}").alias("text"))


def second_texts(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("version_id"), F.expr(SECOND).alias("text"))


PII = f"t0 AS (SELECT doc_id AS version_id, text || {PLANTED} AS text FROM documents)"
SECOND_TEXTS = f"(SELECT doc_id AS version_id, {SECOND} AS text FROM documents)"

# (type, pattern, needs a non-digit on both sides): no look-around in this dialect, so a
# match is taken together with its neighbours and the search goes on behind it
_CASCADE = [
    ("NIK", r"\d{16}", True),
    ("NPWP", r"\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}", False),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", False),
    ("PHONE", r"(?:\+62|62|0)[0-9](?:[0-9\s\-]{4,11}[0-9])?", True),
    ("BANK", r"\d{10,15}", True),
    (
        "ADDR",
        r"(?i:\b(?:jl\.|jalan|gg\.|gang|rt\s*\.?\s*\d+|rw\s*\.?\s*\d+)[^\n]{0,120})",
        None,
    ),
]


def _regex(pattern: str, digits: bool | None) -> str:
    """Text before the first match, and the match; see ``_CASCADE`` for the neighbours."""
    if digits:
        return rf"(?s)^(.*?[^0-9])({pattern})(?:[^0-9].*)?$"
    if digits is None:
        return rf"(?s)^(.+?)({pattern})(?:[\n,.].*)?$"
    return rf"(?s)^(.+?)({pattern})"


def cascade_sql(tag: str, start: str, known: str | None = None) -> str:
    """CTEs that end in ``{tag}6`` (text) and ``{tag}map6`` (mapping), and ``{tag}hits``."""
    ctes = [
        f"{tag}0 AS MATERIALIZED (SELECT version_id, text FROM {start})",
        f"{tag}map0 AS MATERIALIZED ("
        + (
            f"SELECT version_id, token, original, 0 AS place, 0 AS n FROM {known}"
            if known
            else f"SELECT version_id, '' AS token, '' AS original, 0 AS place, 0 AS n FROM {tag}0 WHERE false"
        )
        + ")",
    ]
    for k, (kind, pattern, digits) in enumerate(_CASCADE, 1):
        regex = _regex(pattern, digits)
        f, m, t = f"{tag}f{k}", f"{tag}map{k}", f"{tag}{k}"
        hit = f"regexp_extract(rest, '{regex}', ['pre', 'hit'])"
        ctes += [
            f"{f} AS MATERIALIZED (SELECT version_id, 0 AS i, '' AS pre, '' AS hit, ' ' || text AS rest FROM {tag}{k - 1}"
            f" UNION ALL SELECT version_id, i + 1, x.pre, x.hit, substr(x.hit, length(x.hit)) ||"
            f" substr(rest, length(x.pre) + length(x.hit) + 1) FROM"
            f" (SELECT *, {hit} AS x FROM {f}) WHERE x.hit <> '')",
            f"{m} AS MATERIALIZED (SELECT * FROM {tag}map{k - 1} UNION ALL"
            f" SELECT version_id, '[{kind}_' || (base + r) || ']', original, {k}, r FROM ("
            f" SELECT o.version_id, original, row_number() OVER (PARTITION BY o.version_id ORDER BY o.i) AS r,"
            f" coalesce(b.base, 0) AS base FROM (SELECT version_id, hit AS original, min(i) AS i FROM {f}"
            f" WHERE i > 0 GROUP BY version_id, hit) o"
            f" LEFT JOIN (SELECT version_id, max(TRY_CAST(regexp_extract(token, '^\\[{kind}_(\\d+)\\]$', 1) AS INTEGER))"
            f" AS base FROM {tag}map{k - 1} GROUP BY version_id) b USING (version_id)"
            f" WHERE NOT EXISTS (SELECT 1 FROM {tag}map{k - 1} p WHERE p.version_id = o.version_id"
            f" AND p.original = o.original)))",
            f"{t} AS MATERIALIZED (SELECT f.version_id, coalesce(string_agg(substr(pre, 2) || m.token, '' ORDER BY i)"
            f" FILTER (WHERE i > 0), '') || substr(arg_max(rest, i), 2) AS text"
            f" FROM {f} f LEFT JOIN {m} m ON m.version_id = f.version_id AND m.original = f.hit AND f.i > 0"
            f" GROUP BY f.version_id)",
        ]
    hits = " UNION ALL ".join(
        f"SELECT f.version_id, {k} AS k, i, '{kind}' AS type, hit AS original, m.token FROM {tag}f{k} f"
        f" JOIN {tag}map{k} m ON m.version_id = f.version_id AND m.original = f.hit WHERE i > 0"
        for k, (kind, _, _) in enumerate(_CASCADE, 1)
    )
    return ", ".join(ctes) + f", {tag}hits AS MATERIALIZED ({hits})"


_BASE = f"WITH RECURSIVE {PII.replace('t0', 'src')}, {cascade_sql('t', 'src')}"
_HITS = (
    "SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY k, i) AS INTEGER) AS match_no,"
    " type, original, token FROM thits"
)


def _detect(spark, sf_dir):
    return R.detect_pii(pii_texts(spark, sf_dir))


def _of_type(kind):
    def run(spark, sf_dir):
        return _detect(spark, sf_dir).filter(F.col("type") == kind).drop("type", "match_no")

    return run


def _redact(spark, sf_dir):
    return R.redact(pii_texts(spark, sf_dir))


def _tokens(spark, sf_dir):
    return R.assign_tokens(pii_texts(spark, sf_dir))


def _mapping(spark, sf_dir):
    """The mapping table as written by the first pass."""
    return stored(_tokens(spark, sf_dir).drop("token_no"), "mapping")


def _second(spark, sf_dir):
    out = R.redact_with_mapping(second_texts(spark, sf_dir), _mapping(spark, sf_dir))
    return out.select("version_id", "redacted_text")


def _second_mapping(spark, sf_dir, base):
    out = R.redact_with_mapping(second_texts(spark, sf_dir), base)
    rows = out.select("version_id", F.inline_outer("mapping")).filter("tokens is not null")
    return rows.toDF("version_id", "token", "original")


def _round_trip(spark, sf_dir):
    """Text and mapping of one pass, stored, then put together again."""
    done = R.redacted(pii_texts(spark, sf_dir)).select(
        "version_id",
        F.col("redaction.text").alias("redacted_text"),
        F.arrays_zip("redaction.tokens", "redaction.originals").alias("pairs"),
    )
    done = stored(done, "redacted")
    pairs = done.select("version_id", F.inline("pairs")).toDF("version_id", "token", "original")
    return R.expand(done.drop("pairs"), pairs).select("version_id", "text")


def _merge(spark, sf_dir):
    base = _mapping(spark, sf_dir)
    return R.merge_mapping(base, _second_mapping(spark, sf_dir, base))


def _clauses(spark, sf_dir):
    """Two planted texts of a version as its two clauses, without a mapping so far."""
    first, second = pii_texts(spark, sf_dir), second_texts(spark, sf_dir)
    rows = first.withColumn("ordinal", F.lit(1)).unionByName(second.withColumn("ordinal", F.lit(2)))
    none = spark.createDataFrame([], "version_id long, token string, original string")
    return RR.redact_clauses(rows, none)[0]


def _residual(spark, sf_dir):
    """Half-redacted outbound texts: the stored mapping applied to a text that grew since."""
    texts = _redact(spark, sf_dir).join(second_texts(spark, sf_dir), "version_id")
    grown = texts.select("version_id", F.concat_ws("\n", "redacted_text", "text").alias("text"))
    return R.residual_pii_audit(grown)


def _profile(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("version_id"), "source", "lang"
    )
    return R.pii_profile(_detect(spark, sf_dir).join(docs, "version_id"), ["source", "lang"])


_KINDS = {
    "national_ids": "NIK",
    "tax_ids": "NPWP",
    "emails": "EMAIL",
    "phones": "PHONE",
    "bank_accounts": "BANK",
    "street_addresses": "ADDR",
}

QUERIES = {
    "detect_pii": _detect,
    **{name: _of_type(kind) for name, kind in _KINDS.items()},
    "assign_tokens": _tokens,
    "redact": _redact,
    "redact_with_mapping": _second,
    "redact_clauses": _clauses,
    "expand": _round_trip,
    "merge_mapping": _merge,
    "residual_pii_audit": _residual,
    "pii_profile": _profile,
}



def _residual_sql() -> str:
    """Each pattern counted on its own in the grown text with its placeholders blanked."""
    ctes, counts = [], []
    for k, (kind, pattern, digits) in enumerate(_CASCADE, 1):
        ctes.append(
            f"r{k} AS MATERIALIZED (SELECT version_id, 0 AS i, ' ' || text AS rest FROM grown UNION ALL"
            f" SELECT version_id, i + 1, substr(x.hit, length(x.hit)) || substr(rest, length(x.pre) + length(x.hit) + 1)"
            f" FROM (SELECT *, regexp_extract(rest, '{_regex(pattern, digits)}', ['pre', 'hit']) AS x FROM r{k}) WHERE x.hit <> '')"
        )
        counts.append(f"SELECT version_id, '{kind}' AS type, max(i) AS matches FROM r{k} GROUP BY version_id HAVING max(i) > 0")
    return (
        f"{_BASE}, grown AS MATERIALIZED (SELECT version_id, regexp_replace(t.text || chr(10) || s.text, '\\[[A-Z]+_\\d+\\]', '[]', 'g') AS text"
        f" FROM t6 t JOIN {SECOND_TEXTS} s USING (version_id)), {', '.join(ctes)} {' UNION ALL '.join(counts)}"
    )


_TWICE = f"{_BASE}, {cascade_sql('u', SECOND_TEXTS, 'tmap6')}"

ORACLES = {
    "detect_pii": f"{_BASE} {_HITS}",
    **{
        name: f"{_BASE} SELECT version_id, original, token FROM thits WHERE type = '{kind}'"
        for name, kind in _KINDS.items()
    },
    "assign_tokens": f"{_BASE} SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY place, n)"
    " AS INTEGER) AS token_no, token, original FROM tmap6",
    "redact": f"{_BASE} SELECT version_id, text AS redacted_text FROM t6",
    "redact_with_mapping": f"{_TWICE} SELECT version_id, text AS redacted_text FROM u6",
    "redact_clauses": f"{_TWICE} SELECT version_id, 1 AS ordinal, text AS redacted_text FROM t6 UNION ALL SELECT version_id, 2, text FROM u6",
    "residual_pii_audit": _residual_sql(),
    "expand": f"WITH {PII} SELECT version_id, text FROM t0",
    "merge_mapping": f"{_TWICE} SELECT version_id, token, original FROM umap6",
    "pii_profile": f"{_BASE} SELECT source, lang, type, count(*) AS matches, count(DISTINCT original) AS distinct_originals"
    " FROM thits JOIN documents ON doc_id = version_id GROUP BY source, lang, type",
}
