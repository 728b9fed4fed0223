"""Registered queries for domain routing and request packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.operators import redact as R
from clauselake.operators import redact_rows as RR
from clauselake.operators import route as D
from clauselake.plans import fixtures as X
from clauselake.plans import segment_queries as G
from clauselake.session import stored
from clauselake.sources.lexicon import lexicon_from_rows

# a lexicon made of pieces of words the test corpus uses, from very common to absent
_STEMS = (
    "licen tion keit ment nci warranty orantion ouen eaux reth sch nder zz-none thha pour "
    "mit hehely elleux token ungen ingeser www ción lich ononst paux heit der und rrr "
    "onanation indemn forum agency rev queau"
).split()
TEST_ROWS = [(K.DOMAINS[i % len(K.DOMAINS)], stem) for i, stem in enumerate(_STEMS)]
LEXICON = lexicon_from_rows(TEST_ROWS)

LEXICON_SQL = "lexicon(domain, keyword) AS (VALUES " + ", ".join(
    f"('{d}', '{k}')" for d, k in TEST_ROWS
) + "), domains AS (SELECT DISTINCT domain, domain IN ('governing_language', 'execution_validity') AS always FROM lexicon)"

BASE = f"""WITH {G.CLAUSES}, {LEXICON_SQL},
hits AS MATERIALIZED (SELECT version_id, ordinal, domain, CAST(count(*) AS INTEGER) AS keywords
  FROM clauses JOIN lexicon ON contains(lower(text), keyword) GROUP BY ALL),
presence AS MATERIALIZED (SELECT v.version_id, d.domain, d.always, count(h.ordinal) AS clauses, count(h.ordinal) > 0 AS present
  FROM (SELECT DISTINCT version_id FROM clauses) v CROSS JOIN domains d
  LEFT JOIN hits h ON h.version_id = v.version_id AND h.domain = d.domain GROUP BY ALL),
routed AS MATERIALIZED (SELECT version_id, ordinal, domain, true AS matched FROM hits
  UNION ALL SELECT version_id, NULL, domain, false FROM presence WHERE NOT present)"""

PACKED = (
    BASE
    + """,
entry AS MATERIALIZED (SELECT version_id, ordinal, '[Klausul ' || ordinal ||
  CASE WHEN coalesce(heading_path, '') <> '' THEN ' (' || heading_path || ')' ELSE '' END || ']' || chr(10) || text AS entry
  FROM clauses),
wanted AS (SELECT r.version_id, r.domain, e.ordinal, e.entry FROM routed r JOIN entry e
  ON e.version_id = r.version_id AND (e.ordinal = r.ordinal OR NOT r.matched)),
ended AS (SELECT *, sum(length(entry)) OVER (PARTITION BY version_id, domain ORDER BY ordinal) AS e FROM wanted),
ranged AS (SELECT *, (e - length(entry)) // 6000 AS k, (e - 1) // 6000 AS l FROM ended),
segment AS (SELECT version_id, domain, CASE WHEN k = l THEN 2 * k ELSE 2 * k + 1 END AS g, string_agg(entry, chr(10) || chr(10) ORDER BY ordinal) AS context,
  CAST(count(*) AS INTEGER) AS entries, sum(length(entry)) > 6000 AS oversized FROM ranged GROUP BY ALL),
contexts AS MATERIALIZED (SELECT version_id, domain, CAST(row_number() OVER (PARTITION BY version_id, domain ORDER BY g) AS INTEGER) AS part_no, context, entries, oversized FROM segment)"""
)

_SAMPLE = """joined AS (SELECT version_id, string_agg('[Klausul ' || ordinal || '] ' || text || chr(10), '' ORDER BY ordinal) AS t FROM clauses GROUP BY version_id),
sample AS MATERIALIZED (SELECT version_id, CAST(k + 1 AS INTEGER) AS part_no, substr(t, k * 4000 + 1, 4000) AS sample
  FROM (SELECT *, unnest(range(0, (length(t) - 1) // 4000 + 1)) AS k FROM joined))"""


def comments(spark, sf_dir):
    turns = X.read(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("version_id"),
        F.col("turn").alias("ordinal"),
        F.when(F.col("role") != "system", F.col("role")).alias("author"),
        F.col("text").alias("anchor_text"),
        F.concat_ws(" ", "text", F.expr("'write to a' || CAST(conv_id % 7 AS STRING) || '@example.org'")).alias("body"),
    )


# the planted address is the only personal data the check has to follow here
_COMMENTS = """bubble AS (SELECT conv_id AS version_id, turn AS ordinal, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 20 + 1 AS part_no,
  '- [' || CASE WHEN role <> 'system' THEN role ELSE 'Tanpa nama' END || ']: ' || text || ' write to [EMAIL_1]' ||
  CASE WHEN text <> '' THEN ' (terkait teks: "' || text || '")' ELSE '' END AS line FROM conversations),
comment_block AS MATERIALIZED (SELECT version_id, CAST(part_no AS INTEGER) AS part_no, string_agg(line, chr(10) ORDER BY ordinal) AS comments, CAST(count(*) AS INTEGER) AS n_comments
  FROM bubble GROUP BY version_id, part_no)"""


def _match(spark, sf_dir):
    return D.match_domains(G.clauses(spark, sf_dir), LEXICON)


def _presence(spark, sf_dir):
    return D.domain_presence(G.clauses(spark, sf_dir), LEXICON)


def _gaps(spark, sf_dir):
    return D.domain_gaps(_presence(spark, sf_dir))


def _route(spark, sf_dir):
    return D.route_clauses(G.clause_table(spark, sf_dir), LEXICON)


def _context(spark, sf_dir):
    clauses = G.clause_table(spark, sf_dir)
    return D.pack_context(D.route_clauses(clauses, LEXICON), clauses)


def _sample(spark, sf_dir):
    return D.summary_sample(G.clauses(spark, sf_dir))


def _comments(spark, sf_dir):
    return D.pack_comments(comments(spark, sf_dir))


def _requests(spark, sf_dir, clauses, mapping=None, sections=False):
    versions = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"))
    summaries = versions.select(
        "version_id",
        F.when(
            F.col("version_id") % 3 != 0,
            F.concat(F.lit("Dokumen nomor "), F.col("version_id").cast("string")),
        ).alias("summary"),
    )
    bubbles = stored(D.pack_comments(comments(spark, sf_dir), mapping), "blocks")
    beside = D.sections_beside(versions, summaries, bubbles)
    contexts = D.pack_context(D.route_clauses(clauses, LEXICON), clauses, shared=True, beside=beside)
    return D.build_requests(versions, LEXICON, contexts, summaries, bubbles, sections)


def requests(spark, sf_dir):
    return _requests(spark, sf_dir, G.clause_table(spark, sf_dir))


def outbound_requests(spark, sf_dir, sections=False):
    """Requests as they leave: clauses and comments of a version share one mapping.

    The mapping of the whole text is extended by the clauses in order, and that again by
    the comments, so a token stands for one original in every channel of a version.
    """
    known = R.assign_tokens(X.contract_texts(spark, sf_dir))
    texts, extended = RR.redact_clauses(G.clauses(spark, sf_dir), known, keep=["heading_path"])
    return _requests(spark, sf_dir, texts.withColumnRenamed("redacted_text", "text"), extended, sections)


def _audit(spark, sf_dir):
    """What the patterns still find in outbound requests, per type, zeros included.

    The requests' own numbering (clause numbers and headings in brackets, the number in
    the summary) is no personal data and is blanked first. No pattern matches across the
    words that part two sections, so a section that requests share is searched once and
    its matches count for each of them.
    """
    own = r"\[Klausul \d+( \([^\n]*\))?\]|Dokumen nomor \d+"
    out = outbound_requests(spark, sf_dir, sections=True).select(
        "version_id", "times", F.regexp_replace("text", own, "").alias("text")
    )
    left = R.residual_pii_audit(out).groupBy("type").agg(F.sum("matches").alias("matches"))
    kinds = X.read(spark, sf_dir, "documents").select(
        F.explode(F.array(*[F.lit(kind) for kind, _ in K.PII_PATTERNS])).alias("type")
    )
    checked = kinds.groupBy("type").agg(F.count("*").alias("versions"))
    return checked.join(left, "type", "left").select(
        "type", "versions", F.coalesce("matches", F.lit(0)).cast("long").alias("matches")
    )


def _budget(spark, sf_dir):
    return D.request_budget(requests(spark, sf_dir))


_REQUESTS = f"""{PACKED}, {_COMMENTS},
base AS (SELECT doc_id AS version_id, domain, always FROM documents CROSS JOIN domains),
spot AS (SELECT version_id, domain, 1 AS part_no FROM base UNION SELECT version_id, domain, part_no FROM contexts
  UNION SELECT version_id, domain, part_no FROM comment_block JOIN base USING (version_id)),
request AS MATERIALIZED (
SELECT s.version_id, s.domain, CAST(s.part_no AS INTEGER) AS part_no, concat_ws(chr(10) || chr(10),
  CASE WHEN s.version_id % 3 <> 0 THEN 'Ringkasan Dokumen:' || chr(10) || 'Dokumen nomor ' || s.version_id
    ELSE 'Ringkasan dokumen tidak tersedia untuk analisis ini — gunakan klausul di bawah sebagai satu-satunya konteks.' END,
  'Klausul-Klausul yang Relevan dengan Domain ''' || s.domain || ''':' || chr(10) || coalesce(context, CASE WHEN s.part_no > 1 THEN NULL
    WHEN always THEN 'Tidak ada klausul yang secara eksplisit membahas domain ini dalam kontrak. Evaluasi apakah ketidakhadiran klausul ini sendiri merupakan temuan.'
    ELSE '(Tidak ada klausul yang cocok dengan domain ini)' END),
  CASE WHEN coalesce(comments, '') <> '' THEN 'Komentar yang Ditambahkan oleh Pihak Lain dalam Dokumen:' || chr(10) || comments END,
  'Analisis kontrak ini untuk domain: ' || s.domain || ' (key: ' || s.domain || ')') AS request
FROM spot s JOIN base USING (version_id, domain) LEFT JOIN comment_block b ON b.version_id = s.version_id AND b.part_no = s.part_no
LEFT JOIN contexts c ON c.version_id = s.version_id AND c.domain = s.domain AND c.part_no = s.part_no)"""

QUERIES = {
    "match_domains": _match,
    "route_clauses": _route,
    "domain_presence": _presence,
    "domain_gaps": _gaps,
    "pack_context": _context,
    "summary_sample": _sample,
    "pack_comments": _comments,
    "build_requests": requests,
    "request_budget": _budget,
    "outbound_audit": _audit,
}

ORACLES = {
    "match_domains": f"{BASE} SELECT * FROM hits",
    "route_clauses": f"{BASE} SELECT * FROM routed",
    "domain_presence": f"{BASE} SELECT * FROM presence",
    "domain_gaps": f"{BASE} SELECT version_id, domain, always FROM presence WHERE NOT present",
    "pack_context": f"{PACKED} SELECT * FROM contexts",
    "summary_sample": f"WITH {G.CLAUSES}, {_SAMPLE} SELECT * FROM sample",
    "pack_comments": f"WITH {_COMMENTS} SELECT * FROM comment_block",
    "build_requests": f"{_REQUESTS} SELECT * FROM request",
    "request_budget": f"""{_REQUESTS} SELECT domain, count(*) AS requests, CAST(sum(length(request)) AS BIGINT) AS chars,
  CAST(max(length(request)) AS INTEGER) AS max_chars, count(*) FILTER (WHERE part_no > 1) AS further_parts, count(*) * 2 AS max_calls FROM request GROUP BY domain""",
    "outbound_audit": """SELECT type, (SELECT count(*) FROM documents) AS versions, CAST(0 AS BIGINT) AS matches
  FROM (VALUES ('NIK'), ('NPWP'), ('EMAIL'), ('PHONE'), ('BANK'), ('ADDR')) AS t(type)""",
}
