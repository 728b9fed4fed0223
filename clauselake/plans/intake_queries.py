"""Registered queries for intake, table updates and extraction quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import latest
from clauselake.operators import quality as Q
from clauselake.plans import diff_queries as V
from clauselake.plans import entities as E
from clauselake.plans import fixtures as X
from clauselake.session import scratch_path
from clauselake.sources import corpus as C
from clauselake.sources import storage as S
from clauselake.sources import writes as W

# frequent words per language, a parameter of the detector
PROFILES = {
    "en": "the of and to in is that it for as was be with by this are".split(),
    "de": "der die und das den von zu mit sich auf ist nicht ein für des".split(),
    "fr": "le la les des et un une du que qui dans en pour est au".split(),
    "es": "de la que el en los se del las por un para con no una".split(),
    "id": "yang dan di dengan untuk dari pada dalam ini itu tidak".split(),
}


def _load(spark, sf_dir):
    """Order numbers ask for document versions; only labelled documents have a stored text."""
    docs, labels = X.documents(spark, sf_dir), X.read(spark, sf_dir, "labels")
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("storage_key")
    jobs = X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"))
    versions = docs.select(F.col("doc_id").alias("version_id"), key)
    blobs = docs.join(labels, "doc_id", "left_semi").select(key, "text")
    rows = C.load_versions(jobs, versions, blobs)
    return rows.select("version_id", "status", "failure", F.length("text").cast("bigint").alias("chars"))


_FILES = """SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' WHEN 3 THEN '' WHEN 4 THEN '.Docx' ELSE '.exe' END AS filename,
  CAST(length(html) AS BIGINT) * (page_id % 40) * 250 AS size FROM pages"""


def _admission(spark, sf_dir):
    return C.admission_gate(E._run(spark, sf_dir, _FILES, "pages"))


def _bare_names(spark, sf_dir):
    """Host-free page names, most of them without a dot."""
    names = X.read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("filename"), F.length("html").alias("size")
    )
    return C.admission_gate(names, K.EXTRACTOR_EXTENSIONS)


def _fingerprint(spark, sf_dir):
    return C.content_fingerprint(X.documents(spark, sf_dir)).select("doc_id", "sha256")


def _corpus_files(spark, sf_dir):
    """Documents written as text files of up to 50 texts."""
    path = scratch_path(spark, "corpus")
    docs = X.documents(spark, sf_dir).select("source", "text")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 50).text(path)
    return path


def _read_lines(spark, sf_dir):
    """What the files hold, line by line: number and sum of the lines' hashes, as text and as blobs."""
    path = _corpus_files(spark, sf_dir)
    texts = C.read_corpus(spark, path, "text").select(F.lit("text").alias("reader"), "storage_key", "text")
    blobs = C.read_corpus(spark, path, "binary").select(
        F.lit("binary"), "storage_key", F.decode("content", "UTF-8").alias("text")
    )
    lines = texts.union(blobs).select(
        "reader",
        F.regexp_extract("storage_key", "source=([^/]+)", 1).alias("source"),
        F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)).alias("line"),
    )
    digest = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")
    return lines.groupBy("reader", "source").agg(F.count("*").alias("lines"), F.sum(digest).alias("digest"))


def _read_corpus(spark, sf_dir):
    """Documents written as text files, and read back as blobs and as texts."""
    path = _corpus_files(spark, sf_dir)
    source = F.regexp_extract("storage_key", "source=([^/]+)", 1)
    texts = C.read_corpus(spark, path, "text").groupBy(source.alias("source")).agg(
        F.sum(F.length("text")).alias("chars")
    )
    blobs = C.read_corpus(spark, path, "binary").groupBy(source.alias("source")).agg(
        F.sum("length").alias("bytes"), F.sum(F.octet_length("content")).alias("content_bytes")
    )
    return texts.join(blobs, "source")


def _copies(spark, sf_dir):
    return C.exact_copy_groups(X.documents(spark, sf_dir), "doc_id")


def _version_no(spark, sf_dir):
    orders = X.read(spark, sf_dir, "orders")
    existing = (
        orders.filter("o_orderstatus = 'F'")
        .groupBy(F.col("o_custkey").alias("document_id"))
        .agg(F.count("*").alias("version_no"))
    )
    uploads = orders.filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("upload_id"),
        F.col("o_custkey").alias("document_id"),
        F.col("o_orderdate").alias("uploaded_at"),
    )
    return C.assign_version_no(uploads, existing)


def _storage_key(spark, sf_dir):
    docs = E.documents(spark, sf_dir).select("document_id", "user_id")
    rows = S.storage_key(E.versions(spark, sf_dir).join(docs, "document_id"))
    return rows.select("version_id", "storage_key")


_ASKED = """SELECT c_custkey AS request_id, CAST(c_custkey % 7 AS BIGINT) AS user_id, CASE c_custkey % 6 WHEN 0 THEN '/documents/' || (c_custkey % 7) || '/d/v1/f.pdf'
  WHEN 1 THEN 'documents/' || (c_custkey % 5) || '/d/../v1/f.pdf' WHEN 2 THEN 'exports/' || c_name || '/x/y' WHEN 3 THEN 'documents/1/x'
  WHEN 4 THEN 'documents/' || (c_custkey % 7) || '//../../etc/' || c_name ELSE '../documents/3/a/b' END AS storage_key FROM customer"""


def _parse_key(spark, sf_dir):
    return S.parse_storage_key(E._run(spark, sf_dir, _ASKED, "customer"))


def _items(spark, sf_dir, status):
    rows = X.read(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )


_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_KEYS = ["l_orderkey", "l_linenumber"]


def _upsert(spark, sf_dir):
    return W.upsert_last_wins(_items(spark, sf_dir, "F"), _items(spark, sf_dir, "O"), _KEYS, _ORDER)


def _upsert_on_disk(spark, sf_dir):
    """The same rows as a table in buckets, to which the newer ones come in three batches."""
    path = scratch_path(spark, "buckets")
    W.write_buckets(_items(spark, sf_dir, "F"), path, _KEYS, 64, _ORDER)
    newer = latest(_items(spark, sf_dir, "O"), _KEYS, _ORDER)
    for part in range(3):
        W.upsert_buckets(newer.filter(F.col("l_orderkey") % 3 == part), path, _KEYS, _ORDER, 64)
    return W.read_buckets(spark, path)


def _insert(spark, sf_dir):
    return W.insert_first_wins(_items(spark, sf_dir, "F"), _items(spark, sf_dir, "O"), _KEYS)


def _replace(spark, sf_dir):
    return W.replace_slice(_items(spark, sf_dir, "F"), _items(spark, sf_dir, "O"), ["l_orderkey"])


def _soft_delete(spark, sf_dir):
    orders = X.read(spark, sf_dir, "orders")
    document = F.floor(F.col("o_custkey") / 3)
    requests = orders.select(
        document.alias("document_id"),
        ((document + F.col("o_orderkey") % 2) % 25).alias("user_id"),
        F.col("o_orderdate").alias("requested_at"),
    )
    return W.soft_delete(E.documents(spark, sf_dir), requests).select("document_id", "user_id", "deleted_at")


_EXTRACTED = """SELECT doc_id AS version_id, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf_text' WHEN 2 THEN 'pdf_image' ELSE 'image' END AS source_format,
  CASE WHEN lang = 'es' AND doc_id % 8 > 3 THEN '  ' ELSE text END AS text, CAST(n_chars * (doc_id % 5) AS BIGINT) AS available_chars,
  CAST(doc_id % 60 AS INTEGER) AS pages, CAST(n_chars * (doc_id % 9) AS BIGINT) AS bytes FROM documents"""


def _extractions(spark, sf_dir):
    return E._run(spark, sf_dir, _EXTRACTED, "documents")


def _gate(spark, sf_dir):
    rows = Q.coverage_gate(_extractions(spark, sf_dir))
    return rows.select("version_id", "coverage", "extraction_ok", F.length("text").cast("bigint").alias("chars"))


def _note(spark, sf_dir):
    return Q.coverage_note(_extractions(spark, sf_dir))


def _bucket(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("lang"))
    return Q.language_bucket(docs).select("doc_id", "language")


def _detect(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select("doc_id", "text")
    return Q.language_bucket(Q.detect_language(docs, PROFILES), "detected").drop("text")


def _warning(spark, sf_dir):
    return Q.accuracy_warning(_extractions(spark, sf_dir)).select("version_id", "accuracy_warning")


_RULES = {"severity": K.SEVERITIES, "finding_type": K.FINDING_TYPES, "domain": K.DOMAINS}


def _vocabulary(spark, sf_dir):
    return Q.vocabulary_audit(E.findings(spark, sf_dir), _RULES)


def _joint(spark, sf_dir):
    """Classified changes, with the dishonest states planted by block number."""
    rows = V.classified(spark, sf_dir)
    forged = rows.withColumn(
        "materiality", F.when(F.col("block_no") % 6 == 5, "immaterial").otherwise(F.col("materiality"))
    )
    return Q.joint_state_audit(forged).select("pair_id", "block_no", "place")


def _stage(spark, sf_dir):
    rows = Q.coverage_gate(_extractions(spark, sf_dir)).withColumns(
        {"tc_readable": F.col("bytes") % 3 > 0, "comments_readable": F.when(F.col("bytes") % 5 > 0, F.col("bytes") % 2 == 0)}
    )
    return Q.stage_status(rows).select("version_id", "tc_parse_status", "comments_parse_status")


def _verdict(spark, sf_dir):
    asked = X.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"))
    gated = Q.coverage_gate(_extractions(spark, sf_dir)).select("version_id", "extraction_ok")
    rows = asked.join(gated, "version_id", "left").withColumn(
        "status", F.when(F.col("extraction_ok").isNull(), "failed").otherwise("loaded")
    )
    return Q.ingest_verdict(rows).select("version_id", "verdict")


QUERIES = {
    "load_versions": _load,
    "admission_gate": _admission,
    "admission_gate_bare_names": _bare_names,
    "content_fingerprint": _fingerprint,
    "exact_copy_groups": _copies,
    "read_corpus": _read_corpus,
    "read_corpus_lines": _read_lines,
    "assign_version_no": _version_no,
    "storage_key": _storage_key,
    "parse_storage_key": _parse_key,
    "upsert_last_wins": _upsert,
    "upsert_buckets": _upsert_on_disk,
    "insert_first_wins": _insert,
    "replace_slice": _replace,
    "soft_delete": _soft_delete,
    "coverage_gate": _gate,
    "coverage_note": _note,
    "language_bucket": _bucket,
    "detect_language": _detect,
    "accuracy_warning": _warning,
    "vocabulary_audit": _vocabulary,
    "joint_state_audit": _joint,
    "stage_status": _stage,
    "ingest_verdict": _verdict,
}

_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_GATED = f"""ex AS MATERIALIZED ({_EXTRACTED}), sized AS (SELECT *, CASE WHEN source_format = 'image' THEN trim(text, '{X.BLANKS}') ELSE text END AS t FROM ex),
judged AS (SELECT *, coalesce(CASE WHEN source_format = 'docx' THEN length(t) >= 100 AND available_chars > 0 AND length(t) / available_chars >= 0.5
  WHEN source_format = 'image' THEN length(t) >= greatest(1, least(100, 0.5 * bytes / 1024)) ELSE length(t) >= greatest(100, 40 * pages) END, false) AS ok FROM sized),
gated AS MATERIALIZED (SELECT *, CASE WHEN ok THEN 'ok' WHEN trim(t, '{X.BLANKS}') = '' AND source_format = 'pdf_text' THEN 'needs_ocr'
  WHEN trim(t, '{X.BLANKS}') = '' OR source_format = 'image' THEN 'empty' ELSE 'partial' END AS coverage FROM judged)"""


def _admit(sql: str, extensions: list[str]) -> str:
    allowed = ", ".join(f"'{e}'" for e in extensions)
    return f"""WITH f AS ({sql}), e AS (SELECT *, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '\\.([^.]*)$', 1)) ELSE '' END AS extension FROM f),
r AS (SELECT *, CASE WHEN extension NOT IN ({allowed}) THEN 'unsupported_format' WHEN size > 20971520 THEN 'too_large' END AS reject_reason FROM e) SELECT *, reject_reason IS NULL AS admitted FROM r"""


def _language_sql() -> str:
    scores = ", ".join(
        f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words)}))) AS s{i}"
        for i, words in enumerate(PROFILES.values())
    )
    names = [f"s{i}" for i in range(len(PROFILES))]
    pick = " ".join(f"WHEN s{i} = top THEN '{lang}'" for i, lang in enumerate(PROFILES))
    return f"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\pL]+') AS w FROM documents), s AS (SELECT doc_id, {scores} FROM t),
m AS (SELECT *, greatest({', '.join(names)}) AS top FROM s), d AS (SELECT doc_id, CASE WHEN top > 0 THEN CASE {pick} END END AS detected, CAST(top AS INTEGER) AS score FROM m)
SELECT *, CASE WHEN detected IS NULL THEN 'id' WHEN detected IN ('id', 'en') THEN detected ELSE 'mixed' END AS language FROM d"""


ORACLES = {
    "load_versions": """SELECT o_orderkey AS version_id, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'loaded' END AS status,
  CASE WHEN d.doc_id IS NULL THEN 'version_missing' WHEN l.doc_id IS NULL THEN 'blob_missing' END AS failure, CASE WHEN l.doc_id IS NOT NULL THEN CAST(length(d.text) AS BIGINT) END AS chars
FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
    "admission_gate": _admit(_FILES, ["docx", "pdf"]),
    "admission_gate_bare_names": _admit(
        "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS filename, length(html) AS size FROM pages",
        ["docx", "pdf", "jpg", "jpeg", "png", "webp", "bmp"],
    ),
    "read_corpus_lines": """SELECT reader, source, count(*) AS lines, CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS digest
  FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), (SELECT unnest(['text', 'binary']) AS reader) GROUP BY ALL""",
    "read_corpus": """SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes,
  CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS content_bytes FROM documents GROUP BY source""",
    "exact_copy_groups": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "assign_version_no": """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_orderkey AS upload_id, o.o_custkey AS document_id, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version_no
FROM orders o LEFT JOIN f ON f.o_custkey = o.o_custkey WHERE o_orderstatus <> 'F'""",
    "storage_key": f"""WITH {E.DOCUMENTS}, {E.VERSIONS} SELECT version_id, 'documents/' || user_id || '/' || document_id || '/v' || version_no || '/' || source_filename AS storage_key
  FROM vers JOIN docs USING (document_id)""",
    "parse_storage_key": f"""WITH a AS ({_ASKED}), p AS (SELECT *, string_split(ltrim(storage_key, '/'), '/') AS l FROM a)
SELECT request_id, user_id, storage_key, array_to_string(list_filter(string_split(replace(storage_key, '\\', '/'), '/'), lambda x: x <> '' AND x <> '..'), '/') AS path,
  CASE WHEN len(l) < 4 OR l[1] <> 'documents' THEN 'invalid' WHEN l[2] <> CAST(user_id AS VARCHAR) THEN 'denied' ELSE 'ok' END AS verdict FROM p""",
    "upsert_last_wins": f"""SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_linestatus = 'O' DESC,
  l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "insert_first_wins": f"""SELECT {_COLS} FROM lineitem l WHERE l_linestatus = 'F' OR NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linestatus = 'F'
  AND b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber)""",
    "replace_slice": f"SELECT {_COLS} FROM lineitem WHERE l_linestatus = 'O' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')",
    "soft_delete": f"""WITH {E.DOCUMENTS}, r AS (SELECT o_custkey // 3 AS document_id, (o_custkey // 3 + o_orderkey % 2) % 25 AS user_id, min(o_orderdate) AS asked FROM orders GROUP BY ALL)
SELECT document_id, user_id, coalesce(deleted_at, asked) AS deleted_at FROM docs LEFT JOIN r USING (document_id, user_id)""",
    "coverage_gate": f"""WITH {_GATED} SELECT version_id, coverage, ok AS extraction_ok, CAST(CASE WHEN source_format = 'image' AND NOT ok THEN 0 ELSE length(t) END AS BIGINT) AS chars FROM gated""",
    "coverage_note": f"""WITH {_GATED} SELECT version_id, coverage, CASE WHEN coverage = 'empty' THEN CASE source_format WHEN 'docx' THEN 'Dokumen DOCX tidak mengandung teks yang dapat dibaca.' WHEN 'pdf_image' THEN 'OCR tidak berhasil mengekstrak teks dari PDF.' ELSE 'OCR tidak menghasilkan teks yang memadai dari gambar.' END
  WHEN coverage = 'partial' THEN CASE source_format WHEN 'docx' THEN 'Ekstraksi DOCX tampak tidak lengkap (' || length(t) || ' dari perkiraan ' || available_chars || ' karakter dalam dokumen). '
    WHEN 'pdf_text' THEN 'Ekstraksi PDF tampak tidak lengkap (' || length(t) || ' karakter dari ' || pages || ' halaman). '
    ELSE 'OCR menghasilkan teks yang tampak tidak lengkap (' || length(t) || ' karakter dari ' || pages || ' halaman). ' END || 'Dokumen ini memerlukan tinjauan manual.' END AS extraction_note FROM gated""",
    "language_bucket": "SELECT doc_id, CASE WHEN lang = 'es' THEN 'id' WHEN lang IN ('id', 'en') THEN lang ELSE 'mixed' END AS language FROM documents",
    "detect_language": _language_sql(),
    "accuracy_warning": f"WITH ex AS ({_EXTRACTED}) SELECT version_id, CASE source_format WHEN 'pdf_image' THEN 'Dokumen ini adalah PDF berbasis gambar. Akurasi ekstraksi teks dapat bervariasi — verifikasi klausul penting secara manual.' WHEN 'image' THEN 'Dokumen diunggah sebagai gambar. Akurasi ekstraksi teks dapat bervariasi — verifikasi klausul penting secara manual.' END AS accuracy_warning FROM ex",
    "vocabulary_audit": f"WITH {E.FINDINGS}, h AS ("
    """SELECT 'severity' AS rule, severity AS value FROM finding WHERE severity NOT IN ('critical', 'high', 'medium', 'info')
UNION ALL SELECT 'finding_type', finding_type FROM finding WHERE finding_type NOT IN ('present_risky', 'absent', 'ambiguous', 'none')
UNION ALL SELECT 'domain', domain FROM finding WHERE domain NOT IN ('scope_deliverables', 'exclusivity', 'ip_ownership', 'moral_rights', 'usage_rights',
  'payment_terms', 'term_termination', 'morality_clause', 'content_approval', 'confidentiality', 'personal_data_likeness', 'liability_indemnity', 'non_compete',
  'dispute_forum', 'governing_language', 'agency_commission', 'disclosure_compliance', 'execution_validity'))
SELECT rule, value, count(*) AS rows FROM h GROUP BY ALL""",
    "joint_state_audit": f"""WITH {V._ITEMS}, {V._CLASS}, forged AS (SELECT *, CASE WHEN block_no % 6 = 5 THEN 'immaterial' ELSE materiality END AS m FROM classified)
SELECT pair_id, block_no, place FROM forged WHERE status = 'failed' AND m IS NOT NULL OR status <> 'failed' AND m IS NULL""",
    "stage_status": f"""WITH {_GATED} SELECT version_id, CASE WHEN source_format = 'docx' AND ok THEN CASE WHEN bytes % 3 > 0 THEN 'ok' ELSE 'failed' END END AS tc_parse_status,
  CASE WHEN source_format = 'docx' AND ok THEN CASE WHEN bytes % 5 > 0 AND bytes % 2 = 0 THEN 'ok' ELSE 'failed' END END AS comments_parse_status FROM gated""",
    "ingest_verdict": f"""WITH {_GATED} SELECT o_orderkey AS version_id, CASE WHEN version_id IS NULL THEN 'failed' WHEN ok THEN 'continue' ELSE 'done_with_note' END AS verdict
  FROM orders LEFT JOIN gated ON version_id = o_orderkey""",
}
ORACLES["upsert_buckets"] = ORACLES["upsert_last_wins"]  # the same table by another way
