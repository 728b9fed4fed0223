"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import (
    feistel,
    hilbert_search,
    lsh_forest,
    mil_quality,
    mixing,
    preferences,
    ranked_search,
    repeated_spans,
    sorted_passes,
    suffix_leaks,
    trie_bpe,
    warc,
    whitening,
)
from clauselake.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    read = warc.records(warc.read_chunks(spark, path, payload=False))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n,
                  sha1(coalesce(html, '')) AS d FROM pages),
best AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM p LEFT JOIN best ON p.d = best.d AND n >= 1000
"""


def op2_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    model = mil_quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return mil_quality.score(docs, model).select(
        "doc_id",
        mil_quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles are similar by 0.8 or more."""
    return lsh_forest.similar_documents(_table(spark, sf_dir, "documents"))


def op4_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one."""
    return hilbert_search.nearest(
        _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20
    )


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards of equal row counts."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    placed = feistel.shard_rows(rows, ["doc_id", "text_crc32", "size"], shards=40, seed=20)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among the embeddings of a label."""
    return sorted_passes.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


def paired_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation as a preference pair.

    Chosen is the conversation itself. Rejected keeps its turns up to number
    ``conv_id % 4`` and goes on with the later turns of the conversation before it.
    """
    own = conversations.select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text", (F.col("conv_id") % 4).alias("fork")
    )
    kept = own.filter("turn < fork")
    others = own.filter("turn >= (pair_id + 1) % 4").withColumn("pair_id", F.col("pair_id") + 1)
    return (
        own.withColumn("side", F.lit("chosen"))
        .union(kept.withColumn("side", F.lit("rejected")))
        .union(others.withColumn("side", F.lit("rejected")))
        .drop("fork")
    )


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of all conversations, paired with their neighbours."""
    pairs = preferences.preference_pairs(
        paired_conversations(_table(spark, sf_dir, "conversations"))
    )

    def runs(mask: str) -> F.Column:
        return F.array_join(
            F.transform(
                mask, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))
            ),
            ",",
        )

    return pairs.select(
        "pair_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        "prompt",
        "chosen",
        "rejected",
        runs("chosen_mask").alias("chosen_mask"),
        runs("rejected_mask").alias("rejected_mask"),
    )


OP7_SQL = """
WITH sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, 'rejected', turn, role, text FROM conversations WHERE turn < conv_id % 4
  UNION ALL
  SELECT conv_id + 1, 'rejected', turn, role, text FROM conversations
  WHERE turn >= (conv_id + 1) % 4),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side
            ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM sides),
forks AS (
  SELECT pair_id, min(place) AS fork FROM (
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place
    FROM (SELECT * FROM placed WHERE side = 'chosen') a
    FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') b
      ON a.pair_id = b.pair_id AND a.place = b.place
    WHERE a.pair_id IS NULL OR b.pair_id IS NULL OR a.role IS DISTINCT FROM b.role
          OR a.text IS DISTINCT FROM b.text)
  GROUP BY pair_id),
parts AS (
  SELECT p.pair_id, place, role,
         CASE WHEN fork IS NULL OR place < fork THEN 'prompt' ELSE side END AS part,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>'
           || chr(10) AS r
  FROM placed p LEFT JOIN forks f ON p.pair_id = f.pair_id
  WHERE NOT ((fork IS NULL OR place < fork) AND side = 'rejected')),
ended AS (
  SELECT *, CAST(sum(length(r)) OVER (PARTITION BY pair_id, part ORDER BY place) AS BIGINT) AS e
  FROM parts)
SELECT pair_id, count(*) FILTER (part = 'prompt') AS prompt_turns,
       coalesce(string_agg(r, '' ORDER BY place) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(r, '' ORDER BY place) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY place) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg((e - length(r)) || '-' || e, ',' ORDER BY place)
         FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((e - length(r)) || '-' || e, ',' ORDER BY place)
         FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM ended GROUP BY pair_id
"""


def vocabulary() -> str:
    """The public vocabulary file that the encoding queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole document."""
    encoded = trie_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary())
    return trie_bpe.digests(encoded)


def op9_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without strings of 400 bytes that repeat."""
    cut = repeated_spans.repeated_spans(_table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document when sources weigh 5, 2, 1 in turn."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), [5, 2, 1], most=3)
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.size("draws") * F.col("size")).cast("long").alias("taken"),
    )


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR))) AS perm FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
ranked AS (
  SELECT *, row_number() OVER by_ratio AS place,
         CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS BIGINT) AS open
  FROM weighed
  WINDOW by_ratio AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST),
         earlier AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT place, rest, open FROM ranked WHERE w * rest <= 3 * source_size * open
        ORDER BY place LIMIT 1),
targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.place < c.place THEN CAST(3 * r.source_size AS DOUBLE)
              ELSE CAST(r.w * c.rest AS DOUBLE) / c.open END AS target
  FROM ranked r, cut c),
placed AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY perm, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS before FROM sized),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n
  FROM targets)
SELECT doc_id, size, source_size, target,
       size * (n + CASE WHEN before + size / 2.0::DOUBLE <= target - n * source_size
                        THEN 1 ELSE 0 END) AS taken
FROM placed p JOIN passes t ON p.source IS NOT DISTINCT FROM t.source
"""


def op11_suffix_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten words in a row of a benchmark item, and of which items."""
    found = suffix_leaks.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes)),
shown AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS i
        FROM d, (SELECT DISTINCT k FROM sizes))),
hits AS (SELECT doc_id, item_id, i, k FROM shown JOIN wanted USING (k, s)),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the eight main axes of their covariance, scaled to variance 1."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)


def op13_blas_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.search(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10
    )


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
sized AS (SELECT doc_id, 100 - 90 + (90 * n * big_n) // big_l AS m FROM lengths, totals),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sized USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank,
         doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_mil_quality": op2_mil_quality,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_hilbert_search": op4_hilbert_search,
    "op5_feistel_sharding": op5_feistel_sharding,
    "op6_sorted_passes": op6_sorted_passes,
    "op7_preference_pairs": op7_preference_pairs,
    "op8_trie_bpe": op8_trie_bpe,
    "op9_suffix_merge": op9_suffix_merge,
    "op10_source_mixing": op10_source_mixing,
    "op11_suffix_leaks": op11_suffix_leaks,
    "op12_refined_whitening": op12_refined_whitening,
    "op13_blas_search": op13_blas_search,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_warc_chunks": OP1_SQL,
    "op7_preference_pairs": OP7_SQL,
    "op10_source_mixing": OP10_SQL,
    "op11_suffix_leaks": OP11_SQL,
    "op13_blas_search": OP13_SQL,
}
