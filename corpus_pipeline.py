"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import lsh_forest, mil_quality, mixing, repeated_spans, trie_bpe
from clauselake.llm.queries import vocabulary
from clauselake.session import discard, stored


PASSAGE = 250  # bytes of a passage that repeats: 50 words of four letters and a blank


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key of their own, and its name; wholly equal rows share a key."""
    key = _free(docs, "_row")
    return docs.withColumn(key, F.struct("doc_id", F.xxhash64(*docs.columns).alias("rest"))), key


def _renamed(docs: DataFrame, kept: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns beside ``kept`` under names that no operator uses, and what they stand for."""
    names = {f"_column_{i}": c for i, c in enumerate(docs.columns) if c not in kept}
    return docs.select(*kept, *[F.col(f"`{c}`").alias(n) for n, c in names.items()]), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label")
    )
    rows, names = _renamed(docs, ["doc_id", "text"])
    rows, names = rows.withColumn("_text", F.col("text")), names | {"_text": "text"}
    scored = mil_quality.score(rows, mil_quality.train(rows, labels), carry=list(names))
    kept = scored.filter("score >= 0.3")
    return kept.select(
        "doc_id", *[F.col(n).alias(c) for n, c in names.items()]
    ).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one of smallest id.

    Rows that are wholly equal count as one; rows that share an id and differ are documents
    of their own. Documents without words are kept.
    """
    rows, key = _keyed(docs)
    found = lsh_forest.similar_documents(rows, doc_id=key)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").dropDuplicates([key]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 250 bytes (some 50 words) or more that occur elsewhere."""
    rows, names = _renamed(docs.drop("n_chars"), ["doc_id", "text"])
    cut = repeated_spans.repeated_spans(rows, PASSAGE, carry=list(names), as_text=True)
    return cut.select(
        "doc_id",
        F.col("kept").alias("text"),
        F.length("kept").cast("long").alias("n_chars"),
        *[F.col(n).alias(c) for n, c in names.items()],
    ).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to its shards and shuffled there."""
    rows, key = _keyed(docs)
    draw, draws = _free(rows, "_draw"), _free(rows, "_draws")
    taken = (
        mixing.mix(rows, [5, 2, 1], most=3, doc_id=key)
        .select(F.col("doc_id").alias(key), F.explode("draws").alias(draw))
        .groupBy(key)
        .agg(F.collect_list(draw).alias(draws))
    )
    dealt = (
        rows.dropDuplicates([key])
        .join(taken, key)
        .select(*docs.columns, F.explode(draws).alias(draw))
    )
    return (
        dealt.repartition(F.col(draw)["shard"])
        .sortWithinPartitions(F.col(draw)["shard"], F.col(draw)["shuffle_key"])
        .select(*docs.columns)
    )


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (unsigned 32-bit, little-endian)."""
    coded = trie_bpe.encode(docs, vocabulary(), decoded=False)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoding", encoding),
]

# the classifier is trained, which SQL does not express; tests/llm compares the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            made: list[str] = []
            docs = stored(docs, name, made)
            discard(spark, before)
            before = made
    return docs
