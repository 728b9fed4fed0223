"""Idempotent table updates as relational results: upsert, insert-once, slice replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.functions.running import latest
from clauselake.session import children, stored


def upsert_last_wins(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or update by key: any new row beats the base, the newest new row beats the rest.

    One map-side combined aggregate over the union, so a key written very often
    is reduced before the shuffle.
    """
    tagged = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(tagged, keys, ["_new", *order]).drop("_new")


def insert_first_wins(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert rows whose key is absent; rows that exist stay as they are."""
    return base.unionByName(new.join(base.select(*keys).distinct(), keys, "left_anti"))


def replace_slice(base: DataFrame, new: DataFrame, slice_key: list[str]) -> DataFrame:
    """Delete-then-insert of whole slices; running it twice gives the same table."""
    return base.join(new.select(*slice_key).distinct(), slice_key, "left_anti").unionByName(new)


def write_slices(df: DataFrame, path: str, slice_key: list[str]) -> None:
    """The same on disk: only the partitions present in ``df`` are overwritten."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*slice_key)
        .parquet(path)
    )


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(
    df: DataFrame, path: str, keys: list[str], buckets: int = 256, order: list[str] | None = None
) -> None:
    """A table of one row per key, in ``buckets`` folders by the key's hash.

    With ``order`` the newest row of each key counts, picked by the task that writes the key's
    bucket, so that rows move once.
    """
    rows = df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket")
    if order:
        rows = latest(rows, ["_bucket", *keys], order)
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def upsert_buckets(new: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 256) -> int:
    """``upsert_last_wins`` on a table of ``write_buckets``; gives the number of buckets written.

    Only folders that hold a key of the batch are read and overwritten. Of the batch the
    newest row of each key counts; the table's own rows are compared by key alone. Rows move
    once, to the task that writes their bucket. The new state of those folders is staged
    beside them and takes their place when all of it is written, so a lost executor repeats
    reading and not half a replacement; running the batch again changes nothing.
    """
    spark = new.sparkSession
    newest = stored(latest(new, keys, order).withColumn("_bucket", _bucket(keys, buckets)), "batch")
    touched = [r[0] for r in newest.select("_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    if not children(spark, path):  # the first batch
        write_slices(newest.repartition("_bucket"), path, ["_bucket"])
        return len(touched)
    base = spark.read.parquet(path).filter(F.col("_bucket").isin(touched))
    both = base.withColumn("_new", F.lit(0)).unionByName(newest.withColumn("_new", F.lit(1)))
    key = Window.partitionBy("_bucket", *keys)
    merged = (
        both.repartition("_bucket")
        .withColumn("_newest", F.max("_new").over(key))
        .filter(F.col("_new") == F.col("_newest"))
        .drop("_new", "_newest")
    )
    write_slices(merged, path, ["_bucket"])
    return len(touched)


def soft_delete(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Set ``deleted_at`` where a request names the document and its owner.

    ``requests``: ``document_id, user_id, requested_at``. A document that is
    already deleted keeps its first date.
    """
    first = requests.groupBy("document_id", "user_id").agg(
        F.min("requested_at").alias("_requested")
    )
    return documents.join(first, ["document_id", "user_id"], "left").select(
        *[
            F.coalesce("deleted_at", "_requested").alias("deleted_at") if c == "deleted_at" else c
            for c in documents.columns
        ]
    )
