"""Corpus intake: loading, admission, fingerprints, version numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.running import running_total


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``storage_key, text`` (or ``content`` for blobs) from a folder.

    ``binary`` reads whole files as blobs, ``text`` whole files as strings; any
    other format is read as a table that has the columns already.
    """
    if fmt == "binary":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(F.col("path").alias("storage_key"), "content", "length")
    if fmt == "text":
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        return files.select(F.input_file_name().alias("storage_key"), F.col("value").alias("text"))
    return spark.read.format(fmt).load(path)


def load_versions(jobs: DataFrame, versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """The text of each job's version; a missing version or blob is a failed row, no exception."""
    rows = jobs.join(versions.select("version_id", "storage_key"), "version_id", "left").join(
        blobs.select("storage_key", "text", F.lit(True).alias("_stored")), "storage_key", "left"
    )
    reason = F.when(F.col("storage_key").isNull(), "version_missing").when(
        F.col("_stored").isNull(), "blob_missing"
    )
    status = F.when(reason.isNull(), "loaded").otherwise("failed")
    return rows.withColumns({"failure": reason, "status": status}).drop("_stored")


def file_extension(name: Column) -> Column:
    """Lower-cased text after the last dot, empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def admission_gate(
    files: DataFrame,
    extensions: list[str] = K.UPLOAD_EXTENSIONS,
    max_bytes: int = K.MAX_FILE_BYTES,
) -> DataFrame:
    """Adds ``extension``, ``admitted`` and ``reject_reason``. Input has ``filename, size``."""
    reason = F.when(~F.col("extension").isin(extensions), "unsupported_format").when(
        F.col("size") > max_bytes, "too_large"
    )
    return (
        files.withColumn("extension", file_extension(F.col("filename")))
        .withColumn("reject_reason", reason)
        .withColumn("admitted", F.col("reject_reason").isNull())
    )


def content_fingerprint(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256))


def exact_copy_groups(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Fingerprints that occur more than once, with their number and smallest key."""
    groups = content_fingerprint(df, column).groupBy("sha256")
    counted = groups.agg(F.count("*").alias("copies"), F.min(key).alias("first_id"))
    return counted.filter("copies > 1")


def assign_version_no(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """Next number per document in upload order, after the highest existing one.

    ``uploads``: ``upload_id, document_id, uploaded_at``.
    """
    highest = versions.groupBy("document_id").agg(F.max("version_no").alias("_max"))
    placed = running_total(
        uploads.select("upload_id", "document_id", "uploaded_at"),
        ["document_id"],
        ["uploaded_at", "upload_id"],
        F.lit(1),
        "_nth",
    )
    return placed.join(highest, "document_id", "left").select(
        "upload_id",
        "document_id",
        (F.coalesce("_max", F.lit(0)) + F.col("_nth")).cast("int").alias("version_no"),
    )
