"""Storage keys: building, parsing and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def storage_key(versions: DataFrame) -> DataFrame:
    """``documents/{user}/{document}/v{n}/{file}``."""
    return versions.withColumn(
        "storage_key",
        F.concat_ws(
            "/",
            F.lit("documents"),
            "user_id",
            "document_id",
            F.concat(F.lit("v"), F.col("version_no").cast("string")),
            "source_filename",
        ),
    )


def parse_storage_key(requests: DataFrame) -> DataFrame:
    """Path below the root and a verdict per requested key.

    ``requests``: ``storage_key, user_id``. Parent-directory segments and empty
    ones are dropped, so the path cannot leave the root. The verdict is taken from
    the key as asked for.
    """
    asked = F.split(F.ltrim("storage_key", F.lit("/")), "/")
    normal = F.replace("storage_key", F.lit("\\"), F.lit("/"))
    safe = F.filter(F.split(normal, "/"), lambda p: (p != "") & (p != ".."))
    verdict = (
        F.when((F.size("_asked") < 4) | (F.get("_asked", F.lit(0)) != "documents"), "invalid")
        .when(F.get("_asked", F.lit(1)) != F.col("user_id").cast("string"), "denied")
        .otherwise("ok")
    )
    return (
        requests.withColumn("_asked", asked)
        .withColumn("path", F.array_join(safe, "/"))
        .withColumn("verdict", verdict)
        .drop("_asked")
    )
