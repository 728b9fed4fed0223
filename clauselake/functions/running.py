"""Running totals that never put one whole group into one task."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.session import ensure_checkpoint_dir


def running_total(
    df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str
) -> DataFrame:
    """Add ``name`` = sum of ``amount`` up to and including the row, per key.

    ``keys + order`` must be unique for a repeatable answer. Rows are ranged
    over ``keys + order`` so that a hot key spans as many partitions as it
    needs; only one subtotal per (partition, key) goes through the second
    window. The ranged rows are checkpointed because range bounds are sampled:
    both uses must see the same cut, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (
        df.withColumn("_amount", amount.cast("bigint"))
        .repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn("_part", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("_part", *keys)
        .agg(F.sum("_amount").alias("_subtotal"))
        .withColumn("_base", F.coalesce(F.sum("_subtotal").over(before), F.lit(0)))
        .drop("_subtotal")
    )
    inside = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # null-safe: a missing key is a key like any other
    bases = bases.select("_base", *[F.col(c).alias(f"_b_{c}") for c in ["_part", *keys]])
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in ["_part", *keys]]
    return (
        ranged.join(bases, same)
        .withColumn(name, F.col("_base") + F.sum("_amount").over(inside))
        .select(*df.columns, name)
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a map-side combinable aggregate.

    The rest of a row follows its order values; of rows alike in those the greatest counts.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def moment(value: datetime) -> Column:
    """A literal time without zone, whatever the session's zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; a time without zone is taken as it stands,
    so the session's zone and its clock changes play no part."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    since = F.col(name) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = F.extract(F.lit("SECOND"), since) * 1_000_000
    return (
        F.extract(F.lit("DAY"), since).cast("bigint") * 86_400_000_000
        + F.extract(F.lit("HOUR"), since).cast("bigint") * 3_600_000_000
        + F.extract(F.lit("MINUTE"), since).cast("bigint") * 60_000_000
        + seconds.cast("bigint")
    )
