"""Session settings and the shared scratch folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    name: str = "clauselake", cpus: str = "*", partitions: int = 8, memory: str = "12g"
) -> SparkSession:
    """A local session for tests and the bench.

    ``SPARK_MASTER`` replaces the master, ``CLAUSELAKE_SCRATCH`` the shared folder. On a
    cluster pass the session that is there; no operator makes one.
    """
    scratch = os.environ.get("CLAUSELAKE_SCRATCH") or tempfile.mkdtemp(prefix="clauselake-")
    spark = (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.clauselake.input.partitions", "16")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or by the context itself.

    Where neither is set, a bare local session gets a folder of this machine; on a cluster
    that would lie on another disk for every machine, and is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="clauselake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_SHIPPED: set[str] = set()  # applications that have the package


def package_zip() -> bytes:
    """This package as a zip that Python imports from."""
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    return held.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package, whatever folder the driver runs in.

    Functions of the package travel to Python workers by name. Once per application its
    files go to the shared folder as a zip and to every executor from there. Local workers
    that have the folder on ``PYTHONPATH`` need none.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.master.startswith("local") and root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = scratch_path(spark, "package") + ".zip"
    system, named = _files(spark, path)
    out = system.create(named)
    out.write(bytearray(package_zip()))
    out.close()
    context.addPyFile(str(system.makeQualified(named).toString()))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/clauselake-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    return f"{_own_scratch(spark)}/{purpose}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; call it when its results are written."""
    remove(spark, _own_scratch(spark))


def _files(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path as it knows it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()), named


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    system, named = _files(spark, path)
    return [f.getPath().getName() for f in system.listStatus(named)] if system.exists(named) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    system, named = _files(spark, path)
    system.delete(named, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str, shelf: list[str] | None = None) -> DataFrame:
    """Write a table that several steps read, and continue from the file.

    Its path goes on the ``shelf``, if there is one, for ``discard``. What the executors
    shuffled to make the table goes when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    if shelf is not None:
        shelf.append(path)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
    return spark.read.parquet(path)


def discard(spark: SparkSession, shelf: list[str]) -> None:
    """Delete the tables of a shelf, when what was made of them is stored itself."""
    while shelf:
        remove(spark, shelf.pop())
