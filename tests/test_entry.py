"""The driver's functions from another folder, and without the training-data queries."""

import os
import shutil
import subprocess
import sys

import pytest

from clauselake import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
print(len(entry.queries()), entry.queries()["align_clauses"](spark, {data!r}).count())
"""


def _run(root, folder, data):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN.format(root=root, data=data)
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return [int(x) for x in done.stdout.split()[-2:]]


def test_queries_run_from_another_folder(tmp_path, sf_dir):
    """Python workers get the package though their path does not have it."""
    n, rows = _run(ROOT, tmp_path, sf_dir)
    assert n > 150 and rows > 0


def test_without_the_subpackage(tmp_path, sf_dir):
    """A copy without the folders that can be left out still gives all other queries."""
    copy = tmp_path / "copy"
    for part in ("clauselake", "__spark_entry__.py"):
        whole = os.path.join(ROOT, part)
        if os.path.isdir(whole):
            shutil.copytree(whole, copy / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(whole, copy / part)
    n, rows = _run(str(copy), tmp_path, sf_dir)
    assert n > 150 and rows > 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
