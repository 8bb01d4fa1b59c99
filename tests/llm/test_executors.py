"""Executors need no copy of the repository: every corpus query from another folder, where workers can't import it."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
def blind(batches):
    found = importlib.util.find_spec("pixelfurrow")
    for b in batches:
        yield b.slice(0, 0) if found is None else b
assert spark.range(3).mapInArrow(blind, "id long").count() == 0, "workers see the repository"
import __spark_entry__
from pixelfurrow.llm import queries
for name in [*queries.QUERIES, "pipeline"]:
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
    print("ran", name, flush=True)
"""


def test_every_query_without_the_repository_on_workers(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("ran ") == 11, done.stdout + done.stderr[-3000:]
