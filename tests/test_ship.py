"""Workers import the package from another folder without PYTHONPATH."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(ROOT, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config(
    "spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in ("rank_eval", "link_eval", "ranked_list_score", "encode_symbols"):
    print("ROWS", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=900)
    assert run.stdout.count("ROWS") == 4, run.stderr[-2000:]
