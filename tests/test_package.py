"""The package reaches workers that start elsewhere."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.append({repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {work!r}).config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as e
for name in {names!r}:
    if name in e.queries():
        print(name, e.queries()[name](spark, {sf!r}).count())
print("done")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_elsewhere_find_the_package(tmp_path):
    names = ["p2_found", "p3_found", "p9_found"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    script = SCRIPT.format(repo=REPO, work=f"file://{tmp_path}/shared", names=names, sf=SF)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0 and "done" in run.stdout, run.stderr[-3000:]
