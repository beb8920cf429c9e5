"""The driver's view: a plain session started from another folder, with
only the repository on the driver's sys.path (Python workers must still
find the package for the pandas-backed stages)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
df = E.entry(spark)
assert df.count() == 9, df.count()
assert df.columns == ["top_pct", "strategy", "top_n", "total_churned_revenue", "caught_revenue", "caught_pct"]
q = E.queries()
assert set(E.oracle_sql()) <= set(q)
for name in ("concordance_index", "detect_anomalies"):
    assert q[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("ok")
"""


def test_entry_and_python_stages_from_another_folder(scratch):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=scratch, env=env, capture_output=True, text=True, timeout=900
    )
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.strip().endswith("ok")


def test_bench_prints_one_json_line(scratch):
    import json

    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4")
    env.pop("PYTHONPATH", None)
    out = subprocess.run(
        [sys.executable, os.path.join(REPO, "bench.py"), "load_validate", "backtest_thresholds", "roc_auc"],
        cwd=scratch, env=env, capture_output=True, text=True, timeout=900,
    )
    assert out.returncode == 0, out.stderr[-3000:]
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == 0.001
    assert set(rec["queries"]) == {"load_validate", "backtest_thresholds", "roc_auc"}
    assert rec["value"] == round(sum(rec["queries"].values()), 3)
