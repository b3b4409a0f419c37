"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


#: Some queries of each kind, run where the operators are gone.
RUNS = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", "{top}/local").config("spark.checkpoint.dir", "file://{top}/shared").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in ("search_ordered", "point_in_polygon", "import_runs", "ingest_delimited", "daily_telemetry", "cluster_points"):
    assert q[name](s, "/root/testdata/sf0.001").count() > 0, name
"""


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    top = Path(__file__).resolve().parents[1]
    for name in ("flurstrom", "tests"):
        shutil.copytree(top / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(top / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_ordered' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for with_pipeline in (False, True):
        if with_pipeline and (top / "corpus_pipeline.py").exists():
            shutil.copy(top / "corpus_pipeline.py", tmp_path)
            code += RUNS.format(top=tmp_path)
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=300)
