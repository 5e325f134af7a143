import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["list_id", "dim", "value"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 25


def test_feed_matches_batch(spark):
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    a = {tuple(r) for r in q["feed_centers"](spark, sf).collect()}
    b = {tuple(r) for r in q["word_center"](spark, sf).collect()}
    assert a == b


def test_upload_feed_matches_batch(spark):
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    a = {tuple(r) for r in q["feed_uploads"](spark, sf).collect()}
    b = {tuple(r) for r in q["uploads_validate"](spark, sf).collect()}
    assert a == b and len(a) > 0


def test_python_tasks_run_without_package_on_worker_path(tmp_path):
    """A job started from another directory (no --py-files) still runs the
    Python kernels: the package ships its functions by value."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print("ROWS", len(q["nearest_word"](spark, "/root/testdata/sf0.001").collect()),
      len(q["uploads_models"](spark, "/root/testdata/sf0.001").collect()),
      len(q["w2v_import"](spark, "/root/testdata/sf0.001").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    assert all(int(x) > 0 for x in line[0].split()[1:])
