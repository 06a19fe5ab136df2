import duckdb
import pytest

from conftest import SF001


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["conv_id", "error_reason", "is_fallback", "n_input", "n_supervised"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {n for n in set(q) - set(o) if not n.startswith("op") and n != "pipeline"} == {"m2_fit_step_verifier"}


@pytest.mark.parametrize("name", ["stage2_summary", "t9_locate_steps", "b1_exact_split", "m6_top_k_softmax",
                                  "j5_pool_patches", "f1_first_n", "s2_read_step_jsonl"])
def test_oracle_agrees_at_sf0001(spark, name):
    import __spark_entry__ as E
    from stepcorpus.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(tuple(norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect())
    idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    b = sorted(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
    assert a == b


def test_queries_run_outside_the_repo(tmp_path):
    """A plain session started elsewhere (as the driver does) can run the
    pandas-UDF queries: the package is shipped to the Python workers."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print("COUNTS", q["m1_score_steps"](spark, {SF001!r}).count(), q["s2_quarantine"](spark, {SF001!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert "COUNTS" in out.stdout, out.stderr[-2000:]
