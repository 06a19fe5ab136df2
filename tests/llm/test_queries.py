"""Every opN query over whole small tables; those with SQL against DuckDB; the pipeline stage by stage."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as C  # noqa: E402
from stepcorpus.llm import language_mixture, mixing, near_dups, phrase_index  # noqa: E402
from stepcorpus.llm.queries import QUERIES, SQL  # noqa: E402
from stepcorpus.sources.tables import table  # noqa: E402

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF01}/{t}.parquet'")
    df = QUERIES[name](spark, SF01)
    res = con.execute(SQL[name])
    names = sorted(c[0] for c in res.description)
    assert sorted(df.columns) == names
    at = {c[0]: i for i, c in enumerate(res.description)}
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == sorted((tuple(r[at[n]] for n in names) for r in res.fetchall()), key=str)


def test_entry_lists_the_queries():
    import __spark_entry__ as E
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())


def test_pipeline_stage_by_stage(spark):
    docs, kept = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        kept.append((docs, out))
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    und = {r.doc_id for r in language_mixture.identify(kept[0][0]).collect() if r.lang_pred == "und" or r.score < language_mixture.MIN_SCORE}
    assert ids(kept[0][1]) == sorted(set(ids(kept[0][0])) - und)
    assert ids(kept[1][1]) == sorted(r[0] for r in near_dups.brute_force(rows(kept[1][0]), 5) if r[3])
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert ids(kept[2][1]) == sorted(r[0] for r in phrase_index.brute_force(rows(kept[2][0]), items) if not r[5])
    n = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    quotas = mixing.mix(kept[3][0], share=C.MIX_SHARE, max_epochs=1)
    assert n(kept[3][1]) == sum(r.taken for r in quotas.collect()) <= 0.8 * n(kept[3][0]) and set(ids(kept[3][1])) <= set(ids(kept[3][0]))
    assert n(kept[3][1]) > 0.8 * n(kept[3][0]) - kept[3][0].select("source", "lang").distinct().count() - 1
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == ids(docs)
    assert sorted(tuple(r) for r in C.run(spark, SF).collect()) == sorted(tuple(r) for r in last)
