"""Near duplicates: components against all pairs, large groups, shared passages, edge rows."""
import random

import pytest

from stepcorpus.llm import near_dups as N
from stepcorpus.llm.components import components
from stepcorpus.sources.tables import table


def result(docs, size):
    return sorted(tuple(r) for r in N.near_duplicates(docs, size).collect())


@pytest.mark.parametrize("size", [4, 5])
def test_given_tables(spark, size):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = sorted(N.brute_force([(r.doc_id, r.text) for r in docs.collect()], size))
    assert result(docs, size) == want
    assert any(not r[3] for r in want)


def test_large_groups_and_shared_passages(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(150):  # near copies, about as far from each other as the limit
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(120)] = word()
        rows.append(" ".join(t))
    rows += [" ".join(base)] * 30
    rows += [" ".join([word() for _ in range(rng.randrange(5, 60))] + passage) for _ in range(120)]
    rows += [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(docs, 4) == sorted(N.brute_force(rows, 4))


def test_nodes_that_stay_large_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "DEPTH", 1)
    monkeypatch.setattr(N, "STARS", 1)
    monkeypatch.setattr(N, "SMALL", 12)
    monkeypatch.setattr(N, "BLOCK", 7)
    test_large_groups_and_shared_passages(spark)


def test_large_nodes_branch(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 12)
    test_large_groups_and_shared_passages(spark)


def test_pieces_hold_whole_texts(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = result(docs, 4)
    monkeypatch.setattr(N, "PIECE", 100)
    assert result(docs, 4) == want


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "A b", 0), (4, "a\tB\n", 0), (5, "a b c", 0), (None, "a b", 0), (None, None, 0), (6, "x " * 40000, 0), (7, "X  x x x x", 0), (4, "a b", 0), (8, " \n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs, 4).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True),
                          (None, 1, None, True), (None, 0, None, True)], key=str)
    assert N.near_duplicates(docs.limit(0), 4).collect() == []
    left = N.deduplicate(docs, 4)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "5", "6", "8", "None", "None"]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {100} and got[201] == 200 and 300 not in got
