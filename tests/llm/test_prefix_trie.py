"""Prefix trie against a literal one; subtree sums of chains, stars and random trees."""
import random

import pytest

from stepcorpus.llm import prefix_trie as P
from stepcorpus.llm.ordered import hash_in_order
from stepcorpus.sources.tables import table

COLUMNS = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def literal(df, shared=True):
    return P.brute_force([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], shared)


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    assert nodes(P.build_shared(df)) == literal(df)


def test_unshared(spark):
    rows = [(c, t, "user", "abc"[:(c >> t) % 4]) for c in range(20) for t in range(c % 4)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert nodes(P.build(df)) == literal(df, False)


def test_copies_and_one_conversation_with_a_third_of_the_rows(spark):
    rng = random.Random(5)
    rows = []
    for c in range(0, 420):
        if c % 100 == 0 and c != 300 or rng.random() < 0.8:  # some groups have no first conversation
            same = c % 3 == 0
            rows += [(c, t, "user" if t % 2 == 0 else "assistant", "same" if same else rng.choice("abc") * rng.randrange(3)) for t in range(4 if same else rng.randrange(1, 9))]
    rows += [(7, t, "user", rng.choice("xy")) for t in range(100, 700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert nodes(P.build_shared(df)) == literal(df)


def test_edge_rows(spark):
    rows = [(0, 0, "user", "a"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (1, 5, "user", "é" * 100_000), (2, None, "system", "x"), (2, None, "system", "x"),
            (None, 0, "user", "lost"), (-3, 0, "user", "n"), (-100, 1, "a", "b:c"), (-103, 1, "a:b", "c"), (250, 0, "user", "z"), (2 ** 62, 0, "user", "far")]
    df = spark.createDataFrame(rows, COLUMNS)
    want = literal(df)
    assert nodes(P.build_shared(df)) == want
    assert nodes(P.build_shared(df.selectExpr("*", "1 as part", "2 as pos", "'x' as digest", "3 as id", "4 as depth"))) == want
    assert nodes(P.build_shared(spark.createDataFrame([], COLUMNS))) == []


def test_turnless_conversations(spark):
    turnless = spark.createDataFrame([(c, 0, "user", "one turn") for c in range(201, 300)], COLUMNS)  # the first of the group is absent
    got = nodes(P.build_shared(turnless))
    assert got == literal(turnless) and got[0][:2] == (201, 0)


def _trees():
    rng = random.Random(9)
    yield "chain", [(i, i - 1 if i else None) for i in range(120)]
    yield "star", [(i, 0 if i else None) for i in range(300)]
    yield "random", [(i, rng.randrange(max(0, i - 6), i) if i else None) for i in range(120)]
    yield "caterpillar", [(i, (i - 2 if i % 2 == 0 else i - 1) if i else None) for i in range(100)]
    yield "forest", [(i, i - 1 if i % 7 else None) for i in range(60)]
    yield "one node", [(0, None)]
    yield "empty", []


@pytest.mark.parametrize("name, tree", list(_trees()), ids=lambda x: x if isinstance(x, str) else "")
def test_subtree_sums(spark, name, tree):
    want = {i: [1, i] for i, _ in tree}
    for i, p in sorted(tree, reverse=True):
        if p is not None:
            want[p] = [a + b for a, b in zip(want[p], want[i])]
    df = spark.createDataFrame([(i, p, 1, i) for i, p in tree], "id long, parent long, n long, s long")
    assert {r.id: [r.n, r.s] for r in P.subtree_sums(df, ["n", "s"]).collect()} == want


def test_hot_parents_are_looked_up(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)], "k long, v long").repartition(4)
    names = spark.createDataFrame([(i, i * 10) for i in range(900)], "k long, name long")
    assert sorted(tuple(r) for r in P._looked_up(rows, names, ["k"], "name").select("v", "name").collect()) == [(i, 10 if i % 3 else i * 10) for i in range(900)]


def test_ids_of_a_node_over_many_batches(spark):
    import hashlib
    ends = spark.range(30_000).selectExpr("id % 3 as hi", "0L as lo", "id * 7 - 50000 as conv_id", "cast(cast(id * 7 - 50000 as string) as binary) as piece").repartition(6)
    got = {r.hi: r.h for r in hash_in_order(ends, ["hi", "lo"], "conv_id", "h", ",").collect()}
    assert got == {h: hashlib.sha256(",".join(str(i * 7 - 50000) for i in range(30_000) if i % 3 == h).encode()).hexdigest() for h in range(3)}
