"""Positional index: the query against a literal scan, edge rows, blocks, proximity."""
import random
from collections import Counter

from stepcorpus.llm import phrase_index as P
from stepcorpus.sources.tables import table

SF = "/root/testdata/sf0.001"


def run(docs, bench, **o):
    return P.digest(P.contamination(docs, bench, **o)).drop("n_near")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_given_tables(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = ordered(P.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]))
    assert ordered(run(docs, bench).collect()) == want
    assert ordered(run(docs, bench, block_words=200).collect()) == want  # many blocks
    assert any(r[5] for r in want)


def test_edge_rows_and_random_texts(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "cé", "9", "the", "the", "the", "x_y", "z-z"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 13, 14, 20])))) for i in range(25)]
    docs += [(100 + i, "x " + t + " y " + t) for i, t in items] + [(None, "a b"), (7, None), (8, ""), (9, "..."), (9, "..."), (300, "the " * 5000)]
    items += [(None, "a"), (50, None), (3, items[3][1]), (60, "the " * 20)]
    d = spark.createDataFrame([(k, t, 1, [2]) for k, t in docs], "doc_id long, text string, n_words int, items array<int>").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = ordered(P.brute_force(docs, items))
    assert ordered(run(d, b).collect()) == want
    assert ordered(run(d, b, block_words=1).collect()) == want
    assert run(d.limit(0), b).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in run(d, b.limit(0)).collect())
    left = P.decontaminate(d, b)
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, *_, bad in P.brute_force(docs, items) if not bad)


def test_rows_that_share_an_id_are_judged_apart(spark):
    d = spark.createDataFrame([(1, "one two three"), (1, "clean text here"), (2, "other"), (2, "one two three"), (None, "one two three"), (None, None)], "doc_id long, text string")
    left = P.decontaminate(d, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    assert sorted(map(str, left.collect())) == sorted(map(str, d.filter("text is null or text <> 'one two three'").collect()))


def test_proximity_moves_terms_by_the_slop_at_most(spark):
    item = "alpha beta gamma delta epsilon"
    docs = spark.createDataFrame([(1, item), (2, "alpha q beta gamma delta epsilon"), (3, "alpha q q q q beta gamma delta epsilon"), (4, "alpha beta")], "doc_id long, text string")
    got = {r.doc_id: (len(r.spans), r.n_near > 0) for r in P.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (0, False), 4: (0, False)}


def brute_near(docs, items, window=P.WINDOW, slop=P.SLOP, near_terms=P.NEAR_TERMS):
    """(item, start) of each document's proximity matches, by a scan for each place of a phrase's rarest term."""
    texts = [P.words_of((t or "").encode()) for _, t in docs]
    count = Counter(w for t in texts for w in t)
    phrases = {(str(k), tuple(w[i:i + window])) for k, t in items if k is not None and (w := P.words_of((t or "").encode())) for i in range(max(1, len(w) - window + 1))}
    out = []
    for words in texts:
        found = []
        for item, phrase in phrases:
            rare = sorted(range(len(phrase)), key=lambda i: (count[phrase[i]], i))[:near_terms]
            for place in (i for i, w in enumerate(words) if w == phrase[rare[0]]):
                start = place - rare[0]
                if all(phrase[o] in words[max(0, start + o - slop):max(0, start + o + slop + 1)] for o in rare[1:]):
                    found.append((item, start))
        out.append(sorted(found))
    return out


def test_proximity_against_a_literal_scan(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 6, 13, 15]))) for i in range(30)] + [(40, "a b c"), (41, "a b c"), (42, "nowhere a"), (None, "a"), (43, None)]
    docs = [(i, text(rng.randrange(30))) for i in range(80)] + [(90, None), (91, "")]
    docs += [(100 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in items[:30]]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {k: x for (k, _), x in zip(docs, brute_near(docs, items))}
    assert any(want.values()) and any(s < 0 for x in want.values() for _, s in x)
    for words in (P.BLOCK_WORDS, 20):
        got = P.contamination(d, b, block_words=words).collect()
        assert {r.doc_id: sorted((m["item"], m["start"]) for m in r.near) for r in got} == want
