"""Budgets against a literal redistribution; prefixes, epochs and edge rows."""
import hashlib
import random
from collections import defaultdict

from stepcorpus.llm import mixing as M


def fill(children, budget):
    """{name: (weight, capacity)} -> shares, one shortage handed on at a time."""
    share, open_ = {}, dict(children)
    while open_:
        w = sum(x for x, _ in open_.values())
        short = {k: c for k, (x, c) in open_.items() if c <= budget * x / w + 1e-9}
        if not short:
            return share | {k: budget * x / w for k, (x, _) in open_.items()}
        k = min(short, key=lambda n: open_[n][1] / open_[n][0])
        share[k] = short[k]
        budget -= short[k]
        del open_[k]
    return share


def descend(leaves, budget, epochs, weights, depth=0, path=()):
    if depth == 3:
        return {path: budget}
    groups = defaultdict(dict)
    for leaf, n in leaves.items():
        groups[leaf[depth]][leaf] = n
    level = M.LEVELS[depth]
    shares = fill({k: (weights.get(level, {}).get(k, 1.0), float(epochs * sum(g.values()))) for k, g in groups.items()}, budget)
    out = {}
    for k, g in groups.items():
        out |= descend(g, shares[k], epochs, weights, depth + 1, path + (k,))
    return out


def test_against_a_literal_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "en", "en", "de", "fr", None]), "s0" if rng.random() < .4 else f"s{rng.randrange(30)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for share, epochs in ((0.5, 1), (0.8, 4), (3.0, 2), (1.7, 3)):
        got = defaultdict(list)
        for r in M.mix(docs, share=share, max_epochs=epochs).collect():
            got[(r.domain, r.lang, r.source)].append(r)
        leaves = defaultdict(int)
        for _, t, lang, s in rows:
            leaves[(s[1], lang or "", s)] += len(t.split())
        leaves = {k: n for k, n in leaves.items()}
        total = sum(leaves.values())
        quotas = descend(leaves, min(int(share * total), epochs * total), epochs, M.WEIGHTS)
        for leaf, n in leaves.items():
            q = int(round(quotas[leaf], 3))
            assert sum(r.taken for r in got[leaf]) == (q if n else 0), (leaf, share)
            if n:
                full, rest = divmod(q, n)
                mine = sorted((hashlib.md5(f"{M.SEED}:{full}:{i}".encode()).hexdigest(), i, len(t.split())) for i, t, lang, s in rows if (s[1], lang or "", s) == leaf)
                start, want = 0, []
                for _, i, k in mine:
                    if start < rest:
                        want.append((i, full, min(k, rest - start)))
                    start += k
                want += [(i, e, k) for _, i, k in mine for e in range(full)]
                assert sorted((r.doc_id, r.epoch, r.taken) for r in got[leaf]) == sorted(want)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, "d"), (1, "a b", None, None, None), (1, "a b", None, None, None), (None, "", "en", "x", "d")], "doc_id long, text string, lang string, source string, domain string")
    assert M.mix(docs.limit(0)).collect() == []
    out = M.mix(docs, share=1.0).collect()
    assert sum(r.taken for r in out) == 4 and {r.domain for r in out} == {""}


def test_taken_rows_hold_the_quotas_to_the_word(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["", " ", "\n\t"]) + f"w{j}" + " " for j in range(rng.randrange(0, 30))), rng.choice(["en", "de", None]), f"s{i % 3}", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    text = {r[0]: r[1] for r in rows}
    for share, epochs in ((0.6, 1), (1.7, 3)):
        want = defaultdict(list)
        for r in M.mix(docs, share=share, max_epochs=epochs).collect():
            want[r.doc_id].append(r.taken)
        got = defaultdict(list)
        for r in M.take(docs, share=share, max_epochs=epochs).collect():
            got[r.doc_id].append(len(r.text.split()))
            assert text[r.doc_id].startswith(r.text) and r.n_chars == (0 if r.text == text[r.doc_id] else len(r.text))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        assert any(n < len(text[k].split()) for k, v in got.items() for n in v)
