"""Turn repair against literal searches: the DP alone, small chunks, damaged tables, edge rows."""
import itertools
import random
import re

from stepcorpus.llm import turn_repair as T
from stepcorpus.sources.tables import table

COLUMNS = "conv_id long, turn long, role string, text string"


def found(df):
    return sorted((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in T.repair_damaged(df).collect())


def literal(df, harm=True):
    return T.brute_force([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], harm)


def solved(codes, cuts=()):
    parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
    return T.decoded(*T.whole_weight([(T.chunk_width(p), T.chunk_matrix(p, i == len(parts) - 1)) for i, p in enumerate(parts)]))


def every_way(codes):
    """All edits of at most two inserts a gap, tried one by one."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    edits = []
    for c in codes:
        initial, fault = "suax"[(ord(c) - 65) // 4], (ord(c) - 65) % 4
        edits.append([(3, "D", "")] + ([(fault, "K", initial), (2 + fault, "R", "u"), (2 + fault, "R", "a")] if fault < 2 else []))
    best = None
    for ways in itertools.product(inserts, *itertools.chain.from_iterable((e, inserts) for e in edits)):
        gaps, chosen = ways[0::2], ways[1::2]
        roles = gaps[0] + "".join(e[2] + g for e, g in zip(chosen, gaps[1:]))
        if re.fullmatch("(s?(ua)+)?", roles):
            cost = 2 * sum(map(len, gaps)) + sum(e[0] for e in chosen)
            audit = "I" * len(gaps[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(chosen, gaps[1:]))
            best = min(best or (cost, audit), (cost, audit))
    return best


def test_numbers_find_the_least_of_every_way():
    letters = [T.code_of(i, f) for i in range(4) for f in range(4)]
    for n in (1, 2):
        for codes in itertools.product(letters, repeat=n):
            assert solved("".join(codes)) == every_way(codes)
    rng = random.Random(1)
    for _ in range(25):
        codes = "".join(rng.choice(letters[:2] + letters[4:6] + letters[8:10] + letters[12:]) for _ in range(3))
        assert solved(codes) == every_way(codes)


def test_chunks_together_are_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(T.code_of(rng.randrange(4), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(2, 14)))
        cuts = sorted(rng.sample(range(1, len(codes)), rng.randrange(1, min(4, len(codes)))))
        assert solved(codes, cuts) == solved(codes)
        audit = solved(codes)[1]
        edits = T.edits_of(codes, audit)
        assert len(edits) == len(codes) and "".join(re.sub("[ua]", "I", re.sub("[UA]", "R", e)) for e in edits) == audit


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    assert found(df) == literal(df)


def test_repaired_turns_as_they_stand(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations").unionByName(spark.createDataFrame(
        [(900, 0, "assistant", "Late."), (901, 0, "tool", "x"), (902, 0, "", None), (902, 1, None, "a.")], COLUMNS))
    audits, turns = T.repair(df)
    want = {w[0]: w for w in literal(df, False)}
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in audits.collect()} == {c: w[1:8] for c, w in want.items()}
    from hashlib import sha256
    lines = {}
    for r in turns.orderBy("conv_id", "at", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == {c: w[8] for c, w in want.items()}


def test_one_conversation_with_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BITS", 4)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(("user", "assistant", "system", "tool")), rng.choice(("Yes.", "no", "", " \t", "Well!\n", "so what?"))) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(7, 100 + t, rng.choice(("user", "assistant")), f"turn {t}" + rng.choice((".", ""))) for t in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(df) == literal(df)


def test_edge_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 2 ** 62, "user", "é" * 200_000 + "."), (1, -2 ** 62, "assistant", "b\x0b"), (2, 0, "system", "only"), (2, 0, "system", "only"),
            (None, 0, "user", "lost"), (-5, 3, "user", "\x1cq."), (-5, 3, "user", "\x1cq."), (3, None, "assistant", "?"), (4, 1, "", "x."), (5, 2, "user", "line\nbreak: K."), (5, 9, "assistant", "ok.\r\n")]
    rows += [(c, 0, "user", "u.") for c in range(100, 140)]  # some lose their one row
    df = spark.createDataFrame(rows, COLUMNS)
    want = literal(df)
    kept = {w[0] for w in want}
    from hashlib import sha256
    want = sorted(want + [(c, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for c in {r[0] for r in rows if r[0] is not None} - kept])
    assert found(df) == want
    assert found(df.selectExpr("*", "1 as at", "'x' as code", "2 as first", "3 as digest", "4 as copy", "5 as source")) == want
    assert found(spark.createDataFrame([], COLUMNS)) == []
