from stepcorpus.operators.steps import explode_steps

GOLDEN = [
    ("Step 1: a и <pos>\nStep 2: b\nmore и<neg> tail", [("Step 1:", 0, 1), ("Step 2:", 18, 0)]),
    ("步骤 1：甲 и\n步骤2:乙 и <neg>", [("步骤 1：", 0, 1), ("步骤2:", 9, 0)]),
    ("Step 1: a Step 2: b и <neg>", [("Step 1:", 0, 0)]),
    ("Step 1: x и <pos> Step 1: y и <neg>", [("Step 1:", 0, 1), ("Step 1:", 0, 0)]),
    ("Step 1: <pos> z и <neg>", [("Step 1:", 0, 1)]),
    ("Step ٣: arabic-indic digit и", [("Step ٣:", 0, 1)]),
    ("Step 1: no marker at all", []),
    (None, []), ("", []), ("no steps", []),
]


def test_golden_steps(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "k int, instruction string")
    out = explode_steps(df, keep=("k",)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["k"], r["step_no"])):
        got.setdefault(r["k"], []).append((r["header"], r["char_start"], r["label"]))
    for i, (_, want) in enumerate(GOLDEN):
        assert got.get(i, []) == want, GOLDEN[i][0]


def test_token_index(spark):
    df = spark.createDataFrame([(0, "Q? Step 1: a и\nStep 2: b и")], "k int, instruction string")
    r = sorted(explode_steps(df, keep=("k",)).collect(), key=lambda r: r["step_no"])
    # tokens before "Step 1:" are "Q", "?", " " -> 3; the templated index adds the prompt prefix
    assert r[0]["token_idx"] == 3
    assert r[1]["token_idx"] > r[0]["token_idx"]
    assert r[0]["token_idx_templated"] > r[0]["token_idx"]
