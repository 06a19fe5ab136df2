"""Randomised checks against brute-force Python implementations."""

import random
import re

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.operators import tokens as K
from stepcorpus.operators.steps import explode_steps

A, E = 7, 9


def scan_spans(ids):
    """Direct scan: from each assistant token, the span runs from the next
    position through the next end token; scanning resumes after it.  An
    assistant token with no end token after it makes the row unclosed."""
    spans, i = [], 0
    while i < len(ids):
        if ids[i] != A:
            i += 1
            continue
        j = i + 1
        while j < len(ids) and ids[j] != E:
            j += 1
        if j == len(ids):
            return spans, True
        spans.append((i + 1, j + 1))
        i = j + 1
    return spans, False


def test_assistant_spans_match_scan(spark):
    rng = random.Random(5)
    seqs = [[rng.choice([1, 2, A, E, E, A, 3]) for _ in range(rng.randint(0, 30))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, ids array<int>")
    sp, unc = K.assistant_spans(F.col("ids"), F.lit(A), F.lit(E))
    lab = K.span_mask_labels(F.col("ids"), sp, F.lit(0))
    got = {r.i: r for r in df.select("i", sp.alias("sp"), unc.alias("unc"), lab.alias("lab")).collect()}
    for i, ids in enumerate(seqs):
        spans, unclosed = scan_spans(ids)
        assert got[i].unc == unclosed, ids
        if not unclosed:
            assert [(s.start, s.end) for s in got[i].sp] == spans, ids
            want = [t if any(a <= p < b for a, b in spans) else 0 for p, t in enumerate(ids)]
            assert got[i].lab == want, ids


def test_steps_match_python_re(spark):
    rng = random.Random(11)
    pieces = ["Step 1:", "Step 22:", "步骤 3：", "步骤4:", " и", "и ", "<pos>", "<neg>", " x", "\n", "Step", ":", "и\n<neg>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, instruction string")
    got = {}
    for r in explode_steps(df, keep=("k",)).collect():
        got.setdefault(r.k, []).append((r.step_no, r.header, r.char_start, r.label))
    pat = re.compile(S.STEP_PATTERN_BODY, re.DOTALL)
    for k, t in enumerate(texts):
        want = []
        for n, m in enumerate(pat.finditer(t)):
            lab = 1 if "<pos>" in m.group(0) else (0 if "<neg>" in m.group(0) else 1)
            want.append((n, m.group(1), t.find(m.group(1)), lab))
        assert sorted(got.get(k, [])) == want, t


def test_tokenizer_is_lossless(spark):
    rng = random.Random(3)
    alphabet = list("ab Z9é日本 \n\t,.!?<|>_-") + ["<|im_end|>", "<|image_pad|>", " ", "　", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.j for r in df.select("i", F.array_join(T.tokenize(F.col("t")), "").alias("j")).collect()}
    assert all(got[i] == t for i, t in enumerate(texts))


def test_linear_token_index_equals_prefix_tokenizing(spark):
    from stepcorpus.functions.arrays import explode_rows
    from stepcorpus.operators.steps import locate_steps, with_steps
    rng = random.Random(17)
    pieces = ["Step 1:", "Step 2:", "步骤3:", "步骤 4：", "x", "ab", " ", "  ", "\n", "и", " и", "<pos>", "<neg>",
              "9", ",", "<|im_end|>", "é", "日本", "Step", "\t", "a步骤5:", "xStep 6:"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 24))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, instruction string")
    new = explode_rows(with_steps(df, "instruction", "st"), "st", ["k"], value="s").select("k", "s.*")
    old = explode_rows(df.select("k", locate_steps(F.col("instruction")).alias("st")), "st", ["k"], value="s") \
        .select("k", "s.*")
    cols = ["k", "step_no", "header", "char_start", "token_idx", "token_idx_templated", "label"]
    a = sorted(tuple(r) for r in new.select(cols).collect())
    b = sorted(tuple(r) for r in old.select(cols).collect())
    assert len(a) > 200
    assert a == b
