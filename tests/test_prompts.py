from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.operators import prompts as P
from stepcorpus.sources.files import CONVERSATION_SCHEMA

CONV = [
    ("a.png", [("human", "<image>\nq"), ("gpt", "a")]),
    ("b.png", []),                                           # empty
    ("c.png", [("human", "only")]),                          # one turn
    ("d.png", [("gpt", "x"), ("gpt", "y")]),                 # no human
    ("e.png", [("human", "q"), ("human", "q2")]),            # no assistant
    ("f.png", [("assistant", "A"), ("human", "Q")]),         # assistant before human
    (None, [("human", "q"), ("gpt", "a")]),                  # null image
]


def conv_df(spark):
    data = [(img, [{"from": f, "value": v} for f, v in turns]) for img, turns in CONV]
    return spark.createDataFrame(data, CONVERSATION_SCHEMA).withColumn("i", F.monotonically_increasing_id())


def test_positional_pair(spark):
    out = {r["image"]: (r["question"], r["answer"], r["pair_error"])
           for r in conv_df(spark).transform(P.positional_pair).collect()}
    assert out["a.png"] == ("<image>\nq", "a", None)
    assert out["b.png"][2] == "too_few_turns"
    assert out["c.png"][2] == "too_few_turns"
    assert out["d.png"] == ("x", "y", None)          # roles ignored
    assert out["f.png"] == ("A", "Q", None)


def test_role_pair(spark):
    out = {r["image"]: (r["question"], r["answer"], r["pair_error"])
           for r in conv_df(spark).transform(P.role_pair).collect()}
    assert out["a.png"] == ("<image>\nq", "a", None)
    assert out["b.png"][2] == "no_human_turn"
    assert out["d.png"][2] == "no_human_turn"
    assert out["e.png"][2] == "no_assistant_turn"
    assert out["f.png"] == ("Q", "A", None)          # order does not matter


def test_resolve_image_path(spark):
    urls = ["MathV-360k/x", "MathV-360k//x", "mathv-360k/x", "data_images/x", "x", "/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = dict(df.select("u", P.resolve_image_path(F.col("u"), "B").alias("p")).collect())
    assert got == {"MathV-360k/x": "B/data_images/x", "MathV-360k//x": "/x",
                   "mathv-360k/x": "B/data_images/mathv-360k/x", "data_images/x": "B/data_images/x",
                   "x": "B/data_images/x", "/x": "/x"}


def test_join_path_matches_os_path(spark):
    import os.path
    cases = [("root", "a"), ("root/", "a"), ("", "a"), ("root", "/abs"), ("root", ""), ("/r//", "b/c")]
    df = spark.createDataFrame(cases, "r string, p string")
    got = [r[0] for r in df.select(P.join_path("r", "p")).collect()]
    assert got == [os.path.join(r, p) for r, p in cases]


def test_render_and_expand(spark):
    df = spark.createDataFrame([("a <image> b <image>",)], "t string")
    r = df.select(P.render_chat([("system", "S"), ("user", F.col("t"))], True).alias("x")).first()["x"]
    assert r == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\na <image> b <image><|im_end|>\n<|im_start|>assistant\n"
    for n in (0, 3, 243):
        e = df.select(P.expand_image_tag(F.col("t"), n).alias("x")).first()["x"]
        assert e == "a <image> b <image>".replace("<image>", S.IMAGE_PAD * n)
    assert df.select(P.append_eos(F.col("t"))).first()[0].endswith(S.EOS_TOKEN)


def test_render_instruction_null_and_missing(spark):
    df = spark.createDataFrame([("x", True), (None, True), (None, False)], "i string, present boolean")
    raw = [r[0] for r in df.select(P.render_instruction(F.col("i"), False, F.col("present"))).collect()]
    assert raw == ["x", None, ""]
    tpl = df.select(P.render_instruction(F.col("i"))).first()[0]
    assert tpl.startswith(P.stage3_prompt_prefix()) and tpl.endswith("<|im_start|>assistant\n")


def test_check_pad_count(spark):
    df = spark.createDataFrame([([3, 1, 3, 3], 3), ([1], 0), ([3], 2)], "ids array<int>, n int")
    n, ok = P.check_pad_count(F.col("ids"), F.lit(3), F.col("n"))
    assert [tuple(r) for r in df.select(n, ok).collect()] == [(3, True), (0, True), (1, False)]
