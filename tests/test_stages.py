"""bad rows are replaced by the stage's fallback sample, never dropped."""

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.plans import stages as G


def _conv(spark, rows):
    data = [(i, img, [{"from": f, "value": v} for f, v in turns]) for i, (img, turns) in enumerate(rows)]
    return spark.createDataFrame(data, "conv_id long, image string, "
                                       "conversations array<struct<from:string,value:string>>")


def _toks(spark, text):
    return spark.range(1).select(T.tokenize(F.lit(text))).first()[0]


def test_stage1_fallback_and_labels(spark):
    conv = _conv(spark, [("a.png", [("human", "<image>\nq"), ("gpt", "ans")]), ("b.png", [("human", "only")])])
    manifest = spark.createDataFrame([("R/a.png",), ("R/b.png",)], "path string")
    out = {r.conv_id: r for r in G.stage1_labels(G.stage1_tokens(conv, "R", manifest, n_pads=2), "tokens",
                                                 F.lit(S.PAD_TOKEN)).collect()}
    assert out[0].error_reason is None and out[1].error_reason == "too_few_turns" and out[1].is_fallback
    fb_answer = _toks(spark, S.FALLBACK_STAGE1_ANSWER + S.EOS_TOKEN)
    assert out[1].tokens[-len(fb_answer):] == fb_answer
    assert out[0].tokens.count(S.IMAGE_PAD) == 2
    # labels: prompt masked, answer kept, shifted by one
    assert out[0].labels[-1] == S.EOS_TOKEN and out[0].labels[0] == S.PAD_TOKEN
    assert len(out[0].input) == len(out[0].labels) == len(out[0].tokens) - 1


def test_stage2_fallbacks(spark):
    conv = _conv(spark, [("a.png", [("human", "q <image>"), ("gpt", "x")]),
                         ("b.png", [("gpt", "no human")]),
                         ("missing.png", [("human", "q"), ("gpt", "x")])])
    manifest = spark.createDataFrame([("a.png",), ("b.png",)], "path string")
    out = {r.conv_id: r for r in G.stage2_labels(G.stage2_tokens(conv, "", manifest, n_pads=1), "tokens",
                                                 F.lit(S.PAD_TOKEN)).collect()}
    assert out[0].error_reason is None and out[0].spans
    assert out[1].error_reason == "no_human_turn" and out[2].error_reason == "image_missing"
    assert out[1].tokens == out[2].tokens  # the same fixed fallback sample
    supervised = [t for t in out[0].labels if t != S.PAD_TOKEN]
    assert supervised == ["\n", "x", S.IM_END]  # assistant span: after the role token through <|im_end|>


def test_stage3_fallback_for_unreadable_image(spark):
    rec = spark.createDataFrame([(1, "a.png", "Step 1: a и <neg>", True), (2, "b.png", "Step 1: b и", False)],
                                "conv_id long, image_url string, instruction string, ok boolean")
    out = {r.conv_id: r for r in G.stage3_tokens(rec, F.col("ok")).collect()}
    assert [s.label for s in out[1].steps] == [0] and not out[1].is_fallback
    assert out[2].is_fallback and out[2].steps == []
    assert out[2].tokens == _toks(spark, S.FALLBACK_STAGE3_TEXT)


def test_step_batches_match_the_encoded_batches(spark):
    from conftest import SF001, rows
    from stepcorpus.plans import batch_queries as BQ
    cols = ("epoch", "batch_id", "slot", "conv_id", "steps")
    want = BQ.stage3_batches(spark, SF001)
    got = BQ.stage3_step_batches(spark, SF001)
    assert rows(got, *cols) == rows(want, *cols)
    assert got.count() > 0


def test_unreadable_images_and_missing_instructions(spark):
    files = spark.createDataFrame([("B/data_images/img/1.png", "ok"), ("B/data_images/img/2.png", "invalid")], "path string, status string")
    recs = spark.createDataFrame([(1, "img/1.png", None, True), (2, "img/2.png", "Step 1: a и", True), (3, "img/3.png", "x", True), (4, "img/1.png", None, False)],
                                 "conv_id long, image_url string, instruction string, instruction_present boolean")
    got = {r.conv_id: r for r in G.stage3_tokens(G.stage3_valid(recs, files, "B")).collect()}
    assert sorted(got) == [1, 2, 4]  # the third has no file
    assert {k: r.is_fallback for k, r in got.items()} == {1: False, 2: True, 4: False}
    assert "None" in "".join(got[1].tokens) and "None" not in "".join(got[4].tokens)
    assert "".join(got[2].tokens) == S.FALLBACK_STAGE3_TEXT and got[2].steps == []
    plain = {r.conv_id: r.is_fallback for r in G.stage3_tokens(G.stage3_valid(recs, files, "B"), use_template=False).collect()}
    assert plain == {1: True, 2: True, 4: False}  # a null can't be tokenized, a missing key is empty
    conv = spark.createDataFrame([(i, f"img/{i}.png", [("human", "<image>\nq"), ("gpt", "a")]) for i in (1, 2, 3)],
                                 "conv_id long, image string, conversations array<struct<from:string,value:string>>")
    for stage in (G.stage1_tokens, G.stage2_tokens):
        reasons = {r.conv_id: r.error_reason for r in stage(conv, "B/data_images", files).collect()}
        assert reasons == {1: None, 2: "image_invalid", 3: "image_missing"}
