import pytest
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.operators import tokens as K
from stepcorpus.session import broadcast_if_small

A, E = 7, 9  # assistant, <|im_end|>


def toks(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(T.tokenize(F.col("t"))).first()[0]


def test_tokenizer_edges(spark):
    assert toks(spark, "") == []
    assert toks(spark, " <|im_end|>") == [" ", "<|im_end|>"]
    assert toks(spark, "a helpful assistant.") == ["a", " helpful", " assistant", "."]
    assert toks(spark, "<|im_start|>assistant\n") == ["<|im_start|>", "assistant", "\n"]
    assert toks(spark, "Héllo wörld") == ["Héllo", " wörld"]
    assert toks(spark, "几何 问题\n\n") == ["几何", " 问题", "\n", "\n"]
    for s in ["x  y", "a\tb\r\nc", "ü-ö, 12.5%", "<|image_pad|><|image_pad|>"]:
        assert "".join(toks(spark, s)) == s


def test_encode_decode_roundtrip_and_vocab(spark):
    texts = ["the cat <|im_end|>", "the dog", "<|endoftext|>", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("tok", T.tokenize(F.col("t")))
    vocab = K.build_vocab(df, "tok")
    v = {r["token"]: (r["token_id"], r["n"]) for r in vocab.collect()}
    assert [v[t][0] for t in S.SPECIAL_TOKENS] == [0, 1, 2, 3]
    assert v["the"] == (4, 2)  # most frequent ordinary token right after the specials
    ids = sorted(v.values())
    assert [i for i, _ in ids] == list(range(len(ids)))
    enc = K.encode(df, "tok", vocab, "k", "ids")
    dec = K.decode(enc, "ids", vocab, "k", "back")
    assert {r["k"]: r["back"] for r in dec.collect()} == dict(enumerate(texts))


def test_encode_decode_without_broadcast(spark, monkeypatch):
    """Of a vocabulary above the broadcast bound only the head is broadcast;
    the ids and texts are the same for any head."""
    texts = ["<|im_start|>user\n<|image_pad|><|image_pad|> x<|im_end|>", "y y z", "", "<|image_pad|>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("tok", T.tokenize(F.col("t")))
    vocab = K.build_vocab(df, "tok")

    def run():
        enc = K.encode(df, "tok", vocab, "k", "ids")
        dec = K.decode(enc, "ids", vocab, "k", "back")
        return {r["k"]: (tuple(r["ids"]), r["back"]) for r in dec.collect()}

    small = run()
    monkeypatch.setattr(K, "BROADCAST_MAX_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no size-based broadcast either
    try:
        plan = K.encode(df, "tok", vocab, "k", "ids")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        for head in (K.HEAD_IDS, 6, 0):
            monkeypatch.setattr(K, "HEAD_IDS", head)
            assert run() == small
        monkeypatch.setattr(K, "HEAD_IDS", 10**6)
        monkeypatch.setattr(K, "HEAD_CHARS", 1)  # longer tokens stay out of the head
        assert run() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {k: v[1] for k, v in small.items()} == {k: t or "" for k, t in enumerate(texts)}
    assert small[3][0] == (3,)  # the image pad keeps its fixed id


def test_encode_reports_a_repeated_key(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"])], "k long, tok array<string>")
    with pytest.raises(Exception, match="k is not unique"):
        K.encode(df, "tok", K.build_vocab(df, "tok"), "k", "ids").collect()


def test_frequent_tokens_are_looked_up_in_the_row(spark, monkeypatch):
    """Neither rows nor a join for the vocabulary's head; only other elements become rows, and their places are filled."""
    texts = ["a a a b b c <|im_end|>", "", None, "d a\u0000e", "几何 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("tok", T.tokenize(F.col("t")))
    vocab = K.build_vocab(df, "tok")
    enc = K.encode(df, "tok", vocab, "k", "ids")
    for out in (enc, K.decode(enc, "ids", vocab, "k", "back")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Generate", "Exchange", "Join"))
    want = {r.k: r.ids for r in enc.collect()}
    monkeypatch.setattr(K, "HEAD_IDS", 6)
    head, rest, whole = K._head(vocab, "token", "token_id")
    assert not whole and len(head) == 6 and rest.count() == vocab.count() - 6
    near, far, _ = K._resolvers(spark, head, "token", "token_id", vocab.schema["token"].dataType, vocab.schema["token_id"].dataType, "k", {})
    got = {r.k: r for r in df.select("k", "tok", near("tok").alias("n"), far("tok").alias("f")).collect()}
    known = set(head["token"].to_pylist())
    for r in got.values():
        assert [(x.pos, x.token) for x in r.f] == [(i, t) for i, t in enumerate(r.tok or []) if t not in known]
        assert r.n == [i if t in known else None for t, i in zip(r.tok or [], want[r.k])]
    assert {r.k: r.ids for r in K.encode(df, "tok", vocab, "k", "ids").collect()} == want


def test_a_repeated_or_null_key_without_elements_is_no_error(spark):
    df = spark.createDataFrame([(1, []), (1, ["<|im_end|>"]), (2, ["a"])], "k long, tok array<string>")
    vocab = K.build_vocab(df, "tok")
    assert sorted((r.k, r.ids) for r in K.encode(df, "tok", vocab, "k", "ids").collect()) == [(1, []), (1, [2]), (2, [4])]
    for key in ("1", "cast(null as long)"):
        with pytest.raises(Exception, match="k is not unique"):
            K.encode(df.unionAll(df.selectExpr(f"{key} as k", "array('a') as tok")), "tok", vocab, "k", "ids").collect()


def test_vocabulary_of_long_tokens_is_not_broadcast(spark):
    df = spark.createDataFrame([("x" * 100, 1), ("y", 2)], "token string, token_id long")
    assert broadcast_if_small(df)[1] and not broadcast_if_small(df, max_bytes=120)[1] and not broadcast_if_small(df, max_rows=1)[1]


def spans_of(spark, seqs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, ids array<int>")
    sp, unc = K.assistant_spans(F.col("ids"), F.lit(A), F.lit(E))
    return [([(s["start"], s["end"]) for s in r[0]], r[1]) for r in df.orderBy("i").select(sp, unc).collect()]


def test_assistant_spans_golden(spark):
    got = spans_of(spark, [[1, 9, 2, 9, 7, 3, 4, 9], [1, 7, 5, 9, 7, 7, 6, 9], [7, 9, 9, 7, 9], [1, 9, 7, 3], [1, 2], []])
    assert got == [([(5, 8)], False), ([(2, 4), (5, 8)], False), ([(1, 2), (4, 5)], False),
                   ([], True), ([], False), ([], False)]


def test_span_mask_labels(spark):
    df = spark.createDataFrame([([1, 7, 5, 9, 7, 7, 6, 9],)], "ids array<int>")
    sp, _ = K.assistant_spans(F.col("ids"), F.lit(A), F.lit(E))
    lab = df.select(K.span_mask_labels(F.col("ids"), sp, F.lit(0))).first()[0]
    assert lab == [0, 0, 5, 9, 0, 7, 6, 9]


def test_prefix_mask_shift_and_concat(spark):
    df = spark.createDataFrame([([1, 2], [3, 4, 5])], "q array<int>, a array<int>")
    r = df.select(K.concat_qa(F.col("q"), F.col("a")).alias("ids"),
                  K.prefix_mask_labels(F.col("q"), F.col("a"), F.lit(0)).alias("lab")).first()
    assert r["ids"] == [1, 2, 3, 4, 5] and r["lab"] == [0, 0, 3, 4, 5]
    d2 = spark.createDataFrame([([],), ([1],), ([1, 2],)], "x array<int>")
    i, l = K.shift_pair(F.col("x"), F.col("x"))
    assert [tuple(r) for r in d2.select(i, l).collect()] == [([], []), ([], []), ([1], [2])]


def test_attention_mask(spark):
    df = spark.createDataFrame([([5, 0, 3, 0],)], "ids array<int>")
    assert df.select(K.attention_mask(F.col("ids"), F.lit(0))).first()[0] == [1, 0, 1, 0]
