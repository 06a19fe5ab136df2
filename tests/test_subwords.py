"""Sub-word ids against a public implementation of the same vocabulary."""
import random

import pytest
import tiktoken

from stepcorpus import settings as S
from stepcorpus.operators import subwords as W
from stepcorpus.plans import views as V
from stepcorpus.plans.token_queries import _subword_ids, subword_ranks


@pytest.fixture(scope="module")
def ranks():
    return subword_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def test_words(ranks, library):
    rng = random.Random(4)
    words = ["", "a", "aaaaaaaaaaa", "the", " the", "\n\n", "naïve", "数学", "😀😀", "<|image_pad|>", "é", "x" * 300, "abababab" * 20]
    words += ["".join(rng.choice("aehnrst ioué数<|\n") for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    for w in words:
        assert W.merged(w.encode(), ranks) == library.encode_ordinary(w), w


def test_samples(spark, ranks, library):
    d = "/root/testdata/sf0.001"
    special = W.special_pieces(ranks)
    assert sorted(i for [i] in special.values()) == list(range(max(ranks.values()) + 1, max(ranks.values()) + 1 + len(S.SPECIAL_TOKENS)))
    want = {r.sample_id: [i for t in r.toks for i in (special.get(t) or library.encode_ordinary(t))] for r in V.token_arrays(spark, d).collect()}
    assert {r.sample_id: r.ids for r in _subword_ids(spark, d)[1].collect()} == want


def test_edges(spark, ranks):
    rows = [(0, []), (1, None), (2, ["a\u0000b", "é"]), (3, [S.IMAGE_PAD] * 3 + ["数学"])]
    df = spark.createDataFrame(rows, "k long, toks array<string>")
    types = W.subword_types(df, "toks", ranks)
    ids = W.encode_subwords(df, "toks", types, ranks, "k", "ids")
    back = {r.k: (r.ids, r.text) for r in W.decode_subwords(ids, "ids", ranks, "k").collect()}
    assert back[0] == ([], "") and back[1] == ([], "") and back[2][1] == "a\u0000bé" and back[3][1] == S.IMAGE_PAD * 3 + "数学"
    assert len(back[3][0]) > 3


def test_a_vocabulary_without_all_bytes(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no rank"):
        W.read_ranks(str(tmp_path / "few"))
