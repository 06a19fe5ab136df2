"""Patched frame-of-reference token files: block and file round trips, and the query against the library itself."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepcorpus.llm import pfor

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \t\n", "Hello world's END... it'll 3.14 ½ x²", "Éà ÇA Straße ÀÉÎ", "İstanbul ΣΑΣ σας é  x y",
         "a<|endoftext|>b <|ENDOFTEXT|> <|x", "中文字符 и русский 😀😀", "\x00\x1c\x85 a­b", "we're ''s 's't", "x" * 5000, "word " * 3000]


def brute(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), min_size=1, max_size=400), st.sampled_from([0, 50, 90, 100]))
def test_block_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    assert (pfor.decode_block(pfor.encode_block(ids, percentile)) == ids).all()


def test_file_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(int(k), rng.integers(0, 49408, int(n)).astype(np.uint32)) for k, n in enumerate([0, 1, 5000, 64, 0, 333, 100])]
    assert pfor.write_shard(f"{tmp_path}/x/a.pfor", iter(docs), block=128) == (7, 5498)
    got = list(pfor.read_shard(f"{tmp_path}/x/a.pfor"))
    assert [k for k, _, _ in got] == list(range(7))
    assert all((a == b).all() for (_, a), (_, _, b) in zip(docs, got))


def test_encoder_equals_library():
    from tokenizers import Tokenizer
    t, e = Tokenizer.from_file(PATH), pfor.encoder(PATH)
    for text in TEXTS[1:]:
        assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2500, exclude_categories=["Cs"]), max_size=40))
def test_encoder_equals_library_on_any_text(text):
    from tokenizers import Tokenizer
    if "t" not in _T:
        _T["t"] = Tokenizer.from_file(PATH)
    e = pfor.encoder(PATH)
    assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == _T["t"].encode(text, add_special_tokens=False).ids


_T: dict = {}


def test_query_rows(spark):
    rows = [(i * 7 % 12, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (100, "b a"), (101, None)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string").repartition(5)
    got = [tuple(r) for r in pfor.token_files(docs, PATH, 2).orderBy(pfor.F.col("start"), "n_tokens").collect()]
    assert got == brute(rows)


def test_ties_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (0, "d")], "doc_id int, text string")
    got = sorted(tuple(r) for r in pfor.token_files(docs, PATH, 2).collect())
    assert [r[0] for r in got] == [0, 1, 1, 1] and sorted(r[1] for r in got)[0] == 0
    assert sum(r[2] for r in got) == max(r[1] + r[2] for r in got)
    assert pfor.token_files(docs.limit(0), PATH, 2).collect() == []


def test_tables_whole(spark):
    from stepcorpus.sources.tables import table
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(r) for r in pfor.token_files(docs, PATH, 2).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_unfinished_file_is_refused(tmp_path):
    (tmp_path / "a").write_bytes(b"PFOR" + bytes(40))
    with pytest.raises(ValueError):
        list(pfor.read_shard(f"{tmp_path}/a"))


def test_other_tokenizer_files_equal_the_library(tmp_path):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers
    cased, digits, cut = (Tokenizer.from_file(PATH) for _ in range(3))
    cased.normalizer = normalizers.NFC()
    digits.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    paths = [public_tokenizers.path("byte_bpe_50k.json")]
    for name, t in (("cased", cased), ("digits", digits)):
        t.save(f"{tmp_path}/{name}.json")
        paths.append(f"{tmp_path}/{name}.json")
    for path in paths:
        t, e = Tokenizer.from_file(path), pfor.Encoder(path)
        assert not e.follows
        for text in TEXTS[1:]:
            assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, (path, text)
    cut.enable_truncation(3)
    cut.save(f"{tmp_path}/cut.json")
    e = pfor.Encoder(f"{tmp_path}/cut.json")
    assert e.follows and pfor.encoder(PATH).follows
    assert e.encode(TEXTS[-1].encode()) == pfor.encoder(PATH).encode(TEXTS[-1].encode())


def test_new_runs_of_some_texts_are_merged_in_one_call_and_the_cache_is_bounded(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(pfor, "CACHE", 50)
    t, e = Tokenizer.from_file(PATH), pfor.Encoder(PATH)
    calls, words = [], e.words
    monkeypatch.setattr(e, "words", lambda w: calls.append(len(w)) or words(w))
    texts = [" ".join(f"run{i % 7}x,{'éa' * (i % 3)} it's {i}... <|x {'ab' * (i % 40)}" for i in range(lo, lo + 60)) for lo in range(0, 600, 60)]
    for part in (texts[:4], texts[4:], texts[:4], ["", " "], [t for t in TEXTS if t]):
        calls.clear()
        got = [np.frombuffer(x, e.dtype).tolist() for x in e.encode_all([x.encode() for x in part])]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in part]
        assert len(calls) <= 1 and len(e.runs) <= 50 and len(e.older) <= 50


def test_a_column_is_cut_into_runs_at_once_and_each_distinct_run_looked_up_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer
    t, e = Tokenizer.from_file(PATH), pfor.Encoder(PATH)
    asked, ids_of = [], e.ids_of
    monkeypatch.setattr(e, "ids_of", lambda runs: asked.append(list(runs)) or ids_of(runs))
    texts = [*TEXTS, "  Edge\x0bof\x0c it\x1call ", None, "", "b", "A<|endoftext|>a", *TEXTS]
    whole = pa.array([x and x.encode() for x in texts], pa.binary())
    for column in (whole, whole.cast(pa.large_binary()), whole.slice(3, 9), whole.slice(0, 0)):
        asked.clear()
        got = [np.frombuffer(x, e.dtype).tolist() for x in e.encode_column(column, np.array([2], e.dtype).tobytes()).to_pylist()]
        assert got == [t.encode((x or b"").decode(), add_special_tokens=False).ids + [2] for x in column.to_pylist()]
        assert all(len(runs) == len(set(runs)) for runs in asked) and len(asked) <= 1
    assert e.encode_all([]) == []
