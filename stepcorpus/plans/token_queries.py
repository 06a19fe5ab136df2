"""Queries for T1-T8: tokenizer, vocabulary, encode/decode, labels, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.operators import subwords as W
from stepcorpus.operators import tokens as K
from stepcorpus.plans import stages as G
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import STAGE_IMAGE_ROOT, TOKEN_RE, q, vocab_sql, with_views
from stepcorpus.plans.registry import query
from stepcorpus.session import materialize
from stepcorpus.sources.tables import table


_DOC_TOKENS = f"select unnest(regexp_extract_all(text, {TOKEN_RE}, 0)) as token from documents"


@query("t1_build_vocab", with_views([], "select * from vocab", [("vocab", vocab_sql(_DOC_TOKENS))]))
def t1_vocab(spark, d):
    """Vocabulary of the documents: specials first, then by falling count."""
    docs = table(spark, d, "documents").select(T.tokenize(F.col("text")).alias("tokens"))
    return K.build_vocab(docs, "tokens")


@query("t1_encode", with_views(["tokens"], """
select t.sample_id, t.pos, v.token_id from tokens t join vocab v on v.token = t.tok""",
                               [("vocab", vocab_sql("select tok as token from tokens"))]))
def t1_encode(spark, d):
    """Token strings of the chat samples -> ids, in order (long form)."""
    arr = materialize(V.token_arrays(spark, d))
    vocab = K.build_vocab(arr, "toks")
    enc = K.encode(arr, "toks", vocab, "sample_id", "ids")
    return (explode_rows(enc, "ids", ["sample_id"], "pos", "token_id")
            .select("sample_id", F.col("pos").cast("bigint").alias("pos"), "token_id"))


@query("t2_decode", "select doc_id, text as text_out, cast(len(regexp_extract_all(text, "
       f"{TOKEN_RE}, 0)) as bigint) as n_tokens from documents")
def t2_decode(spark, d):
    """documents -> tokens -> ids -> text again; equal to the input (lossless)."""
    docs = materialize(table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens")))
    vocab = K.build_vocab(docs, "tokens")
    # Only the ids are kept: the token strings are neither joined back nor written again.
    enc = materialize(K.encode(docs, "tokens", vocab, "doc_id", "ids")
                      .select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens")))
    dec = K.decode(enc, "ids", vocab, "doc_id", "text_out")
    return dec.select("doc_id", "text_out", "n_tokens")


def _stage1(spark, d):
    return G.stage1_tokens(V.conv_nested(spark, d), STAGE_IMAGE_ROOT, V.manifest(spark, d))


@query("t3_concat_qa", with_views(["stage1_tokens"], """
select conv_id, unnest(range(len(tokens))) as pos, unnest(tokens) as tok from stage1_tokens"""))
def t3(spark, d):
    """Stage-1 ``q + a`` token sequence (fallback rows hold the fallback sample)."""
    s = _stage1(spark, d)
    return (explode_rows(s, "tokens", ["conv_id"], "pos", "tok")
            .select("conv_id", F.col("pos").cast("bigint").alias("pos"), "tok"))


@query("t4_prefix_mask_labels", with_views(["stage1_tokens"], f"""
select conv_id, unnest(range(len(tokens))) as pos,
  unnest(list_transform(range(len(tokens)), lambda i: case when i < n_prompt then {q(S.PAD_TOKEN)} else tokens[i + 1] end))
    as label_tok
from stage1_tokens"""))
def t4(spark, d):
    """Stage-1 labels: pad over the prompt, the answer after it."""
    s = _stage1(spark, d)
    lab = G.prefix_labels(F.col("tokens"), F.col("n_prompt"), F.lit(S.PAD_TOKEN))
    return (explode_rows(s, lab, ["conv_id"], "pos", "label_tok")
            .select("conv_id", F.col("pos").cast("bigint").alias("pos"), "label_tok"))


@query("t8_shift_pair", with_views(["stage1_tokens"], f"""
select conv_id, unnest(range(len(tokens) - 1)) as pos,
  unnest(list_slice(tokens, 1, len(tokens) - 1)) as input_tok,
  unnest(list_transform(range(1, len(tokens)), lambda i: case when i < n_prompt then {q(S.PAD_TOKEN)} else tokens[i + 1] end))
    as label_tok
from stage1_tokens"""))
def t8(spark, d):
    """Stage-1 pairs after the shift: ids[:-1] against labels[1:]."""
    s = G.stage1_labels(_stage1(spark, d), "tokens", F.lit(S.PAD_TOKEN))
    z = F.arrays_zip(F.col("input").alias("i"), F.col("labels").alias("l"))
    return (explode_rows(s, z, ["conv_id"], "pos", "z")
            .select("conv_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("z.i").alias("input_tok"), F.col("z.l").alias("label_tok")))


_SEGMENTS = f"""
seg as (select sample_id, pos, tok, coalesce(sum(case when tok = {q(S.IM_END)} then 1 else 0 end)
          over (partition by sample_id order by pos rows between unbounded preceding and 1 preceding), 0) as seg
        from tokens),
grp as (select sample_id, seg, min(pos) filter (where tok = {q(S.ROLE_ASSISTANT)}) as a,
          max(pos) filter (where tok = {q(S.IM_END)}) as e from seg group by sample_id, seg)"""


@query("t5_assistant_spans", with_views(["tokens"], f"""
, {_SEGMENTS.strip()}
select sample_id, a + 1 as span_start, e + 1 as span_end from grp where a is not null and e is not null"""))
def t5(spark, d):
    """Half-open assistant spans per chat sample."""
    arr = V.token_arrays(spark, d)
    spans, _ = K.assistant_spans(F.col("toks"), F.lit(S.ROLE_ASSISTANT), F.lit(S.IM_END))
    return (explode_rows(arr, spans, ["sample_id"], value="s")
            .select("sample_id", F.col("s.start").cast("bigint").alias("span_start"),
                    F.col("s.end").cast("bigint").alias("span_end")))


@query("t6_span_mask_labels", with_views(["tokens"], f"""
, {_SEGMENTS.strip()}
select s.sample_id, s.pos,
  case when g.a is not null and g.e is not null and s.pos > g.a then s.tok else {q(S.PAD_TOKEN)} end as label_tok
from seg s join grp g using (sample_id, seg)"""))
def t6(spark, d):
    """Labels: the token inside assistant spans, pad elsewhere."""
    arr = V.token_arrays(spark, d)
    spans, _ = K.assistant_spans(F.col("toks"), F.lit(S.ROLE_ASSISTANT), F.lit(S.IM_END))
    lab = K.span_mask_labels(F.col("toks"), spans, F.lit(S.PAD_TOKEN))
    return (explode_rows(arr, lab, ["sample_id"], "pos", "label_tok")
            .select("sample_id", F.col("pos").cast("bigint").alias("pos"), "label_tok"))


def subword_ranks():
    """The public byte-level vocabulary of the sub-word queries."""
    import public_tokenizers
    return W.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _subword_ids(spark, d):
    ranks = subword_ranks()
    arr = materialize(V.token_arrays(spark, d), "token-arrays")
    types = W.subword_types(arr, "toks", ranks)
    return ranks, W.encode_subwords(arr, "toks", types, ranks, "sample_id", "ids")


@query("t1_subword_round_trip", with_views(["token_arrays"], f"""
select sample_id, array_to_string(toks, '') as text, len(list_filter(toks, lambda t: t = {q(S.IMAGE_PAD)})) as n_pads from token_arrays"""))
def t1_subwords(spark, d):
    """Samples as sub-word ids of a public vocabulary, and back: the text byte for byte, the pads one id each."""
    ranks, enc = _subword_ids(spark, d)
    ids = materialize(enc.select("sample_id", "ids"), "subword-ids")
    pad = W.special_pieces(ranks)[S.IMAGE_PAD][0]
    out = W.decode_subwords(ids, "ids", ranks, "sample_id")
    return out.select("sample_id", "text", F.size(F.filter("ids", lambda i: i == F.lit(pad))).cast("bigint").alias("n_pads"))
