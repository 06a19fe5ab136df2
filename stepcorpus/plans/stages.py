"""End-to-end sample preparation for the three training stages.

Each stage is a chain of narrow, per-row steps (pair selection, prompt
rendering, image tags, tokenizing, spans, labels) plus at most:

* one join against the image manifest (existence check: F3 / F6),
* the vocabulary build and encode (T1), and
* batching (B2-B4) when asked for.

Bad rows are never dropped: an ``error_reason`` is computed up front and the
row is replaced by the stage's fallback sample (F6), as the scripts do.
Token work happens on token strings; ids come last from one encode pass, so
the fallback decision, spans and masks need no vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.operators import prompts as P
from stepcorpus.operators import tokens as K
from stepcorpus.operators.steps import with_steps
from stepcorpus.operators.validity import image_readable


def _lit_tokens(text: str) -> Column:
    return T.tokenize(F.lit(text))


def _image_check(df: DataFrame, path: Column, manifest: DataFrame | None) -> DataFrame:
    """Add ``image_path`` and ``image_error``: null, ``image_missing`` or, where
    the manifest (one row per file) has a ``status``, ``image_invalid``."""
    df = df.withColumn("image_path", path)
    if manifest is None:
        return df.withColumn("image_error", F.lit(None).cast("string"))
    m = manifest.select(F.col("path").alias("_mpath"), image_readable(manifest).alias("_readable"))
    error = F.when(F.col("_readable").isNull(), F.lit("image_missing")).when(~F.col("_readable"), F.lit("image_invalid"))
    return (df.join(m, F.col("image_path") == F.col("_mpath"), "left")
            .withColumn("image_error", error).drop("_mpath", "_readable"))


def prefix_labels(tokens: Column, n_prompt: Column, pad: Column) -> Column:
    """T4 on an already concatenated sequence: pad the first n_prompt slots."""
    return F.concat(F.array_repeat(pad, n_prompt),
                    F.slice(tokens, n_prompt + 1, F.greatest(F.size(tokens) - n_prompt, F.lit(0))))


# -------------------------------------------------------------------- stage 1

def stage1_tokens(conv: DataFrame, image_root: str = "", manifest: DataFrame | None = None,
                  n_pads: int = S.IMAGE_PAD_NUM) -> DataFrame:
    """Stage 1 on ``conv_id, image, conversations``: positional pair, prompt
    with generation prompt, tags expanded in the question only, answer + EOS.
    Output ``tokens`` (unshifted q + a) and ``n_prompt``."""
    df = conv.transform(P.positional_pair)
    df = _image_check(df, T.join_path_lit(image_root, F.col("image")), manifest)
    err = F.coalesce(F.when(F.col("image").isNull(), F.lit("no_image")), F.col("pair_error"), F.col("image_error"))
    q_text = T.expand_image_tag(T.render_chat([("system", S.SYSTEM_STAGE1), ("user", F.col("question"))], True), n_pads)
    a_text = T.append_eos(F.col("answer"))
    fb_q = _lit_tokens((f"{S.IM_START}system\n{S.SYSTEM_STAGE1}{S.IM_END}\n{S.IM_START}user\n"
                        f"{S.FALLBACK_STAGE1_USER}{S.IM_END}\n{S.IM_START}assistant\n")
                       .replace(S.IMAGE_TAG, S.IMAGE_PAD * n_pads))
    fb_a = _lit_tokens(S.FALLBACK_STAGE1_ANSWER + S.EOS_TOKEN)
    ok = err.isNull()
    q_tok = F.when(ok, T.tokenize(q_text)).otherwise(fb_q)
    a_tok = F.when(ok, T.tokenize(a_text)).otherwise(fb_a)
    return df.select("conv_id", err.alias("error_reason"), (~ok).alias("is_fallback"),
                     K.concat_qa(q_tok, a_tok).alias("tokens"), F.size(q_tok).alias("n_prompt"))


def stage1_labels(df: DataFrame, tokens: str, pad: Column) -> DataFrame:
    """T4 + T8: prefix-masked labels, then the one-position shift."""
    labels = prefix_labels(F.col(tokens), F.col("n_prompt"), pad)
    ids, lab = K.shift_pair(F.col(tokens), labels)
    return df.withColumns({"input": ids, "labels": lab})


# -------------------------------------------------------------------- stage 2

def stage2_tokens(conv: DataFrame, image_root: str = "", manifest: DataFrame | None = None,
                  n_pads: int = S.IMAGE_PAD_NUM) -> DataFrame:
    """Stage 2: role pair, full dialogue without generation prompt, tags
    expanded everywhere, assistant spans.  Output ``tokens``, ``spans`` and,
    for fallback rows, ``n_prompt``."""
    df = conv.transform(P.role_pair)
    df = _image_check(df, T.join_path_lit(image_root, F.col("image")), manifest)
    text = T.expand_image_tag(T.render_chat([("system", S.SYSTEM_STAGE2), ("user", F.col("question")),
                                             ("assistant", F.col("answer"))], False), n_pads)
    # Tokens first, as their own column: the span lambdas then read the
    # column instead of re-running the tokenizer per element.
    df = df.withColumn("_toks", T.tokenize(text))
    spans, unclosed = K.assistant_spans(F.col("_toks"), F.lit(S.ROLE_ASSISTANT), F.lit(S.IM_END))
    df = df.withColumns({"_spans": spans, "_unclosed": unclosed})
    err = F.coalesce(F.when(F.col("image").isNull(), F.lit("no_image")), F.col("pair_error"),
                     F.when(F.col("_unclosed"), F.lit("unclosed_span")), F.col("image_error"))
    fb_q = _lit_tokens((f"{S.IM_START}system\n{S.SYSTEM_STAGE2}{S.IM_END}\n{S.IM_START}user\n"
                        f"{S.FALLBACK_STAGE2_USER}{S.IM_END}\n").replace(S.IMAGE_TAG, S.IMAGE_PAD * n_pads))
    fb_a = _lit_tokens(S.FALLBACK_STAGE2_ANSWER + S.EOS_TOKEN)
    ok = err.isNull()
    return df.select(
        "conv_id", err.alias("error_reason"), (~ok).alias("is_fallback"),
        F.when(ok, F.col("_toks")).otherwise(K.concat_qa(fb_q, fb_a)).alias("tokens"),
        F.when(ok, F.col("_spans")).alias("spans"),
        F.when(ok, F.lit(None).cast("int")).otherwise(F.size(fb_q)).alias("n_prompt"))


def stage2_labels(df: DataFrame, tokens: str, pad: Column) -> DataFrame:
    """T6 (or T4 for fallback rows) + T8."""
    labels = F.when(F.col("spans").isNotNull(), K.span_mask_labels(F.col(tokens), F.col("spans"), pad)) \
        .otherwise(prefix_labels(F.col(tokens), F.col("n_prompt"), pad))
    ids, lab = K.shift_pair(F.col(tokens), labels)
    return df.withColumns({"input": ids, "labels": lab})


# -------------------------------------------------------------------- stage 3

def stage3_valid(records: DataFrame, manifest: DataFrame, base: str) -> DataFrame:
    """F2 + P3 + F3: records with a URL whose resolved image exists; where the
    manifest has a ``status``, with ``image_ok`` (an image that can't be read
    keeps its record, which becomes the stage-3 fallback)."""
    has_url = records.filter(F.coalesce(F.col("image_url"), F.lit("")) != F.lit(""))
    resolved = has_url.withColumn("full_image_path", P.resolve_image_path(F.col("image_url"), base))
    if "status" not in manifest.columns:
        return resolved.join(manifest.select(F.col("path").alias("full_image_path")), "full_image_path", "left_semi")
    return resolved.join(manifest.select(F.col("path").alias("full_image_path"), image_readable(manifest).alias("image_ok")), "full_image_path")


def stage3_tokens(valid: DataFrame, image_ok: Column | None = None, use_template: bool = True) -> DataFrame:
    """P8 + T1 + T7 + T9-T11 on valid records; an unreadable image (``image_ok``,
    by default the column of that name) or an instruction that can't be
    tokenized gives the stage-3 fallback (fixed text, no template, no steps).
    ``instruction_present``, if there, tells a missing key from a null."""
    if image_ok is None:
        image_ok = F.col("image_ok") if "image_ok" in valid.columns else F.lit(True)
    present = F.col("instruction_present") if "instruction_present" in valid.columns else None
    prompt = P.render_instruction(F.col("instruction"), use_template, present)
    ok = image_ok & prompt.isNotNull()
    toks = F.when(ok, T.tokenize(prompt)).otherwise(_lit_tokens(S.FALLBACK_STAGE3_TEXT))
    located = with_steps(valid, "instruction", "_steps")
    steps = F.when(ok, F.col("_steps")).otherwise(F.array())
    return located.select("conv_id", (~ok).alias("is_fallback"), toks.alias("tokens"), steps.alias("steps"))


# ------------------------------------------------------------------- encode

def encode_stage(df: DataFrame, vocab: DataFrame, key: str = "conv_id") -> DataFrame:
    """Token strings -> ids (one encode pass over ``tokens``)."""
    return K.encode(df, "tokens", vocab, key, out="ids")
