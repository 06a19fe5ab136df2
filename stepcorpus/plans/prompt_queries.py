"""Queries for P1-P9 over the stage views."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.operators import prompts as P
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import q, resolve_sql, sql_text, with_views
from stepcorpus.plans.registry import query, sql_join


_PAIR_ERR_SQL = ("case when len(conversations) < 2 then 'too_few_turns' "
                 "when {q} is null or {a} is null then 'null_text' else 'ok' end")


@query("p1_positional_pair", with_views(["conv_nested"], f"""
select conv_id, conversations[1]['value'] as question, conversations[2]['value'] as answer,
  {_PAIR_ERR_SQL.format(q="conversations[1]['value']", a="conversations[2]['value']")} as pair_error
from conv_nested"""))
def p1(spark, d):
    """Question = turn 0, answer = turn 1, roles ignored."""
    return (V.conv_nested(spark, d).transform(P.positional_pair)
            .select("conv_id", "question", "answer", F.coalesce("pair_error", F.lit("ok")).alias("pair_error")))


_HUMAN = "list_filter(conversations, lambda x: x['from'] = 'human')[1]"
_BOT = "list_filter(conversations, lambda x: x['from'] in ('gpt', 'assistant'))[1]"


@query("p2_role_pair", with_views(["conv_nested"], f"""
select conv_id, {_HUMAN}['value'] as question, {_BOT}['value'] as answer,
  case when {_HUMAN} is null then 'no_human_turn' when {_BOT} is null then 'no_assistant_turn'
       when {_HUMAN}['value'] is null or {_BOT}['value'] is null then 'null_text' else 'ok' end as pair_error
from conv_nested"""))
def p2(spark, d):
    """First human turn and first gpt/assistant turn, in any order."""
    return (V.conv_nested(spark, d).transform(P.role_pair)
            .select("conv_id", "question", "answer", F.coalesce("pair_error", F.lit("ok")).alias("pair_error")))


@query("p3_resolve_image_path", with_views(["step_records"], f"""
select conv_id, image_url, {resolve_sql('image_url', V.IMAGE_BASE)} as full_image_path from step_records"""))
def p3(spark, d):
    """Stage-3 image URL -> path in the image store."""
    r = V.step_records(spark, d)
    return r.select("conv_id", "image_url",
                    P.resolve_image_path(F.col("image_url"), V.IMAGE_BASE).alias("full_image_path"))


P4_ROOT = "ROOT/images/"


@query("p4_join_path", with_views(["conv_nested", "step_records"], f"""
select c.conv_id, {sql_join(q(P4_ROOT), 'c.image')} as image_path,
  {sql_join('c.image', "substr(r.image_url, 11)")} as nested_path
from conv_nested c join step_records r using (conv_id)"""))
def p4(spark, d):
    """os.path.join of an image root and the record's image, and of the image
    with the tail of the stage-3 URL (which may be absolute)."""
    c = V.conv_nested(spark, d)
    r = V.step_records(spark, d)
    return (c.join(r, "conv_id")
            .select("conv_id", P.join_path(F.lit(P4_ROOT), F.col("image")).alias("image_path"),
                    P.join_path(F.col("image"), F.substring("image_url", 11, 1 << 30)).alias("nested_path")))


def _stage1_prompt_sql(user: str) -> str:
    return (f"{sql_text(f'{S.IM_START}system{chr(10)}{S.SYSTEM_STAGE1}{S.IM_END}{chr(10)}{S.IM_START}user{chr(10)}')}"
            f" || {user} || {sql_text(f'{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}')}")


def _stage2_text_sql(user: str, bot: str) -> str:
    return (f"{sql_text(f'{S.IM_START}system{chr(10)}{S.SYSTEM_STAGE2}{S.IM_END}{chr(10)}{S.IM_START}user{chr(10)}')}"
            f" || {user} || {sql_text(f'{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}')} || {bot}"
            f" || {sql_text(S.IM_END + chr(10))}")


@query("p5_render_chat", with_views(["conv_nested"], f"""
select conv_id, {_stage1_prompt_sql("conversations[1]['value']")} as prompt_stage1,
  {_stage2_text_sql(_HUMAN + "['value']", _BOT + "['value']")} as text_stage2
from conv_nested"""))
def p5(spark, d):
    """ChatML: stage-1 prompt with generation prompt, stage-2 full dialogue without."""
    c = V.conv_nested(spark, d).transform(P.positional_pair)
    s1 = P.render_chat([("system", S.SYSTEM_STAGE1), ("user", F.col("question"))], True)
    c = c.withColumn("prompt_stage1", s1).drop("question", "answer", "pair_error").transform(P.role_pair)
    s2 = P.render_chat([("system", S.SYSTEM_STAGE2), ("user", F.col("question")),
                        ("assistant", F.col("answer"))], False)
    return c.select("conv_id", "prompt_stage1", s2.alias("text_stage2"))


@query("p6_expand_image_tag", with_views(["conv_nested"], f"""
select conv_id,
  replace({_stage2_text_sql(_HUMAN + "['value']", _BOT + "['value']")}, '<image>', repeat('<|image_pad|>', {S.IMAGE_PAD_NUM}))
    as text_expanded,
  replace(conversations[1]['value'], '<image>', repeat('<|image_pad|>', {S.IMAGE_PAD_NUM_DEMO})) as question_demo
from conv_nested"""))
def p6(spark, d):
    """Every <image> -> 243 pads (stage 2 text) and 49 pads (demo)."""
    c = V.conv_nested(spark, d).transform(P.role_pair)
    s2 = P.render_chat([("system", S.SYSTEM_STAGE2), ("user", F.col("question")),
                        ("assistant", F.col("answer"))], False)
    first = F.get(F.col("conversations"), 0)["value"]
    return c.select("conv_id", P.expand_image_tag(s2).alias("text_expanded"),
                    P.expand_image_tag(first, S.IMAGE_PAD_NUM_DEMO).alias("question_demo"))


@query("p7_append_eos", with_views(["conv_nested"], f"""
select conv_id, conversations[2]['value'] || {q(S.EOS_TOKEN)} as answer_eos from conv_nested"""))
def p7(spark, d):
    """Answer text + EOS."""
    c = V.conv_nested(spark, d).transform(P.positional_pair)
    return c.select("conv_id", P.append_eos(F.col("answer")).alias("answer_eos"))


_P8_PREFIX = P.stage3_prompt_prefix()


@query("p8_render_instruction", with_views(["step_records_full"], f"""
select conv_id,
  {sql_text(_P8_PREFIX)} || coalesce(instruction, 'None') || {sql_text(f'{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}')}
    as prompt,
  instruction as prompt_untemplated
from step_records_full"""))
def p8(spark, d):
    """Stage-3 prompt, with and without a chat template."""
    r = V.step_records_full(spark, d)
    return r.select("conv_id", P.render_instruction(F.col("instruction")).alias("prompt"),
                    P.render_instruction(F.col("instruction"), use_template=False).alias("prompt_untemplated"))


@query("p9_check_pad_count", with_views(["token_arrays", "patches"], """
select t.sample_id, cast(len(list_filter(t.toks, lambda x: x = '<|image_pad|>')) as bigint) as n_pads,
  coalesce(p.n, 0) as n_features,
  cast(len(list_filter(t.toks, lambda x: x = '<|image_pad|>')) = coalesce(p.n, 0) as integer) as ok
from token_arrays t left join (select image_id, count(*) as n from patches group by image_id) p
  on t.sample_id = p.image_id"""))
def p9(spark, d):
    """Image-pad positions per sample against the feature rows of its image."""
    t = V.token_arrays(spark, d)
    feats = V.patches(spark, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    j = t.join(feats, t["sample_id"] == feats["image_id"], "left")
    n_feat = F.coalesce(F.col("n"), F.lit(0))
    n, ok = P.check_pad_count(F.col("toks"), F.lit(S.IMAGE_PAD), n_feat)
    return j.select("sample_id", n.cast("bigint").alias("n_pads"), n_feat.alias("n_features"),
                    ok.cast("int").alias("ok"))
