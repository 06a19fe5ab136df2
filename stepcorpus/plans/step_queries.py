"""Queries for T9-T11: reasoning steps in the stage-3 instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepcorpus.operators import prompts as P
from stepcorpus.operators.steps import explode_steps
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import STEP_RE, TOKEN_RE, sql_text, with_views
from stepcorpus.plans.registry import query


_STEPS = f"""
steps as (
  select conv_id, instruction, unnest(range(len(hs))) as step_no, unnest(hs) as header, unnest(cs) as content
  from (select conv_id, instruction, regexp_extract_all(instruction, {STEP_RE}, 1) as hs,
               regexp_extract_all(instruction, {STEP_RE}, 0) as cs from instr)),
located as (
  select conv_id, instruction, step_no, header, cast(instr(instruction, header) - 1 as integer) as char_start,
    case when contains(content, '<pos>') then 1 when contains(content, '<neg>') then 0 else 1 end as label
  from steps)"""


def _steps(spark, d):
    return explode_steps(V.instr(spark, d), keep=("conv_id",))


@query("t9_locate_steps", with_views(["instr"], f"""
, {_STEPS.strip()}
select conv_id, cast(step_no as integer) as step_no, header, char_start, label from located"""))
def t9(spark, d):
    """One row per reasoning step: header, first position of the header, label."""
    return _steps(spark, d).select("conv_id", "step_no", "header", "char_start", "label")


@query("t10_step_labels", with_views(["instr"], f"""
, {_STEPS.strip()}
select cast(step_no as integer) as step_no, count(*) as n_steps, count(*) filter (where label = 1) as n_correct,
  count(*) filter (where label = 0) as n_incorrect
from located group by step_no"""))
def t10(spark, d):
    """Step verdicts (<pos> -> 1, <neg> -> 0, none -> 1) counted by step number."""
    return (_steps(spark, d).groupBy("step_no")
            .agg(F.count(F.lit(1)).alias("n_steps"), F.count(F.when(F.col("label") == 1, 1)).alias("n_correct"),
                 F.count(F.when(F.col("label") == 0, 1)).alias("n_incorrect")))


@query("t11_step_token_index", with_views(["instr"], f"""
, {_STEPS.strip()}
select conv_id, cast(step_no as integer) as step_no,
  cast(len(regexp_extract_all(substr(instruction, 1, char_start), {TOKEN_RE}, 0)) as integer) as token_idx,
  cast(len(regexp_extract_all({sql_text(P.stage3_prompt_prefix())} || substr(instruction, 1, char_start), {TOKEN_RE}, 0))
       as integer) as token_idx_templated
from located"""))
def t11(spark, d):
    """Token position of each step in the raw instruction and in the rendered prompt."""
    return _steps(spark, d).select("conv_id", "step_no", "token_idx", "token_idx_templated")
