"""Locate reasoning steps, label them, and index them in tokens.

The step pattern is matched with ``regexp_extract_all`` (Java regex with
DOTALL and Unicode classes, like Python's ``re``), so the whole operator is
built-in expressions over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.operators.prompts import stage3_prompt_prefix


def step_label(content: Column) -> Column:
    """``<pos>`` anywhere in the step -> 1, else ``<neg>`` -> 0, else 1."""
    return (F.when(content.contains(S.STEP_POS), F.lit(1))
            .when(content.contains(S.STEP_NEG), F.lit(0))
            .otherwise(F.lit(1)))


def step_token_index(instruction: Column, char_start: Column) -> Column:
    """Number of tokens in the instruction text before the step."""
    return T.token_count(instruction.substr(F.lit(1), char_start))


def step_token_index_templated(instruction: Column, char_start: Column) -> Column:
    """T11 variant: the same position counted in the rendered stage-3 prompt,
    which is where the hidden states are actually gathered."""
    return T.token_count(F.concat(F.lit(stage3_prompt_prefix()), instruction.substr(F.lit(1), char_start)))


def locate_steps(instruction: Column) -> Column:
    """T9 + T10 + T11 in nested form as a single expression (tokenizes the
    text before every step, like the reference).  Prefer ``with_steps``, which
    gives the same array with one pass per record."""
    pattern = F.lit(S.STEP_PATTERN_JAVA)
    text = F.coalesce(instruction, F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("h"),
                         F.regexp_extract_all(text, pattern, 0).alias("c"))

    def one(z: Column, i: Column) -> Column:
        cs = F.instr(text, z["h"]) - 1
        return F.struct(
            i.alias("step_no"), z["h"].alias("header"), cs.alias("char_start"),
            step_token_index(text, cs).alias("token_idx"),
            step_token_index_templated(text, cs).alias("token_idx_templated"),
            step_label(z["c"]).alias("label"))

    return F.transform(found, one)


_WORDISH = r"^[\p{L}\p{N}]$"
_WORDISH_OR_SPACE = r"^[ \p{L}\p{N}]$"


def with_steps(df: DataFrame, instruction: str = "instruction", out: str = "steps") -> DataFrame:
    """T9 + T10 + T11 in nested form, linear in the record length:
    ``array<struct<step_no, header, char_start, token_idx,
    token_idx_templated, label>>`` in column ``out``.

    The tokens before a step are the tokens of the whole instruction that
    start before it.  So the text is cut at the distinct step starts, each
    piece is tokenized once, and running sums give every start its index;
    where a word (or a space + word) runs across a cut, the piece after the
    cut counts it again, which is subtracted.  The prompt prefix ends with a
    newline, which never joins the next token, so the templated index is the
    prefix's token count plus the raw one.

    The lookup arrays are referenced twice in the final projection so that
    Catalyst keeps them as computed columns instead of inlining them into
    the per-step lambda (which would re-tokenize per step).
    """
    pattern = F.lit(S.STEP_PATTERN_JAVA)
    text = F.coalesce(F.col(instruction), F.lit(""))
    d = df.withColumn("_st_found", F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("h"),
                                                 F.regexp_extract_all(text, pattern, 0).alias("c")))
    d = d.withColumn("_st_cs", F.transform("_st_found", lambda z: F.instr(text, z["h"]) - 1))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.col("_st_cs"))))
    d = d.withColumn("_st_bounds", bounds)
    m = F.size("_st_bounds")
    segs = F.arrays_zip(F.slice("_st_bounds", 1, m - 1).alias("lo"), F.slice("_st_bounds", 2, m - 1).alias("hi"))

    def piece(z: Column) -> Column:
        cnt = T.token_count(text.substr(z["lo"] + 1, z["hi"] - z["lo"]))
        straddle = ((z["lo"] > 0) & text.substr(z["lo"], F.lit(1)).rlike(_WORDISH_OR_SPACE)
                    & text.substr(z["lo"] + 1, F.lit(1)).rlike(_WORDISH))
        return cnt - straddle.cast("int")

    start = F.struct(F.lit(0).alias("run"), F.array(F.lit(0)).alias("idx"))
    running = F.aggregate(F.transform(segs, piece), start, lambda acc, c: F.struct(
        (acc["run"] + c).alias("run"), F.concat(acc["idx"], F.array(acc["run"] + c)).alias("idx")))
    d = d.withColumn("_st_idx", running["idx"])
    n_prefix = T.token_count(F.lit(stage3_prompt_prefix()))

    def one(z: Column, i: Column) -> Column:
        k = F.get(F.col("_st_idx"), F.array_position(F.col("_st_bounds"), z["cs"]).cast("int") - 1)
        return F.struct(i.alias("step_no"), z["f"]["h"].alias("header"), z["cs"].alias("char_start"),
                        k.alias("token_idx"), (k + n_prefix).alias("token_idx_templated"),
                        step_label(z["f"]["c"]).alias("label"))

    steps = F.transform(F.arrays_zip(F.col("_st_found").alias("f"), F.col("_st_cs").alias("cs")), one)
    guard = (F.size("_st_idx") >= 0) & (F.size("_st_bounds") >= 0)
    return d.withColumn(out, F.when(guard, steps)).drop("_st_found", "_st_cs", "_st_bounds", "_st_idx")


def explode_steps(df: DataFrame, instruction: str = "instruction", keep: tuple[str, ...] = ()) -> DataFrame:
    """T9 in long form: one row per located step."""
    d = with_steps(df.select(*keep, instruction), instruction, "_steps")
    return explode_rows(d, "_steps", list(keep), value="s").select(*keep, "s.*")
