"""Input shapes of the three stages, derived from the given tables.

The conversation, step and image records the training scripts read are
built from ``conversations``, ``embeddings``, ``labels`` and ``events`` so
that every query's work grows with those tables.  Each view has a DuckDB
twin in ``oracle_views`` with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.sources.tables import table


IMAGE_BASE = "BASE"  # image store root used by the stage-3 views
PADS_PER_SAMPLE = S.IMAGE_PAD_NUM  # image pads per sample in the ``tokens`` view
PATCHES_PER_IMAGE = S.IMAGE_PAD_NUM  # embedding rows per image in the ``patches`` view; the last image is short


def conv_nested(spark: SparkSession, d: str) -> DataFrame:
    """Stage 1/2 records: ``conv_id, image, conversations array<struct<from, value>>``."""
    c = table(spark, d, "conversations")
    frm = (F.when(F.col("role") == "user", F.lit("human"))
           .when(F.col("role") == "assistant", F.lit("gpt")).otherwise(F.col("role")))
    val = F.when(F.col("role") == "user", F.concat(F.lit("<image>\n"), F.col("text"))).otherwise(F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", frm.alias("from"), val.alias("value"))))
    return (c.groupBy("conv_id").agg(turns.alias("_t"))
            .select("conv_id",
                    F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".png")).alias("image"),
                    F.transform("_t", lambda x: F.struct(x["from"].alias("from"),
                                                         x["value"].alias("value"))).alias("conversations")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """First user text ``q`` and first assistant text ``a`` per conversation."""
    c = table(spark, d, "conversations")

    def first(role: str):
        return F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]

    return c.groupBy("conv_id").agg(first("user").alias("q"), first("assistant").alias("a"))


def answered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``pairs`` with the stage-2 default turns where a conversation has no question or no answer."""
    bad = F.col("q").isNull() | F.col("a").isNull()
    return pairs(spark, d).select("conv_id", F.when(bad, F.lit(S.FALLBACK_STAGE2_USER)).otherwise(F.col("q")).alias("q"),
                                  F.when(bad, F.lit(S.FALLBACK_STAGE2_ANSWER)).otherwise(F.col("a")).alias("a"))


def instr(spark: SparkSession, d: str) -> DataFrame:
    """Stage-3 instructions: one ``Step k: … и <verdict>`` line per non-system turn."""
    c = table(spark, d, "conversations").filter(F.col("role") != "system")
    verdict = (F.when(F.col("turn") % 3 == 0, F.lit("<neg>"))
               .when(F.col("turn") % 3 == 1, F.lit("<pos>")).otherwise(F.lit("")))
    line = F.concat(F.lit("Step "), (F.col("turn") + 1).cast("string"), F.lit(": "), F.col("text"),
                    F.lit(" и "), verdict)
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("s"))))
    return (c.groupBy("conv_id").agg(lines.alias("_l"))
            .select("conv_id", F.concat_ws("\n", F.transform("_l", lambda x: x["s"])).alias("instruction")))


def step_records(spark: SparkSession, d: str) -> DataFrame:
    """Stage-3 records before validation: every image-URL form appears."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    cid = F.col("conv_id").cast("string")
    m = F.col("conv_id") % 5
    url = (F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit(""))
           .when(m == 2, F.concat(F.lit("MathV-360k/img/"), cid, F.lit(".png")))
           .when(m == 3, F.concat(F.lit("img/"), cid, F.lit(".png")))
           .otherwise(F.concat(F.lit("data_images/img/"), cid, F.lit(".png"))))
    return ids.select("conv_id", url.alias("image_url"))


def step_records_full(spark: SparkSession, d: str) -> DataFrame:
    """``step_records`` with the instruction text."""
    return step_records(spark, d).join(instr(spark, d), "conv_id", "left")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The image files that exist: those of about seven in eight conversations, by a hash of the id."""
    ids = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("c")).distinct()
    there = ~F.substring(F.md5(F.concat(F.lit("image:"), F.col("c"))), 1, 1).isin("0", "1")
    return ids.filter(there).select(F.concat(F.lit(f"{IMAGE_BASE}/data_images/img/"), F.col("c"), F.lit(".png")).alias("path"))


def chatml_sample_text(q, a):
    return F.concat(
        F.lit(f"{S.IM_START}system\n{S.SYSTEM_STAGE1}{S.IM_END}\n{S.IM_START}user\n"
              + S.IMAGE_PAD * PADS_PER_SAMPLE + "\n"),
        q, F.lit(f"{S.IM_END}\n{S.IM_START}assistant\n"), a, F.lit(f"{S.IM_END}\n"))


def token_arrays(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id, toks array<string>`` of every conversation; one without an answer holds the stage-2 default turns."""
    p = answered_pairs(spark, d)
    return p.select(F.col("conv_id").alias("sample_id"),
                    F.regexp_extract_all(chatml_sample_text(F.col("q"), F.col("a")),
                                         F.lit(S.TOKEN_PATTERN), 0).alias("toks"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Long form ``(sample_id, pos, tok)``."""
    return (token_arrays(spark, d)
            .transform(lambda a: explode_rows(a, "toks", ["sample_id"], "pos", "tok")))


def patches(spark: SparkSession, d: str) -> DataFrame:
    """``image_id, patch_idx, embedding``: consecutive embedding rows per image.
    The last image may be short; operators that need whole groups check it."""
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / PATCHES_PER_IMAGE).cast("bigint").alias("image_id"),
                    (F.col("vec_id") % PATCHES_PER_IMAGE).cast("int").alias("patch_idx"),
                    "embedding")


def step_features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    lab = table(spark, d, "labels")
    return (e.join(lab, e["vec_id"] == lab["doc_id"])
            .select("vec_id", "embedding", F.col("quality").alias("label")))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """``grp, item, score``: one score per embedding element."""
    e = table(spark, d, "embeddings")
    return (explode_rows(e, "embedding", [F.col("vec_id").alias("grp")], "item", "x")
            .select("grp", F.col("item").cast("bigint").alias("item"), F.col("x").cast("double").alias("score")))


def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records: the ``view`` events stand for evaluations (a user is a run, an event a step, its value
    the loss); events of other types are other kinds of log lines and no part of this log."""
    ev = table(spark, d, "events")
    return (ev.filter(F.col("event_type") == "view")
            .select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                    F.col("value").alias("eval_loss")))
