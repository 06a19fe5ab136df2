"""Round-trip queries for the file sources and the sink.

Each query writes data derived from the given tables in the reference's file
format to the shared scratch folder (``spark.checkpoint.dir``), reads it back
with the source operator and returns what was read.  S3/S4 need image files,
which the given tables do not hold; they are covered by tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepcorpus.functions import text as T_
from stepcorpus.functions.arrays import explode_rows
from stepcorpus.plans import views as V
from stepcorpus.plans.oracle_views import TOKEN_RE, with_views
from stepcorpus.plans.registry import REGISTRY, query
from stepcorpus.session import scratch_dir
from stepcorpus.sources import files as SRC
from stepcorpus.sources import first_records as FIRST
from stepcorpus.sources import json_arrays as ARRAYS
from stepcorpus.sources.tables import table


_NESTED_SQL = """
select conv_id, 'img/' || conv_id || '.png' as image,
  cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as turn,
  case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as "from",
  case when role = 'user' then '<image>' || chr(10) || text else text end as value
from conversations"""
_NESTED_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType())] + SRC.CONVERSATION_SCHEMA.fields)


def _turns(back):
    return (explode_rows(back, "conversations", ["conv_id", "image"], "turn", "m")
            .select("conv_id", "image", "turn", F.col("m.from").alias("from"), F.col("m.value").alias("value")))


@query("s1_read_conversations", _NESTED_SQL)
def s1(spark, d):
    """Conversation records written as JSON-array files and read back (multiLine JSON)."""
    path = scratch_dir(spark, "conversations-json")
    SRC.write_conversations(V.conv_nested(spark, d), path, "conv_id", rows_per_file=1000)
    return _turns(SRC.read_conversations(spark, path, _NESTED_SCHEMA))


TURNS_PER_FILE = 2_000_000


@query("s1_split_array", _NESTED_SQL)
def s1_split(spark, d):
    """Conversation records streamed into few large JSON arrays and read back by byte ranges, many tasks a file."""
    path = scratch_dir(spark, "conversation-arrays")
    files = -(-table(spark, d, "conversations").count() // TURNS_PER_FILE) or 1
    ARRAYS.write_array_files(V.conv_nested(spark, d), path, "conv_id", files)
    return _turns(ARRAYS.read_array_files(spark, path, _NESTED_SCHEMA))


def _jsonl_lines(spark, d):
    good = V.step_records_full(spark, d).select(
        "conv_id", F.to_json(F.struct("conv_id", "image_url", "instruction")).alias("value"))
    sys_turns = table(spark, d, "conversations").filter(F.col("role") == "system")
    m = F.col("conv_id") % 3
    # the whole text, kept on one physical line (CR/LF become spaces)
    bad = sys_turns.select("conv_id", F.when(m == 0, F.concat(F.lit("{bad "), F.translate("text", "\r\n", "  ")))
                           .when(m == 1, F.lit("")).otherwise(F.col("turn").cast("string")).alias("value"))
    return good.unionByName(bad)


def _read_back(spark, d):
    path = scratch_dir(spark, "step-records-jsonl")
    _jsonl_lines(spark, d).select("value").write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("conv_id", T.LongType())] + SRC.STEP_RECORD_SCHEMA.fields)
    return SRC.read_step_jsonl(spark, path, schema)


@query("s2_read_step_jsonl", with_views(["step_records_full"], """
select conv_id, image_url, instruction, cast(instruction is not null as integer) as instruction_present
from step_records_full"""))
def s2(spark, d):
    """Stage-3 records written as JSONL (with bad lines mixed in) and parsed back."""
    good, _ = _read_back(spark, d)
    return good.select("conv_id", "image_url", "instruction",
                       F.col("instruction_present").cast("int").alias("instruction_present"))


@query("s2_quarantine", """
select case conv_id % 3 when 0 then 'parse_error' when 1 then 'blank' else 'not_object' end as reason,
  substr(case conv_id % 3 when 0 then '{bad ' || translate(text, chr(13) || chr(10), '  ') when 1 then '' else cast(turn as varchar) end,
         1, 100) as head,
  case conv_id % 3 when 0 then '{bad ' || translate(text, chr(13) || chr(10), '  ') when 1 then '' else cast(turn as varchar) end as line
from conversations where role = 'system'""")
def s2q(spark, d):
    """The unparsable lines of the same file: whole, their first 100 characters and the reason."""
    _, quarantine = _read_back(spark, d)
    return quarantine.select("reason", "head", "line")


FIRST_N = 60  # max_samples of the S2 query


@query("s2_first_n", with_views(["step_records_full"], f"select conv_id, image_url, instruction from step_records_full order by conv_id limit {FIRST_N}"))
def s2_first(spark, d):
    """The first 60 parsed records of JSONL files in file order (bad lines don't count); later files aren't read."""
    path = scratch_dir(spark, "step-records-in-order")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = _jsonl_lines(spark, d).repartitionByRange(n, "conv_id", "value").sortWithinPartitions("conv_id", "value")
    lines.select("value").write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("conv_id", T.LongType())] + SRC.STEP_RECORD_SCHEMA.fields)
    good, _ = FIRST.first_step_records(spark, path, FIRST_N, schema)
    return good.select("conv_id", "image_url", "instruction")


def _stage3_sql():
    from stepcorpus.plans import stage_queries  # noqa: F401  (registers stage3_samples)
    return REGISTRY["stage3_samples"].sql


@query("s5_write_samples", _stage3_sql())
def s5(spark, d):
    """Stage-3 samples written as Parquet partitioned by split and read back."""
    from stepcorpus.plans.stage_queries import stage3_long, stage3_sample_rows
    path = scratch_dir(spark, "stage3-samples")
    SRC.write_samples(stage3_sample_rows(spark, d), path, ("split",))
    return stage3_long(SRC.read_samples(spark, path))


SHARD_TOKENS = 20_000


@query("s5_balanced_shards", f"""
with t as (select doc_id, len(regexp_extract_all(coalesce(text, ''), {TOKEN_RE}, 0))::bigint as n_tokens from documents),
b as (select *, coalesce(sum(n_tokens) over (order by md5('42:' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before, sum(n_tokens) over () as total from t),
s as (select *, greatest(total // {SHARD_TOKENS}, 1) as shards from b)
select least(floor(before::double * shards / greatest(total, 1)), shards - 1)::bigint as shard, count(*) as n_rows, sum(n_tokens)::bigint as n_tokens, min(before) as first_token,
  sum(('0x' || substr(md5(doc_id || ':' || n_tokens), 1, 8))::bigint)::bigint as checksum
from s group by 1""")
def s5_balanced(spark, d):
    """Documents written as shards of equal token counts; the manifest as read back from the files."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "text", T_.token_count(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))
    return SRC.write_balanced_shards(rows, scratch_dir(spark, "shards"), "doc_id", "n_tokens", SHARD_TOKENS)
