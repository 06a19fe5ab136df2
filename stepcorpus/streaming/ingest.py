"""Incremental stage-3 record preparation with Structured Streaming.

New JSONL files dropped into a folder are parsed with the same strict check
as the batch reader (S2), validated against a static image manifest (F2, P3,
F3 as a stream-static semi join) and turned into prompt tokens and located
steps (P8, T1, T9-T11).  Valid samples and quarantined lines go to two file
sinks whose checkpoints live in the shared ``spark.checkpoint.dir``, so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stepcorpus.plans import stages as G
from stepcorpus.session import scratch_dir
from stepcorpus.sources.files import QUARANTINE_CHARS, STEP_RECORD_SCHEMA, checked_lines


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with a key: the file, the split that holds the line and its place there.  A split is read by one task
    in file order, so a batch that runs again gives the same keys."""
    last, place = None, 0
    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        keys = []
        for split in zip(files, blocks):
            last, place = split, place + 1 if split == last else 0
            keys.append(f"{split[0]}:{split[1]}:{place}")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], ["value", "_file", "_line"])


def step_record_stream(spark: SparkSession, src_dir: str, manifest: DataFrame, base: str,
                       schema: T.StructType = STEP_RECORD_SCHEMA,
                       max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(samples, quarantine)`` streaming DataFrames over a JSONL folder."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(src_dir).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = lines.mapInArrow(_with_places, "value string, _file string, _line string")
    checked = checked_lines(raw, schema)
    quarantine = checked.filter(F.col("reason").isNotNull()).select(
        "_file", F.col("value").alias("line"), F.substring("value", 1, QUARANTINE_CHARS).alias("head"), "reason")
    parsed = checked.filter(F.col("reason").isNull()).select(
        *[F.col("_r")[f.name].alias(f.name) for f in schema.fields], "instruction_present", "_file", "_line")
    if "conv_id" not in schema.names:  # equal lines are records of their own
        parsed = parsed.withColumnRenamed("_line", "conv_id")
    samples = G.stage3_tokens(G.stage3_valid(parsed, manifest, base))
    return samples, quarantine


def start_ingest(spark: SparkSession, src_dir: str, out_dir: str, manifest: DataFrame, base: str,
                 schema: T.StructType = STEP_RECORD_SCHEMA, once: bool = True,
                 checkpoint: str | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """Start the two sinks (``out_dir/samples`` and ``out_dir/quarantine``).
    ``once`` processes what is there now and stops (``availableNow``)."""
    samples, quarantine = step_record_stream(spark, src_dir, manifest, base, schema)
    ckpt = checkpoint or scratch_dir(spark, "ingest-checkpoint")
    out = []
    for name, df in (("samples", samples), ("quarantine", quarantine)):
        w = (df.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{ckpt}/{name}").option("path", f"{out_dir}/{name}"))
        w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
        out.append(w.start())
    return out[0], out[1]
