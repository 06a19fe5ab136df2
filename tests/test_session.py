"""Written tables: their lifetime and where they may go."""
import os
from types import SimpleNamespace

import pytest

from stepcorpus import session as S


def test_scope_deletes_what_was_written_in_it(spark):
    outside = S.materialize(spark.range(3), "outside")
    with S.written_tables(spark):
        inside = S.materialize(spark.range(5), "inside")
        path = inside.inputFiles()[0].removeprefix("file://")
        assert inside.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and outside.count() == 3


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_the_pipeline_bounds_the_batches_its_tasks_hand_to_python(spark):
    import corpus_pipeline
    import pyarrow as pa
    from stepcorpus.session import BATCH_BYTES, bound_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4m")
        bound_batches(spark)
        assert spark.conf.get(key) == "4m"  # a session that asks for less keeps it
        for (_, stage), asked in zip(corpus_pipeline.STAGES[:2], (before, "1g")):
            spark.conf.set(key, asked)
            stage(spark, spark.createDataFrame([(1, "a b c d e", "en", "x")], "doc_id long, text string, lang string, source string"), "")
            texts = spark.range(0, 300, 1, 1).selectExpr("repeat(cast(id as string), 50000) as text")
            got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(got) > 3 * BATCH_BYTES and max(got) < 1.5 * BATCH_BYTES
    finally:
        spark.conf.set(key, before)
