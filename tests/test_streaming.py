import json

from stepcorpus.streaming.ingest import start_ingest


def test_ingest_available_now(spark, tmpdir_path):
    src = f"{tmpdir_path}/in"
    import os
    os.makedirs(src)
    with open(f"{src}/a.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"image_url": "MathV-360k/x.png", "instruction": "Step 1: a и <neg>\nStep 2: b и"}) + "\n")
        f.write(json.dumps({"image_url": "missing.png", "instruction": "Step 1: c и"}) + "\n")
        f.write("{broken\n")
    manifest = spark.createDataFrame([("B/data_images/x.png",)], "path string")
    q1, q2 = start_ingest(spark, src, f"{tmpdir_path}/out", manifest, "B", checkpoint=f"{tmpdir_path}/ckpt")
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    samples = spark.read.parquet(f"{tmpdir_path}/out/samples").collect()
    assert len(samples) == 1
    assert [s.label for s in samples[0].steps] == [0, 1]
    quarantine = spark.read.parquet(f"{tmpdir_path}/out/quarantine").collect()
    assert [(r.reason, r.head) for r in quarantine] == [("parse_error", "{broken")]


def test_ingest_resumes_from_checkpoint(spark, tmpdir_path):
    """A second run with the same checkpoint picks up only the new file."""
    import os
    src = f"{tmpdir_path}/in"
    os.makedirs(src)
    manifest = spark.createDataFrame([("B/data_images/x.png",)], "path string")

    def drop(name, url):
        with open(f"{src}/{name}", "w", encoding="utf-8") as f:
            f.write(json.dumps({"image_url": url, "instruction": "Step 1: a и <pos>"}) + "\n")

    def run():
        for q in start_ingest(spark, src, f"{tmpdir_path}/out", manifest, "B", checkpoint=f"{tmpdir_path}/ckpt"):
            q.awaitTermination(120)
        return spark.read.parquet(f"{tmpdir_path}/out/samples").count()

    drop("a.jsonl", "x.png")
    assert run() == 1
    drop("b.jsonl", "MathV-360k/x.png")
    assert run() == 2  # the first file is not processed again


def test_equal_lines_are_samples_of_their_own(spark, tmpdir_path):
    """Equal lines, in one file and in two, have keys of their own, and the samples encode."""
    import os
    from stepcorpus.operators import tokens as K
    src = f"{tmpdir_path}/in"
    os.makedirs(src)
    line = json.dumps({"image_url": "x.png", "instruction": "Step 1: a и <pos>"}) + "\n"
    for name in ("a", "b"):
        with open(f"{src}/{name}.jsonl", "w", encoding="utf-8") as f:
            f.write(line * 2)
    manifest = spark.createDataFrame([("B/data_images/x.png",)], "path string")
    for q in start_ingest(spark, src, f"{tmpdir_path}/out", manifest, "B", checkpoint=f"{tmpdir_path}/ckpt"):
        q.awaitTermination(120)
    samples = spark.read.parquet(f"{tmpdir_path}/out/samples")
    assert samples.count() == 4 and samples.select("conv_id").distinct().count() == 4
    ids = [r.ids for r in K.encode(samples, "tokens", K.build_vocab(samples, "tokens"), "conv_id", "ids").collect()]
    assert len(ids) == 4 and len(set(map(tuple, ids))) == 1 and len(ids[0]) > 5
