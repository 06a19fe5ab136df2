import pytest
from pyspark.sql import functions as F

from stepcorpus.functions import text as T
from stepcorpus.operators import validity as VA


def test_first_n_file_order(spark, tmpdir_path):
    # three files, each split into several row groups/partitions
    path = f"{tmpdir_path}/t"
    df = spark.range(0, 3000).withColumn("f", (F.col("id") / 1000).cast("int"))
    df.repartition(3, "f").sortWithinPartitions("id").write.option("parquet.block.size", 4096).parquet(path)
    files = sorted(r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        src = spark.read.parquet(path)
        ordered = []
        for f in files:
            ordered += [r[0] for r in spark.read.parquet(f).select("id").collect()]
        for n in (1, 7, 1000, 1001, 2999, 5000):
            got = sorted(r[0] for r in VA.first_n(src, n).select("id").collect())
            assert got == sorted(ordered[:n])
        assert VA.first_n(src, 0).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        VA.first_n(src, -1)


def test_validity_report_invariant(spark):
    rec = spark.createDataFrame([(1, None), (2, ""), (3, "MathV-360k/a.png"), (4, "b.png"), (5, "data_images/c.png")],
                                "id long, image_url string")
    manifest = spark.createDataFrame([("B/data_images/a.png",), ("B/data_images/c.png",)], "path string")
    rep = VA.validity_report(VA.validity_reasons(rec, manifest, "B")).first().asDict()
    assert rep == {"total": 5, "valid": 2, "invalid": 3, "no_image_url": 2, "image_missing": 1}
    kept = VA.image_exists(VA.has_image_url(rec), manifest, "B")
    missing = VA.image_exists(VA.has_image_url(rec), manifest, "B", keep_missing=True)
    assert sorted(r[0] for r in kept.select("id").collect()) == [3, 5]
    assert sorted(r[0] for r in missing.select("id").collect()) == [4]


def test_spot_check(spark):
    rec = spark.range(0, 50).withColumn("image", F.concat(F.lit("i"), F.col("id").cast("string")))
    manifest = spark.createDataFrame([("R/i1",), ("R/i2",)], "path string")
    a = VA.path_spot_check(rec, T.join_path_lit("R", F.col("image")), manifest, "id", 5, 42).collect()
    b = VA.path_spot_check(rec, T.join_path_lit("R", F.col("image")), manifest, "id", 5, 42).collect()
    assert len(a) == 5 and sorted(a) == sorted(b)
    small = rec.limit(3)
    assert VA.path_spot_check(small, F.col("image"), manifest, "id", 5, 1).count() == 3
