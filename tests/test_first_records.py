"""The first n records: equal to a literal cut, and files behind them are not read."""
import json
import os

import pytest

from stepcorpus.sources import first_records as R


def test_rows_over_files(spark, tmpdir_path):
    for k, n in enumerate((40, 0, 25, 60)):
        spark.range(1000 * k, 1000 * k + n).coalesce(1).write.parquet(f"{tmpdir_path}/w{k}")
        part = next(f for f in os.listdir(f"{tmpdir_path}/w{k}") if f.endswith(".parquet"))
        os.makedirs(f"{tmpdir_path}/t", exist_ok=True)
        os.link(f"{tmpdir_path}/w{k}/{part}", f"{tmpdir_path}/t/part {k}.parquet")
    everything = list(range(40)) + list(range(2000, 2025)) + list(range(3000, 3060))
    for n in (1, 40, 41, 65, 66, 125, 500, None, 0):
        got = R.first_rows(spark, f"{tmpdir_path}/t", n)
        assert sorted(r.id for r in got.collect()) == everything[:n or None], n
    assert len(R.first_rows(spark, f"{tmpdir_path}/t", 50).inputFiles()) == 3  # the fourth is left out of the plan
    with open(f"{tmpdir_path}/t/part 9.parquet", "wb") as f:
        f.write(b"not a parquet file")  # would fail if it were read
    schema_file = f"{tmpdir_path}/t/part 0.parquet"
    assert spark.read.parquet(schema_file).count() == 40
    assert R.first_rows(spark, f"{tmpdir_path}/t", 40).count() == 40
    with pytest.raises(ValueError):
        R.first_rows(spark, f"{tmpdir_path}/t", -1)


def test_files_are_counted_until_n_is_reached():
    rows = {f"f{i:02}": i % 5 for i in range(40)}
    files = sorted(rows)
    for n in range(1, 85):
        asked = []

        def counts(group):
            asked.extend(group)
            return {f: rows[f] for f in group if rows[f]}
        got, before = R.needed_files(files, counts, n)
        total, want = 0, files
        for i, f in enumerate(files):
            if total + rows[f] >= n:
                want = files[:i + 1]
                break
            total += rows[f]
        assert got == want and before == sum(rows[f] for f in want[:-1])
        assert len(asked) <= 2 * len(want) + 1


def test_step_records_over_files_and_splits(spark, tmpdir_path):
    lines = []
    for k in range(5):
        with open(f"{tmpdir_path}/part{k}.jsonl", "w") as f:
            for i in range(50):
                f.write(json.dumps({"image_url": f"{k}-{i}", "instruction": "x" * 20}) + "\n")
                lines.append(f"{k}-{i}")
                if i % 7 == 0:
                    f.write("{oops\n")  # bad lines do not count towards n
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(x) for x in names]
    try:
        for x in names:
            spark.conf.set(x, "700")  # several splits a file
        for n in (1, 50, 51, 70, 120, 249, 250, 999):
            good, bad = R.first_step_records(spark, tmpdir_path, n)
            assert [r.image_url for r in good.orderBy("_file", "_block", "_mid").collect()] == lines[:n], n
            files = -(-min(n, 250) // 50)
            assert bad.count() == 8 * files and len(good.inputFiles()) == files
        assert R.first_step_records(spark, tmpdir_path, None)[0].count() == 250
    finally:
        for x, v in zip(names, old):
            spark.conf.set(x, v)
    with pytest.raises(ValueError):
        R.first_step_records(spark, tmpdir_path, -1)
