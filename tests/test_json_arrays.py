"""JSON arrays in many ranges against the single-task reader and Python's json."""
import json
import random

import pytest

from stepcorpus.sources import files as SRC
from stepcorpus.sources import json_arrays as J

NASTY = ['a}b', '{"', '\\', '\\"}', '[]{}', 'é}ü', '日本}語', '\\\\', '"', "}\n{", "\t}", "", "\\u007d", "😀}"]


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def set_to(size):
        for n in names:
            spark.conf.set(n, str(size))
    yield set_to
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def records(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(NASTY + ["x", " ", "yz"]) for _ in range(rng.randrange(6)))
    return [{"image": rng.choice([None, f"{i}.png", word()]), "conversations": [{"from": rng.choice(("human", "gpt")), "value": word()} for _ in range(rng.randrange(4))]} for i in range(n)]


def plain(rows):
    return sorted(repr((r.image, [(t["from"], t["value"]) for t in (r.conversations or [])])) for r in rows)


@pytest.mark.parametrize("indent, ascii_, size", [(None, False, 331), (2, True, 700)])
def test_equal_to_one_task(spark, tmpdir_path, small_ranges, indent, ascii_, size):
    for k in range(2):
        with open(f"{tmpdir_path}/{k}.json", "w", encoding="utf-8") as f:
            json.dump(records(60, k), f, indent=indent, ensure_ascii=ascii_)
    want = plain(SRC.read_conversations(spark, tmpdir_path).collect())
    small_ranges(size)
    got = J.read_array_files(spark, tmpdir_path, SRC.CONVERSATION_SCHEMA)
    assert plain(got.collect()) == want and len(want) == 120


def test_one_file_in_many_tasks(spark, tmpdir_path, small_ranges):
    with open(f"{tmpdir_path}/one.json", "w", encoding="utf-8") as f:
        json.dump(records(2000, 5), f, ensure_ascii=False)
    small_ranges(16384)
    pieces = J._pieces(spark, tmpdir_path)
    assert pieces.rdd.getNumPartitions() >= 8 and pieces.select("block").distinct().count() >= 8
    starts = J.range_starts(pieces).orderBy("block").collect()
    assert starts[0].start_depth == 0 and not starts[0].start_inside and all(s.base == 1 for s in starts)
    assert J.read_records(spark, tmpdir_path).count() == 2000


def test_a_record_over_many_ranges(spark, tmpdir_path, small_ranges):
    recs = records(5, 1) + [{"image": "long", "conversations": [{"from": "human", "value": "}" * 900 + '{"' * 300}]}] + records(5, 2)
    with open(f"{tmpdir_path}/one.json", "w", encoding="utf-8") as f:
        json.dump(recs, f, ensure_ascii=False)
    want = plain(SRC.read_conversations(spark, tmpdir_path).collect())
    small_ranges(200)
    assert plain(J.read_array_files(spark, tmpdir_path, SRC.CONVERSATION_SCHEMA).collect()) == want


def test_other_shapes(spark, tmpdir_path):
    texts = {"empty": "", "blank": " \n", "none": "[]", "one": '{"image": "a", "conversations": []}', "lines": '{"image": "b"}\n{"image": "c"}', "nested": '[{"image": "d", "x": [{"y": {}}, "}"]}]\n',
             "others": '[1, null, "}", {"image": "e"}, [{"image": "no record"}], {"image": 5}]', "marked": "﻿" + '[{"image": "f"}]'}
    for name, text in texts.items():
        with open(f"{tmpdir_path}/{name}.json", "w", encoding="utf-8") as f:
            f.write(text)
    assert sorted(r.image for r in J.read_array_files(spark, tmpdir_path, SRC.CONVERSATION_SCHEMA).collect()) == ["5", "a", "b", "c", "d", "e", "f"]


def test_quotes_after_backslashes():
    import numpy as np
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice('\\\\"ab') for _ in range(rng.randrange(30)))
        if text.startswith("\\"):
            text = "x" + text
        want, run = [], 0
        for i, c in enumerate(text):
            if c == '"' and run % 2 == 0:
                want.append(i)
            run = run + 1 if c == "\\" else 0
        assert J._real_quotes(np.frombuffer(text.encode(), np.uint8)).tolist() == want, text


def test_write_then_read(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"{i}}}.png", [{"from": "human", "value": f'q"{i}'}]) for i in range(500)], "conv_id long, image string, conversations array<struct<from:string,value:string>>")
    J.write_array_files(df, f"{tmpdir_path}/out", "conv_id", 3)
    import glob
    assert sum(len(json.load(open(p, encoding="utf-8"))) for p in glob.glob(f"{tmpdir_path}/out/part-*")) == 500
    assert sorted(map(tuple, J.read_array_files(spark, f"{tmpdir_path}/out", df.schema).select("conv_id", "image").collect())) == sorted(map(tuple, df.select("conv_id", "image").collect()))
