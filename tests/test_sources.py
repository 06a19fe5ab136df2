import json
import os
import struct
import zlib


from stepcorpus.sources import files as SRC


def write_png(path, width, height, color_type, pixels):
    """Minimal PNG writer for tests (8-bit, no filtering)."""
    ch = {0: 1, 2: 3, 4: 2, 6: 4}[color_type]
    raw = b"".join(b"\x00" + bytes(pixels[y * width * ch:(y + 1) * width * ch]) for y in range(height))

    def chunk(kind, data):
        c = struct.pack(">I", len(data)) + kind + data
        return c + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", width, height, 8, color_type, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_conversations_json_arrays(spark, tmpdir_path):
    recs = [{"image": "a.png", "conversations": [{"from": "human", "value": "<image>\nq"}, {"from": "gpt", "value": "a"}]},
            {"image": None, "conversations": []}, {"conversations": [{"from": "human", "value": "x"}], "extra": 1}]
    with open(f"{tmpdir_path}/one.json", "w", encoding="utf-8") as f:
        json.dump(recs[:2], f, ensure_ascii=False, indent=2)
    with open(f"{tmpdir_path}/two.json", "w", encoding="utf-8") as f:
        json.dump(recs[2:], f)
    df = SRC.read_conversations(spark, tmpdir_path)
    got = sorted((r.image or "", len(r.conversations)) for r in df.collect())
    assert got == [("", 0), ("", 1), ("a.png", 2)]


def test_write_then_read_conversations(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"{i}.png", [{"from": "human", "value": f"q{i}"}]) for i in range(25)],
                               "conv_id long, image string, conversations array<struct<from:string,value:string>>")
    SRC.write_conversations(df, f"{tmpdir_path}/out", "conv_id", rows_per_file=10)
    back = SRC.read_conversations(spark, f"{tmpdir_path}/out", df.schema)
    assert sorted(tuple(r) for r in back.select("conv_id", "image").collect()) == \
        sorted(tuple(r) for r in df.select("conv_id", "image").collect())


def test_read_step_jsonl_edges(spark, tmpdir_path):
    lines = ['{"image_url": "a.png", "instruction": "Step 1: x и"}', '{bad', '', '3',
             '{"image_url": "b.png"} trailing', '{"image_url": "c.png", "v": NaN}',
             '{"image_url": "d.png", "v": ' + "[" * 1100 + "]" * 1100 + "}", '{"image_url": null, "instruction": null}', '{"instruction": "i", "extra": [1, 2]}']
    with open(f"{tmpdir_path}/a.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    good, bad = SRC.read_step_jsonl(spark, tmpdir_path)
    g = sorted((r.image_url or "", r.instruction or "", r.instruction_present) for r in good.collect())
    assert g == [("", "", True), ("", "i", True), ("a.png", "Step 1: x и", True), ("c.png", "", False)]
    reasons = sorted((r.reason, r.head) for r in bad.collect())
    assert reasons == [("blank", ""), ("not_object", "3"), ("not_readable", ('{"image_url": "d.png", "v": ' + "[" * 100)[:100]), ("parse_error", '{"image_url": "b.png"} trailing'),
                       ("parse_error", "{bad")]


def test_read_step_jsonl_first_n_file_order(spark, tmpdir_path):
    for k in range(3):
        with open(f"{tmpdir_path}/part{k}.jsonl", "w") as f:
            for i in range(50):
                f.write(json.dumps({"image_url": f"{k}-{i}", "instruction": "x"}) + "\n")
                if i % 7 == 0:
                    f.write("{oops\n")  # bad lines do not count towards n
    good, _ = SRC.read_step_jsonl(spark, tmpdir_path, first_n=70)
    got = [r.image_url for r in good.orderBy("_file", "_block", "_mid").collect()]
    assert got == [f"0-{i}" for i in range(50)] + [f"1-{i}" for i in range(20)]


def test_read_images_and_manifest(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/img/sub")
    write_png(f"{tmpdir_path}/img/rgb.png", 2, 1, 2, [255, 0, 0, 0, 0, 255])
    write_png(f"{tmpdir_path}/img/sub/gray.png", 1, 1, 0, [77])
    write_png(f"{tmpdir_path}/img/sub/ga.png", 1, 1, 4, [90, 10])
    write_png(f"{tmpdir_path}/img/rgba.png", 1, 1, 6, [1, 2, 3, 4])
    with open(f"{tmpdir_path}/img/junk.png", "wb") as f:
        f.write(b"not an image at all")
    imgs = {os.path.basename(r.path): r for r in SRC.read_images(spark, f"{tmpdir_path}/img").collect()}
    assert imgs["rgb.png"].status == "ok" and bytes(imgs["rgb.png"].rgb) == bytes([255, 0, 0, 0, 0, 255])
    assert bytes(imgs["gray.png"].rgb) == bytes([77, 77, 77])
    assert bytes(imgs["ga.png"].rgb) == bytes([90, 90, 90])
    assert bytes(imgs["rgba.png"].rgb) == bytes([1, 2, 3])
    assert imgs["junk.png"].status == "invalid"
    man = SRC.image_manifest(spark, f"{tmpdir_path}/img")
    paths = sorted(r.path for r in man.collect())
    assert paths[0].startswith("/") and len(paths) == 5
    assert f"{tmpdir_path}/img/sub/gray.png" in paths
    assert len(SRC.fallback_image()) == 224 * 224 * 3


def test_write_samples_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "train", [1, 2]), (2, "validation", [3])], "k long, split string, ids array<int>")
    SRC.write_samples(df, f"{tmpdir_path}/s")
    assert sorted(r.k for r in SRC.read_samples(spark, f"{tmpdir_path}/s", "train").collect()) == [1]
    assert os.path.isdir(f"{tmpdir_path}/s/split=validation")


def test_files_from_rows(spark, tmpdir_path):
    from stepcorpus.sources import binary_files as BIN
    rows = [(f"a/{i % 3}/{i}.bin", bytes([i] * (i + 1))) for i in range(40)]  # Spark lists no empty files
    df = spark.createDataFrame(rows, "name string, data binary").repartition(4)
    for _ in range(2):  # again: the same files
        listed = BIN.write_files(df, f"{tmpdir_path}/out", "name", "data")
        assert sorted((r["name"], r.length) for r in listed.collect()) == sorted((n, len(d)) for n, d in rows)
    man = {r.path.removeprefix(f"{tmpdir_path}/out/"): r.length for r in SRC.image_manifest(spark, f"{tmpdir_path}/out").collect()}
    assert man == {n: len(d) for n, d in rows}
    assert all(open(f"{tmpdir_path}/out/{n}", "rb").read() == d for n, d in rows)
    import pytest
    for bad in ("/abs", "../up", None):
        with pytest.raises(Exception, match="no file can be written"):
            BIN.write_files(spark.createDataFrame([(bad, b"x")], "name string, data binary"), f"{tmpdir_path}/bad", "name", "data")


def test_made_images_are_read(spark, tmpdir_path):
    from stepcorpus.sources import binary_files as BIN
    kinds = {"g": (2, 2, 1), "ga": (2, 1, 2), "rgb": (1, 2, 3), "rgba": (1, 1, 4)}
    rows = [(f"{n}.png", BIN.png(w, h, c, bytes(range(10, 10 + w * h * c)))) for n, (w, h, c) in kinds.items()]
    BIN.write_files(spark.createDataFrame(rows, "name string, data binary"), tmpdir_path, "name", "data")
    got = {os.path.basename(r.path): (r.height, r.width, list(r.rgb)) for r in SRC.read_images(spark, tmpdir_path).collect()}
    assert got == {"g.png": (2, 2, [v for p in range(10, 14) for v in [p] * 3]), "ga.png": (1, 2, [10, 10, 10, 12, 12, 12]), "rgb.png": (2, 1, [10, 11, 12, 13, 14, 15]), "rgba.png": (1, 1, [10, 11, 12])}
