"""Token ids of whole documents in patched frame-of-reference files.

A shard file holds the ids of consecutive documents as blocks.  A block
subtracts its minimum, packs what is left at the width that holds the
``PERCENTILE`` lowest values, and keeps the others in an exception list.

file    = b"PFOR" u32(version) block* footer u64(footer length) b"PFOR"
block   = u32 min, u32 count, u32 width, u32 exceptions, u64 words[],
          u32 positions[], u32 values[]        (little-endian)
footer  = u64 blocks, u64 documents, u64 block byte starts[],
          u64 document token starts[documents + 1], i64 doc ids[]

``write_files`` range-partitions encoded documents by id, so shard k's ids
come before those of shard k + 1; each task writes one file under a name of
its own attempt and the table of files, committed by Spark, names the files
of the attempts that counted.  A lost executor's half file is never read.
Texts that are null count as empty; equal doc_ids stand next to each other,
ordered by their ids; null doc_ids come first; an empty table gives no file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepcorpus.llm.arrowtext import as_bytes, slices
from stepcorpus.session import materialize, scratch_dir

MAGIC, VERSION = b"PFOR", 1
BLOCK = 32_768  # ids in a block
PERCENTILE = 95  # of a block's values fit the packed width
CACHE = 300_000  # entries in each of the two halves of a worker's cache of runs
PIECE = 1 << 20  # bytes of text encoded at once; a longer single text stands alone
NULL_ID = -(1 << 63)  # stands for a null doc_id in the files


# ---- blocks

def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits a value, 64 values in ``width`` words of 64 bits."""
    v = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    v[:len(values)] = values
    v = v.reshape(-1, 64)
    out = np.zeros((len(v), width), np.uint64)
    for j in range(64 if width else 0):
        word, bit = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - bit)
    return out.ravel()


def unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint64)
    w = words.reshape(-1, width)
    out = np.empty((len(w), 64), np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        out[:, j] = w[:, word] >> np.uint64(bit)
        if bit + width > 64:
            out[:, j] |= w[:, word + 1] << np.uint64(64 - bit)
    return (out & np.uint64((1 << width) - 1)).ravel()[:count]


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = ids.astype(np.uint64) - np.uint64(low)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    over = np.flatnonzero(rest >> np.uint64(width))
    kept = rest.copy()
    kept[over] = 0
    return b"".join((struct.pack("<4I", low, len(ids), width, len(over)), pack(kept, width).astype("<u8").tobytes(),
                     over.astype("<u4").tobytes(), rest[over].astype("<u4").tobytes()))


def decode_block(raw: bytes) -> np.ndarray:
    low, count, width, n_over = struct.unpack_from("<4I", raw)
    n_words = -(-count // 64) * width
    out = unpack(np.frombuffer(raw, "<u8", n_words, 16).astype(np.uint64), width, count)
    over = np.frombuffer(raw, "<u4", n_over, 16 + 8 * n_words)
    out[over] = np.frombuffer(raw, "<u4", n_over, 16 + 8 * n_words + 4 * n_over)
    return (out + np.uint64(low)).astype(np.uint32)


# ---- files

def file_system(path: str):
    """(pyarrow file system, path in it): the shared folder may be local, HDFS or an object store."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_shard(path: str, documents: Iterator[tuple[int, np.ndarray]], block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[int, int]:
    """Write one file; (documents, ids).  Holds a block of ids and the document table in memory."""
    store, inner = file_system(path)
    store.create_dir(inner.rpartition("/")[0])
    starts, at_bytes, keys, total = [0], [], [], 0
    waiting: list[np.ndarray] = []
    n_waiting = 0
    with store.open_output_stream(inner) as f:
        place = f.write(MAGIC + struct.pack("<I", VERSION))

        def flush(final: bool) -> None:
            nonlocal waiting, n_waiting, place
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            end = len(ids) if final else len(ids) // block * block
            for i in range(0, end, block):
                at_bytes.append(place)
                place += f.write(encode_block(ids[i:min(i + block, end)], percentile))
            waiting, n_waiting = [ids[end:]], len(ids) - end

        for key, ids in documents:
            keys.append(key)
            total += len(ids)
            starts.append(total)
            waiting.append(ids)
            n_waiting += len(ids)
            if n_waiting >= 8 * block:
                flush(False)
        flush(True)
        footer = b"".join((struct.pack("<2Q", len(at_bytes), len(keys)), np.array([*at_bytes, place], "<u8").tobytes(),
                           np.array(starts, "<u8").tobytes(), np.array(keys, "<i8").tobytes()))
        f.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return len(keys), total


def read_shard(path: str, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start in the shard, ids) of each document, decoding block by block."""
    store, inner = file_system(path)
    with store.open_input_file(inner) as f:
        size = f.size()
        f.seek(size - 12)
        tail = f.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path}: not a finished shard file")
        length = struct.unpack("<Q", tail[:8])[0]
        f.seek(size - 12 - length)
        footer = f.read(length)
        n_blocks, n_docs = struct.unpack_from("<2Q", footer)
        at_bytes = np.frombuffer(footer, "<u8", n_blocks + 1, 16)
        starts = np.frombuffer(footer, "<u8", n_docs + 1, 16 + 8 * (n_blocks + 1)).astype(np.int64)
        keys = np.frombuffer(footer, "<i8", n_docs, 16 + 8 * (n_blocks + 1) + 8 * (n_docs + 1))
        have, base, k = np.zeros(0, np.uint32), 0, 0  # decoded ids from position ``base`` on
        for i in range(n_docs):
            lo, hi = int(starts[i]), int(starts[i + 1])
            parts = [have[lo - base:]]
            got = base + len(have)
            while got < hi:
                f.seek(int(at_bytes[k]))
                ids = decode_block(f.read(int(at_bytes[k + 1] - at_bytes[k])))
                parts.append(ids)
                got += len(ids)
                k += 1
            have, base = np.concatenate(parts) if len(parts) > 1 else parts[0], lo
            yield int(keys[i]), lo, have[:hi - lo]


# ---- tokenizer

_ENCODERS: dict[str, "Encoder"] = {}

#: The settings that ``Encoder`` follows by itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
                                                       {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = "!-~¡-ɏ"  # characters whose letters and digits the library and Python tell alike


def plain_split() -> str:
    """``SPLIT`` for texts of the plain range in lower case, its classes listed for ``re``."""
    low = sorted({x for i in (*range(0x21, 0x7F), *range(0xA1, 0x250)) for c in (chr(i), chr(i).lower()) for x in c})
    letters, digits = ("".join(c for c in low if unicodedata.category(c)[0] == kind) for kind in "LN")
    return SPLIT.replace(r"[\p{N}]", f"[{digits}]").replace(r"\p{L}", letters).replace(r"\p{N}", digits)


def follows(settings: dict) -> bool:
    """Whether a tokenizer file has the settings that ``Encoder`` follows; special tokens have to show by ``<|``."""
    return (settings["normalizer"] == NORMALIZER and settings["pre_tokenizer"] == PRE_TOKENIZER and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout") and bool(settings["model"].get("end_of_word_suffix"))
            and all(t["content"].startswith("<|") and not (t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in settings["added_tokens"]))


class Encoder:
    """Ids of texts by the tokenizers library, one run without ASCII white space at a time.

    Where the file has the settings above, it drops white space and merges
    within a run only, so a text's ids are those of its runs; with any other
    settings, whole texts go to the library.  Arrow cuts a column of texts
    into runs and tells which are distinct, so only these are looked up.
    Runs are cached, and those that aren't go to the library's merges, cut
    into word pieces, each distinct piece once; a run outside the plain Latin
    range, or one that may hold a special token, goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one of many
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()  # documents are encoded whole
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model  # a word piece to ids, and nothing else
        self.follows = follows(json.loads(self.tokenizer.to_str()))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.pieces = re.compile(plain_split() + r"|\n")
        self.odd = re.compile(f"[^\\n{PLAIN}]")
        # byte -> the letter that stands for it in the vocabulary: printable ones stand for themselves, the rest follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        assert set(letters.values()) == set(pre_tokenizers.ByteLevel.alphabet())
        self.table = {i: letters[i] for i in range(256)}
        self.runs: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # those before the last ``CACHE``

    def fresh(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs that aren't cached: the pieces of all of them merged in one call."""
        out: dict[bytes, bytes] = {}
        text = b"\n".join(runs).decode()
        if self.odd.search(text) or "<|" in text:
            for r in runs:
                if self.odd.search(t := r.decode()) or "<|" in t:
                    out[r] = self.library(t)
            runs = [r for r in runs if r not in out]
            text = b"\n".join(runs).decode()
        if not runs:
            return out
        cut = self.pieces.findall(text.lower())  # of a run one after the other, a line's end between two runs
        words = dict.fromkeys(cut)
        words.pop("\n", None)
        words |= zip(words, self.words(list(words)))
        words["\n"] = b""
        ids = list(map(words.get, cut))
        lo = 0
        for r, hi in zip(runs, [*(i for i, w in enumerate(cut) if w == "\n"), len(cut)]):
            out[r] = ids[lo] if hi == lo + 1 else b"".join(ids[lo:hi])
            lo = hi + 1
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of word pieces.  One by one: a text of them all would have each of its characters aligned with the input."""
        merge, flat, ends = self.merges.tokenize, [], [0]
        for w in words:
            flat += [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(self.table))]
            ends.append(len(flat) * self.dtype.itemsize)
        raw = np.array(flat, self.dtype).tobytes()
        return [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids_of(self, runs: list[bytes]) -> list[bytes]:
        """Ids of distinct runs."""
        found = list(map(self.runs.get, runs))
        missing = [r for r, g in zip(runs, found) if g is None]
        new = {r: g for r in missing if (g := self.older.get(r)) is not None}
        new |= self.fresh([r for r in missing if r not in new])
        for r, g in new.items():
            if len(r) <= 64:
                if len(self.runs) >= CACHE:
                    self.older, self.runs = self.runs, {}
                self.runs[r] = g
        return [new[r] if g is None else g for r, g in zip(runs, found)] if missing else found

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text of a binary column (null: empty) and ``end``."""
        if not self.follows:
            return pa.array([self.library((t or b"").decode()) + end for t in texts.to_pylist()], pa.binary())
        texts = texts.fill_null(b"").cast(pa.string())
        special = pc.match_substring(texts, "<|")
        low = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        coded = split.flatten().dictionary_encode()
        runs = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.binary())), b"\n")[0].as_py().split(b"\n") if len(coded.dictionary) else []
        # each text's runs and, behind them, the end
        upto = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        at = np.insert(np.asarray(coded.indices), upto, len(runs))
        ids = pa.array([*self.ids_of(runs), end], pa.binary()).take(pa.array(at))
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, np.int32)[np.concatenate([[0], upto + np.arange(1, len(upto) + 1)])]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), data])

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.binary())).to_pylist()

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- Spark

def encode(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int] = ()) -> DataFrame:
    """(doc_id, shard, ids, wide): ids of each whole text and the end id; the shard by ``bounds`` of doc_id."""
    cut = np.array(bounds, np.int64)

    def task(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            keys = b.column(0)
            shard = np.searchsorted(cut, keys.fill_null(NULL_ID).to_numpy(zero_copy_only=False), side="right")
            for lo, hi, _, _ in slices(b, limit=PIECE):
                ids = enc.encode_column(b.column(1).slice(lo, hi - lo), end)
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(shard[lo:hi], pa.int32()), ids,
                                                  pa.array([enc.dtype.itemsize] * (hi - lo), pa.int32())], ["doc_id", "shard", "ids", "wide"])

    return as_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(task, "doc_id long, shard int, ids binary, wide int")


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encode ``docs`` into shard files under ``folder``; the table of files (shard, path, documents, ids, start)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))

    def task(batches):
        shards: dict[int, tuple] = {}

        def rows():
            for b in batches:
                for key, shard, ids, wide in zip(*(b.column(i).to_pylist() for i in range(4))):
                    yield shard, (NULL_ID if key is None else key, np.frombuffer(ids, f"<u{wide}").astype(np.uint32))

        from itertools import groupby
        for shard, group in groupby(rows(), key=lambda r: r[0]):
            path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.pfor"
            shards[shard] = (path, *write_shard(path, (d for _, d in group), block, percentile))
        yield pa.RecordBatch.from_arrays([pa.array(list(shards), pa.int32()), pa.array([x[0] for x in shards.values()], pa.string()),
                                          *(pa.array([x[i] for x in shards.values()], pa.int64()) for i in (1, 2))], ["shard", "path", "documents", "ids"])

    files = materialize(encode(docs, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, F.col("shard"))
                        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
                        .mapInArrow(task, "shard int, path string, documents long, ids long"), "pfor-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    def task(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple] = []
                for key, start, ids in read_shard(path):
                    out.append((None if key == NULL_ID else key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 4096:
                        yield rows(out)
                        out = []
                yield rows(out)

    def rows(out):
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return (files.select("path", "start", "shard").repartitionByRange(n, "shard").select("path", "start")
            .mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the files (by default under the shared checkpoint folder) and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_files(write_files(docs, folder or scratch_dir(spark, "pfor"), tokenizer, end_id))
