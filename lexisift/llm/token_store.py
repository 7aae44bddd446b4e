"""Token-id store: directly addressable codes (chunk levels, continuation bitmaps, rank directories).

An id is split into 8-bit chunks, low chunk first.  Level 0 holds the first chunk of every id, level
k the next chunk of those ids that have one; a level's continuation bitmap says which of its entries
go on, and a rank directory holds the number of set bits before every 512th.  Token i is found by one
byte of level 0, its bit and rank, one byte of level 1, and so on: no block is decoded.

File: magic, then segments of at most SEGMENT_TOKENS ids, each with its levels and a document
directory, then a JSON footer with the byte position of every part, its length, magic.  A data set is
a folder of such files, one for each range of doc_id, and a Parquet manifest that names the files of
the attempts that ended well and the number of tokens before each; a lost executor's half-written
files are never named.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows with one
doc_id are ordered by text; an empty table gives an empty data set; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binaries, n_partitions, new_folder, steps, text_buffer
from .fast_tokens import encoder

MAGIC = b"DACTOK01"
SEGMENT_TOKENS = 4 << 20
RANK_EVERY = 512
READ_TOKENS = 1 << 20
MANIFEST = "part int, file string, n_docs long, n_tokens long, bytes long"


# ---------------------------------------------------------------- the code itself


def dac_encode(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the ids: chunks (uint8), bits (packed, little bit order), ranks (uint32, every RANK_EVERY entries)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        per = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8), "bits": bits, "ranks": np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32) if len(per) else per})
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


def dac_decode(levels: list[dict[str, np.ndarray]]) -> np.ndarray:
    """All ids of the levels."""
    out: np.ndarray | None = None
    for lv in reversed(levels):
        here = lv["chunks"].astype(np.uint32)
        if out is not None:
            more = np.unpackbits(lv["bits"], count=len(here), bitorder="little").view(bool)
            here[more] |= out << np.uint32(8)
        out = here
    return out if out is not None else np.zeros(0, np.uint32)


def dac_get(levels: list[dict[str, np.ndarray]], i: int) -> int:
    """Id number i, by one byte a level."""
    value, shift = 0, 0
    for lv in levels:
        value |= int(lv["chunks"][i]) << shift
        if not lv["bits"][i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_EVERY
        lo = block * RANK_EVERY >> 3
        inside = np.unpackbits(lv["bits"][lo : (i >> 3) + 1], bitorder="little")[: i - block * RANK_EVERY]
        i = int(lv["ranks"][block]) + int(inside.sum())
        shift += 8
    raise IndexError("the last level goes on")


# ---------------------------------------------------------------- files


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _Writer:
    def __init__(self, folder: str, part: int) -> None:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}.dac"
        self.out = fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.pos, self.segments, self.n_docs, self.n_tokens = 0, [], 0, 0
        self.put(MAGIC)
        self.docs, self.ids, self.held = [], [], 0

    def put(self, data: bytes) -> list[int]:
        self.out.write(data)
        self.pos += len(data)
        return [self.pos - len(data), len(data)]

    def add(self, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, known, counts))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= SEGMENT_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        doc_ids, known, counts = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        ids = np.concatenate(self.ids)
        seg = {"tokens": len(ids), "docs": len(doc_ids), "first": self.n_tokens}
        seg["doc_ids"], seg["known"], seg["counts"] = self.put(doc_ids.astype("<i8").tobytes()), self.put(np.packbits(known).tobytes()), self.put(counts.astype("<u8").tobytes())
        seg["levels"] = [{k: self.put(v.astype(v.dtype.newbyteorder("<")).tobytes()) for k, v in lv.items()} for lv in dac_encode(ids)]
        self.segments.append(seg)
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)
        self.docs, self.ids, self.held = [], [], 0

    def close(self) -> tuple:
        self.flush()
        foot = json.dumps(self.segments).encode()
        self.put(foot)
        self.put(len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.name, self.n_docs, self.n_tokens, self.pos


_KINDS = {"chunks": np.uint8, "bits": np.uint8, "ranks": np.dtype("<u4")}


class TokenFile:
    """Random access to one file: only the bytes that are needed are read."""

    def __init__(self, uri: str) -> None:
        fs, path = _open(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        tail = self.f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        n = int.from_bytes(tail[:8], "little")
        self.segments = json.loads(self.f.read_at(n, size - 16 - n))

    def part(self, where: list[int], kind=np.uint8) -> np.ndarray:
        return np.frombuffer(self.f.read_at(where[1], where[0]), kind)

    def documents(self, seg: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.unpackbits(self.part(seg["known"]), count=seg["docs"]).view(bool)
        return self.part(seg["doc_ids"], "<i8"), known, self.part(seg["counts"], "<u8").astype(np.int64)

    def ids(self, seg: dict) -> np.ndarray:
        return dac_decode([{k: self.part(v, _KINDS[k]) for k, v in lv.items()} for lv in seg["levels"]])

    def token(self, i: int) -> int:
        """Id number i of the file: one byte, one bitmap byte and at most one rank block a level."""
        seg = self.segments[int(np.searchsorted([s["first"] for s in self.segments], i, side="right")) - 1]
        i -= seg["first"]
        if not 0 <= i < seg["tokens"]:
            raise IndexError(i)
        value, shift = 0, 0
        byte = lambda where, k, n=1: self.f.read_at(n, where[0] + k)
        for lv in seg["levels"]:
            value |= byte(lv["chunks"], i)[0] << shift
            if not byte(lv["bits"], i >> 3)[0] >> (i & 7) & 1:
                return value
            block = i // RANK_EVERY
            lo = block * RANK_EVERY >> 3
            bits = np.unpackbits(np.frombuffer(byte(lv["bits"], lo, (i >> 3) + 1 - lo), np.uint8), bitorder="little")
            i = int.from_bytes(byte(lv["ranks"], 4 * block, 4), "little") + int(bits[: i - block * RANK_EVERY].sum())
            shift += 8
        raise ValueError("the last level goes on")


# ---------------------------------------------------------------- data sets


def _write(folder: str, path: str, end_id: int, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = encoder(path, specials), None
        for batch in batches:
            for part in steps(batch, "text"):
                writer = writer or _Writer(folder, TaskContext.get().partitionId())
                ids, offs = enc.encode(*text_buffer(part.column(1)))
                n = np.diff(offs)
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[offs[1:] + np.arange(len(n))] = False
                out[keep] = ids
                doc = part.column(0)
                writer.add(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False), n + 1, out)
        if writer:
            name, docs, tokens, size = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (docs, tokens, size))], names=["part", "file", "n_docs", "n_tokens", "bytes"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, specials: bool = False) -> DataFrame:
    """Writes the data set in ascending doc_id order; returns its manifest.  With `specials`, strings of special tokens become their ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(n_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_write(folder, tokenizer, end_id, specials), MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row per file: part, file, n_docs, n_tokens, bytes, base (tokens of all files before it)."""
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file only
    return m.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, start = TokenFile(f"{folder}/{row['file']}"), row["base"]
                for seg in file.segments:
                    ids, (docs, known, counts) = file.ids(seg).astype("<u4"), file.documents(seg)
                    offs = np.concatenate([[0], np.cumsum(counts)])
                    i = 0
                    while i < len(docs):
                        j = max(i + 1, int(np.searchsorted(offs, offs[i] + READ_TOKENS, side="right")) - 1)
                        doc = pa.array(docs[i:j], pa.int64(), mask=~known[i:j])
                        part = ids[offs[i] : offs[j]]
                        yield pa.RecordBatch.from_arrays([doc, pa.array(start + offs[i:j]), pa.array(counts[i:j]), binaries(part.view(np.uint8), (offs[i : j + 1] - offs[i]) * 4)], names=["doc_id", "start", "n_tokens", "ids"])
                        i = j
                    start += len(ids)

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document of the data set: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    files = manifest(spark, folder)
    return files.repartition(n_partitions(spark)).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    folder = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
