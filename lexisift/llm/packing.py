"""Packing: bounded-space online packing of token ids into windows of fixed size.

Each partition keeps a fixed number of open windows.  A document's ids (with the end id) give whole
windows first; the rest goes best-fit into the open window with the least room that still holds it.
When none fits, the fullest window is topped up with the head of the rest and emitted, so an emitted
window is always full.  At the end of a partition the leftovers are merged: concatenated, cut into
full windows, and the last odd ids into windows of powers of two, which need no padding.

No shuffle and no state beyond `open_windows * size` ids per task.  A window's id is made of the
partition's number and a counter, so a repeated task gives the same rows.

Defined cases: a null or empty text is the end id alone; a very long text is cut into whole windows and a rest;
of open windows with equal room the first takes a piece; repeated rows are packed each on their own;
a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, give_back, steps, text_buffer
from .fast_tokens import encoder

SIZE, OPEN_WINDOWS = 2048, 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Bounded-space best-fit packing; `emit` gets (window id, [(doc, start, ids, doc_tokens), ...])."""

    def __init__(self, size: int, open_windows: int, base: int) -> None:
        self.size, self.next = size, base
        self.pieces: list[list[tuple]] = [[] for _ in range(open_windows)]
        self.free = [size] * open_windows
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start, size = len(ids), 0, self.size
        while total - start >= size:
            self.emit([(doc, start, ids[start : start + size], total)])
            start += size
        while start < total:
            need = total - start
            fits = [f for f in self.free if f >= need]
            if fits:
                k = self.free.index(min(fits))
                take = need
            else:
                k = self.free.index(min(self.free))
                take = self.free[k]
            self.pieces[k].append((doc, start, ids[start : start + take], total))
            self.free[k] -= take
            start += take
            if self.free[k] == 0:
                self.emit(self.pieces[k])
                self.pieces[k], self.free[k] = [], size

    def finish(self) -> None:
        """Merges the leftovers of all open windows."""
        rest = [p for pieces in self.pieces for p in pieces]
        left = sum(len(p[2]) for p in rest)
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = rest[0]
                take = min(room, len(ids))
                window.append((doc, start, ids[:take], total))
                room -= take
                if take == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + take, ids[take:], total)
            self.emit(window)

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        data = np.concatenate([r[2] for r in rows]).astype("<u4") if rows else np.zeros(0, "<u4")
        col = lambda k: pa.array([r[k] for r in rows], pa.int64())
        ids = binaries(data.view(np.uint8), np.concatenate([[0], np.cumsum(sizes * 4)]))
        return pa.RecordBatch.from_arrays([col(0), col(1), pa.array(sizes, pa.int64()), ids, col(3), col(4), col(5)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_ids(size: int, open_windows: int, path: str, end_id: int, specials: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path, specials), Packer(size, open_windows, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, offs = enc.encode(*text_buffer(part.column(1)))
                # the end id goes after each document's ids
                n = np.diff(offs)
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[offs[1:] + np.arange(len(n))] = False
                out[keep] = ids
                at = offs + np.arange(len(offs))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    packer.add(doc, out[at[k] : at[k + 1]])
                if packer.rows:
                    yield packer.drain()
        packer.finish()
        if packer.rows:
            yield packer.drain()
        give_back()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, open_windows: int = OPEN_WINDOWS, specials: bool = False) -> DataFrame:
    """A row per piece: doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset (in the window).  With `specials`,
    strings of special tokens in a text become their ids."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack_ids(size, open_windows, tokenizer, end_id, specials), SCHEMA)


def op8(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
