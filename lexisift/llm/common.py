"""Shared plumbing of the training-data operators: staged tables and vectorised byte-level text tools.

Staged tables are Parquet folders below ``spark.checkpoint.dir`` (the folder that every executor
shares); they cut lineage and survive lost executors.  The byte tools work on the contiguous UTF-8
buffer of an Arrow string column, so no Python string is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 2 << 20
#: Rows of one vectorised step at most (keeps row numbers in 16 bits).
STEP_ROWS = 8192


# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a session that names none (tests) gets a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="lexisift-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table."""
    path = new_folder(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexisift_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    path = getattr(df, "_lexisift_path", None)
    if path:
        drop_path(df.sparkSession, path)


#: Staged tables of the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end the tables staged inside are removed, but for those given to what it yields, which an outer scope then owns."""
    mine: list[str] = []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        path = getattr(df, "_lexisift_path", None)
        if path in mine:
            mine.remove(path)
            if len(_scopes) > 1:
                _scopes[-2].append(path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for path in mine:
            drop_path(spark, path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow text buffers


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
        empty = ""
    else:
        col = col.cast(pa.large_binary())
        empty = b""
    if col.null_count:
        col = col.fill_null(empty)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most STEP_BYTES of text each (or one row)."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + STEP_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n, i + STEP_ROWS)
        yield batch.slice(i, j - i)
        i = j


def give_back() -> None:
    """Returns freed memory to the system, so that a reused Python worker doesn't hold its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_text(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow over bounded steps; with setup, fn also gets what it returned in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in steps(batch, text):
                yield fn(part, state) if setup else fn(part)
        give_back()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- words and hashes


def byte_class(*ranges: tuple[int, int], negate: bool = False) -> np.ndarray:
    lut = np.zeros(256, bool)
    for lo, hi in ranges:
        lut[lo : hi + 1] = True
    return ~lut if negate else lut


#: A-Z to a-z, all else kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but ASCII white space.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), negate=True)


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class `inside` in each text: starts, ends, and offsets[n+1] of each text's runs."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    st = np.empty(n, bool)
    st[0] = True
    np.logical_not(m[:-1], out=st[1:])
    st |= edge[:n]
    st &= m
    en = np.empty(n, bool)
    en[-1] = True
    np.logical_not(m[1:], out=en[:-1])
    en |= edge[1:]
    en &= m
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Bytes up to which spans are hashed piece after piece.
LONG_SPAN = 64
_C1, _C2, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _K
    x ^= x >> np.uint64(31)
    return x


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a time over all spans at once."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.ndarray((len(buf) + 1,), "<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64)
    h *= _C1
    h ^= view[starts] & _MASK[np.minimum(length, 8)]
    mix(h)
    at, more = 8, np.flatnonzero((length > 8) & (length <= LONG_SPAN))
    while len(more):
        part = h[more] * _C1
        part ^= view[starts[more] + at] & _MASK[np.minimum(length[more] - at, 8)]
        h[more] = mix(part)
        at += 8
        more = more[length[more] > at]
    big = np.flatnonzero(length > LONG_SPAN)
    if len(big):  # all their pieces at once, each weighed by its place
        n = (length[big] + 7) // 8
        place = ranges(np.zeros(len(big), np.int64), n)
        x = view[np.repeat(starts[big], n) + 8 * place] & _MASK[np.minimum(np.repeat(length[big], n) - 8 * place, 8)]
        x ^= (place.astype(np.uint64) + np.uint64(1)) * _K
        h[big] = mix(h[big] * _C1 + np.add.reduceat(mix(x * _C1), np.cumsum(n) - n))
    return h


def grams(words: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles (fewer words: the whole sequence as one), and their offsets."""
    count = np.diff(woffs)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(have)])
    first = np.repeat(woffs[:-1] - offs[:-1], have) + np.arange(offs[-1])
    span = np.minimum(count, n)
    h = words[first] if len(first) else np.zeros(0, np.uint64)
    width = np.repeat(span, have)
    for k in range(1, n):
        if len(h) == 0:
            break
        if (width > k).all():
            h = mix(h * _C1 + words[first + k])
        else:
            on = np.flatnonzero(width > k)
            h[on] = mix(h[on] * _C1 + words[first[on] + k])
    return h, offs


def distinct_in(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their offsets."""
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint16), np.diff(offs))
    order = np.argsort(h)
    order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    if len(h):
        keep = np.empty(len(h), bool)
        keep[0] = True
        np.not_equal(h[1:], h[:-1], out=keep[1:])
        keep[1:] |= row[1:] != row[:-1]
        h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(offs)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c)."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    offs = np.cumsum(counts) - counts
    return np.repeat(starts - offs, counts) + np.arange(total)


def lists(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column from flat bytes and byte offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
