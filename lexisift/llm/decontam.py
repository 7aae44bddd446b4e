"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of WINDOW consecutive words of the benchmark items (an item of fewer words is
one window of its own length; each length has its own tables).  A shift table over blocks of two
words says how far the search may jump from a text position; only where the shift is 0 are the
patterns in the bucket of that suffix block compared, word by word.  The search runs over many lanes
at once (a lane is a piece of a document, overlapping the next by the window), so that a jump is one
vectorised step for all of them.

Words are told apart by 64-bit hashes of their bytes.  Patterns are sent to the executors in blocks
of at most BLOCK_PATTERNS windows; a longer item is cut into several that share WINDOW - 1 words.  A benchmark of
one block is searched in one pass.  A larger one is searched block by block, a job for each: its hits are written before
the next block is sent, so the driver and every task hold one block at a time.  Hits are narrow rows of the
documents that have any; their runs are merged once all blocks are through.

Defined cases: a null text has no words; items without words have no windows; equal windows of
several items count for each item; items whose item_id is null count as one item that is left out of the
digest of ids; very long texts are searched whole, in lanes; repeated rows are judged each on their own; an empty benchmark
leaves every document clean; an empty table gives no rows; columns of the documents are passed through
under their names by `clean_documents`, whatever they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_class, drop_path, give_back, hash_spans, lists, mix, new_folder, ranges, spans, staged, steps, text_buffer

WINDOW = 13
#: Share of hit words from which a document counts as contaminated: SHARE * n_hit >= n_words.
SHARE = 20
BLOCK_PATTERNS = 500_000
LANE_WORDS = 2048

#: Words are runs of digits, ASCII letters and all bytes beyond ASCII.
WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), negate=True)
#: The same of a text that isn't lower-cased yet.
_WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_C = np.uint64(0x9E3779B97F4A7C15)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text, and their offsets."""
    buf, offs = text_buffer(col)
    buf = LOWER[buf]
    starts, ends, woffs = spans(buf, offs, WORD)
    return hash_spans(buf, starts, ends), woffs


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C + b)


class Patterns:
    """Wu-Manber tables of patterns of one length: (number, length) words and the item of each."""

    def __init__(self, pats: np.ndarray, items: np.ndarray) -> None:
        self.pats, self.items, self.m = pats, items, pats.shape[1]
        self.b = min(2, self.m)
        keys, shifts = [], []
        for end in range(self.b, self.m + 1):
            keys.append(self.block(pats, end))
            shifts.append(np.full(len(pats), self.m - end, np.int64))
        keys, shifts = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((shifts, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.shift = shifts[order][first]
        self.default = self.m - self.b + 1
        suffix = self.block(pats, self.m)
        order = np.argsort(suffix, kind="stable")
        self.pats, self.items, suffix = pats[order], items[order], suffix[order]
        self.suffix, self.first, self.count = np.unique(suffix, return_index=True, return_counts=True)
        #: a bit for each value of a key's low bits: most blocks of a text are not in the table at all
        self.sieve_bits = np.uint64((1 << max(10, int(len(self.keys)).bit_length() + 4)) - 1)
        self.sieve = np.zeros(int(self.sieve_bits) + 1, bool)
        self.sieve[self.keys & self.sieve_bits] = True

    def block(self, seq: np.ndarray, end: int) -> np.ndarray:
        return seq[:, end - 1].copy() if self.b == 1 else _pair(seq[:, end - 2], seq[:, end - 1])

    def find(self, w: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, pattern) of every occurrence."""
        m, step = self.m, LANE_WORDS
        count = np.diff(woffs)
        lanes = np.where(count >= m, -(-(count - m + 1) // step), 0)
        lane_start = np.repeat(woffs[:-1], lanes) + step * (ranges(np.zeros(len(lanes), np.int64), lanes))
        pos = lane_start + m  # the end of the window that is looked at
        stop = np.minimum(lane_start + step + m - 1, np.repeat(woffs[1:], lanes))
        at, pat = [], []
        while len(pos):
            tail = w[pos - 1].copy() if self.b == 1 else _pair(w[pos - 2], w[pos - 1])
            shift = np.full(len(pos), self.default, np.int64)
            near = np.flatnonzero(self.sieve[tail & self.sieve_bits])
            if len(near):
                k = np.minimum(np.searchsorted(self.keys, tail[near]), len(self.keys) - 1)
                hit = self.keys[k] == tail[near]
                shift[near[hit]] = self.shift[k[hit]]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                k = np.searchsorted(self.suffix, tail[zero])
                n = self.count[k]
                p = ranges(self.first[k], n)
                e = np.repeat(pos[zero], n)
                for j in range(m):  # direct comparison, from the front
                    same = w[e - m + j] == self.pats[p, j]
                    e, p = e[same], p[same]
                    if not len(e):
                        break
                at.append(e - m)
                pat.append(p)
                shift[zero] = 1
            pos = pos + shift
            on = pos <= stop
            pos, stop = pos[on], stop[on]
        z = np.zeros(0, np.int64)
        return (np.concatenate(at), np.concatenate(pat)) if at else (z, z)


def compile_patterns(table: pa.Table, window: int) -> list[Patterns]:
    """Tables for each pattern length of a block of benchmark items (item_id string, text)."""
    w, woffs = words(table.column("text"))
    count = np.diff(woffs)
    out = []
    for m in np.unique(np.minimum(count[count > 0], window)):
        mine = np.flatnonzero(np.minimum(count, window) == m)
        n = count[mine] - m + 1
        first = ranges(woffs[:-1][mine], n)
        out.append(Patterns(w[first[:, None] + np.arange(m)], np.repeat(mine, n)))
    return out


def _search(names: list[str], text: int, blocks, fresh: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids = blocks.value
        tables = compile_patterns(block, WINDOW)
        ids = np.array(ids, dtype=object)
        for batch in batches:
            for part in steps(batch, batch.schema.names[text]):
                w, woffs = words(part.column(text))
                hit = np.zeros(len(w) + 1, np.int32)
                found = []
                for t in tables:
                    at, pat = t.find(w, woffs)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + t.m, -1)
                    found.append(np.stack([np.searchsorted(woffs, at, side="right") - 1, t.items[pat]], axis=1))
                covered = np.cumsum(hit[:-1]) > 0
                # words hit, as runs [start, end) within their document
                edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
                cuts = np.zeros(len(w) + 1, bool)
                cuts[woffs] = True
                s = np.flatnonzero((edge[:-1] == 1) | (cuts[:-1] & covered)) if len(w) else np.zeros(0, np.int64)
                e = np.flatnonzero((edge[1:] == -1) | (cuts[1:] & covered)) + 1 if len(w) else np.zeros(0, np.int64)
                doc = np.searchsorted(woffs, s, side="right") - 1
                runs = np.stack([s - woffs[doc], e - woffs[doc]], axis=1).reshape(-1)
                n_runs = np.bincount(doc, minlength=part.num_rows)
                pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
                items = ids[pairs[:, 1]] if len(pairs) else np.zeros(0, object)
                n_items = np.bincount(pairs[:, 0], minlength=part.num_rows) if len(pairs) else np.zeros(part.num_rows, np.int64)
                new = [
                    pa.array(np.diff(woffs), pa.int64()),
                    lists(runs, 2 * np.concatenate([[0], np.cumsum(n_runs)]), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)), pa.array(list(items), pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *fresh])
        give_back()

    return run


def _pieces(text: str, window: int) -> Iterator[tuple[str, int]]:
    """The text in pieces of at most BLOCK_PATTERNS windows, and how many each has at most; together they have its windows."""
    most = len(text) // 2 + 1  # at least as many as its words
    if most <= BLOCK_PATTERNS:
        yield text, most
        return
    at = [m.span() for m in _WORD_RE.finditer(text)]
    windows = max(len(at) - window + 1, min(len(at), 1))
    for k in range(0, windows, BLOCK_PATTERNS):
        upto = min(k + BLOCK_PATTERNS, windows)
        yield text[at[k][0] : at[min(upto + window - 1, len(at)) - 1][1]], upto - k


def _blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[pa.Table, list[str]]]:
    """The items in blocks of at most BLOCK_PATTERNS windows."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held: list[tuple[str, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        for text, n in _pieces(r["text"], window):
            if held and size + n > BLOCK_PATTERNS:
                yield pa.table({"text": pa.array([t for _, t in held])}), [i for i, _ in held]
                held, size = [], 0
            held.append((r["item_id"], text))
            size += n
    yield pa.table({"text": pa.array([t for _, t in held], pa.string())}), [i for i, _ in held]


def merge_runs(runs: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [start, end) of each row, in any order and overlapping, as runs that neither meet nor overlap, in order."""
    n = len(offs) - 1
    if not len(runs):
        return runs, offs
    s, e = runs[0::2], runs[1::2]
    row = np.repeat(np.arange(n), np.diff(offs) // 2)
    order = np.lexsort((s, row))
    base = row * (int(e.max()) + 2)  # rows lie apart
    s, e = s[order] + base, np.maximum.accumulate(e[order] + base)
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    last = np.append(first[1:], len(s)) - 1
    out = np.stack([s[first] - base[first], e[last] - base[first]], axis=1).reshape(-1)
    return out, np.concatenate([[0], np.cumsum(2 * np.bincount(row[first], minlength=n))])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column(1)
        values, offs = merge_runs(runs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(values, offs, pa.int64()), batch.column(2)], names=batch.schema.names)


def _counted(names: list[str], text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, names[text]):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(words(part.column(text))[1]), pa.int64())], names=[*names, "n_words"])
        give_back()

    return run


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _found(source: DataFrame, text: int, sent) -> DataFrame:
    return source.mapInArrow(_search(source.columns, text, sent, [f.name for f in _FOUND]), T.StructType([*source.schema.fields, *_FOUND]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The given columns (at first doc_id) of the documents, then, under names that none of them has:
    number of words, runs of hit words [start, end) in a row, sorted item_ids with occurring windows."""
    columns = ["doc_id"] if columns is None else columns
    spark = docs.sparkSession
    k = len(columns)
    named = docs.select(*[docs[c] for c in columns], docs["text"].cast("string")).toDF(*[f"c{i}" for i in range(k)], "text")
    blocks = _blocks(benchmark, WINDOW)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        out = _found(named, k, spark.sparkContext.broadcast(block))
    else:
        out = _by_blocks(named, k, chain([block, following], blocks))
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def _by_blocks(named: DataFrame, k: int, blocks) -> DataFrame:
    """The documents (columns, text at place k) with what all blocks find, each in a job of its own."""
    spark = named.sparkSession
    counted = named.mapInArrow(_counted(named.columns, k), T.StructType([*named.schema.fields, _FOUND[0]]))
    numbered = staged(counted.withColumn("row", F.monotonically_increasing_id()), "numbered")
    where = new_folder(spark, "hits")
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        _found(numbered.select("row", "text"), 1, sent).where("size(runs) > 0").select("row", "runs", "items").write.mode("append").parquet(where)
        sent.destroy()
    hits = spark.read.schema("row long, runs array<long>, items array<string>").parquet(where)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))  # a document's
    merged = staged(hits.mapInArrow(_merge, hits.schema), "hits")
    drop_path(spark, where)
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return numbered.join(merged, "row", "left").select(*[f"c{i}" for i in range(k)], "text", "n_words", none("runs", "long"), none("items", "string"))


def _hit_words() -> "F.Column":
    """Number of different words in the runs; runs of several blocks may overlap."""
    n = F.expr("""aggregate(array_sort(transform(sequence(0, size(runs) div 2 - 1), i -> struct(runs[2 * i] as s, runs[2 * i + 1] as e))),
        struct(0L as n, 0L as upto), (a, r) -> struct(a.n + greatest(0L, r.e - greatest(r.s, a.upto)) as n, greatest(a.upto, r.e) as upto), a -> a.n)""")
    return F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(n)


def _judged(found: DataFrame) -> DataFrame:
    return found.withColumn("n_hit", _hit_words()).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _passage(words: int) -> "F.Column":
    """Whether some run of hit words in a row has so many words."""
    return F.exists(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.get("runs", i + 1) - F.get("runs", i) >= words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, passage: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated and hold no run of `passage` hit words, however long they are, with all their columns."""
    columns = docs.columns
    held = F.when(F.size("runs") > 0, _passage(passage)).otherwise(F.lit(False))
    found = _judged(find_contamination(docs, benchmark, columns)).where(~F.col("contaminated") & ~held)
    return found.select(*[F.col(f"c{i}") for i in range(len(columns))]).toDF(*columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return _judged(found).select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
g AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT g.r, g.i, g.m, p.item FROM g JOIN p ON g.g = p.g AND g.m = p.m),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
