"""Audit of the sources of each language: how far their use of words differs.

A byte-level tokenizer finds the terms: a lookup table over the concatenated UTF-8 buffer of many texts
gives their boundaries, XXH64 (in numpy for short slices) groups equal slices, and every slice is
compared byte for byte with its group's first one, so that no count rests on a hash alone.  Rows of
(lang, source, term, occurrences, documents) leave a task; the terms of enough documents of their
language are kept.

Divergences of all pairs of a language's sources come from blocks of terms.  A block is a CSR matrix of
sources x terms; of a pair, the terms that either source has are summed by reduceat over the matrix,
all others are one number times their count.  So a pair costs as much as its sources have terms, not
as the language has.  Blocks are dealt by a hash of the term; the few numbers that leave them are
summed.  All arithmetic is on whole numbers: a chance is 1 + floor(10^9 (count + 1) / (N + V)), divided in
two steps, exact while counts stay below 9 * 10^13.

Defined cases: a null text, lang or source is the empty string; texts without terms make an occurring
(lang, source) group all the same; repeated rows are documents of their own; a language without kept
terms has pairs of value 0 and no terms; a language of one source has no pairs; bytes that are no UTF-8
don't occur in a string column; texts of any length are read whole, a step of at least one text at a
time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, binaries, byte_class, give_back, ranges, spans, staged, steps, text_buffer

LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: The unit of a chance, and the two steps in which it is divided.
UNIT, FIRST, SECOND = 1_000_000_000, 100_000, 10_000
#: Counts (source, term) of a block of terms, on average.
BLOCK_COUNTS = 200_000
#: Numbers of an outer product made at once.
CELLS = 1 << 21

#: ASCII letters and every byte of a character beyond ASCII.
TERM = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F), negate=True)

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice: those below 32 bytes all at once, longer ones by the library."""
    n = ends - starts
    h = _P5 + n.astype(np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=padded.data, strides=(1,))
    four = np.ndarray((len(buf) + 1,), "<u4", buffer=padded.data, strides=(1,))
    at, short = starts.copy(), n < 32
    while len(on := np.flatnonzero(short & (ends - at >= 8))):
        h[on] = _turn(h[on] ^ (_turn(eight[at[on]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[on] += 8
    on = np.flatnonzero(short & (ends - at >= 4))
    h[on] = _turn(h[on] ^ (four[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[on] += 4
    while len(on := np.flatnonzero(short & (at < ends))):
        h[on] = _turn(h[on] ^ (buf[at[on]].astype(np.uint64) * _P5), 11) * _P1
        at[on] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def equal_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the slice that stands for each group of equal ones, and each slice's group."""
    _, first, which = np.unique(xxh64(buf, starts, ends), return_index=True, return_inverse=True)
    size, lead = ends - starts, first[which]
    same = size == size[lead]
    on = np.flatnonzero(same & (lead != np.arange(len(lead))))
    if len(on):
        bytes_equal = buf[ranges(starts[on], size[on])] == buf[ranges(starts[lead[on]], size[on])]
        same[on] = np.logical_and.reduceat(bytes_equal, np.cumsum(size[on]) - size[on])
    if not same.all():  # slices that share a hash with another one get groups of their own
        known: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same):
            word = buf[starts[i] : ends[i]].tobytes()
            if word not in known:
                known[word] = len(first) + len(more)
                more.append(i)
            which[i] = known[word]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return first, which


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to (lang, source, term, n, docs), summed over a step's texts."""
    for batch in batches:
        for part in steps(batch, "text"):
            buf, offs = text_buffer(part.column(2))
            buf = LOWER[buf]
            starts, ends, woffs = spans(buf, offs, TERM)
            if not len(starts):
                continue
            names: dict[tuple[str, str], int] = {}
            of_row = np.array([names.setdefault(k, len(names)) for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
            first, which = equal_slices(buf, starts, ends)
            row = np.repeat(np.arange(len(of_row)), np.diff(woffs))
            # one number for (group, term, row), sorted: a document's terms lie together, then a group's
            seen, times = np.unique((of_row[row] * len(first) + which) * len(of_row) + row, return_counts=True)
            key, at = np.unique(seen // len(of_row), return_index=True)
            n, docs = np.add.reduceat(times, at), np.diff(np.append(at, len(seen)))
            take, term = pa.array(key // len(first)), first[key % len(first)]
            sizes = ends[term] - starts[term]
            words = binaries(buf[ranges(starts[term], sizes)], np.concatenate([[0], np.cumsum(sizes)])).cast(pa.string())
            lang, source = (pa.array([k[i] for k in names], pa.string()).take(take) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, words, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])
        give_back()


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term)."""
    rows = docs.select(_text("lang"), _text("source"), _text("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def whole(a: Column, b: Column) -> Column:
    """a div b of whole numbers that aren't negative."""
    return F.call_function("div", a, b)


def chance(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (N + V)), divided in two steps so that no product overflows."""
    over, by = count + 1, total + terms
    return whole(over * FIRST, by) * SECOND + whole(F.pmod(over * FIRST, by) * SECOND, by) + 1


def chances(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    over, by = (count + 1) * FIRST, total + terms
    return over // by * SECOND + over % by * SECOND // by + 1


def _divergences(lang: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of a language's terms: for each ordered pair of its sources the block's share of the sum of f."""
    name, block = lang[0].as_py(), lang[1].as_py()
    groups = groups.combine_chunks().sort_by("source")
    sources, total = groups.column("source"), groups.column("total").to_numpy()
    k = len(sources)
    value = np.zeros((k, k), np.int64)
    if rows.num_rows:
        rows = rows.combine_chunks()
        v = int(groups.column("terms")[0].as_py())
        term = rows.column("term").combine_chunks().dictionary_encode()
        index, width = term.indices.to_numpy(), len(term.dictionary)
        at = pc.index_in(rows.column("source"), sources).to_numpy()
        order = np.lexsort((index, at))
        index, at, count = index[order], at[order], rows.column("n").to_numpy()[order]
        indptr = np.searchsorted(at, np.arange(k + 1))
        p, none = chances(count, total[at], v), chances(np.zeros(k, np.int64), total, v)
        have, full = np.diff(indptr), np.diff(indptr) > 0
        f = lambda a, b: (a - b) * (a - b) // b
        for s in range(k):
            mine = slice(indptr[s], indptr[s + 1])
            dense, has = np.full(width, none[s]), np.zeros(width, bool)
            dense[index[mine]], has[index[mine]] = p[mine], True
            # what the other source has, then what only this one has, then what neither has
            both = has[index]
            theirs = f(dense[index], p)
            theirs[both] -= f(dense[index[both]], none[at[both]])
            total_f = np.zeros(k, np.int64)
            shared = np.zeros(k, np.int64)
            total_f[full] = np.add.reduceat(theirs, indptr[:-1][full])
            shared[full] = np.add.reduceat(both.astype(np.int64), indptr[:-1][full])
            step = max(1, CELLS // k)
            for lo in range(indptr[s], indptr[s + 1], step):
                total_f += f(p[lo : min(lo + step, indptr[s + 1]), None], none[None, :]).sum(axis=0)
            total_f += (width - have - have[s] + shared) * f(none[s], none)
            value[s] = total_f
    i, j = np.nonzero(~np.eye(k, dtype=bool)) if block == 0 else np.nonzero((value != 0) & ~np.eye(k, dtype=bool))
    take = lambda x: sources.take(pa.array(x))
    return pa.table({"lang": pa.array([name] * len(i), pa.string()), "source": take(i), "item": take(j), "value": pa.array(value[i, j])})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: a source's divergence from each other source of its language,
    and the terms that it uses more than its language does."""
    of_term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(of_term), "in_lang": F.sum("n").over(of_term)}).where(F.col("in_docs") >= least)
    kept = staged(kept.select("lang", "source", "term", "n", "in_lang"), "terms")
    terms = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_text("lang"), _text("source")).distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = staged(groups.na.fill(0, ["total", "terms", "lang_total"]), "sources")
    blocks = max(1, -(-kept.count() // BLOCK_COUNTS))
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "source", "term", "n")
    every = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", "total", "terms")
    parts = dealt.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInArrow(_divergences, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    p, q = chance(F.col("n"), F.col("total"), F.col("terms")), chance(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    rated = kept.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    rated = rated.select("lang", "source", F.col("term").alias("item"), whole((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, rated = pairs.withColumn("rank", F.row_number().over(order)), rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*cols).unionByName(rated.select(*cols))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TERM_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERM_SQL} AS w FROM documents),
u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM u JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(y.n, 0)::BIGINT AS total, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) y USING (lang, source) LEFT JOIN v ON v.lang = x.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT} * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
l AS (SELECT lang, term, 1 + ({UNIT} * (sum(n)::BIGINT + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::BIGINT AS q FROM c GROUP BY lang, term),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP_TERMS}"""
