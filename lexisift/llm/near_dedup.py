"""Near-duplicate documents by min-max hashing.

A document's set is its distinct n-word shingles.  Under each permutation both the least and the
greatest hash are kept, so one hash evaluation gives two signature slots.  Bands of slots propose
pairs; links are confirmed on the full sets.

No group is spread out into all its pairs.  In a bucket each member is first paired with the
bucket's centre only, the text that meets most others over all buckets.  Confirmed links make
components.  Where a bucket still holds several components, the members outside its largest one are
compared with all members, in blocks inside a task, at the first band where both agree; only one
link for each component met is emitted.  So every pair of different texts that shares a bucket is
either compared or already joined by a path of confirmed links, and no pair is dropped.

A text is known by 128 bits, two hashes of its bytes.  Its node is the first of them; texts that share it but differ in the
second, which is looked up, get nodes made of both, so equal texts only are one node.  With 28 bands of 5 slots a
pair of similarity 0.8 is missed with probability 2e-5.

Defined cases: texts without words (null, empty, white space) have empty sets and link with nothing;
equal texts with words are linked; rows with a null doc_id take part, count as no smallest doc_id,
and are kept only where a component has no other id; where several texts of a component have its least
doc_id, or none has one, that with the least node is kept; repeated rows share their component; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, distinct_in, grams, hash_spans, lists, map_text, mix, ranges, scope, spans, staged, steps, text_buffer
from .graph import connected_components

BANDS, ROWS = 28, 5
#: Least similarity, as a fraction: 100 * intersection >= 80 * union.
SIMILAR = (80, 100)
#: Texts of a block about, and the bytes of text from which there are more blocks (a longer text counts for itself).
QUERY_BLOCK, MEMBER_BLOCK = 512, 2048
QUERY_BYTES, MEMBER_BYTES = 8 << 20, 32 << 20
#: Rows of two numbers up to which the candidates' keys are sent to all executors.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240607)
_N = BANDS * ROWS // 2
_XOR = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Slots in the order of the bands: no band has both ends of one permutation more often than it must.
_ORDER = np.concatenate([np.arange(_N), np.arange(_N, 2 * _N)]).reshape(2, _N).T.reshape(-1)[np.argsort(np.arange(2 * _N) % BANDS, kind="stable")]


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles (with repeats) and their offsets."""
    buf, offs = text_buffer(col)
    buf = LOWER[buf]
    starts, ends, woffs = spans(buf, offs, NOT_SPACE)
    return grams(hash_spans(buf, starts, ends), woffs, n)


def minmax_bands(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) band hashes as int64; every text must have a shingle."""
    at = offs[:-1]
    slots = np.empty((2 * _N, len(at)), np.uint64)
    x = np.empty_like(h)
    for k in range(_N):
        np.bitwise_xor(h, _XOR[k], out=x)
        x *= _MUL[k]
        x ^= x >> np.uint64(29)
        slots[k] = np.minimum.reduceat(x, at)
        slots[_N + k] = np.maximum.reduceat(x, at)
    slots = slots[_ORDER].reshape(BANDS, ROWS, len(at))
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(at), axis=1)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + slots[:, r])
    return out.T.view(np.int64) if out.T.flags.c_contiguous else np.ascontiguousarray(out.T).view(np.int64)


def _signatures(n: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        h, offs = shingles(part.column(3), n)
        size = np.diff(distinct_in(h, offs)[1])
        full = np.flatnonzero(np.diff(offs))
        bands = minmax_bands(h, np.append(offs[:-1][full], len(h))) if len(full) else np.zeros((0, BANDS), np.int64)
        counts = np.where(size > 0, BANDS, 0)
        return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size, pa.int64()), lists(bands.reshape(-1), np.concatenate([[0], np.cumsum(counts)]), pa.int64())], names=["doc_id", "h1", "h2", "n_shingles", "bands"])

    return run


def overlap(ha: np.ndarray, oa: np.ndarray, hb: np.ndarray, ob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the i-th sets, whose members may be given more than once."""
    n = len(oa) - 1
    rows = np.arange(n, dtype=np.uint16)
    row = np.concatenate([np.repeat(rows, np.diff(oa)), np.repeat(rows, np.diff(ob))])
    h = np.concatenate([ha, hb])
    if not len(h):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    side = np.ones(len(h), np.uint8)
    side[len(ha) :] = 2
    order = np.argsort(h)
    order = order[np.argsort(row[order], kind="stable")]
    h, row, side = h[order], row[order], side[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    sides = np.bitwise_or.reduceat(side, first)
    return np.bincount(row[first[sides == 3]], minlength=n), np.bincount(row[first], minlength=n)


def _confirm(n: int, num: int, den: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        both, either = overlap(*shingles(part.column(2), n), *shingles(part.column(3), n))
        ok = pa.array((den * both >= num * either) & (either > 0))
        return part.select(["a", "b"]).filter(ok)

    return run


def _confirm_blocks(n: int, num: int, den: int):
    """One block of a bucket: its queries against its members; a link for each other component met."""

    def run(key, table):
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        node, label, query, bucket, banded = get("node"), get("label"), get("query").astype(bool), get("unit")[0], get("banded")[0]
        bands = np.stack(get("bands"))
        h, o = distinct_in(*shingles(table.column("text"), n))
        words, ids = np.unique(h, return_inverse=True)
        size = np.diff(o)
        members = np.flatnonzero(~query)
        mo = np.concatenate([[0], np.cumsum(size[members])])
        mids = ids[ranges(o[:-1][members], size[members])]
        outside = get("outside").astype(bool)[members]
        flag = np.zeros(len(words), np.int64)
        a, b = [], []
        for q in np.flatnonzero(query):
            same = bands[members] == bands[q]
            # a pair that shares several buckets is compared in the first of them
            here = bands[q][same.argmax(axis=1)] == bucket if banded else True
            go = np.flatnonzero(same.any(axis=1) & here & (label[members] != label[q]) & ~(outside & (node[members] < node[q])))
            if not len(go):
                continue
            own = ids[o[q] : o[q + 1]]
            flag[own] = 1
            both = np.concatenate([[0], np.cumsum(flag[mids])])
            both = both[mo[go + 1]] - both[mo[go]]
            flag[own] = 0
            go = go[den * both >= num * (size[q] + size[members[go]] - both)]
            got = members[go]
            _, once = np.unique(label[got], return_index=True)
            a += [node[q]] * len(once)
            b += list(node[got[once]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def hashes(text: Column) -> list[Column]:
    """The two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """A row per document: doc_id, h1, h2, node (of its text), n_shingles, component_id, kept."""
    with scope(docs.sparkSession) as keep:
        return _near_duplicates(docs, shingle_words, similar, keep)


def _near_duplicates(docs: DataFrame, shingle_words: int, similar: tuple[int, int], keep) -> DataFrame:
    num, den = similar
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes(text), text.alias("text"))
    sigs = keep(staged(map_text(rows, "doc_id long, h1 long, h2 long, n_shingles long, bands array<long>", _signatures(shingle_words)), "signatures"))
    clash = sigs.where("n_shingles > 0").groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo != hi")
    clash = keep(staged(clash.select("h1", F.lit(True).alias("clash")), "clashes"))
    if clash.isEmpty():
        rows, sigs = (df.withColumn("node", F.col("h1")) for df in (rows, sigs))
    else:
        rows, sigs = (df.join(clash, "h1", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("clash") for df in (rows, sigs))
    # one row per different text; rep finds its text again
    rep = F.coalesce("doc_id", F.lit(-(1 << 63)))
    nodes = sigs.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(rep).alias("rep"), F.first("bands").alias("bands"))
    keys = nodes.select("node", "rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = Observation()
    buckets = staged(keys.join(shared, "key").observe(met, F.count("*").alias("n")), "buckets")
    if met.get["n"]:
        labels = connected_components(_links(rows, sigs, buckets, shingle_words, num, den))
        joined = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
        joined = keep(staged(joined, "components"))
        first = joined.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))).alias("first"))
        first = first.select("label", F.col("first.least").alias("component_id"), F.col("first.node").alias("keeper"))
        joined = joined.join(first, "label").select("node", "component_id", "keeper")
    else:
        joined = nodes.select("node", F.col("least").alias("component_id"), F.col("node").alias("keeper"))
    alone = F.col("n_shingles") == 0
    out = sigs.select("doc_id", "h1", "h2", "node", "n_shingles").join(joined, "node", "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | (F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "h1", "h2", "node", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _links(rows: DataFrame, sigs: DataFrame, buckets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) that join exactly the components of all confirmed pairs."""
    weight = buckets.groupBy("node", "rep").agg(F.sum("n").alias("w"))
    weight = staged(weight, "weights")
    # the texts of the nodes that share a bucket, once
    rep = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    wanted = weight.select("node", "rep")
    if weight.count() <= BROADCAST_ROWS:  # a table of two numbers a row; beyond that a shuffle join
        wanted = F.broadcast(wanted)
    found = rows.withColumn("rep", rep).join(wanted, ["rep", "node"], "left_semi").dropDuplicates(["rep", "node"])
    texts = staged(found.select("node", F.octet_length("text").alias("bytes"), "text"), "texts")
    best = buckets.select("key", "node").join(weight.select("node", "w"), "node").groupBy("key").agg(F.max(F.struct("w", "node"))["node"].alias("a"))
    pairs = staged(buckets.select("key", F.col("node").alias("b")).join(best, "key").where("a != b").select("a", "b").distinct(), "pairs")
    sided = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    first = staged(map_text(sided.select("a", "b", "ta", "tb"), "a long, b long", _confirm(n, num, den), text="ta"), "links")
    labels = connected_components(first)
    named = buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    per = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_ = per.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
    open_ = open_.select("key", F.col("top.label").alias("b_major"), (F.col("all") - F.col("top.n")).alias("b_asks"), F.col("all").alias("b_all"))
    left = Observation()
    rest = staged(named.join(open_, "key").observe(left, F.count("*").alias("n")), "open")
    if not left.get["n"]:
        return first
    # all buckets that hang together, as one unit: each text is sent once, where that costs few more comparisons
    groups = connected_components(pairs)
    placed = rest.join(groups.select("node", F.col("label").alias("grp")), "node").join(texts.select("node", "bytes"), "node")
    inside = placed.select("grp", "node", "label", "bytes").distinct()
    tops = inside.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top"))
    tops = tops.select("grp", "all", (F.col("all") - F.col("top.n")).alias("asks"), F.col("top.label").alias("major"))
    by_bucket = placed.select("grp", "key", (F.col("b_all") * F.col("b_asks")).alias("c")).distinct().groupBy("grp").agg(F.sum("c").alias("cost"))
    tops = tops.join(by_bucket, "grp").withColumn("whole", F.col("all") * F.col("asks") <= 4 * F.col("cost"))
    tops = staged(tops.select("grp", "all", "asks", "major", "whole"), "units")
    one = inside.join(tops.where("whole"), "grp").select(F.col("grp").alias("unit"), "node", "label", "bytes", "major", F.lit(False).alias("banded"))
    many = placed.join(tops.where("not whole").select("grp"), "grp", "left_semi").select(F.col("key").alias("unit"), "node", "label", "bytes", F.col("b_major").alias("major"), F.lit(True).alias("banded"))
    units = one.unionByName(many).withColumn("outside", F.col("label") != F.col("major"))
    # blocks by texts and by their bytes, whichever are more
    enough = lambda of, texts, size: F.greatest(F.ceil(F.count(of) / texts), F.ceil(F.sum(of) / size)).cast("int")
    sizes = units.groupBy("unit", "banded").agg(enough(F.when(F.col("outside"), F.col("bytes")), QUERY_BLOCK, QUERY_BYTES).alias("nq"), enough(F.col("bytes"), MEMBER_BLOCK, MEMBER_BYTES).alias("nm"))
    units = units.join(sizes, ["unit", "banded"])
    units = staged(units.select("unit", "node", "label", "outside", "banded", "nq", "nm"), "blocks")
    spot = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    members = units.select("unit", "node", "label", "outside", "banded", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), spot("nm").alias("mb"))
    asks = units.where("outside").select("unit", "node", "label", "outside", "banded", F.lit(True).alias("query"), spot("nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"))
    signed = sigs.join(texts.select("node"), "node", "left_semi").groupBy("node").agg(F.first("bands").alias("bands"))
    known = texts.drop("bytes").join(signed, "node")
    full = members.unionByName(asks).join(known, "node")
    second = full.groupBy("unit", "banded", "qb", "mb").applyInArrow(_confirm_blocks(n, num, den), "a long, b long").distinct()
    return staged(first.unionByName(second), "links")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs by shared shingles; for small tables.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 2) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def keep_one(docs: DataFrame, shingle_words: int = 5, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id, with all its columns;
    of equal rows with that doc_id one stays.  Texts without words all stay."""
    columns = docs.columns
    with scope(docs.sparkSession) as keep:
        found = near_duplicates(docs, shingle_words, similar)
        chosen = found.where("kept or n_shingles = 0").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
        again = ((F.col("n") > 1) & (F.col("size") > 0)).alias("again")
        chosen = keep(staged(chosen.select(F.col("doc_id").alias("o_doc"), F.col("h1").alias("o_h1"), F.col("h2").alias("o_h2"), again), "kept"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    cols = [f"c{i}" for i in range(len(columns))]
    named = docs.select(*[docs[c] for c in columns], docs["doc_id"].cast("long"), *hashes(text)).toDF(*cols, "k_doc", "k_h1", "k_h2")
    joined = named.join(chosen, F.col("k_doc").eqNullSafe(F.col("o_doc")) & (F.col("k_h1") == F.col("o_h1")) & (F.col("k_h2") == F.col("o_h2")))
    if chosen.where("again").limit(1).count():  # repeated rows: one of each stays
        order = Window.partitionBy("k_doc", "k_h1", "k_h2").orderBy(*[F.col(c).cast("string") for c in cols])
        once = joined.where("again").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
        joined = joined.where("not again").unionByName(once)
    return joined.select(*[F.col(f"c{i}") for i in range(len(columns))]).toDF(*columns)
