"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its PREFIX nearest reference points (pivots) in order.  Inverted lists hold,
for each label and pivot, the vectors that have it in their prefix.  Two vectors of one list are
candidates when their prefixes share at least SHARED pivots; a pair is looked at only in the list of
the least pivot they share, and then verified by cosine in double precision.

Pivots are a bounded sample: the vectors with the least hashes, PIVOTS(n) of them, at most 8192.
Lists are cut into blocks of at most BLOCK vectors and pairs of blocks are compared inside a task; what
leaves it is a number of links for each vector and a spanning forest of the links, so a list of n
vectors never becomes n * n rows.  Equal vectors of a label are one node with a weight.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing; only vectors of the same length are compared; equal vectors link;
repeated rows count as vectors of their own; a null vec_id counts as no smallest id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, staged
from .graph import connected_components

SIMILAR = 0.93
PREFIX, SHARED, BLOCK = 8, 2, 1024


def pivot_count(n: int) -> int:
    """Grows as the root of the rows, so that lists do too."""
    return max(1, min(n, 8192, max(128, 2 * math.isqrt(n))))


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each vector, nearest first, ties by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int32)


def _describe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = {d: unit(np.array(p)) for d, p in shared.value.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                dims = part.column(1).value_lengths().to_numpy()
                for d in np.unique(dims):
                    rows = part.filter(pa.array(dims == d))
                    if d in pivots:
                        near = nearest_pivots(unit(matrix(rows.column(1))), pivots[d], PREFIX)
                    else:  # no pivot of this length in the sample: one list for all of them
                        near = np.zeros((rows.num_rows, 1), np.int32)
                    offs = np.arange(rows.num_rows + 1, dtype=np.int32) * near.shape[1]
                    prefix = pa.ListArray.from_arrays(pa.array(offs), pa.array(near.reshape(-1), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, prefix], names=[*rows.schema.names, "prefix"])

    return run


def spanning_forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (u, v) that join the components of a symmetric matrix of links."""
    left = np.ones(len(near), bool)
    us, vs = [], []
    for i in np.flatnonzero(near.any(axis=1)):
        if not left[i]:
            continue
        left[i] = False
        todo = [int(i)]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(near[u] & left)
            left[new] = False
            us += [u] * len(new)
            vs += new.tolist()
            todo += new.tolist()
    return us, vs


def _compare(similar: float, shared: int):
    def run(key, table):
        table = table.combine_chunks()
        pivot = table.column("pivot")[0].as_py()
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        node, weight, second = (table.column(c).to_numpy() for c in ("node", "weight", "second"))
        x, prefix = unit(matrix(table.column("embedding"))), matrix(table.column("prefix")).astype(np.int64)
        need = min(shared, prefix.shape[1])
        names, local = np.unique(prefix, return_inverse=True)
        has = np.zeros((len(node), len(names)), np.float32)
        has[np.arange(len(node))[:, None], local.reshape(prefix.shape)] = 1
        a = np.flatnonzero(~second)
        b = a if bi == bj else np.flatnonzero(second)
        below = int(np.searchsorted(names, pivot))
        near = (has[a] @ has[b].T >= need) & (has[a][:, :below] @ has[b][:, :below].T == 0)
        near &= x[a] @ x[b].T >= similar
        if bi == bj:
            np.fill_diagonal(near, False)
            full, who = near, a
        else:
            who = np.concatenate([a, b])
            full = np.zeros((len(who), len(who)), bool)
            full[: len(a), len(a) :] = near
            full[len(a) :, : len(a)] = near.T
        links = full @ weight[who]
        us, vs = spanning_forest(full)
        some = np.flatnonzero(links)
        zeros = np.zeros(len(us), np.int64)
        return pa.table({"a": pa.array(np.concatenate([node[who[some]], node[who[us]]]).astype(np.int64)), "b": pa.array(np.concatenate([node[who[some]], node[who[vs]]]).astype(np.int64)), "links": pa.array(np.concatenate([links[some], zeros]).astype(np.int64))})

    return run


def near_duplicate_vectors(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    fine = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    all_ = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = F.col("label").isNotNull() & fine
    all_ = all_.withColumn("node", F.when(ok, F.xxhash64(F.col("label").cast("string"), "embedding")))
    nodes = all_.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first(F.struct("label", "embedding")).alias("v"))
    nodes = staged(nodes.select("node", "least", "weight", F.col("v.label").cast("string").alias("label"), F.col("v.embedding").alias("embedding")), "vectors")
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(pivot_count(n)).select("embedding").collect() if n else []
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(len(r[0]), []).append(r[0])
    pivots = {d: p for d, p in pivots.items() if len(p) >= PREFIX}
    described = nodes.select("node", "embedding", "weight", "label").mapInArrow(_describe(spark.sparkContext.broadcast(pivots)), "node long, embedding array<double>, weight long, label string, prefix array<int>")
    listed = staged(described.withColumn("dim", F.size("embedding")), "described")
    lists = listed.select("node", "weight", "label", "dim", "embedding", "prefix", F.explode("prefix").alias("pivot"))
    sizes = listed.select("label", "dim", F.explode("prefix").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    lists = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(k, "own").alias("bi"), F.greatest(k, "own").alias("bj"), (k < F.col("own")).alias("second")))
    blocks = lists.withColumn("p", F.explode(pairs)).select("label", "dim", "pivot", "node", "weight", "embedding", "prefix", "p.bi", "p.bj", "p.second")
    found = staged(blocks.groupBy("label", "dim", "pivot", "bi", "bj").applyInArrow(_compare(similar, SHARED), "a long, b long, links long"), "found")
    labels = connected_components(found.where("a != b"))
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "least", "weight").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = staged(known, "known")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(least, "label").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = all_.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
