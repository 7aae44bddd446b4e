"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of whole texts, vectorised over many documents.  Trees are
grown on the driver from a bounded sample of labelled documents (at most TRAIN_ROWS, those with the
least hashes of their ids), over at most BINS quantile bins a feature, with the logistic loss.  The
forest is flattened into arrays (feature, threshold, left, right, value), and a whole block of
documents walks down one level of a tree in one numpy step.

Defined cases: a null or empty text has all statistics 0 and gets the forest's score for that; null
labels are not learned from; without labels every score is 0.5; repeated labels of a document count
once; repeated documents are scored each on their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, byte_class, distinct_in, hash_spans, spans, steps, text_buffer

TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAF, L2 = 64, 80, 4, 0.15, 20, 1.0

#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": byte_class((65, 90)),
    "lower": byte_class((97, 122)),
    "digit": byte_class((48, 57)),
    "high": byte_class((128, 255)),
    "space": ~NOT_SPACE,
    "line": byte_class((10, 10)),
    "stop": byte_class((33, 33), (46, 46), (63, 63)),
    "comma": byte_class((44, 44), (58, 59)),
    "bang": byte_class((33, 33)),
    "bar": byte_class((124, 124)),
    "symbol": byte_class((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)),
    "quote": byte_class((34, 34), (39, 41), (45, 45), (47, 47)),
}
NAMES = ["log_bytes", *CLASSES, "log_words", "word_bytes", "long_words", "short_words", "distinct_words", "twice", "top_word", "upper_words", "symbol_words", "log_lines", "distinct_lines", "line_words"]
_LINE = byte_class((10, 10), negate=True)


def _per(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a vector over each text's part."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def statistics(col: pa.Array) -> np.ndarray:
    """(texts, features) of a string column."""
    buf, offs = text_buffer(col)
    size = np.diff(offs).astype(np.float64)
    share = lambda x, n: x / np.maximum(n, 1)
    out = [np.log1p(size)] + [share(_per(lut[buf], offs), size) for lut in CLASSES.values()]
    starts, ends, woffs = spans(buf, offs, NOT_SPACE)
    n, length = np.diff(woffs).astype(np.float64), ends - starts
    h = hash_spans(buf, starts, ends)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        same[woffs[:-1][n > 0]] = False
    row = np.repeat(np.arange(len(n)), n.astype(np.int64))
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    hs, rs = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])) if len(hs) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(hs)))
    top = np.zeros(len(n))
    np.maximum.at(top, rs[new], times)
    upper, symbol = CLASSES["upper"][buf], CLASSES["symbol"][buf]
    sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    u, s = sums(upper), sums(symbol)
    caps = 2 * (u[ends] - u[starts]) >= length
    odd = s[ends] > s[starts]
    ls, le, loffs = spans(buf, offs, _LINE)
    lines = np.diff(loffs).astype(np.float64)
    different = np.diff(distinct_in(hash_spans(buf, ls, le), loffs)[1])
    out += [np.log1p(n), share(_per(length, woffs), n), share(_per(length > 15, woffs), n), share(_per(length < 3, woffs), n), share(np.bincount(rs[new], minlength=len(n)), n), share(_per(same, woffs), n), share(top, n), share(_per(caps & (length > 1), woffs), n), share(_per(odd, woffs), n), np.log1p(lines), share(different, lines), share(n, lines)]
    return np.stack(out, axis=1)


class Forest:
    """Flattened trees: node arrays over all trees, and each tree's root."""

    def __init__(self, feature, threshold, left, right, value, roots, base: float) -> None:
        self.feature, self.threshold = np.array(feature, np.int32), np.array(threshold, np.float64)
        self.left, self.right, self.value = np.array(left, np.int32), np.array(right, np.int32), np.array(value, np.float64)
        self.roots, self.base = np.array(roots, np.int32), base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row; leaves point to themselves, so all rows walk DEPTH steps."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            raw += self.value[at]
        return 1 / (1 + np.exp(-raw))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Histogram gradient boosting, level by level."""
    if len(y) == 0:
        return Forest([0], [0.0], [0], [0], [0.0], [], 0.0)
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n_f = x.shape[1]
    flat = binned + BINS * np.arange(n_f)
    raw = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    leaf = lambda g, h: -RATE * g / (h + L2)

    def node(v: float) -> int:
        feature.append(0)
        threshold.append(0.0)
        left.append(len(value))
        right.append(len(value))
        value.append(v)
        return len(value) - 1

    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-raw))
        grad, hess = chance - y, chance * (1 - chance)
        roots.append(node(leaf(grad.sum(), hess.sum())))
        level = [(roots[-1], np.arange(len(y)))]
        for _ in range(DEPTH):
            below = []
            for k, rows in level:
                if len(rows) < 2 * LEAF:
                    continue
                at = flat[rows].reshape(-1)
                hist = lambda w: np.bincount(at, np.repeat(w, n_f), n_f * BINS).reshape(n_f, BINS).cumsum(axis=1)  # noqa: B023, E731
                g, h, c = hist(grad[rows]), hist(hess[rows]), hist(np.ones(len(rows)))
                gt, ht, ct = g[0, -1], h[0, -1], c[0, -1]
                gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
                gain[(c < LEAF) | (ct - c < LEAF)] = 0
                f, b = divmod(int(gain.argmax()), BINS)
                if gain[f, b] <= 1e-9 or b >= len(edges[f]):
                    continue
                goes = binned[rows, f] <= b
                feature[k], threshold[k] = f, float(edges[f][b])
                left[k], right[k] = node(leaf(g[f, b], h[f, b])), node(leaf(gt - g[f, b], ht - h[f, b]))
                below += [(left[k], rows[goes]), (right[k], rows[~goes])]
            level = below
        tree = Forest(feature, threshold, left, right, value, [roots[-1]], 0.0)
        at = np.full(len(y), roots[-1], np.int32)
        for _ in range(DEPTH):
            at = np.where(x[np.arange(len(y)), tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
        raw += tree.value[at]
    return Forest(feature, threshold, left, right, value, roots, base)


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest from the labelled documents that are not held out, TRAIN_ROWS of them at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS).groupBy("doc_id").agg(F.max("y").alias("y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = statistics(part.column(1)).astype("<f8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(features, "y int, x binary").collect()  # bounded by TRAIN_ROWS
    got = sorted((bytes(r["x"]), r["y"]) for r in got)
    x = np.array([np.frombuffer(b, "<f8") for b, _ in got]).reshape(-1, len(NAMES))
    return fit_forest(x, np.array([float(y > 0) for _, y in got]))


def score_documents(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                score = np.clip(shared.value.score(statistics(part.column(2))), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
