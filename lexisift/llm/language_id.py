"""Language ID: a linear-chain conditional random field over words.

Each word has affix features (its first and last 1 to 4 bytes), n-gram features (its 2 and 3 byte
pieces) and lexicon features (the words met at least twice in training); transitions between the
languages of neighbouring words are learned with them, by gradient steps on the log-likelihood.
Training sequences are runs of words of two training documents in turn, so that switches of language
occur.  Prediction is by forward-backward: the chances of every word's label, which sum to those of
the document.

Training takes whole texts of at most TRAIN_DOCS documents of each language (those with the least
hashes of their ids); the languages are the values learned.  Prediction reads whole texts.  Forward
and backward passes run over lanes of LANE words at once: first each lane's transfer matrix, then the
lanes of a document in a row, then all words of all lanes.

Defined cases: a null text, and one without a letter, is `und` with score 0; so is every text where
nothing could be learned; null languages are not learned from; repeated rows are judged each on their
own; an empty table gives no rows; other columns pass through `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_class, give_back, hash_spans, mix, ranges, spans, steps, text_buffer

TRAIN_DOCS = 200
BUCKETS = 1 << 15
LEXICON = 20_000
LANE, SEQUENCE, BATCH, EPOCH_STEPS, RATE, L2 = 64, 48, 96, 160, 0.25, 1e-4
UNKNOWN = "und"
#: Least mean chance of the chosen language for a document to be kept by the pipeline.
LEAST_SCORE = 0.35

LETTER = byte_class((65, 90), (97, 122), (128, 255))
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)


def lower(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, length kept."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        two = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
        out[two] += 0x20
    return out


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and offsets of the letter runs of each text."""
    buf, offs = text_buffer(col)
    buf = lower(buf)
    return (buf, *spans(buf, offs, LETTER))


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words in a row, and how many each has."""
    view = np.ndarray((len(buf) + 1,), "<u8", buffer=np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))
    size = ends - starts
    ids, word = [], []

    def add(kind: int, which: np.ndarray, at: np.ndarray, n: int) -> None:
        h = mix((view[at] & _MASK[n]) * _C + np.uint64(kind))
        ids.append((h & np.uint64(BUCKETS - 1)).astype(np.int32))
        word.append(which)

    for n in range(1, 5):
        on = np.flatnonzero(size >= n)
        add(n, on, starts[on], n)
        add(8 + n, on, ends[on] - n, n)
    for n in (2, 3):
        count = np.maximum(size - n + 1, 0)
        add(16 + n, np.repeat(np.arange(len(starts)), count), ranges(starts, count), n)
    word, ids = np.concatenate(word), np.concatenate(ids)
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=len(starts))


class Model:
    """labels, weights (BUCKETS + lexicon + 1, labels), transitions (labels, labels) as log scores."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> None:
        self.labels, self.lexicon, self.weights, self.trans = labels, lexicon, weights, trans

    def lexicon_rows(self, h: np.ndarray) -> np.ndarray:
        """The weight row of each word's lexicon entry; the last row is for all others."""
        k = np.minimum(np.searchsorted(self.lexicon, h), max(0, len(self.lexicon) - 1))
        known = self.lexicon[k] == h if len(self.lexicon) else np.zeros(len(h), bool)
        return BUCKETS + np.where(known, k, len(self.lexicon))

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Emission scores of the words; each different word is scored once."""
        h = hash_spans(buf, starts, ends)
        seen, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, n = features(buf, starts[first], ends[first])
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        w = self.weights
        own = np.empty((len(seen), w.shape[1]), np.float32)
        for k in range(w.shape[1]):
            own[:, k] = np.add.reduceat(w[:, k][ids], at)
        own += w[self.lexicon_rows(seen)]
        return own[inverse]


def forward_backward(emit: np.ndarray, trans: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chances of every word's label (words, labels) in sequences with the given offsets."""
    n, k = emit.shape
    if n == 0:
        return np.zeros((0, k))
    p = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max())
    count = np.diff(offs)
    lanes = -(-count // LANE)
    first = np.concatenate([[0], np.cumsum(lanes)])
    start = np.repeat(offs[:-1], lanes) + LANE * ranges(np.zeros(len(lanes), np.int64), lanes)
    size = np.minimum(LANE, np.repeat(offs[1:], lanes) - start)
    m = len(start)
    idx = np.minimum(start[:, None] + np.arange(LANE), n - 1)
    on = np.arange(LANE) < size[:, None]
    # each lane's transfer matrix
    t = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for j in range(LANE):
        live = np.flatnonzero(on[:, j])
        new = (t[live].reshape(-1, k) @ a).reshape(-1, k, k) * p[idx[live, j]][:, None, :]
        t[live] = new / new.max(axis=(1, 2), keepdims=True)
    # the vectors before and behind each lane, the lanes of a document in a row
    before, behind = np.ones((m, k)), np.ones((m, k))
    most = int(lanes.max())
    order = np.argsort(-lanes, kind="stable")
    left = np.searchsorted(-lanes[order], -np.arange(1, most + 1), side="right")  # documents with more than j lanes
    for j in range(1, most):
        d = first[:-1][order[: left[j]]] + j
        v = np.einsum("dk,dkl->dl", before[d - 1], t[d - 1])
        before[d] = v / v.max(axis=1, keepdims=True)
        d = first[1:][order[: left[j]]] - 1 - j
        v = np.einsum("dkl,dl->dk", t[d + 1], behind[d + 1])
        behind[d] = v / v.max(axis=1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    v = before
    for j in range(LANE):
        live = np.flatnonzero(on[:, j])
        w = idx[live, j]
        x = (v[live] @ a) * p[w]
        x /= x.sum(axis=1, keepdims=True)
        alpha[w] = x
        v[live] = x
    v = behind
    for j in range(LANE - 1, -1, -1):
        live = np.flatnonzero(on[:, j])
        w = idx[live, j]
        beta[w] = v[live]
        x = (v[live] * p[w]) @ a.T
        v[live] = x / x.max(axis=1, keepdims=True)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Gradient steps (AdaGrad) on the log-likelihood of sequences that switch between two documents."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs])
    buf, starts, ends, woffs = words_of(pa.array(texts, pa.large_string()))
    full = np.flatnonzero(np.diff(woffs) > 0)
    k = len(labels)
    if not len(full):
        return Model([], np.zeros(0, np.uint64), np.zeros((BUCKETS + 1, k), np.float32), np.zeros((k, k)))
    h = hash_spans(buf, starts, ends)
    seen, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times >= 2)
    lexicon = np.sort(seen[common[np.argsort(-times[common], kind="stable")[:LEXICON]]])
    model = Model(labels, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32), np.zeros((k, k)))
    ids, n = features(buf, starts[first], ends[first])
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    lex = model.lexicon_rows(seen)
    rng = np.random.default_rng(7)
    by_label = [full[y[full] == c] for c in range(k)]
    g2w, g2t = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    offs = np.arange(BATCH + 1) * SEQUENCE
    for _ in range(EPOCH_STEPS):
        # each sequence: runs of words of two documents in turn
        doc = np.stack([[rng.choice(by_label[c]) if len(by_label[c]) else rng.choice(full) for c in rng.integers(0, k, BATCH)] for _ in range(2)])
        spot = rng.random((2, BATCH))
        side = (np.cumsum(rng.random((BATCH, SEQUENCE)) < 0.04, axis=1) + rng.integers(0, 2, (BATCH, 1))) % 2
        d = np.take_along_axis(doc.T, side, axis=1)
        size = np.diff(woffs)[d]
        token = woffs[:-1][d] + (np.take_along_axis(spot.T, side, axis=1) * size + np.arange(SEQUENCE)).astype(np.int64) % size
        gold, word = y[d].reshape(-1), inverse[token].reshape(-1)
        used, local = np.unique(word, return_inverse=True)
        fid, fn = ids[ranges(at[used], n[used])], n[used]
        fat = np.concatenate([[0], np.cumsum(fn)])[:-1]
        emit = np.stack([np.add.reduceat(model.weights[:, c][fid], fat) for c in range(k)], axis=1) + model.weights[lex[used]]
        e = emit[local].astype(np.float64)
        grad, gt = _gradient(e.reshape(BATCH, SEQUENCE, k), model.trans, gold.reshape(BATCH, SEQUENCE))
        per = np.stack([np.bincount(local, grad[:, c], len(used)) for c in range(k)], axis=1)
        g = np.stack([np.bincount(fid, np.repeat(per[:, c], fn), len(model.weights)) + np.bincount(lex[used], per[:, c], len(model.weights)) for c in range(k)], axis=1) / BATCH
        g -= L2 * model.weights
        g2w += (g * g).astype(np.float32)
        model.weights += (RATE * g / np.sqrt(g2w)).astype(np.float32) * 0.2
        gt = gt / BATCH
        g2t += gt * gt
        model.trans += RATE * gt / np.sqrt(g2t)
    return model


def _gradient(e: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood by emissions (flat) and transitions, for sequences of one length."""
    b, t, k = e.shape
    p, a = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(trans - trans.max())
    alpha, beta = np.empty((b, t, k)), np.ones((b, t, k))
    v = np.ones((b, k))
    for j in range(t):
        v = (v @ a) * p[:, j]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, j] = v
    for j in range(t - 2, -1, -1):
        v = (beta[:, j + 1] * p[:, j + 1]) @ a.T
        beta[:, j] = v / v.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (p * beta)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    grad = -post
    np.put_along_axis(grad, gold[..., None], np.take_along_axis(grad, gold[..., None], 2) + 1, 2)
    gt = -pair.sum(axis=(0, 1))
    np.add.at(gt, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
    return grad.reshape(-1, k), gt


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learns from the documents with a language that are not held out, TRAIN_DOCS of each language at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang").withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= TRAIN_DOCS).select("doc_id", "lang").distinct()
    got = rows.join(F.broadcast(picked), ["doc_id", "lang"]).select("text", "lang").distinct().collect()  # TRAIN_DOCS of each language
    got = sorted((r["text"], r["lang"]) for r in got)
    return fit([t for t, _ in got], [x for _, x in got])


def label_words(col: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the labels of every word of the texts, and the words' offsets."""
    buf, starts, ends, woffs = words_of(col)
    if len(starts) == 0 or not model.labels:
        return np.zeros((0, len(model.labels))), np.zeros(len(woffs), np.int64)
    return forward_backward(model.scores(buf, starts, ends), model.trans, woffs), woffs


def _predict(names: list[str], text: int, shared, added: list[str], runs: bool, sure: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in steps(batch, batch.schema.names[text]):
                chance, woffs = label_words(part.column(text), model)
                n = np.diff(woffs)
                some = np.flatnonzero(n)
                total = np.zeros((part.num_rows, max(1, len(model.labels))))
                if len(some):
                    total[some] = np.add.reduceat(chance, woffs[:-1][some], axis=0) / n[some, None]
                letters = part.column(text + 1).to_numpy(zero_copy_only=False).astype(bool) & (n > 0)
                best = total.argmax(axis=1)
                score = np.clip(np.where(letters, total.max(axis=1), 0.0), 0, 1)
                lang = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if runs:
                    new.append(_runs(chance, woffs, model.labels))
                if sure:
                    mean = np.zeros(part.num_rows)
                    if len(some):
                        mean[some] = np.add.reduceat(chance.max(axis=1), woffs[:-1][some]) / n[some]
                    new.append(pa.array(np.where(letters, mean, 0.0)))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *added])
        give_back()

    return run


def _runs(chance: np.ndarray, woffs: np.ndarray, labels: list[str]) -> pa.Array:
    """Runs of equally labelled words, as (label, first word, number of words)."""
    word = chance.argmax(axis=1)
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    new[woffs[:-1][np.diff(woffs) > 0]] = True
    at = np.flatnonzero(new)
    doc = np.searchsorted(woffs, at, side="right") - 1
    size = np.diff(np.append(at, len(word)))
    values = pa.StructArray.from_arrays([pa.array([labels[w] for w in word[at]], pa.string()), pa.array(at - woffs[doc]), pa.array(size)], names=["lang", "first", "words"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(woffs) - 1))]).astype(np.int32)), values)


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None, runs: bool = False, sure: bool = False) -> DataFrame:
    """The given columns as c0, c1, ... (at first doc_id), lang_pred, score, and with runs the labelled runs of words,
    with sure the mean of each word's best chance."""
    columns = ["doc_id"] if columns is None else columns
    k = len(columns)
    text = docs["text"].cast("string")
    source = docs.select(*[docs[c] for c in columns], text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).toDF(*[f"c{i}" for i in range(k)], "text", "letters")
    added = ["lang_pred", "score"] + ["runs"] * runs + ["sure"] * sure
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if runs:
        run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])
        schema = schema.add("runs", T.ArrayType(run))
    if sure:
        schema = schema.add("sure", T.DoubleType())
    out = source.mapInArrow(_predict(source.columns, k, docs.sparkSession.sparkContext.broadcast(model), added, runs, sure), schema)
    return out.drop("text", "letters")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose words' languages are known with at least that mean chance, whether one language or
    several in turn, with all their columns."""
    columns = docs.columns
    out = predict(docs, model, columns, sure=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("sure") >= least))
    return out.select(*[F.col(f"c{i}") for i in range(len(columns))]).toDF(*columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs)).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
