"""Empty tables, repeated rows, null and equal ids, clashing columns, very long texts; second implementations."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexisift.llm import common, decontam, language_id, line_dedup, near_dedup, packing, quality, sharding, token_store, vector_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

SF = "/root/testdata/sf0.001"
CLASH = ["node", "n_shingles", "bands", "label", "key", "h", "c0", "n_words", "runs", "items", "held_out", "score", "shard", "slot", "start", "ids", "weight", "pivot"]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def test_token_store_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    empty = common.new_folder(spark, "t")
    token_store.write_tokens(frame(spark, []), path, empty)
    assert token_store.read_tokens(spark, empty).count() == 0
    rows = [(None, "null id"), (3, "b"), (3, "a"), (3, "a"), (1, None), (2, "long text " * 60_000)]
    folder = common.new_folder(spark, "t")
    token_store.write_tokens(frame(spark, rows, True), path, folder)
    got = token_store.read_tokens(spark, folder).orderBy("start").collect()
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want, start = [], 0
    for d, t in [rows[0], rows[4], rows[5], rows[2], rows[3], rows[1]]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, ids))
        start += len(ids)
    assert [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == want


def test_packing_partitions(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(frame(spark, []), path).count() == 0
    rows = [(None, "a null id"), (None, "a null id"), (1, "again"), (1, "again"), (2, None)] + [(i, f"some words of text {i} " * (i % 90)) for i in range(3, 300)]
    got = packing.pack_documents(frame(spark, rows, True).repartition(5), path).collect()
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == want and len({r["sequence_id"] for r in got}) > 5
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * (len(tok.encode("again", add_special_tokens=False).ids) + 1)


def test_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rng = np.random.default_rng(3)
    v = [rng.normal(size=16).tolist() for _ in range(40)]
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(None, v[0], 1), (7, v[7], 1), (50, v[9], 2)]
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in CLASH if c != "label"})
    got = vector_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert by[None] == [(1, 0, False)] and by[0] == [(1, 0, True)] and by[7] == [(1, 7, True)] * 2 and by[50] == [(0, 50, True)]


def test_vector_recall_by_pivots(spark):
    """Planted neighbours at about the threshold, with more pivots than the small tests have."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2500, 48))
    near = base + rng.normal(size=base.shape) * 0.33
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, r.tolist(), 0) for i, r in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (y @ y.T >= 0.93).sum(axis=1) - 1
    assert true.sum() > 1000 and sum(got.values()) >= 0.9 * true.sum() and all(got[i] <= true[i] for i in got)


def test_language_odd_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(d)
    long = "the and of with from this that " * 30_000
    out = language_id.predict(frame(spark, [(1, long), (1, long), (2, ""), (None, "the and")], True), model, ["doc_id"]).toDF("doc_id", "lang_pred", "score").collect()
    assert [r["lang_pred"] for r in out if r["doc_id"] == 1] == ["en", "en"] and len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    kept = language_id.keep_known(frame(spark, [(1, long), (None, "12 34")], True), model)
    assert kept.columns == ["doc_id", "text", *CLASH] and [r["doc_id"] for r in kept.collect()] == [1]
    assert language_id.predict(frame(spark, []), model).count() == 0


def test_quality_trees_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(d, lab)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 400_000), (5, "plain words here. " * 20_000)] + [(r["doc_id"], r["text"]) for r in d.orderBy("doc_id").limit(60).collect()]
    got = [r["score"] for r in quality.score_documents(frame(spark, rows, True), forest).collect()]
    x = quality.statistics(pa.array([t for _, t in rows], pa.string()))

    def walk(v):
        raw = forest.base
        for root in forest.roots.tolist():
            at = root
            while forest.left[at] != at:
                at = int(forest.left[at] if v[forest.feature[at]] <= forest.threshold[at] else forest.right[at])
            raw += forest.value[at]
        return 1 / (1 + math.exp(-raw))

    assert len(forest.roots) > 5 and np.allclose(got, [walk(v) for v in x], atol=1e-12) and all(0 <= s <= 1 for s in got)
    assert quality.score_documents(frame(spark, []), forest).count() == 0


def place(key, tree):
    """The shard of a key and that with one more shard, by plain loops over the tree."""

    def draw(path, weight):
        bits = int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / (1 << 52)) / weight

    r = min(range(len(tree)), key=lambda i: draw(f"r{i}", sum(map(len, tree[i]))))
    k = min(range(len(tree[r])), key=lambda i: draw(f"r{r}/k{i}", len(tree[r][i])))
    s = min(range(len(tree[r][k])), key=lambda i: draw(f"r{r}/k{k}/s{i}", 1))
    grown = draw(f"r{len(tree)}", 1) < draw(f"r{r}", sum(map(len, tree[r])))
    return tree[r][k][s], sum(len(x) for g in tree for x in g) if grown else tree[r][k][s]


def test_sharding_second_way(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(1500)] + [(None, None), (5, "text 5"), (5, "other")]
    monkeypatch.setattr(sharding, "ROWS_A_PART", 9)  # salted parts, a few in each shard
    got = sharding.assign_shards(frame(spark, rows, True)).collect()
    tree, slots = sharding.even_tree(), {}
    for r in got:
        assert (r["shard"], r["grown_shard"]) == place("null" if r["doc_id"] is None else r["doc_id"], tree)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(frame(spark, [])).count() == 0


def test_decontamination_blocks(spark, monkeypatch):
    assert decontam.clean_documents(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0
    docs = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, "nothing of it at all here"), (3, None), (4, "zeta eta theta")]
    none = decontam.clean_documents(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(docs)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "zeta eta theta"), (3, "beta gamma delta")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_PATTERNS", 3)  # each item in a block of its own
    got = sorted(((r["c0"], r["n_hit"], r["items"]) for r in decontam._judged(decontam.find_contamination(frame(spark, docs, True), bench)).collect()), key=str)
    assert got == sorted([(1, 4, ["1", "3"]), (1, 4, ["1", "3"]), (2, 0, []), (3, 0, []), (4, 3, ["2"])], key=str)


def test_near_duplicates_banded_blocks(spark, monkeypatch):
    """A common stem of about 0.7 makes open groups; small blocks spread them over several tasks."""
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "MEMBER_BLOCK", 32)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    stem, texts = [word() for _ in range(140)], []
    for _ in range(70):
        own = [word() for _ in range(22)]
        texts += [" ".join([*stem, *own, *[word() for _ in range(8)]]) for _ in range(2)]
    sets = [frozenset(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, list(enumerate(texts)), True), 2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_pipeline_lines_of_a_chain(spark, monkeypatch):
    """Windows over one text, each similar to the next one only: all are one component, though every shingle is common."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(190))
    chain = [text[i : i + 30] for i in range(0, 160, 2)]
    real = line_dedup.band_keys
    monkeypatch.setattr(line_dedup, "band_keys", lambda x: real(x).withColumn("keys", F.array(*[F.lit(k).cast("long") for k in range(3)])).distinct())
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.lines(spark, docs, SF).collect()] == [0]


def test_pipeline_stages(spark):
    """Each filtering stage on its own input: the columns stay, decisions take effect, odd rows don't break it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = max((r["text"] for r in bench.collect() if r["text"]), key=len)
    words = " ".join(f"{a} the and of with this" for a in ("one", "two", "three", "four", "five", "six", "seven"))
    long = " ".join(f"the house {i} and the garden of this {i} family" for i in range(3000))
    odd = spark.createDataFrame([(10_001, words, "en", "s", 1), (10_002, words, "en", "s", 1), (None, None, None, None, None), (10_003, "", "en", "s", 0), (10_004, f"{long} {passage} {long}", "en", "s", 1), (10_005, long.replace("house", "home"), "en", "s", 1)], docs.schema)
    given = docs.unionByName(odd)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.staged(stage(spark, given, SF), name)
        assert kept.columns == docs.columns
        out[name] = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert stage(spark, given.limit(0), SF).count() == 0
    assert 10_003 not in out["language"] and {10_001, 10_002, 10_005} <= out["language"]
    assert 10_001 in out["lines"] and 10_002 not in out["lines"]
    assert 10_001 in out["near"] and 10_002 not in out["near"] and 10_005 in out["near"]
    assert 10_004 not in out["clean"] and {10_001, 10_002, 10_003, 10_005} <= out["clean"]
    # the stage `clean` against plain loops: no document that stays holds a run of 13 words of an item
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 13]) for r in bench.collect() for w in [split(r["text"])] for i in range(len(w) - 12)}
    held = {r["doc_id"] for r in given.collect() for w in [split(r["text"])] if any(tuple(w[i : i + 13]) in windows for i in range(len(w) - 12))}
    assert held and not held & out["clean"]
