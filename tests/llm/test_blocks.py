"""Large inputs in small: many blocks of a benchmark, of texts by bytes and of inverted lists; texts of one hash; what is left staged."""

from __future__ import annotations

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexisift.llm import common, decontam, near_dedup, vector_dedup

SF = "/root/testdata/sf0.001"
WORDS = [f"t{i}" for i in range(40)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_contamination(docs, items):
    """doc_id to number of hit words, item_ids, longest run, by plain loops."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for doc, t in docs:
        w = split(t)
        hit, found = [False] * len(w), set()
        for item, u in items:
            u = split(u)
            m = min(len(u), 13)
            windows = {tuple(u[i : i + m]) for i in range(len(u) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit[i : i + m] = [True] * m
                    found.add(str(item))
        runs = "".join("x" if h else " " for h in hit).split()
        out[doc] = (len(w), sum(hit), sorted(found), max((len(r) for r in runs), default=0))
    return out


@pytest.mark.parametrize("most", [40, 150, 500_000])
def test_benchmark_of_many_blocks(spark, monkeypatch, most):
    rng = random.Random(4)
    items = [(i, text(rng, n)) for i, n in enumerate((25, 200, 13, 5, 90, 2, 400, 60))] + [(90, None), (91, "..."), (92, "t1 t2 t3 t4 t5 t6 t7"), (93, "t5 t6 t7 t8 t9 t10 t11 t12 t13 t14")]
    docs = [(i, text(rng, rng.randint(0, 120))) for i in range(40)]
    for i, (_, t) in enumerate(items[:8]):
        w = t.split()
        docs.append((100 + i, f"{text(rng, 30)} {' '.join(w[3:60])} {text(rng, 30)} {' '.join(w[-20:]).upper()}"))
    docs += [(200, None), (201, ""), (202, f"{text(rng, 300)} t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 t12 t13 t14 {text(rng, 300)}")]
    monkeypatch.setattr(decontam, "BLOCK_PATTERNS", most)
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, row string, c0 int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert most > 1000 or len(list(decontam._blocks(bench, 13))) >= 3
    found = decontam._judged(decontam.find_contamination(rows, bench, ["doc_id", "row"]))
    want = plain_contamination(docs, items)
    got = {r["c0"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    stay = {r["doc_id"] for r in decontam.clean_documents(rows, bench).collect()}
    assert stay == {k for k, (n, hit, _, run) in want.items() if run < 13 and not (hit and 20 * hit >= n)} and 202 not in stay
    # what is searched is written block by block: the last plan merges and joins only
    if most < 1000:
        plan = decontam.find_contamination(rows, bench)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan


def test_runs_are_merged():
    runs = np.array([5, 9, 0, 3, 3, 4, 8, 12, 1, 2, 7, 9, 7, 8, 1, 4])
    got, offs = decontam.merge_runs(runs, np.array([0, 8, 8, 16]))
    assert got.tolist() == [0, 4, 5, 12, 1, 4, 7, 9] and offs.tolist() == [0, 4, 4, 8]
    assert len(decontam.merge_runs(runs[:0], np.array([0, 0]))[0]) == 0


def families(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    stem, texts = [word() for _ in range(140)], []
    for _ in range(40):
        own = [word() for _ in range(22)]
        texts += [" ".join([*stem, *own, *[word() for _ in range(8)]]) for _ in range(2)]
    long = [word() for _ in range(20_000)]
    texts += [" ".join(long), " ".join([*long[:-900], *[word() for _ in range(900)]]), " ".join([*long, "more"]), texts[3], "", None, "one"]
    return texts


def classes(texts):
    sets = [frozenset(zip(w, w[1:], strict=False)) or frozenset(w) for w in ((t or "").split() for t in texts)]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_in_blocks_of_bytes(spark, monkeypatch):
    """Blocks of a few kilobytes, in which a long text stands alone, find what one block finds."""
    monkeypatch.setattr(near_dedup, "QUERY_BYTES", 4 << 10)
    monkeypatch.setattr(near_dedup, "MEMBER_BYTES", 8 << 10)
    texts = families(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("bytes", F.lit("clash")).withColumn("h1", F.lit(1))
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()} == classes(texts)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of three bits nearly all texts share theirs; no document is lost."""
    real = near_dedup.hashes
    monkeypatch.setattr(near_dedup, "hashes", lambda t: [real(t)[0].bitwiseAND(F.lit(7)).alias("h1"), real(t)[1]])
    texts = families(random.Random(9))
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    want = classes(texts)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()} == want
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs, 2).collect()) == [i for i in want if want[i] == i]


def test_vectors_in_blocks_of_a_list(spark, monkeypatch):
    """Lists of several blocks: two blocks meet in a task of their own, and nothing changes."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, base[rng.integers(0, 60, 240)] + rng.normal(size=(240, 32)) * 0.28]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, vector_dedup.near_duplicate_vectors(rows).collect()))
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    assert sorted(map(tuple, vector_dedup.near_duplicate_vectors(rows).collect())) == whole
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (y @ y.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    assert true.sum() - 300 > 200 and sum(r[1] for r in whole) >= 0.9 * (true.sum() - 300)


def left(spark):
    where = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {f for f in os.listdir(where) if re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", f)}


def test_what_is_left_staged(spark):
    """A result's own tables only stay: no links, labels, texts or blocks, and no stage but that which the last one reads."""
    docs = spark.createDataFrame(list(enumerate(families(random.Random(3)))), "doc_id long, text string")
    before = left(spark)
    near_dedup.near_duplicates(docs, 2).count()
    assert sorted(f.rsplit("-", 1)[0] for f in left(spark) - before) == ["clashes", "components", "signatures"]
    before = left(spark)
    near_dedup.keep_one(docs, 2).count()
    assert sorted(f.rsplit("-", 1)[0] for f in left(spark) - before) == ["kept"]
    before = left(spark)
    corpus_pipeline.run(spark, SF).count()
    assert [f.rsplit("-", 1)[0] for f in left(spark) - before if f.startswith(("stage", "links", "labels", "texts"))] == ["stage-clean"]


def test_pipeline_packs_odd_rows(spark):
    """The stage `pack` against the library, id for id: null, empty, repeated and very long texts."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    texts = {1: None, 2: "", 3: "The house and the garden.", 4: "the house and a very long garden " * 2000, 5: "zwei\nZeilen <|endoftext|>"}
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in texts.items()] + [(3, texts[3], "clash", 7)], "doc_id long, text string, length string, start int")
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r["doc_id"] == 3 and r["start"] == 0 for r in rows) == 2
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        assert {p[3] for p in pieces} == {len(ids)} and sorted(k for p in pieces for k in range(p[0], p[0] + p[1])) == sorted([*range(len(ids))] * (2 if i == 3 else 1))
        for start, length, crc, _ in pieces:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
