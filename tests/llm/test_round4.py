"""Operators 11 to 13: brute force, exactness, defined cases."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexisift.llm import divergence as dv
from lexisift.llm import spot_signatures as ss
from lexisift.llm import warc
from lexisift.llm import whitening as wh

DOCS = "doc_id long, text string, lang string, source string, fingerprint string, rank int, x int, bucket int"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *([None] * (4 - len(r))), "clash", 1, 2, 3) for r in rows], DOCS)


# ---------------------------------------------------------------- 6: many tasks read an archive


def test_archive_blocks_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://host"), F.col("id") % 90, F.lit(".org/"), F.col("id")).alias("url"), F.concat(F.lit("page "), F.col("id")).alias("html"))
    archive = warc.write_archive(pages, str(tmp_path / "a"), block_lines=8)
    got = archive.fetch_all(pages.select("url")).select("page_id", F.spark_partition_id().alias("p"))
    rows = got.collect()
    assert sorted(r["page_id"] for r in rows) == list(range(400))
    tasks = [sum(r["p"] == p for r in rows) for p in {r["p"] for r in rows}]
    assert len(tasks) > 1 and max(tasks) < 300


# ---------------------------------------------------------------- 11: fingerprints


def plain_signatures(text: str) -> set[int]:
    """The same sets, word by word."""
    data = text.encode().translate(bytes(ss.LOWER.tolist()))
    words = [m.group() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data)]
    known = {w.encode() for ws in ss.COMMON.values() for w in ws}
    h = lambda w: int(ss.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    mix = lambda x: int(ss.mix(np.array([x % (1 << 64)], np.uint64))[0])
    content = [i for i, w in enumerate(words) if w not in known]
    found = []

    def spot(anchor, after):
        chain = [i for i in content if i > after][: ss.CHAIN]
        sig = mix(anchor + 1)
        for i in chain:
            sig = mix(sig * 0x9E3779B97F4A7C15 + h(words[i]))
        if chain:
            found.append(sig)

    last = -1
    for i, w in enumerate(words):
        if w in known:
            last = i
            if i + 1 < len(words) and words[i + 1] not in known:
                spot(h(w), i)
        elif i - last > ss.GAP and h(w) % ss.RARE == 0:
            spot(h(w), i)
    spot(0, -1)
    if not found and data:
        found = [h(data)]
    out, times = set(), {}
    for sig in found:
        k = times[sig] = times.get(sig, -1) + 1
        out.add((mix(sig + k) if k else sig) >> 32)
    return out


def test_signatures_are_those_of_a_plain_walk():
    rng = random.Random(5)
    words = ["the", "of", "und", "la", "été", *("word%d" % i for i in range(40)), "Zebra", "naïve", "x1"]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 12, len(words)])]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["", "!!", "the of", "zebra", "zebra " * 50, "alpha beta gamma delta " * 9, texts[0]]
    h, o = ss.signatures(pa.array(texts))
    for k, t in enumerate(texts):
        got = h[o[k] : o[k + 1]].tolist()
        assert got == sorted(plain_signatures(t)), t


def test_likeness_is_jaccard_and_prunes_by_length():
    rng = np.random.default_rng(3)
    sets = lambda n: [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint32) for _ in range(n)]
    flat = lambda x: (np.concatenate(x), np.concatenate([[0], np.cumsum([len(s) for s in x])]))
    a, b = sets(300), sets(300)
    want = np.array([1.0 if len(x) == len(y) == 0 else len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) for x, y in zip(a, b, strict=True)])
    assert np.array_equal(ss.likeness(*flat(a), *flat(b)), want)
    assert np.array_equal(ss.likeness(*flat(a), *flat(b), 0.3), np.where(want >= 0.3, want, 0.0))


@pytest.mark.parametrize("bucket", [3, 50_000])
def test_fingerprints_against_plain_loops(spark, monkeypatch, bucket):
    monkeypatch.setattr(ss, "ROWS_A_BUCKET", bucket)
    rng = random.Random(bucket)
    rows = [(i, " ".join(rng.choice(["the", "a", "red", "green", "blue", "naïve", "\U0001f600", "été", "sky%d" % (i % 7)]) for _ in range(rng.randint(0, 40)))) for i in rng.sample(range(500), 40)]
    rows += [(600, None), (601, ""), (602, "the " + "long %d " * 3000 % tuple(range(3000))), (None, "no number"), (603, "a"), (604, "ab")]
    got = {r["doc_id"]: r for r in ss.fingerprints(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    jaccard = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    for i, (d, t) in enumerate(order):
        follow, k = order[(i + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - k] + follow[:k]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own = plain_signatures(t)
        assert set(np.frombuffer(r["fingerprint"], "<u4").tolist()) == own
        assert set(np.frombuffer(r["edited_fingerprint"], "<u4").tolist()) == plain_signatures(edited)
        assert (r["near_edited"], r["near_next"]) == (jaccard(own, plain_signatures(edited)), jaccard(own, plain_signatures(follow)))


def test_fingerprints_of_few_equal_or_no_rows(spark):
    assert ss.fingerprints(table(spark, [])).count() == 0
    one = ss.fingerprints(table(spark, [(1, "the same words stand here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    same = ss.fingerprints(table(spark, [(4, "a red house")] * 9 + [(None, None)] * 3)).collect()
    assert len(same) == 12 and len({bytes(r["fingerprint"]) for r in same}) == 2
    assert sum(r["near_next"] == 1.0 for r in same) == 10


# ---------------------------------------------------------------- 12: whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, "v") for r in rows], "vec_id long, embedding array<float>, x int, deviation string")


def test_block_lanczos_finds_the_largest(spark):
    rng = np.random.default_rng(1)
    for d, wanted, block, spectrum in [(30, 8, 8, np.linspace(1, 3, 30)), (30, 5, 2, np.repeat([4.0, 1.0, 0.0], 10)), (7, 8, 8, np.arange(7.0)), (90, 4, 3, rng.random(90) ** 4)]:
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        m = (q * spectrum) @ q.T
        values, v, passes = wh.block_lanczos(lambda x, m=m: m @ x, d, wanted, block, most=40)
        k = min(wanted, d)
        assert np.allclose(values, np.sort(spectrum)[::-1][:k], atol=1e-11) and np.allclose(v.T @ v, np.eye(k), atol=1e-11)
        assert np.abs(m @ v - v * values).max() < 1e-10 and passes >= 1


def test_whitening_against_a_dense_solution(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((400, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32)
    bad = [(1000, None), (1001, []), (1002, [1.0] * 11 + [None]), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (1005, [1.0, 2.0]), (1006, [3e38] + [0.0] * 11)]
    rows = wh.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + bad)).collect()
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100000
    n, s = len(x), whole.sum(axis=0)
    c = whole - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(rows) == n * 8 and {r["n"] for r in rows} == {n} and rows[0]["identity_error"] < 1e-10
    w = np.zeros((n, 8))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == int(((n * whole[r["vec_id"]] - s) ** 2).sum())
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12
    want = c @ u[:, :8] / np.sqrt(e[:8])
    assert np.allclose(w, want * np.sign((w * want).sum(axis=0)), atol=1e-8)


def test_whitening_of_flat_small_and_empty_tables(spark):
    assert wh.whiten(vectors(spark, [])).count() == 0
    assert wh.whiten(vectors(spark, [(1, None)])).count() == 0
    assert wh.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert wh.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    line = wh.whiten(vectors(spark, [(None, [float(i), 2.0 * i, 0.0]) for i in range(6)])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-9 and len(line) == 6


def test_deviations_stay_exact_beyond_a_long():
    x = np.array([[1 << 50, 0], [5, 7]], np.int64)
    n, s = 10**9, np.array([12345678901234567890, 3], dtype=object)
    want = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    x[0, 0] = 1 << 40
    want[0] = (n * (1 << 40) - int(s[0])) ** 2 + (n * 0 - 3) ** 2
    if max(want) < 10**38:
        assert [int(v) for v in wh.deviations(x, n, s).to_pylist()] == want
    small = np.array([[100000, 100003]], np.int64)
    assert [int(v) for v in wh.deviations(small, 3, np.array([300001, 300002], dtype=object)).to_pylist()] == [(300000 - 300001) ** 2 + (300009 - 300002) ** 2]


# ---------------------------------------------------------------- 13: divergence


def test_xxh64_is_the_librarys():
    rng = np.random.default_rng(4)
    buf = np.frombuffer(os.urandom(4000), np.uint8)
    starts = rng.integers(0, 3900, 500)
    ends = starts + rng.integers(0, 70, 500)
    assert dv.xxh64(buf, starts, ends).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dv, "xxh64", lambda buf, starts, ends: (ends - starts).astype(np.uint64) % 2)
    words = [b"aa", b"bb", b"aa", b"ccc", b"d", b"bb", b"d", b"cccc"]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    first, which = dv.equal_slices(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    assert [words[first[k]] for k in which] == words and len(first) == len(set(words))


def plain_audit(rows, least=3, top=200):
    words = [((r[2] or ""), (r[3] or ""), [w.decode() for w in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").encode().lower())]) for r in rows]
    out = set()
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        docs = {}
        for _, _, ws in mine:
            for t in set(ws):
                docs[t] = docs.get(t, 0) + 1
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = lambda ws: {t: sum(x.count(t) for x in ws) for t in kept}
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q = chance(count([w for _, _, w in mine]))
        own = {s: count([w for _, x, w in mine if x == s]) for s in {w[1] for w in mine}}
        p = {s: chance(c) for s, c in own.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        rank = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        for s in p:
            out |= {(lang, s, "pair", t, v, k) for k, (t, v) in rank([(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in p if t != s])}
            out |= {(lang, s, "term", t, v, k) for k, (t, v) in rank([(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]) if k <= top}
    return out


def test_audit_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(dv, "CELLS", 8)
    rng = random.Random(6)
    words = [*("w" + "abcdefgh"[i] for i in range(8)), "Été", "été", "x-y", "ünder", "LONG" * 12, "日本", "a1b"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "s3", "", None])) for i in range(80)]
    rows += [(200, None, "en", "bare"), (201, "12 !!", "fr", "only"), (202, "once", "fr", "other"), (203, "w " * 5000, "en", "s1"), rows[0], rows[0]]
    got = {tuple(r) for r in dv.audit(table(spark, rows)).collect()}
    assert got == plain_audit(rows)
    assert dv.audit(table(spark, [])).count() == 0


def test_chances_are_exact_at_any_size(spark):
    cases = [(0, 0, 1), (7, 90, 13), (5 * 10**13, 8 * 10**13, 10**9), (8 * 10**13, 9 * 10**13, 7)]
    want = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(dv.chance(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == sorted(want)
    assert [int(dv.chances(np.array([c]), np.array([n]), v)[0]) for c, n, v in cases] == want
