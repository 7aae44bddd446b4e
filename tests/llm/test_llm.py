"""The training-data operators against brute force, round trips and held-out labels, with odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexisift.llm import common, decontam, fast_tokens, graph, language_id, line_dedup, near_dedup, packing, quality, sharding, token_store, vector_dedup, warc

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "\n\n", "one", "One", "two words", "two words", "é à ñ", "x" * 5000, "a\n\nb  c\t d", "don't 're \n", "b　c"]


def frame(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_words", F.lit("clash")).withColumn("c0", F.lit(1)) if extra else df


class Sets:
    """A union-find."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    sets = Sets(range(400))
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in edges if a != b for x in (a, b)}


def test_near_duplicates(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocab) for _ in range(90)] for _ in range(3)]
    texts = list(ODD)
    for _ in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    got = near_dedup.near_duplicates(frame(spark, texts, True), 2).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)  # noqa: B905

    s = [shingles(t) for t in texts]
    sets = Sets(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                sets.join(i, j)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[i]), sets.find(i), sets.find(i) == i)
    assert near_dedup.near_duplicates(frame(spark, []), 2).count() == 0
    kept = near_dedup.keep_one(frame(spark, texts, True), 2)
    assert kept.columns == ["doc_id", "text", "n_words", "c0"] and {r["doc_id"] for r in kept.collect()} == {i for i in range(len(s)) if sets.find(i) == i}


def test_near_duplicates_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(200)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 90, 160)]
    far = [" ".join([*[f"v{i}" for i in range(k)], "else", *[f"v{i}" for i in range(k + 1, 200)]]) for k in (20, 90, 160)]
    rows = [(None, near[0]), (None, near[1]), (None, near[2]), (None, near[2]), (5, far[0]), (5, far[1]), (5, far[2]), (None, far[0])]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(kept) == 2 and {r["doc_id"] for r in kept} == {None, 5}


def test_dac_round_trip():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 200
    levels = token_store.dac_encode(ids)
    assert (token_store.dac_decode(levels) == ids).all()
    assert all(token_store.dac_get(levels, i) == ids[i] for i in range(0, 5000, 37))


def test_token_store(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = common.new_folder(spark, "t")
    token_store.write_tokens(frame(spark, ODD), path, folder)
    got = {r["doc_id"]: r for r in token_store.read_tokens(spark, folder).collect()}
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    start, flat = 0, []
    for i, t in enumerate(ODD):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)) and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        start += len(ids)
        flat += ids
    files = token_store.manifest(spark, folder).orderBy("part").collect()
    for r in files:
        f = token_store.TokenFile(f"{folder}/{r['file']}")
        assert all(f.token(i) == flat[r["base"] + i] for i in range(0, r["n_tokens"], 7))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_encoder_specials(name):
    """As a tokenizer left at its defaults encodes."""
    path = public_tokenizers.path(name)
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [t for t in ODD if t is not None] + ["<|endoftext|> x", "a  <|endoftext|>b\n\n<|endoftext|>", "<|ENDOFTEXT|> y", "no special here"]
    ids, offs = fast_tokens.Encoder(path, specials=True).encode(*common.text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_encoder(name):
    e = fast_tokens.Encoder(public_tokenizers.path(name))
    texts = [t for t in ODD if t is not None] + ["x \n y", "\x1c a\x1fb", " a", "<|endoftext|> x"]
    ids, offs = e.encode(*common.text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == e.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, "word " * 3000, "b c " * 700]
    rows = packing.pack_documents(frame(spark, texts), path).collect()
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist() == ids and parts[0]["doc_tokens"] == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    close = base[rng.integers(0, 60, 200)] + rng.normal(size=(200, 32)) * 0.28
    vecs = [*base.tolist(), *close.tolist(), None, [0.0] * 32, [float("nan")] * 32, base[0].tolist(), []]
    labels = [int(i) % 2 for i in range(len(vecs))]
    labels[7] = None
    df = spark.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(zip(vecs, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df).collect()}
    x = [np.array(v, np.float32).astype(float) if v and np.isfinite(v).all() and np.any(v) else None for v in vecs]
    n = {i: 0 for i in range(len(x))}
    for i in range(len(x)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and labels[i] == labels[j] and labels[i] is not None and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93:
                n[i] += 1
                n[j] += 1
    found, true = sum(r["n_links"] for r in got.values()), sum(n.values())
    assert true > 100 and found <= true and found >= 0.9 * true
    assert all(got[i]["n_links"] <= n[i] for i in n) and got[len(vecs) - 1]["component_id"] == len(vecs) - 1


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, tr, offs = rng.normal(size=(400, 3)).astype(np.float32), rng.normal(size=(3, 3)), np.array([0, 1, 1, 70, 134, 300, 400])
    got = language_id.forward_backward(e, tr, offs)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        v, alphas, betas = np.ones(3), [], [np.ones(3)]
        for t in range(a, b):
            v = (v @ np.exp(tr)) * np.exp(e[t].astype(float))
            v /= v.sum()
            alphas.append(v)
        for t in range(b - 1, a, -1):
            w = np.exp(tr) @ (np.exp(e[t].astype(float)) * betas[-1])
            betas.append(w / w.sum())
        for t in range(b - a):
            m = alphas[t] * betas[b - a - 1 - t]
            assert np.abs(m / m.sum() - got[a + t]).max() < 1e-6


def test_language_id_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(d)
    out = language_id.predict(d, model, ["doc_id", "lang"]).toDF("doc_id", "lang", "pred", "score").where(language_id.held_out()).toPandas()
    assert (out.lang == out.pred).mean() > 0.97
    odd = language_id.predict(frame(spark, [None, "", "12 ...", "the and of"]), model).orderBy("c0").collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] == "en"
    assert language_id.predict(frame(spark, ["abc"]), language_id.train(frame(spark, []).withColumn("lang", F.lit("x")))).first()["lang_pred"] == "und"


def test_mixed_text_is_kept(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {x: d.where((F.col("lang") == x) & (F.size(F.split("text", " ")) > 120)).orderBy("doc_id").first()["text"].split()[:100] for x in ("en", "fr", "de", "es")}
    mixed = " ".join(w for k in range(0, 100, 10) for x in words for w in words[x][k : k + 10])
    model = language_id.train(d)
    assert language_id.predict(frame(spark, [mixed]), model).first()["score"] < language_id.LEAST_SCORE
    got = {r["doc_id"] for r in language_id.keep_known(frame(spark, [mixed, " ".join(words["en"]), None, "12 ..."], True), model).collect()}
    assert got == {0, 1}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_documents(d, quality.train(d, lab)).join(lab, "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0.3) == (out.quality == 1)).mean() > 0.97
    odd = quality.score_documents(frame(spark, ODD), quality.train(frame(spark, []), lab)).collect()
    assert all(r["score"] == 0.5 for r in odd) and len(odd) == len(ODD)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "same"), (2, "http://www.a.example/x", "same"), (3, None, None), (4, "https://b.example:8080/y?q=1 2", ""), (5, "http://a.example/x", "own é"), (None, "bad url", "n")], "page_id long, url string, html string")
    archive = warc.write_archive(pages, common.new_folder(spark, "w"))
    got = {r["page_id"]: r for r in archive.fetch_all(pages.select("url")).collect()}
    assert len(got) == 6 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response"
    assert got[3]["record_type"] == "revisit" and got[3]["refers_to"] == 4 and got[5]["payload"].decode() == "own é"
    assert {r["page_id"] for r in archive.fetch("http://a.example/x")} == {1, 2, 5} and archive.fetch("http://none.example/") == []


def test_warc_defined_cases(spark):
    schema = "page_id long, url string, html string"
    empty = warc.write_archive(spark.createDataFrame([], schema), common.new_folder(spark, "w"))
    assert empty.parts == [] and empty.fetch("http://a.example/") == []
    assert empty.fetch_all(spark.createDataFrame([("http://a.example/",)], "url string")).count() == 0
    pages = [(1, "http://a.example/", "short"), (2, "http://a.example/", "short"), (3, "http://b.example/", "long " * 100_000), (4, "http://c.example/", "long " * 100_000), (5, "http://d.example/", None), (5, "http://d.example/", None)]
    df = spark.createDataFrame(pages, schema).withColumn("sha", F.lit("clash")).withColumn("refers", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = warc.write_archive(df, common.new_folder(spark, "w"), least_bytes=100).fetch_all(df.select("url")).collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert len(got) == 6 and kinds == {1: ("response", None, 5), 2: ("response", None, 5), 3: ("revisit", 4, 500_000), 4: ("response", None, 500_000), 5: ("response", None, 0)}


def test_warc_many_blocks(spark):
    """Several parts and blocks, one host with a third of all captures: every page is found, and only those asked for."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.example/same").otherwise(F.concat(F.lit("http://h"), F.col("id") % 97, F.lit(".example/"), "id")).alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    archive = warc.write_archive(pages, common.new_folder(spark, "w"), block_lines=7)
    assert len(archive.parts) > 1 and spark.read.parquet(f"{archive.folder}/parts").agg(F.sum("blocks")).first()[0] > 400
    assert {r["page_id"] for r in archive.fetch_all(pages.select("url")).collect()} == set(range(3000))
    assert {r["page_id"] for r in archive.fetch("http://hot.example/same")} == set(range(0, 3000, 3))
    assert {r["page_id"] for r in archive.fetch_all(spark.createDataFrame([("http://h1.example/1",), ("http://none.example/",)], "url string")).collect()} == {1}


def test_sharding(spark):
    df = frame(spark, ODD * 40).withColumn("doc_id", F.when(F.col("doc_id") % 50 == 0, None).otherwise(F.col("doc_id")))
    rows = sharding.assign_shards(df).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and r["size"] >= 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(ODD) * 40
    assert any(r["grown_shard"] == 40 for r in rows)
    first = next(r for r in rows if r["doc_id"] == 8)
    assert first["text_crc32"] == zlib.crc32(ODD[8].encode())


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    other = "an entirely different sentence that shares nothing with the former one at all"
    texts = [f"{line}\n\n{other}", line, line.replace("today", "todays"), f"own line {other}", None, "", "\n \n", "short", "short"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts, True)).collect()}
    assert got[0] == texts[0] and 1 not in got and 2 not in got
    assert got[4] is None and got[5] == "" and got[6] == "\n \n" and got[7] == "short" and 8 not in got


def line_sets(lines):
    n = line_dedup.SHINGLE
    return [frozenset(x[i : i + n] for i in range(max(len(x) - n, 0) + 1)) for x in lines]


def brute_components(lines):
    """The similar pairs and the components they make."""
    sets, up = line_sets(lines), Sets(range(len(lines)))
    similar = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for i, j in similar:
        up.join(i, j)
    return similar, up


def check_line_components(spark, lines, least):
    """Found components are parts of the true ones, and hold at least the given share of the similar pairs."""
    similar, up = brute_components(lines)
    docs = frame(spark, lines)
    labels = {r["node"]: r["label"] for r in line_dedup.line_components(docs).collect()}
    h = {r["doc_id"]: r["h"] for r in line_dedup.lines_of(docs).collect()}
    got = [labels.get(h[i], h[i]) for i in range(len(lines))]
    for i in range(len(lines)):
        for j in range(i):
            assert got[i] != got[j] or up.find(i) == up.find(j)
    together = sum(got[i] == got[j] for i, j in similar)
    assert together >= least * len(similar), (together, len(similar))
    return similar


def test_line_dedup_families(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(2):  # a stem in common (0.7), pairs that share half of the rest too (0.83)
        stem = word(160)
        for _ in range(60):
            own = word(15)
            lines += [f"{stem}{own}{word(14)}", f"{stem}{own}{word(14)}"]
    rng.shuffle(lines)
    assert len(check_line_components(spark, lines, 0.97)) >= 120


def test_line_dedup_planted_groups(spark):
    rng = random.Random(17)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    lines = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(30)]
        for _ in range(100):
            w = list(base)
            for k in rng.sample(range(30), rng.randint(0, 4)):
                w[k] = rng.choice(vocab)
            lines.append(" ".join(w))
    assert len(check_line_components(spark, list(dict.fromkeys(lines)), 0.98)) > 300


def one_bucket(spark, monkeypatch, lines, keys):
    """All lines get the given band keys, so that the buckets hold all of them."""
    real = line_dedup.band_keys
    monkeypatch.setattr(line_dedup, "band_keys", lambda x: real(x).withColumn("keys", F.array(*[F.lit(k).cast("long") for k in keys])).distinct())


def test_line_dedup_one_shared_bucket(spark, monkeypatch):
    """Similar lines that share a single open bucket are linked, whatever else it holds."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [word(60) for _ in range(20)]
    for _ in range(20):
        stem = word(80)
        lines += [f"{stem}{word(4)}", f"{stem}{word(4)}"]
    one_bucket(spark, monkeypatch, lines, [7])
    monkeypatch.setattr(line_dedup, "BLOCK", 16, raising=False)  # several blocks
    assert len(check_line_components(spark, lines, 1)) == 20


def test_line_dedup_frees_shuffle_files(spark):
    """A staged table of line dedup leaves no shuffle files behind, and the session's setting as it was."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def names():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = names(), spark.conf.get(key)
    table = line_dedup.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert not [x for x in names() - before if x.startswith("shuffle_") and x.endswith(".data")]
    assert table.count() == 7 and spark.conf.get(key) == was


def test_line_dedup_profiles_and_sets(spark):
    """Sizes and bitmaps are those of the sets, repeats or not; a shingle turns one word only; pairs are confirmed by one intersection."""
    rng = random.Random(41)
    word = lambda n: "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(n))
    base = [word(60) for _ in range(12)]
    lines = list(dict.fromkeys([*base, *[x[:50] + word(4) for x in base], *[x * 3 for x in base], "a" * 90, "a" * 40, "ab" * 30, "x"]))
    texts = line_dedup.lines_of(frame(spark, lines)).select("h", "line")
    profiles = line_dedup.profiles_of(texts)
    plan = profiles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_xor(") == 1 and "array_distinct(transform" in plan
    profiles = {r["h"]: r for r in profiles.collect()}
    units = lambda x: [x.encode("utf-16-be")[i : i + 2 * line_dedup.SHINGLE] for i in range(0, max(len(x.encode("utf-16-be")) - 2 * line_dedup.SHINGLE, 0) + 1, 2)]
    sets = {r["h"]: set(units(r["line"])) for r in texts.collect()}
    assert {h: r["n"] for h, r in profiles.items()} == {h: len(x) for h, x in sets.items()}
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b]
    want = {(a, b) for a, b, _, _ in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    given = spark.createDataFrame(pairs, "a long, b long, na long, nb long")
    confirmed = line_dedup._confirmed(given, texts, line_dedup.SIMILAR)
    assert {(r["a"], r["b"]) for r in confirmed.collect()} == want and len(want) >= 2
    for a, b in want:
        apart = sum(bin((profiles[a][f"p{k}"] ^ profiles[b][f"p{k}"]) & (1 << 64) - 1).count("1") for k in range(line_dedup.PROFILE))
        assert 180 * apart <= 20 * (len(sets[a]) + len(sets[b]))


def test_line_dedup_staged_settings(spark):
    """Settings hold while a table is written, and not beyond."""
    key = next(iter(line_dedup._ONE_MAP))
    was = spark.conf.get(key)
    assert line_dedup.staged(spark.range(9), "set", line_dedup._ONE_MAP).count() == 9 and spark.conf.get(key) == was


def test_line_dedup_against_brute_force(spark):
    """Every dropped place, on real documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None)
    places = [(d, k, x) for d, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    lines = sorted({x for _, _, x in places})
    _, up = brute_components(lines)
    name, seen, want = {x: up.find(i) for i, x in enumerate(lines)}, set(), {}
    for d, k, x in places:
        if name[x] in seen:
            want.setdefault(d, []).append(k)
        seen.add(name[x])
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.duplicate_lines(docs).collect()}
    assert want and got == want


def test_line_dedup_defined_cases(spark):
    empty = line_dedup.dedup_lines(frame(spark, []))
    assert empty.columns == ["doc_id", "text"] and empty.count() == 0
    long = " ".join(f"w{i}" for i in range(40_000))
    near = long.replace("w20000 ", "other ")
    rows = [(1, long), (2, near), (None, "a line that stands twice"), (3, "a line that stands twice"), (4, "same same same"), (4, "same same same"), (5, "\n\n"), (6, "é à ñ ü ö"), (7, "é à ñ ü ö")]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]], key=str)


def test_line_bands_meet(spark):
    bases = [{s % line_dedup.PERMUTATIONS % line_dedup.BASES for s in b} for b in line_dedup._ORDER]
    assert sorted(s for b in line_dedup._ORDER for s in b) == list(range(2 * line_dedup.PERMUTATIONS))
    assert all(len({s % line_dedup.PERMUTATIONS for s in b}) == line_dedup.ROWS for b in line_dedup._ORDER) and all(len(b) == line_dedup.BASES for b in bases)
    rng = random.Random(12)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    lines = []
    for stem, own, n in ((80, 9, 1000), (400, 48, 1000)):  # 0.8 of the shingles in common; the second ones are sampled
        for _ in range(n):
            s = word(stem)
            lines += [s + word(own), s + word(own)]
    docs, keys = frame(spark, lines), {}
    for r in line_dedup.band_keys(line_dedup.lines_of(docs).select("h", "line")).collect():
        keys.setdefault(r["h"], set()).update(r["keys"])
    h = {r["doc_id"]: r["h"] for r in line_dedup.lines_of(docs).collect()}
    missed = [not keys[h[i]] & keys[h[i + 1]] for i in range(0, len(lines), 2)]
    assert sum(missed[:1000]) <= 2 and sum(missed[1000:]) <= 6, (sum(missed[:1000]), sum(missed[1000:]))


def test_decontamination(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(50)]
    item = " ".join(rng.choice(words) for _ in range(20))
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "...")], "item_id long, text string")
    long = " ".join(rng.choice(words) for _ in range(5000))
    texts = [*ODD, f"before {item.upper()} after", "a short item here", long + " " + " ".join(item.split()[3:18]) + " " + long]
    got = {r["c0"]: r for r in decontam._judged(decontam.find_contamination(frame(spark, texts, True), bench)).collect()}
    n = len(ODD)
    assert (got[n]["n_words"], got[n]["n_hit"], got[n]["items"], got[n]["contaminated"]) == (22, 20, ["1"], True)
    assert (got[n + 1]["n_hit"], got[n + 1]["items"]) == (2, ["2"])
    assert (got[n + 2]["n_hit"], got[n + 2]["contaminated"]) == (15, False)
    assert all(got[i]["n_hit"] == 0 for i in range(n))
    clean = decontam.clean_documents(frame(spark, [*texts, f"short item {long}"], True), bench)
    # a passage of a window or more is enough in a text of any length; two words of a long text aren't
    assert clean.columns == ["doc_id", "text", "n_words", "c0"] and {r["doc_id"] for r in clean.collect()} == {*range(n), n + 3}


def test_decontamination_null_item_id(spark):
    bench = spark.createDataFrame([(None, "one two three four"), (None, "five six"), (7, "seven eight nine")], "item_id long, text string")
    got = {r["c0"]: r for r in decontam._judged(decontam.find_contamination(frame(spark, ["one two three four five six", "seven eight nine five six", "none"]), bench)).collect()}
    assert [got[i]["n_hit"] for i in range(3)] == [6, 5, 0] and [got[i]["contaminated"] for i in range(3)] == [True, True, False]
    assert [got[i]["items"] for i in range(3)] == [[None], ["7", None], []]


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "sequence_id" in out.columns
