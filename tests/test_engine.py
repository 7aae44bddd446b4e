"""Matching, scoring, redaction, settings, streaming."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexisift import api
from lexisift import config as cfg
from lexisift.operators import matching, redaction, results, scoring
from lexisift.sources import lexicon as lx

MATCH = matching.MATCH


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one_match(spark, text, word, severity=2, categories=("general",), confidence=0.95):
    start = text.index(word)
    row = (text, [(word, word, start, start + len(word), severity, list(categories), "en", confidence, 0)])
    return spark.createDataFrame([row], f"text string, m array<{MATCH}>")


def test_delete_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    a, b = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)})
    ta, tb = spark.createDataFrame([(x,) for x in a], "token string"), spark.createDataFrame([(x,) for x in b], "surface string")
    for d in (1, 2, 3):
        got = {(r["token"], r["surface"], r["distance"]) for r in matching.fuzzy_pairs(ta, tb, d).collect()}
        for sent in (matching.SENT_ROWS, 0):
            monkeypatch.setattr(matching, "SENT_ROWS", sent)
            near = [tuple(r) for r in matching.near_pairs(ta, tb, d).collect()]
            assert set(near) == got and len(near) == len(got)
        want = {(x, y, n) for x, y in itertools.product(a, b) if (n := matching.edit_distance(x, y, d)) <= d}
        assert got == want


def spans(df):
    found = df.select("doc_id", F.explode("candidates").alias("m")).select("doc_id", "m.*")
    return sorted((r["doc_id"], r["start"], r["end"], r["word"], r["match"], r["language"], r["severity"], tuple(r["categories"]), r["distance"], round(r["confidence"], 9)) for r in found.collect())


@pytest.mark.parametrize("unicode_borders", [False, True])
@pytest.mark.parametrize("distance", [0, 2])
def test_joins_find_what_the_automaton_finds(spark, monkeypatch, unicode_borders, distance):
    rng = random.Random(distance)
    texts = ["You idiot, shut up! of the idiot", "scumbag scum scvm", "idiots_x idiot-y", "", None, "id", "очень плохо! плохое", "a $bad one, b.d b.d. $$bad x$bad $bad$", "kill you\nkill  you kill you", "idiott idyot 바보 바보야 ab a b"]
    texts += ["".join(rng.choice("ab $.é") for _ in range(40)) for _ in range(60)]
    d = matching.normalized(docs(spark, *texts)).withColumn("langs", F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("ko"))))
    words = ["bad", "$bad", "плохо", "b.d", "a b", "$", "a", "ab", "a $", "é a", "b a b a b a b a b a b", "a.b", "b$"]
    lex = lx.surfaces(lx.built_in(spark).unionByName(lx.from_entries(spark, [{"lang": "en", "word": w, "severity": 2, "categories": ["general"], "variations": [w + "x"]} for w in words])))
    for languages in (None, "langs"):
        want = spans(matching.automaton_matches(d, lex, distance, unicode_borders, languages))
        assert len({w[4] for w in want}) > 12 and (distance == 0 or any(w[8] for w in want))
        assert spans(matching.automaton_matches(d, lex, distance, unicode_borders, languages, max_rows=3)) == want
    monkeypatch.setattr(matching, "SENT_ROWS", 0)
    assert spans(matching.automaton_matches(d, lex, distance, unicode_borders, "langs")) == want


def test_a_streams_own_lookup_is_the_join(spark):
    lex = [r.asDict() for r in lx.surfaces(lx.built_in(spark)).collect()]
    _, base, _ = matching.index_of("test", lex)
    words = ["idiott", "idiot", "idyot", "scm", "merd", "a", "xyz", "killyou"]
    look = matching.own_lookup(base, 2)
    got = {(w, lex[i]["surface_norm"], d) for w in words for d, i in look(w)}
    d = matching.normalized(docs(spark, *(w + " .." for w in words)))
    assert got == {(r["token"], r["surface"], r["distance"]) for r in matching.near_words(d, lx.surfaces(lx.built_in(spark)), 2).collect()}


def test_a_lexicon_of_a_million_surfaces(spark):
    """Far beyond what an automaton is built of: the detector finds by joins what stands in the texts."""
    code = F.conv(F.col("id").cast("string"), 10, 36)
    n = 1_000_000
    entries = spark.range(n).select(F.lit("en").alias("lang"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("w"), F.lower(code), F.lit(" of x"), F.lower(code))).otherwise(F.concat(F.lit("w"), F.lower(code), F.lit("q"))).alias("word"), F.lit(2).alias("severity"), F.array(F.lit("general")).alias("categories"), F.array().cast("array<string>").alias("variations"), F.lit(False).alias("case_sensitive"), F.col("id").cast("int").alias("seq"))
    pick = [0, 1, 4, 77, 500_000, 999_999, 999_996]
    rows = entries.where(F.col("seq").isin(pick)).select("seq", "word").collect()
    texts = [f"here {r['word']} stands, {r['word']}" for r in rows] + ["nothing of it", None]
    out = api.Detector(spark, cfg.Config(fuzzy=False, context=False), entries).matches(docs(spark, *texts))
    got = {r["doc_id"]: [(m["start"], m["word"]) for m in r["matches"]] for r in out.collect()}
    assert len(rows) == len(pick)
    for k, r in enumerate(rows):
        assert got[k] == [(5, r["word"]), (5 + len(r["word"]) + 9, r["word"])]
    assert got[len(rows)] == got[len(rows) + 1] == []


def test_overlaps_leave_disjoint_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        spans = [(s := rng.randint(0, 40), s + rng.randint(1, 12)) for _ in range(8)]
        rows.append((i, [("w", "t", s, e, rng.randint(1, 4), ["general"], "en", rng.choice([0.5, 0.9]), 0) for s, e in spans]))
    df = spark.createDataFrame(rows, f"i int, m array<{MATCH}>").select("i", scoring.resolve_overlaps(F.col("m")).alias("k"))
    for r in df.collect():
        assert r["k"] and all(a["end"] <= b["start"] for a, b in itertools.pairwise(r["k"]))


MODES = [
    (redaction.Redaction(), "this is **** text"),
    (redaction.Redaction(char="#"), "this is #### text"),
    (redaction.Redaction(structure=False), "this is **** text"),
    (redaction.Redaction(mode="remove"), "this is  text"),
    (redaction.Redaction(mode="replace", categories={"general": ["[mild content]"]}), "this is [mild content] text"),
    (redaction.Redaction(mode="detect_only"), "this is oops text"),
    (redaction.Redaction(custom={"oops": "[EXACT]", "oo*": "[WILDCARD]"}), "this is [EXACT] text"),
    (redaction.Redaction(custom={"oo*": "[WILDCARD]"}), "this is [WILDCARD] text"),
    (redaction.Redaction(least=0.99), "this is oops text"),
]


@pytest.mark.parametrize("k", range(len(MODES)))
def test_redaction_goldens(spark, k):
    r, want = MODES[k]
    df = one_match(spark, "this is oops text", "oops")
    assert df.select(redaction.redact(F.col("text"), F.col("m"), r).alias("x")).first()["x"] == want


def test_sentence_structure_redacts_phrases(spark, tmp_path):
    from lexisift.plans.queries import QUERIES

    texts = ["oh shut up now, idiot", "i will kill you", "good morning"]
    d = docs(spark, *texts).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["filtered"] for r in QUERIES["sentence_structure"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert "shut up" not in got[0] and "idiot" not in got[0]
    assert "kill you" not in got[1] and got[1].lower().startswith("i will ") and got[2] == texts[2]


def test_detector_end_to_end(spark):
    out = api.detect(docs(spark, "You are an idiot and scum!", "this is not an idiot", "good morning", None, "")).orderBy("doc_id").collect()
    assert [r["totalMatches"] for r in out] == [2, 0, 0, 0, 0]
    shown = api.filter_texts(docs(spark, "You are an IDIOT today, scum of all!")).first()["filteredText"]
    assert "IDIOT" not in shown and "scum" not in shown and shown.startswith("You are an")


def test_severity_distribution(spark):
    df = one_match(spark, "this is oops text", "oops", severity=3)
    assert df.select(results.severity_distribution(F.col("m")).alias("d")).first()["d"] == {1: 0, 2: 0, 3: 1, 4: 0}


def test_lexicon_round_trip(spark, tmp_path):
    lx.write_json(lx.built_in(spark), str(tmp_path / "lex"))
    back = lx.read_json(spark, str(tmp_path / "lex"), ["en"])
    assert back.count() == sum(e[0] == "en" for e in lx.BUILT_IN)


def test_settings():
    assert cfg.preset("strict").min_severity == 3
    assert cfg.Config(fuzzy_threshold=0.7).max_distance == 2 and cfg.Config(fuzzy_threshold=0.8).max_distance == 1
    errors, _ = cfg.validate({"languages": [], "min_severity": 9, "fuzzy_threshold": 3})
    assert len(errors) == 3
    m = cfg.ConfigManager()
    m.update(min_severity=2)
    m.update(fuzzy=False)
    assert m.revert().min_severity == 2 and m.config.fuzzy
    assert cfg.ConfigManager().load(m.export()) == m.config


def test_stream(spark, tmp_path):
    from lexisift.streaming.detect import detect_stream, read_documents, write_results

    src = str(tmp_path / "in")
    docs(spark, "you idiot", "fine").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long")).write.parquet(src)
    out = detect_stream(read_documents(spark, src), cfg.Config(fuzzy=False)).select("doc_id", "totalMatches")
    write_results(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, 1), (1, 0)]
