"""Loaders, filters, language choice, fuzzy search, measuring: cases of their own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexisift import api, config
from lexisift.config import Config
from lexisift.functions import langid
from lexisift.functions import text as tx
from lexisift.operators import matching, redaction, results, scoring
from lexisift.sources import lexicon as lx


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def entries(spark, *words):
    return lx.from_entries(spark, [{"language": "en", "word": w, "severity": 2, "categories": ["general"]} for w in words])


def test_remainder_search(spark):
    lex = lx.surfaces(entries(spark, "profanity"))
    for text in ("profanety", "profannity", "profnity", "profxnity"):
        got = matching.remainder_search(matching.normalized(docs(spark, text)), lex, 1).collect()
        assert [(r["start"], r["end"], r["distance"]) for r in got] == [(0, len(text), 1)]
    got = matching.remainder_search(matching.normalized(docs(spark, "profanity", "a profanty", "profanity and a long tail of words")), lex, 2).collect()
    assert {(r["doc_id"], r["start"], r["distance"]) for r in got} == {(0, 0, 0), (1, 2, 1)}


def test_lowest_distance(spark):
    rows = spark.createDataFrame([(1, "a", 2, "x"), (1, "a", 1, "y"), (2, "a", 3, "z")], "doc_id long, word string, distance int, term string")
    assert {tuple(r) for r in matching.lowest_distance(rows, ["doc_id", "word"]).collect()} == {(1, "a", 1, "y"), (2, "a", 3, "z")}


def test_batch_filter(spark):
    texts = docs(spark, "this is T text", "clean")
    found = matching.automaton_matches(matching.normalized(texts), lx.surfaces(entries(spark, "t"))).select("doc_id", F.col("candidates").alias("matches"))
    assert [r["filteredText"] for r in api.batch_filter(texts, found).orderBy("doc_id").collect()] == ["this is * text", "clean"]
    for a, b, message in ((texts, found.where("doc_id = 0"), "no matches for 1"), (texts.where("doc_id = 0"), found, "no text for 1"), (texts, found.withColumn("doc_id", F.lit(0).cast("long")), "repeated key 0|no matches for 1"), (texts.union(texts), found, "repeated key")):
        with pytest.raises(Exception, match=message):
            api.batch_filter(a, b).collect()
    both = texts.join(found, "doc_id")
    assert [r["filteredText"] for r in api.apply_filter(both, "remove").orderBy("doc_id").collect()] == ["this is  text", "clean"]


def test_language_choice(spark):
    found = spark.range(1).select(F.array(F.struct(F.lit("en").alias("language"), F.lit(0.6).alias("confidence")), F.struct(F.lit("fr").alias("language"), F.lit(0.05).alias("confidence"))).alias("f"))
    chosen = lambda *a: found.select(api.selected_languages(F.col("f"), *a).alias("x")).first()["x"]
    assert chosen(["de", "xx"], "es", ["en", "de", "es", "fr"]) == ["en", "de", "es"]
    assert chosen([], None, ["fr"]) == []
    d = api.Detector(spark, Config(fuzzy=False))
    assert d.add_language("fr").config.languages == ["en", "fr"] and d.add_language("en").config.languages == ["en"]
    assert d.add_language("fr").remove_language("en").config.languages == ["fr"] and d.remove_language("en").config.languages == ["en"]


def test_multi_language_is_each_language_alone(spark):
    rows = docs(spark, "you idiot, nom de dieu", "rien ici", "merde and shit")
    d = api.Detector(spark, Config(fuzzy=False))
    alone = {(r["doc_id"], r["result_language"]): r["totalMatches"] for r in d.per_language(rows, ["en", "fr"]).collect()}
    for r in d.multi_language(rows, ["en", "fr"]).collect():
        assert {x["result_language"]: x["n"] for x in r["by_language"]} == {k[1]: n for k, n in alone.items() if k[0] == r["doc_id"] and n}


def test_match_cap_takes_the_first(spark):
    got = api.Detector(spark, Config(fuzzy=False, context=False, max_matches=2), entries(spark, "aaa", "bbb", "ccc")).matches(docs(spark, "ccc bbb aaa")).first()["matches"]
    assert [m["word"] for m in got] == ["ccc", "bbb"]


def test_sentences_keep_odd_characters(spark):
    got = docs(spark, "one.\u0001 two! three", "a. b. c").select(redaction.tidy_sentences(F.col("text"), F.lit(False)).alias("t")).collect()
    assert [r["t"] for r in got] == ["one.\u0001 two! Three", "a. B. C"]


def test_map_folders(spark, tmp_path):
    folder = tmp_path / "en"
    folder.mkdir()
    (folder / "profanity.json").write_text(json.dumps(["bad", "worse"]))
    (folder / "severity.json").write_text(json.dumps({"bad": 3}))
    (folder / "categories.json").write_text("{ not json")
    (folder / "metadata.json").write_text(json.dumps({"name": "English", "version": "1", "wordCount": 2}))
    (tmp_path / "xx").mkdir()
    (tmp_path / "xx" / "profanity.json").write_text("[]")
    got = {r["word"]: (r["severity"], r["categories"], r["variations"]) for r in lx.read_maps(spark, str(folder), "en").collect()}
    assert got == {"bad": (3, ["general"], None), "worse": (1, ["general"], None)}
    meta = lx.metadata(spark, str(tmp_path)).collect()
    assert [(r["lang"], r["name"], r["word_count"], r["context"]) for r in meta] == [("en", "English", 2, None)]


def test_wrapped_words(spark, tmp_path):
    p = tmp_path / "en.json"
    p.write_text(json.dumps({"metadata": {"v": 1}, "words": [{"word": "bad", "severity": 2, "categories": ["general"]}, {"severity": 1}]}))
    rows = lx.read_wrapped(spark, str(p), "en")
    assert rows.count() == 2 and [r["word"] for r in lx.well_formed(rows).collect()] == ["bad"]
    assert [r["problem"] for r in lx.problems(rows).collect()] == ["word"]


def test_cache_keeps_the_last(spark):
    made, cache = [], {}
    load = lambda name: made.append(name) or entries(spark, name)
    for name in ("aa", "bb", "aa", "cc", "dd"):
        lx.kept(cache, name, load, most=3)
    assert made == ["aa", "bb", "cc", "dd"] and list(cache) == ["aa", "cc", "dd"]


def test_measuring(spark):
    monitor = api.PerformanceMonitor()
    seen = monitor.run("detect", api.detect(docs(spark, "you idiot", "good"), Config(fuzzy=False)))
    m = monitor.metrics()["detect"]
    assert seen["texts"] == 2 and seen["characters"] == 13 and seen["matches"] == 1 and m["count"] == 1 and m["charactersPerMs"] > 0


def test_quick_functions(spark):
    rows = docs(spark, "you idiot", "good morning")
    least = config.PRESETS["performance"].min_severity
    want = lx.built_in(spark).where("word = 'idiot'").first()["severity"] >= least
    assert [r["hasProfanity"] for r in api.batch_detect(rows).orderBy("doc_id").collect()] == [want, False]
    assert api.detect_enhanced(rows).where("doc_id = 0").first()["enhanced"][0]["position"]["lineNumber"] == 1
    assert [r["filteredText"] for r in api.filter_enhanced(rows).orderBy("doc_id").collect()] == ["you *****", "good morning"]
    assert api.smart_config(rows).languages and api.health_check(spark)["status"] == "healthy"
    assert api.library_info()["modes"] and api.factory("spanish").languages == ["es"]
    added = api.Detector(spark).add_custom_words([{"language": "en", "word": "zorble", "severity": 3, "categories": ["general"]}])
    assert added.analyze(docs(spark, "a zorble b")).first()["totalMatches"] == 1


def test_text_forms(spark):
    row = docs(spark, "é ‎work 😀").select(tx.unicode_form("NFC")(F.col("text")).alias("c"), tx.remove_emoji(F.col("text")).alias("e"), tx.remove_bidi(F.col("text")).alias("b")).first()
    assert row["c"].startswith("é") and "😀" not in row["e"] and "‎" not in row["b"]


def test_settings_round_trip(tmp_path):
    m = config.ConfigManager()
    m.use("strict")
    heard = []
    m.listen(lambda new, changed: heard.append(changed))
    m.save_file(str(tmp_path / "c.json"))
    n = config.ConfigManager()
    n.load_file(str(tmp_path / "c.json"))
    assert n.config == m.config and config.config_hash(n.config) == config.config_hash(m.config)
    m.reset()
    assert heard and m.config == config.DEFAULT and config.config_hash(m.config) != config.config_hash(n.config)


def test_settings_are_mended():
    errors, warnings, out = config.check({"languages": ["en", "en", "xx", 3], "categories": ["general", "nope", "general"], "whitelist": [" Fine ", "fine", 5], "replacement_char": "#!"})
    assert errors == [] and len(warnings) == 8
    assert (out.languages, out.categories, out.whitelist, out.replacement_char) == (["en"], ["general"], ["Fine"], "#")
    assert config.check({"languages": ["xx"]})[2].languages == ["auto"] and config.check({"categories": []})[2].categories == config.DEFAULT.categories
    assert config.check({"replacement_char": ""})[2].replacement_char == "*" and config.check({"whitelist": "x"})[2].whitelist == []
    words = config.check({"custom_words": ["Bad", {"word": "bad", "severity": 3}, {"word": "worse", "severity": 9, "categories": []}, {"severity": 1}, 7]})
    assert words[0] == [] and len(words[1]) == 4
    assert [(w["word"], w["severity"], w["categories"]) for w in words[2].custom_words] == [("Bad", 2, ["general"]), ("worse", 2, ["general"])]


@pytest.mark.parametrize("values", [{"languages": []}, {"languages": "en"}, {"min_severity": 5}, {"min_severity": True}, {"categories": "general"}, {"fuzzy_threshold": "0.8"}, {"fuzzy_threshold": 1.1}, {"fuzzy_threshold": -0.1}, {"fuzzy_threshold": float("nan")}, {"custom_words": "bad"}, {"min_word_length": 0}, {"max_matches": 0}, {"other": 1}])
def test_settings_with_errors(values):
    errors, _, out = config.check(values)
    assert len(errors) == 1 and out is None and config.sanitize(values) == config.DEFAULT and not config.quick_validate(values)
    with pytest.raises(ValueError):
        config.ConfigManager().update(**values)


@pytest.mark.parametrize(
    "values",
    [{"fuzzy_threshold": 0.4}, {"fuzzy_threshold": 0.96}, {"fuzzy": False, "fuzzy_threshold": 0.7}, {"languages": ["en", "fr", "de", "es", "it", "pt"]}, {"min_severity": 3}, {"languages": ["auto", "en"]}, {"custom_words": ["bad"], "whitelist": ["Bad"]}],
)
def test_settings_with_warnings(values):
    errors, warnings, out = config.check(values)
    assert errors == [] and len(warnings) == 1 and out is not None and config.quick_validate(values)


def test_quick_validate_of_no_settings():
    ring: dict = {}
    ring["custom_words"] = [ring]
    assert not config.quick_validate(ring) and not config.quick_validate(None) and config.quick_validate({})


def test_options(spark):
    assert config.check_options({}) == ([], [], config.Options())
    assert config.check_options({"max_length": 20_000_000})[2].max_length == config.GREATEST_LENGTH and config.check_options({"max_length": 20_000_000})[1]
    assert len(config.check_options({"filter_mode": "x", "max_length": -1})[0]) == 2
    d = api.Detector(spark, Config(fuzzy=False))
    out = d.analyze_with(docs(spark, "you idiot"), filter_mode="remove", include_matches=False, include_confidence=False)
    assert not {"matches", "confidence"} & set(out.columns) and "idiot" not in out.first()["filteredText"]
    assert "filteredText" not in d.analyze_with(docs(spark, "a")).columns
    with pytest.raises(ValueError):
        d.analyze_with(docs(spark, "a"), max_length="9")


def test_manager_keys_and_end(spark):
    m, heard = config.ConfigManager(), []
    m.listen(lambda new, changed: heard.append(changed))
    keys = {"languages": "en, fr", "min_severity": "9", "fuzzy": "false", "fuzzy_threshold": "x", "replacement_char": "#"}
    for k, v in keys.items():
        spark.conf.set(f"spark.lexisift.{k}", v)
    try:
        assert config.session_values(spark) == {"languages": ["en", "fr"], "fuzzy": False, "replacement_char": "#"}
        out = m.override(spark)
        assert out.languages == ["en", "fr"] and not out.fuzzy and out.min_severity == 1 and config.environment("production", spark) == out
    finally:
        for k in keys:
            spark.conf.unset(f"spark.lexisift.{k}")
    assert heard == [["languages", "fuzzy", "replacement_char"]]
    m.dispose()
    m.reset()
    assert len(heard) == 1 and len(m.history) == 1


def test_configure_and_reset(spark):
    rows = docs(spark, "you idiot")
    try:
        api.configure(min_severity=4, fuzzy=False)
        assert api.configure(whitelist=["other"]).min_severity == 4
        assert not api.detect(rows).first()["hasProfanity"] and api.is_clean(rows).first()["clean"]
        with pytest.raises(ValueError):
            api.configure(fuzzy_threshold=2)
    finally:
        api.reset()
    assert api.detect(rows).first()["hasProfanity"] and api.filter_texts(rows).first()["filteredText"] != "you idiot"


def test_factories(spark):
    d = api.configured(spark, "strict", ["en", "fr"], fuzzy=False)
    assert d.config.languages == ["en", "fr"] and d.config.min_severity == 3 and not d.config.fuzzy
    assert api.configured(spark).config.languages == ["auto"]
    many = api.collection(spark, ["es", "it"], min_severity=2)
    assert many["es"].config.fuzzy_threshold == 0.7 and many["it"].config.languages == ["it"] and {x.config.min_severity for x in many.values()} == {2}


def test_similar_places(spark):
    rows = docs(spark, "  Worthles thing\n\tworthless\u0085 x", "", None, "nothing here")
    got = {r["doc_id"]: r["m"] for r in rows.select("doc_id", matching.similar_places(F.col("text"), ["worthless", "things"], 0.8).alias("m")).collect()}
    assert [(m["pattern"], m["match"], m["start"], m["end"]) for m in got[0]] == [("worthless", "Worthles", 2, 10), ("things", "thing", 11, 16), ("worthless", "worthless\u0085", 18, 28)]
    assert got[1] == [] and got[2] is None and got[3] == []


def test_prefix_variants_lose_no_pair(spark):
    import random

    draw = random.Random(7)
    make = lambda n: sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(n)})
    a, b = make(80), make(80)
    words = spark.createDataFrame([(x.upper(),) for x in a], "token string")
    known = spark.createDataFrame([(x,) for x in b], "surface string")
    want = {tuple(r) for r in matching.fuzzy_pairs(words.select(F.lower("token").alias("token")), known, 2).collect()}
    every = words.select(F.lower("token").alias("token")).join(known, F.levenshtein(F.lower("token"), F.col("surface")) <= 2).distinct()
    assert len(want) == every.count()
    for prefix in (3, 5):
        assert {tuple(r) for r in matching.fuzzy_pairs(words, known, 2, prefix, case_sensitive=False).collect()} == want


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.6, 0.75, 0.8, 1.0])
def test_similarity_join_loses_no_pair(spark, threshold):
    import random

    draw = random.Random(int(threshold * 100))
    make = lambda n, most: sorted({"".join(draw.choice("abcé") for _ in range(draw.randint(0, most))) for _ in range(n)})
    words, patterns = spark.createDataFrame([(x,) for x in make(150, 12)], "w string"), spark.createDataFrame([(x.upper(),) for x in make(60, 10)], "pattern string")
    near = matching.similar_pairs(words, patterns, threshold)
    every = words.where("w != ''").crossJoin(patterns.where("pattern != ''")).withColumn("s", tx.similarity(F.col("w"), F.col("pattern"))).where(F.col("s") >= threshold)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, every.collect())) and every.count() > 0
    assert "NestedLoop" not in near._jdf.queryExecution().toString() and "Cartesian" not in near._jdf.queryExecution().toString()


def test_similarity_join_of_no_patterns(spark):
    words = spark.createDataFrame([("a",)], "w string")
    assert matching.similar_pairs(words, words.select(F.col("w").alias("pattern")).limit(0)).count() == 0
    with pytest.raises(ValueError):
        matching.similar_pairs(words, words.select(F.col("w").alias("pattern")), 0)


def test_blank_texts_of_the_sync_form(spark):
    rows = docs(spark, "", None, " \n", "the cat is with the dog and they are here").select("doc_id", langid.detect_sync(F.col("text")).alias("f"), langid.detect(F.col("text")).alias("g"))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert all([(x["language"], x["confidence"]) for x in got[k]["f"]] == [("en", 0.1)] for k in range(3)) and got[3]["f"] == got[3]["g"]


def test_primary_result_is_the_winners_alone(spark):
    rows = docs(spark, "you idiot and scum, the man is with the dog and they are here", "le merde est dans la maison et il ne pas, idiot", "")
    out = {r["doc_id"]: r for r in api.Detector(spark, Config(fuzzy=False)).multi_language(rows, ["en", "fr"]).collect()}
    assert out[0]["primary"] == "en" and out[0]["result"]["totalMatches"] == 2 and out[0]["result"]["maxSeverity"] == 2
    assert out[1]["primary"] == "fr" and [m["match"] for m in out[1]["result"]["matches"]] == ["merde"] and len(out[1]["matches"]) == 2
    assert out[2]["primary"] == "en" and not out[2]["result"]["hasProfanity"] and out[2]["result"]["confidence"] == 1.0


def test_budget_takes_languages_in_turn(spark):
    words = [("en", "aaa"), ("en", "bbb"), ("fr", "ccc"), ("fr", "abab")]
    lex = lx.from_entries(spark, [{"language": k, "word": w, "severity": 2, "categories": ["general"]} for k, w in words])
    run = lambda text, most: [(m["language"], m["word"], m["distance"]) for m in api.Detector(spark, Config(languages=["fr", "en"], context=False, max_matches=most), lex)._candidates(docs(spark, text)).select(scoring.budget(F.col("candidates"), F.col("languages"), most, max(1, most // 2)).alias("m")).first()["m"]]
    assert run("aaa bbb ccc", 2) == [("fr", "ccc", 0), ("en", "aaa", 0)]
    assert run("aaa bbb ccc ccx aax", 3) == [("fr", "ccc", 0), ("fr", "ccx", 1), ("en", "aaa", 0)]  # no fuzzy ones of en: half is spent
    assert run("aaa aax bbx aax", 9) == [("en", "aaa", 0), ("en", "aax", 1), ("en", "aax", 1), ("en", "bbx", 1)]


def test_statistics_information_and_health(spark):
    d = api.Detector(spark)
    n = {(r["kind"], r["key"]): r["n"] for r in d.stats().collect()}
    assert n["language", "fr"] == sum(e[0] == "fr" for e in lx.BUILT_IN)
    assert set(config.UTILITY_PRESETS) == {"default", "strict", "lenient", "family_friendly"} and config.UTILITY_PRESETS["lenient"].min_severity == 2
    whole = d.analyze_enhanced(docs(spark, "You idiot. Fine day!")).first()
    assert whole["statistics"]["totalWords"] == 4 and whole["textContext"]["textType"] == "unknown" and whole["warnings"] == [] and whole["enhanced"][0]["context"]["sentence"] == "you idiot"
    auto = api.Detector(spark, Config(languages=["auto"])).analyze_enhanced(docs(spark, "You idiot. Fine day!")).first()
    assert results.WARN_AUTO in auto["warnings"]
