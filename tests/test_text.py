"""Goldens of the scalar text functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexisift.functions import charmap, langid
from lexisift.functions import text as tx


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


GOLDENS = [
    (charmap.normalize_leet, {"h3ll0": "hello", "w0rld": "world", "4m4z1ng": "amazing", "$up3r": "super", "(0d3": "code", "7h15": "this"}),
    (charmap.normalize_repetition, {"hellooooo": "helloo", "wooooorld": "woorld", "book": "book", "coffee": "coffee"}),
    (charmap.remove_separators, {"h_e_l_l_o": "hello", "w-o-r-l-d": "world", "t.e.s.t": "test", "c*o*d*e": "code"}),
    (lambda c: charmap.normalize_diacritics(c, "de"), {"Müller": "Mueller", "Größe": "Groesse", "Weiß": "Weiss"}),
    (charmap.normalize_characters, {"h3l-l0": "hello"}),
    (lambda c: charmap.obfuscation(c)["obfuscationLevel"], {"hello": "none", "h3llo": "low", "h3l_l0": "medium"}),
    (tx.process, {"café": "cafe", "naïve": "naive", "São Paulo": "sao paulo", "Hello, world! How are you?": "hello world how are you", "hello\x00\x01world\x7f": "helloworld"}),
    (lambda c: tx.process(c, "de"), {"Müller": "mueller"}),
    (lambda c: tx.process(c, "fr"), {"cœur": "coeur"}),
    (lambda c: tx.process(c, "tr"), {"İstanbul": "istanbul"}),
    (lambda c: F.array_join(tx.extract_letters(c), "|"), {"a bb ccc": "bb|ccc", "123 !@# abc": "abc"}),
    (tx.expand_contractions, {"i don't and won't": "i do not and will not", "plain": "plain"}),
    (lambda c: tx.round2(c.cast("double")), {"0.285": 0.28, "0.295": 0.3}),
]


@pytest.mark.parametrize("k", range(len(GOLDENS)))
def test_goldens(spark, k):
    f, want = GOLDENS[k]
    assert apply(spark, f, list(want)) == list(want.values())


def test_normalize_is_idempotent(spark):
    texts = ["Héllo  Wörld", " don't\tDO ", "ÀÉÎ ñ ß", ""]
    once = apply(spark, tx.normalize, texts)
    assert apply(spark, tx.normalize, once) == once


def test_nulls_stay_null(spark):
    for f in (tx.normalize, tx.normalize_text, charmap.normalize_leet, charmap.remove_separators):
        assert apply(spark, f, [None]) == [None]


def test_language_fallbacks(spark):
    got = apply(spark, langid.detect, ["", "hello", "привет как дела сегодня"])
    assert [g[0]["language"] for g in got] == ["en", "en", "ru"]
    assert got[0][0]["confidence"] == 0.11 and got[1][0]["confidence"] == 0.11


def test_unicode_forms_of_all_characters(spark):
    import unicodedata

    chars = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) != "Cn"]
    rng = random.Random(9)
    marks = ["́", "̈", "̧", "ᅡ", "ᆨ", "가", "ﬁ", "Å", "e", "가", "ﾞ", "か"]
    texts = [*chars, *("".join(rng.choice(marks) for _ in range(rng.randint(2, 9))) for _ in range(2000)), ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    forms = ("NFC", "NFD", "NFKC", "NFKD")
    plain = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F))
    got = rows.select("t", *[tx.unicode_form(f)(F.col("t")).alias(f) for f in forms], tx.remove_diacritics(F.col("t")).alias("plain")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["plain"] == plain(r["t"]) and all(r[f] == unicodedata.normalize(f, r["t"]) for f in forms)
    none = spark.createDataFrame([(None,)], "t string").select(tx.unicode_form("NFKC")(F.col("t")).alias("a"), tx.process(F.col("t")).alias("b")).first()
    assert none["a"] is None and none["b"] is None


def test_compatible_forms_are_found(spark):
    row = spark.createDataFrame([("Ｙｏｕ ｉｄｉｏｔ ﬁne ½ ①",)], "t string").select(tx.clean_for_detection(F.col("t")).alias("c"), F.array_join(tx.extract_letters(F.col("t")), " ").alias("w")).first()
    assert row["c"].startswith("you idiot fine 1") and row["w"] == "you idiot fine"
