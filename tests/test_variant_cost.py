"""Delete variants of first letters: the same as letter by letter, and met without a shuffle of them where surfaces are few."""

import random

from pyspark.sql import functions as F

from lexisift.operators import matching
from lexisift.sources import lexicon as lx


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_written_out_variants_are_those_of_each_word(spark, monkeypatch):
    draw = random.Random(3)
    words = ["", "a", "ab", "aa", "éa", "𝒳yz𝒳w", "aaaaaaa", *("".join(draw.choice("abç") for _ in range(draw.randint(1, 9))) for _ in range(60))]
    df = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string")
    for prefix in (1, 2, 3, 5):
        for distance in (0, 1, 2, 3):
            short = lx.delete_variants(df, "w", distance, prefix)
            got = sorted(map(tuple, short.select("w", "variant").collect()))
            with monkeypatch.context() as m:
                m.setattr(lx, "LISTED_VARIANTS", 0)
                want = sorted(map(tuple, lx.delete_variants(df, "w", distance, prefix).select("w", "variant").collect()))
            assert got == want, (prefix, distance)
            assert "lambdafunction" not in _plan(short)


def test_few_surfaces_are_sent_and_many_joined(spark, monkeypatch):
    words = spark.createDataFrame([("Worthles",), ("WORTHLESS",), ("dam",), ("other",), ("hel",)], "token string")
    known = spark.createDataFrame([("worthless",), ("damn",), ("hell",)], "surface string")
    want = {("worthles", "worthless", 1), ("worthless", "worthless", 0), ("dam", "damn", 1), ("hel", "hell", 1)}
    sent = matching.fuzzy_pairs(words, known, 1, 5, case_sensitive=False)
    assert "strategy=broadcast" in _plan(sent) and {tuple(r) for r in sent.collect()} == want
    monkeypatch.setattr(matching, "SENT_ROWS", 0)
    joined = matching.fuzzy_pairs(words, known, 1, 5, case_sensitive=False)
    assert "strategy=broadcast" not in _plan(joined) and {tuple(r) for r in joined.select("token", "surface", F.col("distance")).collect()} == want
