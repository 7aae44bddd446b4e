"""What language identification works out once, and that its shorter ways give what the longer ones do."""

from pyspark.sql import functions as F

from lexisift.functions import langid
from lexisift.functions.text import split_words

ODD = [
    "the is sing ing walking sly redly x_ed 3rd THE Walking", "le etre ment vraiment une tion nation de les le le", "", "   ", "a", "o a e nao não o não e é a é",
    "está gato esta mesa que acción mente claramente mesaestá estáx", "allez-vous aujourd'hui vous Être xêtre êtres très beau", "für sich glücklich übung zeitung lich ist",
    "tab\tthe\nand line the", "von-der that's der_die der", "attenzione zione uma ação ção maçãox heidelijk lijk", "the" * 90, "Ça è là, dove è la città? x.y,the",
]
LONG = [
    "The weather … is – nice “here” ™ and Ünïcode ½ ¨´¸ ŉ İstanbul " * 60, "  ­\u0007 hidden­ words the and " * 90, "..., " * 500 + "the end of it and that " * 40,
    "plain words that are written " * 80 + "и много русских слов " * 100, "e" + "́" * 3 + "te " * 900, "ΟΔΟΣ the and " * 300, "👍🏽 thumbs ☂ up the and → ≠ " * 120,
    "x" * 1599 + " é and the", " " * 1700 + "the and that with this " * 30, "ﬁne ﬂow the and " * 200, "！ｗｉｄｅ the and " * 200, "한글 the and " * 200, "かな 漢字 the " * 200, "​ the ﻿ and " * 300,
]


def test_texts_are_worked_out_once(spark):
    """The text without white space isn't made anew for each letter, nor a language's share for each that reads it."""
    assert str(langid.rate_similarity(F.col("no_space"), langid.RATES["en"])._jc.toString()).count("no_space") == 1
    assert str(langid.rate_confidences(F.col("the_sample"))._jc.toString()).count("the_sample") == 1


def test_marker_scores_are_the_patterns_hits(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, *LONG]], "t string")

    def plain(lang):
        hits = sum((F.regexp_count("t", F.lit("(?i)" + p)) for p in langid.patterns_of(lang)), F.lit(0))
        n = F.greatest(F.size(split_words(F.col("t"))), F.lit(1))
        return F.size(F.filter(split_words(F.col("t")), lambda w: w.isin(langid.MARKERS[lang]))) / n * 0.7 + hits / n * 0.3

    rows = df.select("t", langid.marker_scores(F.col("t")).alias("all"), *[langid.marker_score(F.col("t"), k).alias(f"one_{k}") for k in langid.MARKERS], *[plain(k).alias(k) for k in langid.MARKERS]).collect()
    for r in rows:
        for k in langid.MARKERS:
            assert r["all"][k] == r[k] == r[f"one_{k}"], (r["t"][:60], k)


def test_a_beginning_says_what_the_whole_says(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, *LONG, *[o + " " + x for o in ODD for x in LONG[:4]]]], "t string")
    whole, short = langid.prepared(F.col("t")), langid._enough(F.col("t"))
    rows = df.select("t", *[f(x).alias(f"{n}{k}") for n, x in (("w", whole), ("s", short)) for k, f in enumerate((langid.sample, lambda c: F.least(F.length(c), F.lit(10)), lambda c: langid.script_counts(c)["ru"] + langid.script_counts(c)["zh"]))]).collect()
    for r in rows:
        assert [r[f"w{k}"] for k in range(3)] == [r[f"s{k}"] for k in range(3)], r["t"][:60]
    lengths = df.select(F.length("t") > 3000, F.length(short) <= 1600).collect()
    assert any(a and b for a, b in lengths)  # a long text's rest isn't processed
