"""The index of a text against plain slicing, on texts beyond a chunk and a block."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lexisift.operators import matching, places, results, scoring

WHITE = re.compile(r"^\s+|\s+$")


def trimmed(s: str) -> str:
    return WHITE.sub("", s)


def texts() -> list[str]:
    rng = random.Random(11)
    word = lambda: rng.choice(["bad", "fine", "é", "日本", "x1", "\U0001f600", "don't"])
    gap = lambda: rng.choice([" ", " ", "  ", ". ", ".", "\n", "! ", "?\n", " .. ", "\t"])
    out = ["".join(word() + gap() for _ in range(n)) for n in (1, 2, 5, 40, 400, 3000)]
    return [*out, "bad", ".bad.", " bad ", "bad." * 300, "bad " * 700, "." * 200 + "bad", "no match", ""]


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer("bad", text)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, [("bad", "bad", s, e, 1, ["general"], "en", 1.0, 0) for s, e in spans(t)]) for i, t in enumerate(texts())]
    return spark.createDataFrame(data, f"i int, t string, m array<{matching.MATCH}>").repartition(4)


def test_contexts(rows):
    got = rows.select("i", scoring.contexts(F.col("t"), F.col("m"), sentence=True).alias("c")).collect()
    for r in got:
        t = texts()[r["i"]]
        c = {(x["m"]["start"], x["m"]["end"]): x for x in r["c"] or []}
        assert sorted(c) == spans(t)
        for (s, e), x in c.items():
            lo = t.rfind(".", 0, s) + 1
            hi = t.find(".", e + 1) if t.find(".", e + 1) >= 0 else len(t)
            whole = trimmed(t[lo:hi])
            assert (x["lo"], x["size"], x["sentence"]) == (lo, len(whole), whole)
            assert (x["left"], x["right"]) == (trimmed(t[max(0, s - 25) : s]), trimmed(t[e : e + 25]))


def test_positions_and_wide_contexts(rows):
    got = rows.select("i", results.positions(F.col("t"), F.col("m")).alias("p"), results.wide_contexts(F.col("t"), F.col("m")).alias("w"), results.enhance(F.reverse("m"), F.col("t")).alias("e")).collect()
    for r in got:
        t = texts()[r["i"]]
        for (s, e), p, w, x in zip(spans(t), r["p"], r["w"] or [], r["e"], strict=True):
            head = t[:s]
            assert (p["lineNumber"], p["columnStart"], p["columnEnd"]) == (head.count("\n") + 1, s - head.rfind("\n"), e - head.rfind("\n"))
            assert (p["wordIndex"], p["sentenceIndex"]) == (len(re.findall(r"(?<=\S)[ \n\t]", head)), len(re.findall("[.!?]", head)))
            piece = re.search(r"[^.!?]*$", head).group() + re.search(r"^[^.!?]*", t[s:]).group()
            assert w["sentence"] == trimmed(piece)
            assert (w["before"], w["after"]) == (trimmed(t[max(0, s - 50) : s]), trimmed(t[e : e + 50]))
            assert x["start"] == s and x["position"] == p and x["context"] == w


def test_running_and_bisection(spark):
    for n in (0, 1, 127, 128, 129, 700):
        row = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("v") if n else F.array().cast("array<int>").alias("v"))
        got = row.select(places.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("r")).first()["r"]
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]
    offsets = [0, 3, 4, 9]
    at = spark.range(12).select("id", places.last_up_to(F.array(*map(F.lit, offsets)), F.col("id").cast("int")).alias("k")).collect()
    assert all(offsets[r["k"]] == max(o for o in offsets if o <= r["id"]) for r in at)
