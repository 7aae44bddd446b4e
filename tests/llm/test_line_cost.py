"""Line dedup: work that is done once, in generated code, and cheap conditions before costly ones."""

from __future__ import annotations

import re

from lexisift.llm import line_dedup


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_of_profiles_are_made_once(spark):
    """A line's set is made in one place, and not inside the generator, which would be interpreted then."""
    texts = line_dedup.lines_of(spark.createDataFrame([(1, "a line of some length"), (2, "b")], "doc_id long, text string")).select("h", "line")
    plan = optimized(line_dedup.profiles_of(texts))
    assert plan.count("array_distinct(transform") == 1 and not re.search(r"explode\w*\(array_distinct", plan)


def test_slots_add_nothing(spark):
    """A shingle's flag is set once a base: no checked addition for each slot; all lines have keys, empty samples too."""
    docs = spark.createDataFrame([(1, "a" * 300), (2, "ab" * 900), (3, "x"), (4, "")], "doc_id long, text string")
    bands = line_dedup.band_keys(line_dedup.lines_of(docs).select("h", "line"))
    assert not re.search(r"(min|max)\(\(+[^,]* [+-] ", optimized(bands))
    rows = bands.collect()
    assert len({r["h"] for r in rows}) == 3 and all(len(r["keys"]) == line_dedup.BANDS and None not in r["keys"] and r["occurs"] == 1 for r in rows)


def test_open_pairs_compare_keys_first(spark):
    """Of a bucket's pairs those that another bucket makes are left out before their bitmaps are compared."""
    members = spark.createDataFrame([(k, 1, h) for k in (5, 6) for h in (1, 2, 3)], "key long, a long, h long")
    labels = spark.createDataFrame([(1, 1)], "node long, label long")
    words = [f"p{k}" for k in range(line_dedup.PROFILE)]
    profiles = spark.createDataFrame([(h, 20, *[7] * len(words)) for h in (1, 2, 3)], ", ".join(f"{c} long" for c in ["h", "n", *words]))
    pairs = line_dedup.open_pairs(members, labels, profiles, line_dedup.SIMILAR)
    plan = optimized(pairs)
    assert 0 < plan.index("array_intersect") < plan.index("bit_count")
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3)]
