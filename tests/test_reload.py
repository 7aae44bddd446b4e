"""A stream whose lexicon and settings change between its batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexisift.config import Config, ConfigManager
from lexisift.sources import lexicon as lx
from lexisift.streaming import detect


def entries(spark, *words):
    return lx.from_entries(spark, [{"language": "en", "word": w, "severity": 2, "categories": ["general"]} for w in words])


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    df.coalesce(1).write.mode("append").parquet(folder)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "lex")
    assert lx.versions(spark, path) == []
    with pytest.raises(ValueError):
        lx.newest_version(spark, path)
    assert [lx.publish(entries(spark, w), path) for w in ("one", "two")] == [1, 2] and lx.versions(spark, path) == [1, 2]
    (tmp_path / "lex" / "version=3").mkdir()  # a version that isn't whole yet
    assert lx.newest_version(spark, path) == 2
    assert [r["word"] for r in lx.read_version(spark, path, 1).collect()] == ["one"]


def test_lexicon_and_settings_change_between_batches(spark, tmp_path):
    src, lex, out, state, conf = (str(tmp_path / x) for x in ("in", "lex", "out", "state", "settings.json"))

    def run():
        kept = lambda found: found.select("doc_id", "totalMatches", F.transform("matches", lambda m: m["match"]).alias("terms"))
        detect.detect_reloading(detect.read_documents(spark, src), lex, out, state, conf, kept).awaitTermination()
        return {r["doc_id"]: (r["totalMatches"], r["lexicon_version"], r["batch"]) for r in spark.read.parquet(out).collect()}

    manager = ConfigManager(Config(fuzzy=False, context=False))
    manager.save_file(conf)
    lx.publish(entries(spark, "alpha"), lex)
    arrive(spark, src, [(1, "alpha beta"), (2, "betta")])
    assert run() == {1: (1, 1, 0), 2: (0, 1, 0)}
    lx.publish(entries(spark, "alpha", "beta"), lex)
    manager.update(fuzzy=True)
    manager.save_file(conf)
    arrive(spark, src, [(3, "alpha beta"), (4, "betta")])
    want = {1: (1, 1, 0), 2: (0, 1, 0), 3: (2, 2, 1), 4: (1, 2, 1)}
    assert run() == want
    assert run() == want  # nothing new
    # a batch that runs again, as after a failure, leaves its rows once
    (tmp_path / "state" / "commits" / "1").unlink()
    crc = tmp_path / "state" / "commits" / ".1.crc"
    if crc.exists():
        crc.unlink()
    assert run() == want
