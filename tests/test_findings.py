"""Cases of the findings: results that differed from their SQL, steps that grew too fast."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name: str, texts: list[str | None]) -> tuple[list, list]:
    """A query's rows and its SQL's over documents of these texts."""
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    out = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, out.collect())), sorted(found)


@pytest.mark.parametrize("name", ["similar_places", "similarity_pairs"])
def test_edits_of_accented_words(spark, tmp_path, name):
    """An accented letter is one edit, not one for each of its bytes; white space is Unicode's."""
    got, want = both(spark, tmp_path, name, ["la rélations Nôthing", "worthless pathetic　x\u000bnothing", "r€lation", "", None])
    assert got == want and len(got) == 6


def work(c) -> int:
    """How many calls of the Unicode library a column names."""
    return str(c._jc.toString()).count("Normalizer")


def test_forms_work_once(spark):
    """A chain of forms names its input once: nothing doubles with each step."""
    from pyspark.sql import functions as F

    from lexisift.functions import text as tx

    assert work(tx.process(F.col("t"))) == 3


def test_classes_and_forms_by_character(spark):
    """White space, punctuation and the characters that a form may change, character by character."""
    import unicodedata

    from pyspark.sql import functions as F

    from lexisift.functions import text as tx

    chars = [chr(i) for i in [*range(0x3100), *range(0xFE00, 0x10000), 0x1F600] if not 0xD800 <= i < 0xE000]
    c, df = F.col("c"), spark.createDataFrame([(x,) for x in chars], "c string")
    space = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    marks = r"[\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}\x{a1}-\x{bf}\x{2000}-\x{206f}\x{2e00}-\x{2e7f}]"
    wrong = (c.rlike(space) != c.rlike(tx.SPACE)) | (c.rlike(marks) != c.rlike(tx.PUNCTUATION)) | (c.rlike("[^" + space[1:]) != c.rlike("[^" + tx.SPACE[1:]))
    assert df.where(wrong).count() == 0
    forms = ("NFC", "NFD", "NFKC", "NFKD")
    got = {r[0]: r[1:] for r in df.where(c < "̀").select("c", *[tx.unicode_form(f)(c) for f in forms]).collect()}
    assert got == {x: tuple(unicodedata.normalize(f, x) for f in forms) for x in chars if x < "̀"}


def test_letters_of_words(spark):
    from pyspark.sql import functions as F

    from lexisift.functions import text as tx

    row = spark.createDataFrame([(" Ab-c d e5f   Été " + "x" * 51 + " 你好 ok",)], "t string").select(tx.extract_letters(F.col("t"))).first()[0]
    assert row == ["Ab".lower(), "ef", "ete", "ok"]


def test_sample_and_scripts_of_long_texts(spark):
    """A sample is the same from a text's beginning and from the whole of it; scripts are counted wherever they stand."""
    from pyspark.sql import functions as F

    from lexisift.functions import langid

    texts = ["word " * 1000, "!? " * 900 + "End of it", "..a" * 300, "  " * 500 + "x y " * 100, "Привет " * 90 + "abc " * 400, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}\s\x{feff}]", " "), r"[\s\x{a0}]+", " ")), 1, 200)
    assert all(a == b for a, b in df.select(langid.sample(F.col("t")), whole).collect())
    n = [r[0] for r in df.select(langid.script_counts(F.col("t"))["ru"]).collect()]
    assert n == [0, 0, 0, 0, 540, 0, None]
    found = [r[0] for r in df.select(langid.detect(F.col("t"))).collect()]
    assert found[4][0]["language"] == "ru" and found[5][0]["confidence"] == 0.11


def test_matches_named_once(spark):
    """What a detector has kept and weighed is worked out once on its way through the overlaps."""
    from pyspark.sql import functions as F

    from lexisift.operators import scoring

    assert str(scoring.resolve_overlaps(F.col("kept_so_far"))._jc.toString()).count("kept_so_far") == 1
    assert str(scoring.contexts(F.col("norm"), F.col("kept_so_far"))._jc.toString()).count("kept_so_far") == 1


def test_slices_of_batches():
    """Python gets a batch in parts of bounded text; nothing is lost, empty texts and nulls included."""
    import pyarrow as pa

    from lexisift.operators import matching

    texts = ["x" * 3_000_000, None, "", "é" * 1_500_000, "y" * 9_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "norm"])
    parts = list(matching.slices(batch, 1))
    assert [p.num_rows for p in parts] == [3, 1, 1, 1]
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in matching.slices(batch.slice(0, 0), 1)] == [0]


def test_joined_matches_without_listed_units(spark, monkeypatch):
    """The joins find the same whether the first units of surfaces are listed ahead or not."""
    from lexisift.operators import matching
    from lexisift.plans import base

    docs = spark.createDataFrame([(1, "you idiot of the thing... idiot!"), (2, "nothing like a damn day"), (3, "")], "doc_id long, norm string")
    lex = base.lexicon(spark)
    seen = []
    real = matching._keys
    monkeypatch.setattr(matching, "_keys", lambda *a: seen.append(a[3]) or real(*a))
    rows = lambda: sorted((r["doc_id"], str(r["candidates"])) for r in matching.join_matches(docs, lex).collect())
    a = rows()
    monkeypatch.setattr(matching, "LISTED_UNITS", 1)
    assert rows() == a and seen[0] and seen[1] is None


def test_remainders_of_long_texts(spark):
    """Only a text's end is cut into remainders; their places are those in the whole text."""
    from lexisift.operators import matching

    lex = spark.createDataFrame([("idiot", "idiot"), ("of the", "of the")], "surface_norm string, term string")
    docs = spark.createDataFrame([(1, "w " * 5000 + "idiat"), (2, "idiot"), (3, "some of thes"), (4, "")], "doc_id long, norm string")
    got = sorted(tuple(r) for r in matching.remainder_search(docs, lex, 1).select("doc_id", "start", "end", "term", "distance").collect())
    assert got == [(1, 10000, 10005, "idiot", 1), (2, 0, 5, "idiot", 0), (3, 5, 12, "of the", 1)]


def test_token_list(spark):
    from lexisift.operators import matching

    docs = spark.createDataFrame([("a bc a-b1",), ("bc",), (None,)], "norm string")
    assert sorted(r[0] for r in matching.token_list(docs).collect()) == ["a", "b1", "bc"]
