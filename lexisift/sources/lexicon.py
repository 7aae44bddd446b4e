"""The lexicon: one row for each surface form, from the built-in list, JSON files or a caller's table."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

ENTRY = "word string, severity int, categories array<string>, variations array<string>, case_sensitive boolean"
ENTRIES = "lang string, " + ENTRY + ", seq int"
SURFACES = "lang string, surface string, surface_norm string, term string, is_variation boolean, severity int, categories array<string>, case_sensitive boolean, base_conf double, n_tokens int, seq int"

#: The sixteen core categories; a term outside them is dropped by the default configuration.
CORE_CATEGORIES = [
    "general", "profanity", "sexual", "violence", "hate_speech", "discrimination", "substance_abuse", "religious",
    "political", "body_parts", "scatological", "slurs", "disability", "ethnic", "lgbtq", "racial",
]

#: Delete variants of so many places left out that are written out in a plan; more are made letter by letter.
LISTED_VARIANTS = 64

#: A small built-in lexicon of mild terms; full lexicons are read from files (`read_json`).
BUILT_IN: list[tuple[str, str, int, list[str], list[str]]] = [
    ("en", "idiot", 1, ["general"], ["idi0t", "idiots", "1diot"]),
    ("en", "scum", 2, ["general"], ["scvm", "scumbag"]),
    ("en", "shat", 2, ["scatological"], ["sh4t"]),
    ("en", "moron", 1, ["general"], ["m0ron", "morons"]),
    ("en", "stupid", 1, ["general"], ["stup1d", "stoopid"]),
    ("en", "worthless", 2, ["profanity"], ["w0rthless"]),
    ("en", "pathetic", 2, ["profanity"], ["path3tic"]),
    ("en", "damn", 1, ["religious"], ["d4mn", "damned"]),
    ("en", "hell", 1, ["religious"], ["h3ll"]),
    ("en", "crap", 1, ["scatological"], ["cr4p", "crappy"]),
    ("en", "jerk", 1, ["profanity"], ["j3rk"]),
    ("en", "loser", 1, ["profanity"], ["l0ser", "losers"]),
    ("en", "trash", 1, ["profanity"], ["tr4sh"]),
    ("en", "vermin", 3, ["hate_speech", "discrimination"], ["verm1n"]),
    ("en", "kill you", 4, ["violence"], ["k1ll you"]),
    ("en", "shut up", 1, ["general"], ["shutup"]),
    ("en", "hate", 2, ["hate_speech"], ["h8", "hateful"]),
    ("en", "of the", 1, ["general"], []),
    ("en", "thing", 2, ["general"], ["th1ng"]),
    ("de", "dumm", 1, ["profanity"], ["dummkopf"]),
    ("de", "mist", 1, ["general"], ["m1st"]),
    ("de", "blöd", 1, ["profanity"], ["bloed"]),
    ("de", "heit", 2, ["general"], []),
    ("de", "ung der", 1, ["general"], []),
    ("fr", "merde", 2, ["scatological"], ["m3rde"]),
    ("fr", "idiote", 1, ["profanity"], []),
    ("fr", "crétin", 1, ["profanity"], ["cretin"]),
    ("fr", "ment", 2, ["general"], []),
    ("es", "tonto", 1, ["profanity"], ["t0nto"]),
    ("es", "mierda", 2, ["scatological"], ["m1erda"]),
    ("es", "mente", 2, ["general"], []),
    ("es", "de la", 1, ["general"], []),
    ("ko", "바보", 1, ["cultural_insult"], []),
    ("zh", "笨蛋", 1, ["profanity"], []),
]


def built_in(spark: SparkSession) -> DataFrame:
    """The built-in entries."""
    return spark.createDataFrame([(lang, w, s, c, v, False, i) for i, (lang, w, s, c, v) in enumerate(BUILT_IN)], ENTRIES)


def from_entries(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Entries given as dictionaries (lang or language, word, severity, categories, variations)."""
    rows = [(e.get("lang") or e.get("language"), e.get("word"), e.get("severity"), e.get("categories"), e.get("variations"), e.get("case_sensitive", e.get("caseSensitive", False)), i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, ENTRIES)


def read_json(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """Entries of a folder lang=xx/*.json, as `write_json` makes it; other languages' folders aren't read."""
    df = spark.read.schema(ENTRIES).json(path)
    return df.where(F.col("lang").isin(languages)) if languages else df


def read_wrapped(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """One JSON document {"metadata": ..., "words": [...]}."""
    df = spark.read.schema(f"words array<struct<{', '.join(x.replace(' ', ':', 1) for x in ENTRY.split(', '))}>>").option("multiLine", True).json(path)
    out = df.select(F.posexplode("words").alias("seq", "e")).select(F.lit(lang).alias("lang"), "e.*", "seq")
    return out.select(*[x.split(" ")[0] for x in ENTRIES.split(", ")])


def read_maps(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """A language's folder of maps: profanity (list), severity, categories and variations; the last three may be missing."""
    need = spark.read.option("wholetext", True).text(f"{folder}/*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("kind"), "value")
    text = lambda kind, schema: need.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("m"))
    words = text("profanity", "array<string>").select(F.posexplode("m").alias("seq", "word"))
    severity = text("severity", "map<string,int>").select(F.explode("m").alias("word", "severity"))
    categories = text("categories", "map<string,array<string>>").select(F.explode("m").alias("category", "ws")).select("category", F.explode("ws").alias("word")).groupBy("word").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    variations = text("variations", "map<string,array<string>>").select(F.explode("m").alias("word", "variations"))
    out = words.join(severity, "word", "left").join(categories, "word", "left").join(variations, "word", "left")
    return out.select(F.lit(lang).alias("lang"), "word", F.coalesce("severity", F.lit(1)).alias("severity"), F.coalesce("categories", F.array(F.lit("general"))).alias("categories"), "variations", F.lit(False).alias("case_sensitive"), "seq")


def write_json(entries: DataFrame, path: str) -> None:
    """One folder of JSON lines for each language."""
    entries.write.partitionBy("lang").mode("overwrite").json(path)


def to_maps(entries: DataFrame) -> DataFrame:
    """A row per language: severity by word, words by category, variations by word; for lexicons that are files (`map_rows` for any other)."""
    severity = entries.groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "severity")))).alias("severity"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "variations")))).alias("variations"))
    inverted = entries.select("lang", "word", F.explode("categories").alias("category")).groupBy("lang", "category").agg(F.sort_array(F.collect_set("word")).alias("words"))
    return severity.join(inverted.groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "words")))).alias("categories")), "lang")


def map_rows(entries: DataFrame) -> DataFrame:
    """The same maps with a row for each item (lang, kind, key, value), for lexicons of any size."""
    item = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    word = F.col("word")
    of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    items = F.concat(
        F.array(item("profanity", word, F.lit("")), item("severity", word, F.col("severity").cast("string"))),
        F.transform(of("variations"), lambda v: item("variations", word, v)),
        F.transform(of("categories"), lambda c: item("categories", c, word)),
    )
    return entries.select("lang", F.explode(items).alias("i")).select("lang", "i.*")


def problems(entries: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule: blank word, severity out of 1 to 4, no category, no language."""
    rule = F.when(F.col("lang").isNull() | (F.col("lang") == ""), "language").when(F.col("word").isNull() | (F.trim("word") == ""), "word").when(~F.coalesce(F.col("severity").between(1, 4), F.lit(False)), "severity").when(F.coalesce(F.size("categories"), F.lit(0)) < 1, "categories")
    return entries.withColumn("problem", rule).where("problem is not null")


def well_formed(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("word").isNotNull() & (F.trim("word") != ""))


def admitted(entries: DataFrame, min_severity: int = 1, categories: list[str] | None = None) -> DataFrame:
    """Entries severe enough and of one of the categories; both filters stand below any broadcast."""
    out = entries.where(F.col("severity") >= min_severity)
    return out.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))) if categories else out


def fold(c: Column) -> Column:
    """The same fold as the texts get."""
    return normalize(c, contractions=False)


def surfaces(entries: DataFrame, base_conf: float = 1.0) -> DataFrame:
    """A row for each word and variation; the last of equal (lang, surface) wins."""
    own = well_formed(entries).select("lang", F.lower("word").alias("surface"), "word", "severity", "categories", "case_sensitive", "seq", F.lit(False).alias("v"), F.lit(-1).alias("k"))
    more = well_formed(entries).select("lang", F.posexplode("variations").alias("k", "surface"), "word", "severity", "categories", "case_sensitive", "seq").select("lang", F.lower("surface").alias("surface"), "word", "severity", "categories", "case_sensitive", "seq", F.lit(True).alias("v"), "k")
    both = own.unionByName(more).where(F.trim("surface") != "")
    last = Window.partitionBy("lang", "surface").orderBy(F.desc("seq"), F.desc("k"))
    both = both.withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumn("surface_norm", fold(F.col("surface")))
    return both.select("lang", "surface", "surface_norm", F.col("word").alias("term"), F.col("v").alias("is_variation"), "severity", "categories", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"), F.lit(base_conf).cast("double").alias("base_conf"), F.size(F.split("surface_norm", " ")).alias("n_tokens"), "seq")


def with_custom(lexicon: DataFrame, custom: DataFrame) -> DataFrame:
    """The lexicon with a caller's entries at 0.9, for languages that it has."""
    own = surfaces(custom, 0.9)
    return lexicon.unionByName(own.join(lexicon.select("lang").distinct(), "lang", "left_semi"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a lexicon table, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def newest_version(spark: SparkSession, path: str) -> int:
    got = versions(spark, path)
    if not got:
        raise ValueError(f"no version of a lexicon in {path}")
    return got[-1]


def publish(entries: DataFrame, path: str) -> int:
    """Writes entries as the next version of a lexicon table; readers see it when it is whole."""
    number = max(versions(entries.sparkSession, path), default=0) + 1
    entries.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{path}/version={number}")


def languages(entries: DataFrame) -> DataFrame:
    return entries.select("lang").distinct()


def availability(entries: DataFrame, wanted: list[str]) -> DataFrame:
    """A row for each wanted language: how many words it has, and whether it has any."""
    names = entries.sparkSession.createDataFrame([(x,) for x in wanted], "lang string")
    have = entries.groupBy("lang").agg(F.count("*").alias("words"))
    return names.join(F.broadcast(have), "lang", "left").select("lang", F.coalesce("words", F.lit(0)).alias("words"), F.col("words").isNotNull().alias("available"))


def sizes(entries: DataFrame) -> DataFrame:
    """Words, their characters, and the bytes that a language takes as JSON of two-byte characters."""
    one = F.to_json(F.struct("word", "severity", "categories", "variations"))
    return entries.groupBy("lang").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("characters"), (2 * F.sum(F.length(one))).alias("bytes"))


def kept(entries: dict[str, DataFrame], name: str, load, most: int = 5) -> DataFrame:
    """A loaded language from a cache that keeps the last few; what falls out is unpersisted.  Dropping a name reloads it."""
    if name in entries:
        entries[name] = entries.pop(name)
        return entries[name]
    entries[name] = load(name).cache()
    while len(entries) > most:
        entries.pop(next(iter(entries))).unpersist()
    return entries[name]


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """A row for each language folder of maps below root that has a metadata.json: lang, name, version, context."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    parts = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/([^/]+)\.json$", 1).alias("lang"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("kind"), "value")
    of = lambda kind: parts.where(F.col("kind") == kind)
    known = of("metadata").select("lang", F.from_json("value", "name string, version string, wordCount int").alias("m")).where("m is not null")
    context = of("context").select("lang", F.col("value").alias("context"))
    return known.join(context, "lang", "left").select("lang", "m.name", "m.version", F.col("m.wordCount").alias("word_count"), "context")


def stats(entries: DataFrame) -> DataFrame:
    """Entries by language, by severity and by category."""
    cell = entries.select("lang", "severity", F.explode("categories").alias("category"), "word")
    by = lambda kind, c, rows: rows.groupBy(F.col(c).cast("string").alias("key")).agg(F.count_distinct("lang", "word").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    return by("language", "lang", entries).unionByName(by("severity", "severity", entries)).unionByName(by("category", "category", cell))


def trie_stats(lexicon: DataFrame) -> DataFrame:
    """Words, nodes and depth of the prefix tree that the surfaces would make, by language."""
    prefixes = lexicon.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.length("surface")), lambda i: F.substring("surface", F.lit(1), i))).alias("p"))
    nodes = prefixes.groupBy("lang").agg((F.count_distinct("p") + 1).alias("nodes"))
    words = lexicon.groupBy("lang").agg(F.count("*").alias("words"), F.max(F.length("surface")).cast("long").alias("max_depth"), F.sum(F.length("surface")).cast("long").alias("sum_depth"))
    return words.join(nodes, "lang").select("lang", "words", "nodes", "max_depth", "sum_depth", (F.col("nodes") * 96).alias("memory_bytes"))


def delete_variants(words: DataFrame, column: str, distance: int, prefix: int | None = None) -> DataFrame:
    """words with `variant`: the word (or its first letters) with up to `distance` letters left out."""
    if prefix and math.comb(prefix, min(distance, prefix // 2)) <= LISTED_VARIANTS:
        return words.withColumn("variant", F.explode(F.array_distinct(F.array(*_left_out(F.col(column), prefix, distance)))))
    head = F.substring(column, 1, prefix) if prefix else F.col(column)
    out = words.withColumn("_v", F.array(head))
    for _ in range(distance):
        shorter = F.flatten(F.transform("_v", lambda v: F.when(F.length(v) > 1, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))).otherwise(F.array(F.lit("")))))
        out = out.withColumn("_v", F.array_distinct(F.concat("_v", shorter)))
    return out.withColumn("variant", F.explode("_v")).drop("_v")


def _left_out(word: Column, prefix: int, distance: int) -> list[Column]:
    """The first letters with each choice of up to `distance` places left out, written out as expressions; a place beyond a short
    word's end leaves out nothing, so such a word's repeat."""
    out = []
    for n in range(min(distance, prefix) + 1):
        for gone in itertools.combinations(range(1, prefix + 1), n):
            edges = [0, *gone, prefix + 1]
            runs = [F.substring(word, a + 1, b - a - 1) for a, b in itertools.pairwise(edges) if b - a > 1]
            out.append(F.concat(*runs) if runs else F.when(word.isNotNull(), F.lit("")))
    return out


def symspell_stats(lexicon: DataFrame, distance: int = 1) -> DataFrame:
    v = delete_variants(lexicon.where("not is_variation").select("lang", "surface").distinct(), "surface", distance)
    return v.groupBy("lang").agg(F.count_distinct("surface").alias("words"), F.count_distinct("variant").alias("variants"), F.count("*").alias("entries"))
