"""Queries of the join plans: lexicons of any size, similarity joins, budgets, reloading, forms of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..config import Config, ConfigManager
from ..functions import text as tx
from ..functions.text import normalize
from ..operators import matching, scoring
from ..session import shared_folder
from ..sources import lexicon as lx
from ..streaming import detect
from . import base, more_queries
from . import queries as core
from .base import hits_sql, tokens_sql
from .queries import by_doc, query


# ---------------------------------------------------------------- lexicons of any size


@query("lexicon_joined", hits_sql('SELECT doc_id, start, "end", word, term, language, severity FROM hits'))
def lexicon_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of the lexicon by the plan of large lexicons: word sequences joined with surfaces."""
    rows = base.normed(spark, sf).withColumn("langs", F.array("lang"))
    found = matching.hit_rows(matching.join_matches(rows, base.lexicon(spark), languages="langs"))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "word", "term", "language", "severity")


_PHRASE = "p[i] || p[i + 1] || p[i + 2] || p[i + 3] || p[i + 4]"


def _phrases_sql(name: str, table: str, columns: str) -> str:
    return f"""{name} AS (SELECT {columns} {_PHRASE} AS phrase FROM (SELECT *, unnest(range(1, len(p) - 3)) AS i FROM (SELECT *, regexp_extract_all({base.norm_sql('text')}, '[a-z0-9]+|[^a-z0-9]+') AS p FROM {table}))
  WHERE regexp_matches(p[i], '^[a-z0-9]') AND p[i + 1] = ' ' AND p[i + 3] = ' ')"""


def phrases(texts: DataFrame, words: int = 3) -> DataFrame:
    """phrase: the texts' different sequences of so many words with single blanks between them."""
    pieces = F.regexp_extract_all(normalize(F.col("text")), F.lit(matching.PIECES), F.lit(0))
    size = 2 * words - 1

    def sequences(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(p) - size + 1), lambda i: F.get(p, i - 1).rlike("^[a-z0-9]"))
        cut = F.transform(at, lambda i: F.slice(p, i, F.lit(size)))
        blank = lambda x: F.forall(F.sequence(F.lit(1), F.lit(words - 1)), lambda k: F.get(x, 2 * k - 1) == " ")
        return F.transform(F.filter(cut, blank), lambda x: F.array_join(x, ""))

    rows = texts.select(pieces.alias("p")).where(F.size("p") >= size)
    return rows.select(F.explode(sequences(F.col("p"))).alias("phrase")).distinct()


@query("benchmark_phrases", f"""WITH {_phrases_sql("b", "benchmark", "")}, {_phrases_sql("d", "documents", "doc_id,")}, k AS (SELECT DISTINCT phrase FROM b)
SELECT doc_id, count(*) AS n, count(DISTINCT phrase) AS phrases FROM d JOIN k USING (phrase) GROUP BY doc_id""")
def benchmark_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """All three-word phrases of the benchmark as a lexicon, which grows with it, matched over the documents."""
    own = phrases(spark.read.parquet(f"{sf}/benchmark.parquet"))
    entries = own.select(F.lit("en").alias("lang"), F.col("phrase").alias("word"), F.lit(1).alias("severity"), F.array(F.lit("general")).alias("categories"), F.array().cast("array<string>").alias("variations"), F.lit(False).alias("case_sensitive"), F.lit(0).alias("seq"))
    found = matching.hit_rows(matching.join_matches(base.normed(spark, sf), lx.surfaces(entries)))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("word").alias("phrases"))


# ---------------------------------------------------------------- similarity join


_PART_WORDS = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS pattern FROM part"


@query("part_name_similarity", tokens_sql(f""", w AS (SELECT DISTINCT token AS w FROM tok), p AS ({_PART_WORDS})
SELECT w, pattern, floor((1 - levenshtein(w, pattern)::DOUBLE / greatest(length(w), length(pattern))) * 1000 + 0.5) / 1000 AS similarity FROM w, p
WHERE 1 - levenshtein(w, pattern)::DOUBLE / greatest(length(w), length(pattern)) >= 0.6"""))
def part_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' different tokens that are like a word of a part's name, whatever the number of either."""
    words = matching.tokens(base.normed(spark, sf)).select(F.col("token").alias("w"))
    patterns = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.split(F.lower("p_name"), " ")).alias("pattern"))
    near = matching.similar_pairs(words, patterns, 0.6)
    return near.select("w", "pattern", (F.floor(F.col("similarity") * 1000 + 0.5) / 1000).alias("similarity"))


# ---------------------------------------------------------------- budget and primary result


_ORDER, _MOST, _BELOW = ["en", "fr", "de"], 12, 6


def _budget_sql() -> str:
    """Candidates by language and kind with their place in line, then what is left of the budget at each turn."""
    base_words = "(SELECT language, surface_norm, term, severity FROM lex WHERE NOT is_variation)"
    turns, before = [], "0"
    for k, code in enumerate(_ORDER):
        e, f = f"least(greatest({_MOST} - ({before}), 0), coalesce(max(n) FILTER (language = '{code}' AND kind = 0), 0))", ""
        f = f"CASE WHEN ({before}) < {_BELOW} THEN least(greatest({_MOST} - ({before}) - e{k}, 0), coalesce(max(n) FILTER (language = '{code}' AND kind = 1), 0)) ELSE 0 END"
        turns += [f"{e} AS e{k}", f"{f} AS f{k}"]
        before = f"{before} + e{k} + f{k}"
    cases = " ".join(f"WHEN x.language = '{code}' THEN CASE WHEN kind = 0 THEN e{k} ELSE f{k} END" for k, code in enumerate(_ORDER))
    langs = base.in_list(_ORDER)
    return f"""WITH {base.lexicon_sql()}, {base.NORM_SQL}, {base.TOKENS_SQL}, {core._ALL_HITS},
n AS (SELECT doc_id, start, start + length(token) AS "end", token AS word, l.term, l.language, levenshtein(token, surface_norm) AS distance, min(start) OVER (PARTITION BY doc_id, l.language, token) AS first
  FROM tok JOIN {base_words} l ON abs(length(token) - length(surface_norm)) <= 1 AND levenshtein(token, surface_norm) = 1 WHERE length(token) >= 2),
x AS (SELECT doc_id, language, 0 AS kind, start, "end", word, term, 0 AS distance, row_number() OVER (PARTITION BY doc_id, language ORDER BY "end", start, term) AS k FROM hits WHERE language IN {langs}
  UNION ALL SELECT doc_id, language, 1, start, "end", word, term, distance, row_number() OVER (PARTITION BY doc_id, language ORDER BY first, distance, term, start) FROM n WHERE language IN {langs}),
c AS (SELECT doc_id, language, kind, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT doc_id, {', '.join(turns)} FROM c GROUP BY doc_id)
SELECT x.doc_id, x.language, start, "end", word, term, CAST(distance AS INT) AS distance FROM x JOIN b USING (doc_id) WHERE k <= CASE {cases} END"""


@query("candidate_budget", _budget_sql())
def candidate_budget(spark: SparkSession, sf: str) -> DataFrame:
    """What a budget of few candidates a text leaves of exact and fuzzy ones of three languages in turn."""
    lex = base.lexicon(spark).where(F.col("lang").isin(_ORDER))
    found = matching.automaton_matches(base.normed(spark, sf), lex, 1)
    spent = scoring.budget(F.col("candidates"), F.array(*map(F.lit, _ORDER)), _MOST, _BELOW)
    rows = found.select("doc_id", F.explode(spent).alias("m"))
    return rows.select("doc_id", "m.language", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.word", F.col("m.match").alias("term"), "m.distance")


_PARTS = core.detect_sql("").replace("FROM g WHERE conf >= 0.3)", "FROM (SELECT *, doc_id * 10 + CASE language WHEN 'en' THEN 1 ELSE 2 END AS part FROM g WHERE language IN ('en', 'fr')) WHERE conf >= 0.3)").replace("PARTITION BY doc_id ORDER BY start, severity DESC", "PARTITION BY part ORDER BY start, severity DESC").replace("v AS (SELECT doc_id, k, k AS kept", "v AS (SELECT part AS doc_id, k, k AS kept").replace("UNION ALL SELECT o.doc_id, o.k, CASE", "UNION ALL SELECT o.part, o.k, CASE").replace("ON o.doc_id = f.doc_id AND o.k = f.k + 1)", "ON o.part = f.doc_id AND o.k = f.k + 1)").replace("ON o.doc_id = w.doc_id AND o.k = w.kept", "ON o.part = w.doc_id AND o.k = w.kept")
_SURE = more_queries._RANKED + """ SELECT s.doc_id, greatest(0.1, coalesce(max(c) FILTER (language = 'en' AND n <= 3), CASE WHEN count(language) = 0 THEN 0.11 ELSE 0 END)) AS en, greatest(0.1, coalesce(max(c) FILTER (language = 'fr' AND n <= 3), 0)) AS fr FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id"""


core.ORACLES["multi_language"] = f"""{_PARTS}, sure AS (SELECT doc_id, CASE WHEN fr > en THEN 'fr' ELSE 'en' END AS "primary" FROM ({_SURE}))
SELECT sure.doc_id, "primary", CAST(count(x.doc_id) AS INT) AS n, count(DISTINCT x.language) > 1 AS cross_language FROM sure LEFT JOIN final x ON x.doc_id = sure.doc_id GROUP BY ALL"""


@query("primary_result", f"""{_PARTS}, sure AS (SELECT doc_id, CASE WHEN fr > en THEN 'fr' ELSE 'en' END AS "primary" FROM ({_SURE})),
pm AS (SELECT sure.doc_id, "primary", count(x.doc_id) AS n, max(x.severity) AS s, avg(final) AS a FROM sure LEFT JOIN final x ON x.doc_id = sure.doc_id AND x.language = sure."primary" GROUP BY ALL)
SELECT pm.doc_id, "primary", n > 0 AS profane, CAST(n AS INT) AS matches, CAST(coalesce(s, 1) AS INT) AS severity,
floor((CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, greatest(0.1, a * (0.7 + least(1.0, length(text)::DOUBLE / 100) * 0.2 + least(1.0, n::DOUBLE / 5) * 0.1))) END)::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM pm JOIN norm USING (doc_id)""")
def primary_result(spark: SparkSession, sf: str) -> DataFrame:
    """The result of a text's primary language alone, of two that were analysed."""
    out = api.Detector(spark, Config(fuzzy=False)).multi_language(base.docs(spark, sf), ["en", "fr"])
    r = F.col("result")
    return out.select("doc_id", "primary", r["hasProfanity"].alias("profane"), r["totalMatches"].alias("matches"), r["maxSeverity"].alias("severity"), (F.floor(r["confidence"] * 1000 + 0.5) / 1000).alias("confidence"))


# ---------------------------------------------------------------- reloading


_FIRST_WITHOUT, _THEN_WITHOUT = ["heit", "mente"], ["thing", "of the"]
_RELOADED = core.detect_sql("SELECT CAST(norm.doc_id % 2 + 1 AS INT) AS lexicon_version, norm.lang, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches FROM norm LEFT JOIN (SELECT doc_id, count(*) AS n FROM final GROUP BY doc_id) USING (doc_id) GROUP BY ALL").replace("FROM hits WHERE", f"FROM hits WHERE NOT (doc_id % 2 = 0 AND term IN {base.in_list(_FIRST_WITHOUT)}) AND NOT (doc_id % 2 = 1 AND term IN {base.in_list(_THEN_WITHOUT)}) AND", 1)


@query("stream_reload", _RELOADED)
def stream_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that arrive in two lots, the second after a new version of the lexicon."""
    where = shared_folder(spark, "reload")
    settings = f"{where}/settings"
    spark.createDataFrame([(ConfigManager(Config(languages=core._FOUR, fuzzy=False)).export(),)], "value string").coalesce(1).write.text(settings)
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), lx.built_in(spark)
    for k, without in enumerate((_FIRST_WITHOUT, _THEN_WITHOUT)):
        lx.publish(known.where(~F.col("word").isin(without)), f"{where}/lexicon")
        docs.where(F.pmod("doc_id", F.lit(2)) == k).write.mode("append").parquet(f"{where}/in")
        stream = detect.read_documents(spark, f"{where}/in")
        detect.detect_reloading(stream, f"{where}/lexicon", f"{where}/out", f"{where}/state", settings, lambda out: out.select("doc_id", "lang", "totalMatches")).awaitTermination()
    got = spark.read.schema("doc_id long, lang string, totalMatches int, lexicon_version int, batch int").parquet(f"{where}/out")
    return got.groupBy("lexicon_version", "lang").agg(F.count("*").alias("documents"), F.sum("totalMatches").alias("matches"))


# ---------------------------------------------------------------- compatibility forms


#: Printable ASCII characters and their full-width forms.
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _NARROW)


def _wide(c: Column) -> Column:
    return F.translate(c, _NARROW, _WIDE)


by_doc("wide_forms", lambda c: {"form": tx.unicode_form("NFKC")(c), "cleaned": tx.clean_for_detection(c), "found": tx.prepare_for_search(c)}, {"form": "nfc_normalize(text)", "cleaned": core._CLEANED, "found": f"trim({core._SPREAD})"}, once=_wide)
