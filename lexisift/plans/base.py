"""What several queries share, on the Spark side and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, BASES, CONTRACTIONS
from ..operators import matching
from ..sources import lexicon as lx


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are cores (a table of few row groups);
    larger tables are read as they are cut, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source"))


def lexicon(spark: SparkSession) -> DataFrame:
    return lx.surfaces(lx.admitted(lx.built_in(spark), 1, lx.CORE_CATEGORIES))


def corpus_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicon entries made of the documents themselves, so that a lexicon's queries grow with the data: each language's words of four
    letters or more that occur twice, with severity, categories and variations by rules of their spelling."""
    words = normed(spark, sf).select("lang", F.explode(F.regexp_extract_all("norm", F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    words, n = words.groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 2"), F.length("word")
    names = lambda *x: F.array(*map(F.lit, x))
    categories = F.when(n % 3 == 0, names("general")).when(n % 3 == 1, names("profanity", "hate_speech")).otherwise(names("violence"))
    plural = F.concat("word", F.lit("s"))
    variations = F.when(F.contains("word", F.lit("e")), F.array(F.translate("word", "e", "3"), plural)).otherwise(F.array(plural))
    seq = F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("int")
    return words.select("lang", "word", (1 + n % 4).cast("int").alias("severity"), categories.alias("categories"), variations.alias("variations"), F.lit(False).alias("case_sensitive"), seq.alias("seq"))


def corpus_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return lx.surfaces(lx.admitted(corpus_entries(spark, sf), 1, lx.CORE_CATEGORIES))


def normed(spark: SparkSession, sf: str) -> DataFrame:
    return matching.normalized(docs(spark, sf))


def found(spark: SparkSession, sf: str, phrases: bool = True) -> DataFrame:
    """All documents with `candidates`, the hits in the lexicon of their own language, found inside their rows."""
    lex = lexicon(spark)
    rows = normed(spark, sf).withColumn("langs", F.array("lang"))
    return matching.automaton_matches(rows, lex if phrases else lex.where("n_tokens = 1"), languages="langs").drop("langs")


def hits(spark: SparkSession, sf: str, phrases: bool = True) -> DataFrame:
    """A row per hit."""
    return matching.hit_rows(found(spark, sf, phrases))


def match_struct(confidence: Column | None = None) -> Column:
    """A hit row as the element of a matches array."""
    c = F.col("base_conf") if confidence is None else confidence
    return F.struct("word", F.col("term").alias("match"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "severity", "categories", "language", c.alias("confidence"), F.lit(0).alias("distance"))


def with_matches(spark: SparkSession, sf: str, phrases: bool = True) -> DataFrame:
    """All documents with their array of hits by start; no text is shuffled or joined."""
    return found(spark, sf, phrases).withColumn("matches", matching.by_start(F.col("candidates"))).drop("candidates")


# ---------------------------------------------------------------- DuckDB text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_surfaces() -> list[tuple]:
    """The built-in surfaces, by the rules of the lexicon's table, for the VALUES of the SQL."""
    core, table = set(lx.CORE_CATEGORIES), str.maketrans(ACCENTED, BASES)
    out: dict[tuple[str, str], tuple] = {}
    for lang, word, severity, categories, variations in lx.BUILT_IN:
        if core & set(categories):
            for k, s in enumerate([word, *variations]):
                norm = s.lower().translate(table)
                out[lang, s.lower()] = (lang, s.lower(), norm, word, k > 0, severity, categories)
    return list(out.values())


def lexicon_sql() -> str:
    rows = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)}, {str(e).lower()}, {f}, [{', '.join(map(q, g))}])" for a, b, c, d, e, f, g in py_surfaces())
    return f"lex AS (SELECT *, regexp_extract(surface_norm, '^[a-z0-9]+') AS first, 1.0::DOUBLE AS base_conf, len(string_split(surface_norm, ' ')) AS n_tokens FROM (VALUES {rows}) AS v(language, surface, surface_norm, term, is_variation, severity, categories))"


#: White space as the functions on texts know it (text.SPACE); DuckDB's own class holds ASCII blanks only, without U+000B.
SPACE_SQL = "[\\s\\x{0b}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def edits_sql(word: str, pattern: str) -> str:
    """The edits, in characters, between a word and a pattern of ASCII characters.  DuckDB's levenshtein counts bytes: a character
    outside ASCII is two to four there, so it stands as one that no pattern holds."""
    return f"levenshtein(regexp_replace({word}, '[^[:ascii:]]', chr(1), 'g'), {pattern})"


def norm_sql(column: str) -> str:
    out = f"strip_accents(trim(regexp_replace(lower({column}), '\\s+', ' ', 'g')))"
    for a, b in CONTRACTIONS.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


NORM_SQL = f"norm AS (SELECT doc_id, text, lang, source, {norm_sql('text')} AS t FROM documents)"
CORPUS_SQL = NORM_SQL + """,
en AS (SELECT lang, word, CAST(1 + length(word) % 4 AS INT) AS severity, CASE length(word) % 3 WHEN 0 THEN ['general'] WHEN 1 THEN ['profanity', 'hate_speech'] ELSE ['violence'] END AS categories,
  CASE WHEN contains(word, 'e') THEN [replace(word, 'e', '3'), word || 's'] ELSE [word || 's'] END AS variations, CAST('0x' || substr(md5(word), 1, 7) AS INT) AS seq
  FROM (SELECT lang, unnest(regexp_extract_all(t, '[a-z]{4,}')) AS word FROM norm) GROUP BY lang, word HAVING count(*) >= 2)"""
CORPUS_LEXICON_SQL = CORPUS_SQL + """,
su AS (SELECT lang, word AS surface, word, severity, categories, seq, false AS v, -1 AS k FROM en UNION ALL SELECT lang, unnest(variations), word, severity, categories, seq, true, unnest(range(len(variations))) FROM en),
lex AS (SELECT lang AS language, surface, surface AS surface_norm, word AS term, v AS is_variation, severity, categories, 1.0::DOUBLE AS base_conf
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, surface ORDER BY seq DESC, k DESC) AS n FROM su) WHERE n = 1)"""
TOKENS_SQL = """
pc AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[a-z0-9]+|[^a-z0-9]+') AS p FROM norm),
pu AS (SELECT doc_id, lang, t, unnest(p) AS token, unnest(range(len(p))) AS idx FROM pc),
ps AS (SELECT *, CAST(coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pu),
tok AS (SELECT * FROM ps WHERE regexp_matches(token, '^[a-z0-9]'))"""
HITS_SQL = """
hits AS (SELECT k.doc_id, k.t, k.idx, k.start, k.start + length(l.surface_norm) AS "end", l.surface_norm AS word, l.term, l.language, l.severity, l.categories, l.base_conf, l.n_tokens, l.is_variation
  FROM tok k JOIN lex l ON k.token = l.first AND k.lang = l.language
  WHERE substr(k.t, k.start + 1, length(l.surface_norm)) = l.surface_norm AND NOT regexp_matches(substr(k.t, k.start + length(l.surface_norm) + 1, 1), '[a-z0-9]'))"""


def hits_sql(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{lexicon_sql()}, {NORM_SQL}, {TOKENS_SQL}, {HITS_SQL} {rest}"


def tokens_sql(rest: str) -> str:
    return f"WITH {lexicon_sql()}, {NORM_SQL}, {TOKENS_SQL} {rest}"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"
