"""The engine's queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..config import Config
from ..functions import charmap, langid
from ..functions import text as tx
from ..operators import matching, redaction, results, scoring
from ..session import shared_folder
from ..sources import lexicon as lx
from . import base
from .base import hits_sql, q, tokens_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOC = "documents"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def by_doc(name: str, spark_cols: Callable[[Column], dict[str, Column]], sql_cols: dict[str, str], once: Callable[[Column], Column] = lambda c: c) -> None:
    """A query of expressions over documents.text, or over what `once` makes of it, a column of its own."""
    cols = ", ".join(f"{e} AS {k}" for k, e in sql_cols.items())

    @query(name, f"SELECT doc_id, {cols} FROM documents")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return base.docs(spark, sf).select("doc_id", once(F.col("text")).alias("text")).select("doc_id", *[c.alias(k) for k, c in spark_cols(F.col("text")).items()])


# ---------------------------------------------------------------- SQL for text functions

# DuckDB's regular expressions have no back-references: runs are written out for each character that occurs.
_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~éèêëàâäáíîïóôöúùûüñçßÉÈÊÀÂÄÁÍÓÖÜÑÇ¿¡"


def _esc(c: str) -> str:
    return "\\" + c if c in "\\.^$|?*+()[]{}-" else c


def cap_sql(x: str, least: int = 3, keep: int = 2) -> str:
    for c in _CHARS:
        x = f"regexp_replace({x}, {q('(?:' + _esc(c) + '){' + str(least) + ',}')}, {q((c * keep).replace(chr(92), chr(92) * 2))}, 'g')"
    return x


_SPACED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_SHORT = cap_sql("translate(regexp_replace(" + _SPACED.format("lower(text)") + r""", '[_\-.!@#$%^&()+=\[\]{}|\\:;"''<>,?~`*]', '', 'g'), '0134578', 'oieastb')""")
_LONG = "regexp_replace(" + _SPACED.format("lower(text)") + r", '[_\-.!@#$%^&*]', '', 'g')"
for _d, _l in zip(*tx.DIGIT_LETTERS, strict=True):
    _LONG = f"regexp_replace({_LONG}, '\\b{_d}\\b', '{_l}', 'g')"
_LONG = cap_sql(_LONG, 4)
_RUNS = "(" + "|".join("(?:" + _esc(c) + "){3,}" for c in _CHARS) + ")"

by_doc("normalize_pipeline", lambda c: {"norm": tx.normalize(c)}, {"norm": base.norm_sql("text")})
by_doc("normalize_short", lambda c: {"norm": tx.normalize_short(c)}, {"norm": _SHORT})
by_doc("normalize_text", lambda c: {"norm": tx.normalize_text(c)}, {"norm": f"CASE WHEN length(text) <= 50 THEN {_SHORT} ELSE {_LONG} END"})
by_doc(
    "extract_words",
    lambda c: {"n": F.size(tx.extract_words(c)).cast("long"), "words": F.array_join(tx.extract_words(c), " ")},
    {k: f.format("list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')), lambda w: length(w) > 1)") for k, f in {"n": "CAST(len({}) AS BIGINT)", "words": "array_to_string({}, ' ')"}.items()},
)
_PUNCT = "[\\x{21}-\\x{2f}\\x{3a}-\\x{40}\\x{5b}-\\x{60}\\x{7b}-\\x{7e}\\x{a1}-\\x{bf}\\x{2000}-\\x{206f}\\x{2e00}-\\x{2e7f}]"
_PROCESSED = "translate(lower(translate(regexp_replace(text, '[\\p{C}]', '', 'g'), '" + "".join(tx.LANGUAGE_FOLDS["en"]) + "', '" + "".join(tx.LANGUAGE_FOLDS["en"].values()) + "')), '', '')"
_CLEANED = _SPACED.format(f"regexp_replace(strip_accents({_PROCESSED}), '{_PUNCT}', '', 'g')")
_SPREAD = f"regexp_replace(strip_accents({_PROCESSED}), '{_PUNCT}', ' ', 'g')"
by_doc("clean_for_detection", lambda c: {"cleaned": tx.clean_for_detection(c)}, {"cleaned": _CLEANED})
by_doc(
    "extract_letters",
    lambda w: {"n": F.size(w).cast("long"), "words": F.array_join(w, " ")},
    {k: f.format(f"list_filter(list_transform(string_split_regex({_SPREAD}, '\\s+'), lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')), lambda w: length(w) BETWEEN 2 AND 50)") for k, f in {"n": "CAST(len({}) AS BIGINT)", "words": "array_to_string({}, ' ')"}.items()},
    once=tx.extract_letters,
)
_ALIKE = "translate(text, " + q(charmap._ALIKE) + ", " + q(charmap._ALIKE_TO) + ")"
for _a, _b in charmap.WRITTEN_OUT.items():
    _ALIKE = f"replace({_ALIKE}, {q(_a)}, {q(_b)})"
_DE = "text"
for _a, _b in charmap.DIACRITICS_OF["de"].items():
    _DE = f"replace({_DE}, {q(_a)}, {q(_b)})"
_LEET = f"translate(text, {q(''.join(charmap.LEET))}, {q(''.join(charmap.LEET.values()))})"
_SEPARATED = _SPACED.format("regexp_replace({}, '[_\\-.~*+=|\\\\/<>]+', '', 'g')")
by_doc("leet_normalize", lambda c: {"plain": charmap.normalize_leet(c)}, {"plain": _LEET})
by_doc("homograph_normalize", lambda c: {"plain": charmap.normalize_alike(c)}, {"plain": _ALIKE})
by_doc("diacritics_de", lambda c: {"plain": charmap.normalize_diacritics(c, "de")}, {"plain": f"translate({_DE}, {q(charmap.DIACRITICS[0])}, {q(charmap.DIACRITICS[1])})"})
by_doc("repetition", lambda c: {"plain": charmap.normalize_repetition(c)}, {"plain": cap_sql("text")})
by_doc("separators", lambda c: {"plain": charmap.remove_separators(c)}, {"plain": _SEPARATED.format("text")})
_FLAGS = {
    "leet": f"regexp_matches(text, {q('[' + ''.join(_esc(c) if not c == '`' else c for c in charmap.LEET_CHOICES) + ']')})",
    "alike": f"regexp_matches(text, {q(charmap.ALIKE_CLASS)})",
    "diacritics": f"regexp_matches(text, {q(charmap.ACCENT_CLASS)})",
    "repetition": f"regexp_matches(text, {q(_RUNS)})",
    "separators": "regexp_matches(text, '[_\\-.~*+=|\\\\/<>]+')",
}
_SUM = " + ".join(f"CAST({v} AS INT)" for v in _FLAGS.values())


def _obfuscation(c: Column) -> dict[str, Column]:
    o = charmap.obfuscation(c)
    return {"leet": o["hasLeetspeak"], "alike": o["hasHomographs"], "diacritics": o["hasDiacritics"], "repetition": o["hasRepetition"], "separators": o["hasSeparators"], "level": o["obfuscationLevel"]}


by_doc("obfuscation_level", _obfuscation, _FLAGS | {"level": f"CASE {_SUM} WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END"})
_ENCODING = {k: f"regexp_matches(text, {q(v)})" for k, v in tx.SCRIPTS.items()}
by_doc("encoding_flags", tx.scripts, _ENCODING)
by_doc(
    "text_stats",
    lambda c: {k: v for k, v in tx.text_stats(c).items() if k in ("length", "wordCount", "charCount", "isRTL", "hasMultipleScripts")},
    {"wordCount": f"CAST(len(list_filter(list_transform(string_split_regex({_SPREAD}, '\\s+'), lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')), lambda w: length(w) BETWEEN 2 AND 50)) AS INT)", "length": "CAST(length(text) AS INT)", "charCount": "CAST(length(regexp_replace(text, '\\s', '', 'g')) AS INT)", "isRTL": f"regexp_matches(text, {q(tx.RTL)})", "hasMultipleScripts": "(" + " + ".join(f"CAST({v} AS INT)" for v in _ENCODING.values()) + ") > 1"},
)


def _count(pattern: str, x: str = "text") -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


_N = "length(regexp_replace(text, '\\s', '', 'g'))"
_SHARE = {k: f"least({_count(p)}::DOUBLE / {_N} * 4, 1.0)" for k, p in langid.SCRIPT_CLASSES.items()}
by_doc("script_detect", lambda c: {k: tx.round2(v) for k, v in langid.script_confidence(c).items()}, {k: f"CASE WHEN {_N} > 0 AND {s} > 0.05 THEN floor({s} * 0.9 * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END" for k, s in _SHARE.items()})
_SAMPLE = "substr(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200)"


def _rate_sql(table: dict[str, float], x: str) -> str:
    plain = f"replace({x}, ' ', '')"
    terms = " + ".join(f"greatest(0.0::DOUBLE, {r}::DOUBLE - abs((length({plain}) - length(replace({plain}, {q(k)}, '')))::DOUBLE / length({plain}) * 100 - {r}::DOUBLE))" for k, r in table.items())
    return f"CASE WHEN length({plain}) > 0 THEN ({terms}) / {sum(table.values())}::DOUBLE ELSE 0.0::DOUBLE END"


@query("char_frequency", "WITH s AS (SELECT doc_id, " + _SAMPLE + " AS x FROM documents) SELECT doc_id, " + ", ".join(f"floor(({_rate_sql(t, 'x')}) * 10000 + 0.5) / 10000 AS {k}" for k, t in langid.RATES.items()) + " FROM s")
def char_frequency(spark: SparkSession, sf: str) -> DataFrame:
    s = base.docs(spark, sf).select("doc_id", F.regexp_replace(langid.sample(F.col("text")), " ", "").alias("x"))
    return s.select("doc_id", *[(F.floor(langid.rate_similarity(F.col("x"), t) * 10000 + 0.5) / 10000).alias(k) for k, t in langid.RATES.items()])


def _marker_sql(lang: str, x: str) -> str:
    words = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    marks = "[" + ", ".join(map(q, dict.fromkeys(langid.MARKERS[lang]))) + "]"
    patterns = [p.replace(langid._EDGE, "\\b") for p in langid.patterns_of(lang)]
    hits = " + ".join(_count("(?i)" + p, x) for p in patterns)
    n = f"greatest(len({words}), 1)"
    return f"len(list_filter({words}, lambda w: list_contains({marks}, w)))::DOUBLE / {n} * 0.7 + ({hits})::DOUBLE / {n} * 0.3"


@query("marker_score", "WITH s AS (SELECT doc_id, " + _SAMPLE + " AS x FROM documents) SELECT doc_id, " + ", ".join(f"floor(({_marker_sql(k, 'x')}) * 10000 + 0.5) / 10000 AS {k}" for k in langid.MARKERS) + " FROM s")
def marker_score(spark: SparkSession, sf: str) -> DataFrame:
    s = base.docs(spark, sf).select("doc_id", langid.sample(F.col("text")).alias("x"))
    return s.select("doc_id", *[(F.floor(langid.marker_score(F.col("x"), k) * 10000 + 0.5) / 10000).alias(k) for k in langid.MARKERS])


def _langid_sql() -> str:
    """The whole combination, for texts without the six scripts' characters (their confidences are checked above)."""
    engine = "trim(strip_accents(" + _PROCESSED + "))"
    sample = _SAMPLE.replace("lower(text)", "lower(e)")
    parts = []
    for k, lang in enumerate(dict.fromkeys([*langid.MARKERS, *langid.RATES])):
        p = f"(SELECT CASE WHEN s > 0.02 THEN least(s * 2.8, 1.0) ELSE 0.0 END FROM (SELECT {_marker_sql(lang, 'x')} AS s))" if lang in langid.MARKERS else "0.0"
        r = f"(SELECT CASE WHEN s > 0.15 THEN s * 0.4 ELSE 0.0 END FROM (SELECT {_rate_sql(langid.RATES[lang], 'x')} AS s))" if lang in langid.RATES else "0.0"
        parts.append(f"SELECT doc_id, e, {k} AS k, '{lang}' AS language, least({p} * 0.65 + {r} * 0.10, 1.0) AS y FROM s")
    return f"""WITH e AS (SELECT doc_id, {engine} AS e FROM documents), s AS MATERIALIZED (SELECT doc_id, e, {sample} AS x FROM e),
a AS ({' UNION ALL '.join(parts)}), b AS (SELECT *, CASE WHEN y > 0.5 AND y < 0.8 THEN least(y * 1.1, 1.0) ELSE y END AS c FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, k) AS n FROM b WHERE c > 0.08 AND length(e) >= 10),
t AS (SELECT doc_id, max(language) FILTER (n = 1) AS first, max(c) FILTER (n = 1) AS c1, max(language) FILTER (n = 2) AS second, max(c) FILTER (n = 2) AS c2, count(*) FILTER (n <= 3) AS found FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(first, 'en') AS first, floor(coalesce(c1, 0.11)::DOUBLE * 1000 + 0.5) / 1000 AS c1, coalesce(second, '-') AS second, CAST(coalesce(found, 1) AS INT) AS found, coalesce(c2, 0)::DOUBLE > 0.3 AS mixed FROM s LEFT JOIN t USING (doc_id)"""


@query("langid_top3", _langid_sql())
def langid_top3(spark: SparkSession, sf: str) -> DataFrame:
    found = base.docs(spark, sf).select("doc_id", langid.detect(F.col("text")).alias("f"))
    c1 = F.get("f", F.lit(0))["confidence"]
    return found.select("doc_id", langid.primary(F.col("f")).alias("first"), (F.floor(c1 * 1000 + 0.5) / 1000).alias("c1"), F.coalesce(F.get("f", F.lit(1))["language"], F.lit("-")).alias("second"), F.size("f").alias("found"), langid.mixed(F.col("f")).alias("mixed"))


_LATIN = " + ".join(f"CAST(regexp_matches(text, {q(p)}) AS INT)" for p in [*langid.SCRIPT_CLASSES.values(), "[a-zA-Z]"])
by_doc("multiple_scripts", lambda c: {"several": langid.multiple_scripts(c)}, {"several": f"({_LATIN}) > 1"})

# ---------------------------------------------------------------- lexicon


@query("lexicon_stats", f"""WITH {base.CORPUS_SQL} SELECT 'language' AS kind, lang AS key, count(*) AS n FROM en GROUP BY lang UNION ALL SELECT 'severity', CAST(severity AS VARCHAR), count(*) FROM en GROUP BY severity
UNION ALL SELECT 'category', c, count(*) FROM (SELECT unnest(categories) AS c FROM en) GROUP BY c""")
def lexicon_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lx.stats(base.corpus_entries(spark, sf))


@query("lexicon_surfaces", f"WITH {base.CORPUS_LEXICON_SQL} SELECT language AS lang, surface, surface_norm, term, is_variation, severity, array_to_string(categories, ',') AS categories FROM lex")
def lexicon_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    return base.corpus_lexicon(spark, sf).select("lang", "surface", "surface_norm", "term", "is_variation", "severity", F.array_join("categories", ",").alias("categories"))


@query("lexicon_nodes", f"""WITH {base.CORPUS_LEXICON_SQL}, p AS (SELECT language AS lang, substr(surface, 1, unnest(range(1, length(surface) + 1))::INT) AS p FROM lex), n AS (SELECT lang, count(DISTINCT p) + 1 AS nodes FROM p GROUP BY lang)
SELECT language AS lang, count(*) AS words, any_value(nodes) AS nodes, CAST(max(length(surface)) AS BIGINT) AS max_depth, CAST(sum(length(surface)) AS BIGINT) AS sum_depth, any_value(nodes) * 96 AS memory_bytes FROM lex JOIN n ON n.lang = lex.language GROUP BY language""")
def lexicon_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return lx.trie_stats(base.corpus_lexicon(spark, sf))


@query("symspell_stats", f"""WITH {base.CORPUS_LEXICON_SQL}, w AS (SELECT DISTINCT language AS lang, surface FROM lex WHERE NOT is_variation),
v AS (SELECT lang, surface, surface AS v FROM w UNION SELECT lang, surface, substr(surface, 1, i::INT - 1) || substr(surface, i::INT + 1) FROM (SELECT lang, surface, unnest(range(1, length(surface) + 1)) AS i FROM w))
SELECT lang, count(DISTINCT surface) AS words, count(DISTINCT v) AS variants, count(*) AS entries FROM v GROUP BY lang""")
def symspell_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lx.symspell_stats(base.corpus_lexicon(spark, sf))


_RAW = {"lang": "CASE WHEN source = 'src3' THEN NULL WHEN source = 'src4' THEN '' ELSE lang END", "word": "CASE WHEN n_chars % 7 = 0 THEN ' ' WHEN n_chars % 11 = 0 THEN NULL ELSE substr(text, 1, 9) END", "severity": "CAST(n_chars % 6 AS INT)"}


@query("lexicon_problems", f"""WITH r AS (SELECT doc_id, {_RAW['lang']} AS lang, {_RAW['word']} AS word, {_RAW['severity']} AS severity, doc_id % 5 AS c FROM documents)
SELECT * FROM (SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN 'language' WHEN word IS NULL OR trim(word) = '' THEN 'word' WHEN severity NOT BETWEEN 1 AND 4 THEN 'severity' WHEN c = 0 THEN 'categories' WHEN c = 1 THEN 'categories' END AS problem FROM r) WHERE problem IS NOT NULL""")
def lexicon_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Which rule each entry breaks, of entries made of the documents' starts, many of them with faults."""
    c = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 5 > 1, F.array(F.lit("general")))
    raw = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *[F.expr(v).alias(k) for k, v in _RAW.items()], c.alias("categories"))
    return lx.problems(raw).select("doc_id", "problem")


def _variations_sql() -> str:
    x = "[lower(r_name)]"
    for letter, others in tx.SUBSTITUTIONS.items():
        x = f"flatten(list_transform({x}, lambda v: [v, " + ", ".join(f"replace(v, {q(letter)}, {q(o)})" for o in others) + "]))"
    return f"SELECT r_regionkey, CAST(len(list_distinct({x})) AS INT) AS n, array_to_string(list_sort(list_distinct({x})), ' ') AS forms FROM region"


@query("word_variations", _variations_sql())
def word_variations(spark: SparkSession, sf: str) -> DataFrame:
    v = tx.word_variations(F.lower("r_name"))
    return spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", F.size(v).alias("n"), F.array_join(F.array_sort(v), " ").alias("forms"))


@query("char_variations")
def char_variations(spark: SparkSession, sf: str) -> DataFrame:
    v = charmap.character_variations(F.lower("p_name"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.size(v).alias("n"), F.array_join(F.array_sort(v), "|").alias("forms"))


# ---------------------------------------------------------------- matching


@query("exact_match_counts", hits_sql("SELECT doc_id, count(*) AS n_matches, max(severity) AS max_severity FROM hits GROUP BY doc_id"))
def exact_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return base.hits(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.max("severity").alias("max_severity"))


_POSITION = """SELECT doc_id, start, "end", word, term, CAST(len(string_split(h, chr(10))) AS INT) AS line, CAST(length(string_split(h, chr(10))[-1]) + 1 AS INT) AS col,
CAST(len(regexp_extract_all(h, '\\S\\s')) AS INT) AS word_index, CAST(len(regexp_extract_all(h, '[.!?]')) AS INT) AS sentence_index FROM (SELECT *, substr(t, 1, start) AS h FROM hits)"""


@query("match_positions", hits_sql(_POSITION))
def match_positions(spark: SparkSession, sf: str) -> DataFrame:
    found = F.zip_with("matches", results.positions(F.col("norm"), F.col("matches")), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    rows = base.with_matches(spark, sf).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.m", "x.p")
    return rows.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.word", F.col("m.match").alias("term"), F.col("p.lineNumber").alias("line"), F.col("p.columnStart").alias("col"), F.col("p.wordIndex").alias("word_index"), F.col("p.sentenceIndex").alias("sentence_index"))


@query("phrase_match", hits_sql("SELECT doc_id, word, count(*) AS n FROM hits WHERE n_tokens > 1 GROUP BY doc_id, word"))
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    return base.hits(spark, sf).where(F.contains("word", F.lit(" "))).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("first_match_per_start", hits_sql('SELECT doc_id, start, "end", word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY "end") AS k FROM hits) WHERE k = 1'))
def first_match_per_start(spark: SparkSession, sf: str) -> DataFrame:
    first = scoring.first_per_start(F.col("matches"))
    return base.with_matches(spark, sf).select("doc_id", F.explode(first).alias("m")).select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.word")


@query("early_termination", hits_sql("SELECT doc_id, start, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, word) AS k FROM hits) WHERE k <= 5"))
def early_termination(spark: SparkSession, sf: str) -> DataFrame:
    # the row has its matches already: the first five of its sorted array, no window
    first = F.slice(F.array_sort(F.transform("candidates", lambda m: F.struct(m["start"], m["word"]))), 1, 5)
    rows = base.found(spark, sf).select("doc_id", F.explode(first).alias("m"))
    return rows.select("doc_id", F.col("m.start").cast("long").alias("start"), "m.word")


@query("fuzzy_lookup", tokens_sql("""SELECT token, surface_norm AS surface, CAST(levenshtein(token, surface_norm) AS INT) AS distance FROM (SELECT DISTINCT token FROM tok WHERE length(token) >= 2) t,
(SELECT DISTINCT surface_norm FROM lex WHERE NOT is_variation AND n_tokens = 1) l WHERE abs(length(token) - length(surface_norm)) <= 1 AND levenshtein(token, surface_norm) <= 1"""))
def fuzzy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    words = matching.tokens(base.normed(spark, sf)).where(F.length("token") >= 2)
    known = base.lexicon(spark).where("not is_variation and n_tokens = 1").select(F.col("surface_norm").alias("surface"))
    return matching.fuzzy_pairs(words, known, 1)


@query("fuzzy_distance2", tokens_sql("""SELECT token, surface_norm AS surface, CAST(levenshtein(token, surface_norm) AS INT) AS distance FROM (SELECT DISTINCT token FROM tok WHERE length(token) >= 4) t,
(SELECT DISTINCT surface_norm FROM lex WHERE NOT is_variation AND n_tokens = 1 AND length(surface_norm) >= 5) l WHERE abs(length(token) - length(surface_norm)) <= 2 AND levenshtein(token, surface_norm) <= 2"""))
def fuzzy_distance2(spark: SparkSession, sf: str) -> DataFrame:
    words = matching.token_list(base.normed(spark, sf)).where(F.length("token") >= 4)
    known = base.lexicon(spark).where("not is_variation and n_tokens = 1 and length(surface_norm) >= 5").select(F.col("surface_norm").alias("surface"))
    return matching.near_pairs(words, known, 2)


@query("fuzzy_tokens", tokens_sql("""SELECT doc_id, l.language, count(*) AS n FROM tok t JOIN (SELECT DISTINCT language, surface_norm, term FROM lex WHERE NOT is_variation AND n_tokens = 1) l
ON length(token) >= 2 AND abs(length(token) - length(surface_norm)) <= 1 AND levenshtein(token, surface_norm) = 1 GROUP BY doc_id, l.language"""))
def fuzzy_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return matching.fuzzy_hits(base.normed(spark, sf), base.lexicon(spark), 1).groupBy("doc_id", "language").agg(F.count("*").alias("n"))


_PATTERNS = ["worthless", "pathetic", "nothing", "relation"]


@query("similarity_pairs", f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '{base.SPACE_SQL}+'), lambda x: x <> '')) AS w FROM documents), p AS (SELECT unnest([{', '.join(map(q, _PATTERNS))}]) AS pattern)
SELECT doc_id, pattern, count(*) AS n FROM w, p WHERE abs(length(w) - length(pattern)) <= 3 AND 1 - {base.edits_sql('w', 'pattern')}::DOUBLE / greatest(length(w), length(pattern)) >= 0.75 GROUP BY doc_id, pattern""")
def similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    patterns = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    return matching.similar_words(base.docs(spark, sf), patterns, 0.75).groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))


_BEST = ["united states", "germany", "brazil", "china"]


@query("best_match", f"""WITH p AS (SELECT pattern, row_number() OVER () AS k FROM (SELECT unnest([{', '.join(map(q, _BEST))}]) AS pattern)), s AS (SELECT n_nationkey, pattern, k, 1 - levenshtein(lower(n_name), pattern)::DOUBLE / greatest(length(n_name), length(pattern)) AS x FROM nation, p)
SELECT n_nationkey, arg_max(pattern, (x, -k)) AS pattern, floor(max(x) * 1000 + 0.5) / 1000 AS similarity FROM s GROUP BY n_nationkey""")
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    best = matching.best_pattern(F.col("n_name"), _BEST)
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", best["pattern"].alias("pattern"), (F.floor(best["similarity"] * 1000 + 0.5) / 1000).alias("similarity"))


_BARRED = ["thing", "damn"]


@query("whitelist_antijoin", hits_sql(f"SELECT term, count(*) AS n FROM hits WHERE word NOT IN {base.in_list([*matching.WHITELIST, *_BARRED])} AND length(word) >= 2 GROUP BY term"))
def whitelist_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return matching.keep(base.hits(spark, sf), whitelist=_BARRED).groupBy("term").agg(F.count("*").alias("n"))


@query("severity_category_filter", hits_sql("SELECT doc_id, count(*) AS n FROM hits WHERE severity >= 2 AND list_has_any(categories, ['profanity', 'scatological']) GROUP BY doc_id"))
def severity_category_filter(spark: SparkSession, sf: str) -> DataFrame:
    return matching.keep(base.hits(spark, sf), 2, ["profanity", "scatological"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("is_profane", hits_sql("SELECT doc_id, source FROM norm WHERE doc_id IN (SELECT doc_id FROM hits)"))
def is_profane(spark: SparkSession, sf: str) -> DataFrame:
    return base.found(spark, sf).where(F.size("candidates") > 0).select("doc_id", "source")


@query("is_clean", hits_sql("SELECT doc_id, source FROM norm WHERE doc_id NOT IN (SELECT doc_id FROM hits)"))
def is_clean(spark: SparkSession, sf: str) -> DataFrame:
    return base.found(spark, sf).where(F.size("candidates") == 0).select("doc_id", "source")


# ---------------------------------------------------------------- context and confidence

_CONTEXT_SQL = """, c AS (SELECT *, trim(substr(t, greatest(start - 25, 0)::INT + 1, (start - greatest(start - 25, 0))::INT)) AS l, trim(substr(t, "end"::INT + 1, 25)) AS r,
  CASE WHEN position('.' IN reverse(substr(t, 1, start::INT))) = 0 THEN 0 ELSE start - position('.' IN reverse(substr(t, 1, start::INT))) + 1 END AS s0,
  CASE WHEN position('.' IN substr(t, "end"::INT + 2)) = 0 THEN length(t) ELSE "end" + position('.' IN substr(t, "end"::INT + 2)) END AS s1 FROM hits),
d AS (SELECT *, trim(substr(t, s0::INT + 1, (s1 - s0)::INT)) AS s, start - s0 AS place, string_split_regex(lower(l), '\\s+') AS lw FROM c),
e AS (SELECT *, list_has_any(lw[greatest(1, len(lw) - 2):], ['not', 'don''t', 'doesn''t', 'never', 'hardly', 'barely']) AS negated,
  regexp_matches(lower(l || ' ' || r), 'medical|technical|definition|terminology|glossary|dictionary|research|study|analysis|academic') AS technical,
  regexp_matches(l, '["'']') AND regexp_matches(r, '["'']') AS quoted,
  regexp_matches(l || ' ' || r, '(?i)\\b(damn|hell|crap|shit|fuck|ass|bitch)\\b') OR regexp_matches(l || ' ' || r, '[!@#$%^&*]{2,}') OR regexp_matches(l || ' ' || r, '[A-Z]{3,}') AS surrounded FROM d),
f AS (SELECT *, least(1.0, greatest(0.1, (CASE WHEN length(s) < 10 THEN 0.8::DOUBLE ELSE 1.0 END) * (CASE WHEN place < 5 OR place > length(s) - 10 THEN 0.9::DOUBLE ELSE 1.0 END) * (CASE WHEN surrounded THEN 1.2::DOUBLE ELSE 1.0 END)))::DOUBLE AS cc FROM e),
g AS (SELECT *, base_conf * (CASE WHEN quoted THEN 0.7::DOUBLE ELSE 1.0 END) * cc AS conf FROM f WHERE NOT negated AND NOT technical),
h AS (SELECT *, floor(least(1.0::DOUBLE, greatest(0.1::DOUBLE, conf * (CASE WHEN word = lower(term) THEN 1.1::DOUBLE ELSE 1.0 END) * (CASE WHEN length(term) <= 3 THEN 0.8::DOUBLE ELSE 1.0 END) * (CASE WHEN severity >= 3 THEN 1.1::DOUBLE ELSE 1.0 END) * (CASE WHEN regexp_matches(word, '[0-9]') THEN 0.7::DOUBLE ELSE 1.0 END))) * 100 + 0.5) / 100 AS final FROM g WHERE conf >= 0.3)"""


def _context(spark: SparkSession, sf: str, sentence: bool = False) -> DataFrame:
    """Hit rows with the two windows and the rules' verdicts, all found inside the document's row."""
    rows = base.with_matches(spark, sf).select("doc_id", F.explode(scoring.contexts(F.col("norm"), F.col("matches"), sentence)).alias("c"))
    m, left, right = F.col("c.m"), F.col("c.left"), F.col("c.right")
    fields = [m["start"].alias("start"), m["end"].alias("end"), m["word"].alias("word"), m["match"].alias("term"), m["severity"].alias("severity"), m["confidence"].alias("base_conf")]
    verdicts = {"negated": scoring.negated(left), "technical": scoring.technical(left, right), "quoted": scoring.quoted(left, right), "cc": scoring.context_confidence(F.col("c"))}
    return rows.select("doc_id", *fields, left.alias("l"), right.alias("r"), *([F.col("c.sentence").alias("sentence")] if sentence else []), *[v.alias(k) for k, v in verdicts.items()])


def _hit_columns() -> list[Column]:
    return [F.col("doc_id"), F.col("start").cast("long").alias("start"), F.col("word")]


@query("context_windows", hits_sql(_CONTEXT_SQL + " SELECT doc_id, start, word, l AS before, r AS after, s AS sentence FROM e"))
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf, sentence=True).select(*_hit_columns(), F.col("l").alias("before"), F.col("r").alias("after"), "sentence")


@query("negation_filter", hits_sql(_CONTEXT_SQL + " SELECT doc_id, start, word, negated FROM e"))
def negation_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf).select(*_hit_columns(), "negated")


@query("technical_filter", hits_sql(_CONTEXT_SQL + " SELECT doc_id, start, word, technical FROM e"))
def technical_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf).select(*_hit_columns(), "technical")


@query("quoted_context", hits_sql(_CONTEXT_SQL + " SELECT doc_id, start, word, quoted FROM e"))
def quoted_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf).select(*_hit_columns(), "quoted")


@query("context_confidence", hits_sql(_CONTEXT_SQL + " SELECT doc_id, start, word, floor(cc * 1000 + 0.5) / 1000 AS confidence FROM f"))
def context_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf).select(*_hit_columns(), (F.floor(F.col("cc") * 1000 + 0.5) / 1000).alias("confidence"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    c = _context(spark, sf).where("not negated and not technical")
    c = c.withColumn("conf", F.col("base_conf") * F.when(F.col("quoted"), 0.7).otherwise(1.0) * F.col("cc")).where(F.col("conf") >= scoring.LEAST_CONFIDENCE)
    return c.withColumn("final", scoring.final_confidence(F.col("conf"), F.col("word"), F.col("term"), F.col("severity")))


@query("final_confidence", hits_sql(_CONTEXT_SQL + " SELECT doc_id, start, word, final FROM h"))
def final_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(*_hit_columns(), "final")


def _scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their scored matches, scored inside their rows."""
    scored = F.transform(scoring.in_context(F.col("candidates"), F.col("norm")), lambda m: m.withField("confidence", scoring.final_confidence(m["confidence"], m["word"], m["match"], m["severity"])))
    return base.found(spark, sf).withColumn("matches", matching.by_start(scored)).drop("candidates")


@query("doc_confidence", hits_sql(_CONTEXT_SQL + """, k AS (SELECT doc_id, avg(final) AS a, count(*) AS n FROM h GROUP BY doc_id)
SELECT doc_id, floor((CASE WHEN n IS NULL THEN 1.0 ELSE least(1.0, greatest(0.1, a * (0.7 + least(1.0, length(text)::DOUBLE / 100) * 0.2 + least(1.0, n::DOUBLE / 5) * 0.1))) END)::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM norm LEFT JOIN k USING (doc_id)"""))
def doc_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_docs(spark, sf).select("doc_id", (F.floor(scoring.document_confidence(F.col("matches"), F.col("text")) * 1000 + 0.5) / 1000).alias("confidence"))


_OVERLAP_SQL = """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, severity DESC, "end" DESC, term, language) AS k FROM hits),
f AS (SELECT doc_id, k, k AS kept, start, "end", severity, 1 AS slot FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.start >= f."end" OR o.severity > f.severity THEN o.k ELSE f.kept END, CASE WHEN o.start >= f."end" OR o.severity > f.severity THEN o.start ELSE f.start END,
    CASE WHEN o.start >= f."end" OR o.severity > f.severity THEN o."end" ELSE f."end" END, CASE WHEN o.start >= f."end" OR o.severity > f.severity THEN o.severity ELSE f.severity END, CASE WHEN o.start >= f."end" THEN f.slot + 1 ELSE f.slot END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
w AS (SELECT doc_id, slot, arg_max(kept, k) AS kept FROM f GROUP BY doc_id, slot),
kept AS (SELECT o.* FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.kept)"""


@query("overlap_resolution", hits_sql(_OVERLAP_SQL + ' SELECT doc_id, start, "end", word FROM kept', recursive=True))
def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    kept = scoring.resolve_overlaps(F.col("matches"))
    return base.with_matches(spark, sf).select("doc_id", F.explode(kept).alias("m")).select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.word")


# ---------------------------------------------------------------- results


@query("severity_distribution", hits_sql("SELECT n.doc_id, " + ", ".join(f"CAST(count(h.doc_id) FILTER (severity = {s}) AS INT) AS s{s}" for s in range(1, 5)) + " FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY n.doc_id"))
def severity_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = results.severity_distribution(F.col("matches"))
    return base.with_matches(spark, sf).withColumn("d", d).select("doc_id", *[F.element_at("d", F.lit(s)).alias(f"s{s}") for s in range(1, 5)])


@query("category_distribution", hits_sql("SELECT c AS category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(categories) AS c FROM hits) GROUP BY c"))
def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return base.hits(spark, sf).select("doc_id", F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("language_distribution", hits_sql("SELECT language, count(*) AS n, count(DISTINCT lower(term)) AS unique_words FROM hits GROUP BY language"))
def language_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return base.hits(spark, sf).groupBy("language").agg(F.count("*").alias("n"), F.count_distinct(F.lower("term")).alias("unique_words"))


@query("confidence_buckets", hits_sql(_CONTEXT_SQL + " SELECT n.doc_id, CAST(count(final) FILTER (final >= 0.8) AS INT) AS high, CAST(count(final) FILTER (final >= 0.5 AND final < 0.8) AS INT) AS medium, CAST(count(final) FILTER (final < 0.5) AS INT) AS low FROM norm n LEFT JOIN h ON h.doc_id = n.doc_id GROUP BY n.doc_id"))
def confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in results.confidence_buckets(F.col("matches")).items()])


_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


@query("document_statistics", hits_sql(f"""SELECT n.doc_id, CAST({_WORDS.replace('text', 'any_value(n.text)')} AS INT) AS total_words, CAST(count(h.doc_id) AS INT) AS matches, CAST(count(DISTINCT lower(term)) AS INT) AS unique_words,
floor(count(h.doc_id)::DOUBLE / greatest({_WORDS.replace('text', 'any_value(n.text)')}, 1) * 10000 + 0.5) / 10000 AS density, greatest(1, coalesce(max(severity), 1)) AS max_severity FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY n.doc_id"""))
def document_statistics(spark: SparkSession, sf: str) -> DataFrame:
    m = base.with_matches(spark, sf).withColumn("s", results.statistics(F.col("matches"), F.col("text"), lx.CORE_CATEGORIES))
    return m.select("doc_id", F.col("s.totalWords").alias("total_words"), F.size("matches").alias("matches"), F.col("s.uniqueProfaneWords").alias("unique_words"), (F.floor(F.col("s.profanityDensity") * 10000 + 0.5) / 10000).alias("density"), results.max_severity(F.col("matches")).alias("max_severity"))


_PATTERN_SQL = {k: f"regexp_matches(text, {q(v)})" for k, v in results.PATTERNS.items()} | {"hasRepeatedChars": f"regexp_matches(text, {q(_RUNS.replace(chr(10), ''))})", "hasAllCaps": "regexp_matches(text, '\\b[A-Z]{3,}\\b')"}
_PATTERN_SQL["hasRepeatedChars"] = "regexp_matches(text, " + q("(" + "|".join("(?:" + _esc(c) + "){3,}" for c in _CHARS if c != "\n") + ")") + ")"
by_doc("text_patterns", results.text_patterns, _PATTERN_SQL)
by_doc("text_type", lambda c: {"type": results.text_type(c)}, {"type": f"CASE WHEN {_PATTERN_SQL['hasMentions']} OR {_PATTERN_SQL['hasHashtags']} THEN 'social_media' WHEN {_PATTERN_SQL['hasEmails']} THEN 'email' WHEN length(text) < 200 AND {_PATTERN_SQL['hasEmojis']} THEN 'chat' WHEN length(text) > 300 THEN 'article' ELSE 'unknown' END"})
_TONES = {k: f"len(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(v)})\\b'))" for k, v in {"aggressive": results.AGGRESSIVE, "positive": results.POSITIVE, "negative": results.NEGATIVE}.items()}
_TOTAL = "(" + " + ".join(_TONES.values()) + ")"
by_doc("emotional_tone", results.emotional_tone, {k: f"CASE WHEN {_TOTAL} > 0 THEN {v}::DOUBLE / {_TOTAL} ELSE 0.0::DOUBLE END" for k, v in _TONES.items()} | {"neutral": f"CASE WHEN {_TOTAL} > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"})


@query("warnings_recs", hits_sql(_CONTEXT_SQL + f""", k AS (SELECT doc_id, count(*) AS n, max(severity) AS sev, count(*) FILTER (final < 0.5) AS low5, count(*) FILTER (final < 0.6) AS low6 FROM h GROUP BY doc_id),
j AS (SELECT n0.doc_id, text, coalesce(n, 0) AS n, coalesce(sev, 1) AS sev, coalesce(low5, 0) AS low5, coalesce(low6, 0) AS low6, {_WORDS} AS words, {_PATTERN_SQL['hasMentions']} OR {_PATTERN_SQL['hasHashtags']} AS social, {_TONES['aggressive']}::DOUBLE / greatest({_TOTAL}, 1) AS ag FROM norm n0 LEFT JOIN k USING (doc_id))
SELECT doc_id, concat_ws('; ', CASE WHEN length(text) < 10 THEN {q(results.WARN_SHORT)} END, CASE WHEN low5 > 0 THEN {q(results.WARN_LOW)} END) AS warnings,
concat_ws('; ', CASE WHEN n > len(string_split(text, ' ')) * 0.2 THEN {q(results.ADVISE_DENSE)} END, CASE WHEN n > 0 AND sev >= 4 THEN {q(results.ADVISE_SEVERE)} END, CASE WHEN n > 0 AND sev >= 3 THEN {q(results.ADVISE_REVIEW)} END,
CASE WHEN n > 0 AND n::DOUBLE / greatest(words, 1) > 0.1 THEN {q(results.ADVISE_MODERATE)} END, CASE WHEN n > 0 AND social THEN {q(results.ADVISE_SOCIAL)} END, CASE WHEN n > 0 AND ag > 0.3 THEN {q(results.ADVISE_TONE)} END, CASE WHEN low6 > 0 THEN low6 || ' matches have low confidence - manual review recommended' END) AS recommendations FROM j"""))
def warnings_recs(spark: SparkSession, sf: str) -> DataFrame:
    m, t = F.col("matches"), F.col("text")
    return _scored_docs(spark, sf).select("doc_id", F.array_join(results.warnings(m, t), "; ").alias("warnings"), F.array_join(results.recommendations(m, t), "; ").alias("recommendations"))


@query("suggestions", hits_sql("""SELECT DISTINCT word, array_to_string(list_distinct_ordered, '|') AS suggestions, CASE WHEN severity >= 3 THEN concat_ws(', ', 'high severity', CASE WHEN list_contains(categories, 'hate_speech') THEN 'hate speech' END, CASE WHEN list_contains(categories, 'violence') THEN 'violent content' END)
 WHEN list_contains(categories, 'hate_speech') THEN 'hate speech' ELSE 'profanity detected' END AS reason FROM (SELECT *, list_filter([CASE WHEN length(word) > 3 THEN word[1] || repeat('*', length(word) - 2) || word[-1] END, repeat('*', length(word)),
 CASE WHEN list_contains(categories, 'general') THEN '[censored]' END, CASE WHEN list_contains(categories, 'general') THEN '[removed]' END, CASE WHEN list_contains(categories, 'general') THEN '***' END, CASE WHEN list_contains(categories, 'violence') THEN '[violent content]' END, CASE WHEN list_contains(categories, 'violence') THEN '[aggressive language]' END,
 CASE WHEN list_contains(categories, 'hate_speech') THEN '[hate speech removed]' END, CASE WHEN list_contains(categories, 'hate_speech') THEN '[offensive content]' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM hits)"""))
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    h = base.hits(spark, sf)
    return h.select("word", F.array_join(results.suggestions(F.col("word"), F.col("categories")), "|").alias("suggestions"), results.reason(F.col("base_conf"), F.col("severity"), F.col("categories")).alias("reason")).distinct()


# ---------------------------------------------------------------- redaction


def tidied_sql(x: str, at_start: str) -> str:
    """The tidied sentences of a redacted text; a letter is raised by a rule of its own."""
    for pattern, new in (("\\s{2,}", " "), ("([^\\s,.;:!?])\\s+([,.;:!?])", "\\1\\2"), ("([,.;:!?])([a-zA-Z])", "\\1 \\2")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '([.!?])\\s*{c}', '\\1 {c.upper()}', 'g')"
    return f"(SELECT CASE WHEN {at_start} AND regexp_matches(y, '^[a-z]') THEN upper(y[1]) || y[2:] ELSE y END FROM (SELECT trim({x}) AS y))"


def _redacted_sql(piece: str, tidy: bool = False) -> str:
    """Texts put together again: what lies between the kept hits, phrases included, and what replaces them."""
    whole = "coalesce(head || substr(n.t, last::INT + 1), n.t)"
    if tidy:
        whole = f"CASE WHEN head IS NULL THEN n.t ELSE {tidied_sql('head || substr(n.t, last::INT + 1)', 'first = 0')} END"
    return hits_sql(_OVERLAP_SQL + f""", z AS (SELECT *, base_conf AS conf, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS gap FROM kept),
x AS (SELECT doc_id, string_agg(substr(t, gap::INT + 1, (start - gap)::INT) || {piece}, '' ORDER BY start) AS head, max("end") AS last, min(start) AS first FROM z GROUP BY doc_id)
SELECT n.doc_id, {whole} AS filtered FROM norm n LEFT JOIN x USING (doc_id)""", recursive=True)


_CENSOR = "regexp_replace(regexp_replace(word, '[0-9]', '#', 'g'), '[A-Za-z]', '*', 'g')"


def _partial_sql(share: float) -> str:
    n = f"greatest(1, floor(length(word) * {share}::DOUBLE))::INT"
    at = f"floor((length(word) - {n})::DOUBLE / 2)::INT"
    return f"(CASE WHEN length(word) <= 2 THEN repeat('*', length(word)) ELSE substr(word, 1, {at}) || repeat('*', {n}) || substr(word, {at} + {n} + 1) END)"


_GRADUAL = f"CASE WHEN severity * conf < 1.5 THEN {_partial_sql(0.3)} WHEN severity * conf < 2.5 THEN {_partial_sql(0.6)} WHEN severity * conf < 3.5 THEN {_partial_sql(0.8)} ELSE {_CENSOR} END"
_FALLBACK = "CASE severity WHEN 1 THEN 'inappropriate' WHEN 2 THEN 'offensive' WHEN 3 THEN '[removed]' WHEN 4 THEN '[content removed]' END"
_REPLACE = "coalesce(" + ", ".join(f"CASE categories[{k}] " + " ".join(f"WHEN {q(c)} THEN [{', '.join(map(q, w))}][least(floor((severity - 1) * {len(w)} / 4.0)::INT, {len(w) - 1}) + 1]" for c, w in redaction.BY_CATEGORY.items()) + " END" for k in (1, 2, 3)) + f", {_FALLBACK})"
_CUSTOM = {"idiot": "[CUSTOM]", "th*": "[WILD]"}


def _redacts(name: str, r: redaction.Redaction, piece: str) -> None:
    @query(name, _redacted_sql(piece, r.sentences))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        m = base.found(spark, sf).withColumn("matches", scoring.resolve_overlaps(F.col("candidates")))
        return m.select("doc_id", redaction.redact(F.col("norm"), F.col("matches"), r).alias("filtered"))


_redacts("censor_full", redaction.Redaction(), _CENSOR)
_redacts("censor_plain", redaction.Redaction(structure=False, char="#"), "repeat('#', length(word))")
_redacts("censor_gradual", redaction.Redaction(gradual=True), _GRADUAL)
_redacts("remove", redaction.Redaction(mode="remove"), "''")
_redacts("replace", redaction.Redaction(mode="replace"), _REPLACE)
_redacts("detect_only", redaction.Redaction(mode="detect_only"), "word")
_redacts("custom_replace", redaction.Redaction(custom=_CUSTOM), f"CASE WHEN word = 'idiot' OR lower(term) = 'idiot' THEN '[CUSTOM]' WHEN regexp_matches(word, '(?i)th.*') THEN '[WILD]' ELSE {_CENSOR} END")
_redacts("safe_strict", redaction.safe("strict"), "''")
_redacts("safe_moderate", redaction.safe("moderate"), _GRADUAL)
_redacts("safe_lenient", redaction.safe("lenient"), _REPLACE)
_redacts("sentence_structure", redaction.DETECTOR, _GRADUAL)


@query("redaction_details", hits_sql(_OVERLAP_SQL + f" SELECT doc_id, start, word AS original, {_CENSOR} AS replacement, 'censor' AS method FROM kept", recursive=True))
def redaction_details(spark: SparkSession, sf: str) -> DataFrame:
    d = redaction.details(F.col("norm"), F.col("matches"))
    rows = base.found(spark, sf).withColumn("matches", scoring.resolve_overlaps(F.col("candidates"))).select("doc_id", F.explode(d).alias("d"))
    return rows.select("doc_id", F.col("d.start").cast("long").alias("start"), F.col("d.originalWord").alias("original"), "d.replacement", "d.method")


# ---------------------------------------------------------------- roll-ups


@query("merge_by_source", hits_sql("""SELECT source, count(DISTINCT n.doc_id) AS documents, count(h.doc_id) AS total_matches, greatest(1, coalesce(max(severity), 1)) AS max_severity, coalesce(string_agg(DISTINCT h.language, ',' ORDER BY h.language), '') AS languages FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY source"""))
def merge_by_source(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("candidates")
    rows = base.found(spark, sf).select("source", "doc_id", F.size(m).alias("n"), F.array_max(F.transform(m, lambda x: x["severity"])).alias("s"), F.array_max(F.transform(m, lambda x: x["language"])).alias("l"))
    return rows.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.greatest(F.lit(1), F.coalesce(F.max("s"), F.lit(1))).alias("max_severity"), F.array_join(F.array_sort(F.collect_set("l")), ",").alias("languages"))


@query("compare_modes", hits_sql("""SELECT n.doc_id, CAST(count(h.doc_id) FILTER (severity >= 2) - count(h.doc_id) AS INT) AS "matchesDiff", CASE WHEN count(h.doc_id) FILTER (severity >= 2) < count(h.doc_id) THEN (count(h.doc_id) - count(h.doc_id) FILTER (severity >= 2)) || ' fewer matches found.' ELSE 'Results are similar.' END AS summary
FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY n.doc_id"""))
def compare_modes(spark: SparkSession, sf: str) -> DataFrame:
    m = base.with_matches(spark, sf)
    side = lambda x: {"totalMatches": F.size(x), "maxSeverity": F.lit(1), "confidence": F.lit(1.0)}
    c = results.comparison(side(F.col("matches")), side(F.filter("matches", lambda x: x["severity"] >= 2)))
    return m.select("doc_id", c["matchesDiff"].alias("matchesDiff"), c["summary"].alias("summary"))


@query("result_json")
def result_json(spark: SparkSession, sf: str) -> DataFrame:
    m = base.with_matches(spark, sf).withColumns({"languages": F.array("lang"), "confidence": scoring.document_confidence(F.col("matches"), F.col("text")), "maxSeverity": results.max_severity(F.col("matches"))})
    return m.select("doc_id", results.to_json().alias("json"))


@query("result_json_read", hits_sql("""SELECT n.doc_id, count(h.doc_id) > 0 AS profane, CAST(count(h.doc_id) AS INT) AS matches, greatest(1, coalesce(max(severity), 1)) AS severity, any_value(n.lang) AS languages, coalesce(string_agg(word || ':' || start || '-' || "end" || ':' || severity || ':' || array_to_string(categories, '+'), ',' ORDER BY start, "end", term), '') AS found
FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY n.doc_id"""))
def result_json_read(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON results, parsed again."""
    schema = "hasProfanity boolean, totalMatches int, maxSeverity int, detectedLanguages array<string>, confidence double, matches array<struct<word:string,severity:int,categories:array<string>,confidence:double,position:struct<start:int,end:int>>>"
    j = result_json(spark, sf).select("doc_id", F.from_json("json", schema).alias("j")).select("doc_id", "j.*")
    one = lambda m: F.concat(m["word"], F.lit(":"), m["position"]["start"], F.lit("-"), m["position"]["end"], F.lit(":"), m["severity"], F.lit(":"), F.array_join(m["categories"], "+"))
    return j.select("doc_id", F.col("hasProfanity").alias("profane"), F.col("totalMatches").alias("matches"), F.col("maxSeverity").alias("severity"), F.array_join("detectedLanguages", ",").alias("languages"), F.array_join(F.transform("matches", one), ",").alias("found"))


@query("conversation_moderation", f"""WITH {base.lexicon_sql()}, w AS (SELECT conv_id, role, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS token FROM conversations), l AS (SELECT surface_norm, max(severity) AS severity FROM lex WHERE n_tokens = 1 GROUP BY surface_norm)
SELECT conv_id, count(*) AS matches, count(*) FILTER (role = 'user') AS by_user, max(severity) AS max_severity FROM w JOIN l ON token = surface_norm GROUP BY conv_id""")
def conversation_moderation(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    words = turns.select("conv_id", "role", F.explode(F.regexp_extract_all(tx.strip_accents(F.lower("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    lex = base.lexicon(spark).where("n_tokens = 1").groupBy("surface_norm").agg(F.max("severity").alias("severity"))
    return words.join(lex, F.col("token") == F.col("surface_norm")).groupBy("conv_id").agg(F.count("*").alias("matches"), F.count_if(F.col("role") == "user").alias("by_user"), F.max("severity").alias("max_severity"))


@query("toxic_agreement", hits_sql("SELECT toxic, count(*) AS documents, count(f.doc_id) AS flagged FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM hits WHERE severity >= 1 AND term IN ('idiot', 'scum', 'worthless', 'pathetic', 'moron', 'stupid')) f ON f.doc_id = l.doc_id GROUP BY toxic"))
def toxic_agreement(spark: SparkSession, sf: str) -> DataFrame:
    flagged = base.hits(spark, sf).where(F.col("term").isin("idiot", "scum", "worthless", "pathetic", "moron", "stupid")).select("doc_id").distinct().withColumn("f", F.lit(1))
    return spark.read.parquet(f"{sf}/labels.parquet").join(flagged, "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("documents"), F.count("f").alias("flagged"))


@query("automaton_counts", hits_sql("SELECT n.doc_id, CAST(count(h.doc_id) AS INT) AS n FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY n.doc_id"))
def automaton_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = base.normed(spark, sf).withColumn("langs", F.array("lang"))
    return matching.automaton_matches(d, base.lexicon(spark), languages="langs").select("doc_id", F.size("candidates").alias("n"))


# ---------------------------------------------------------------- the whole detector


_FOUR = ["en", "fr", "de", "es"]


@query("detect")
def detect(spark: SparkSession, sf: str) -> DataFrame:
    out = api.detect(base.docs(spark, sf), Config(languages=_FOUR))
    # nine places: a mean of many two-place numbers lies on the border of three far too often
    return out.select("doc_id", "hasProfanity", "totalMatches", "maxSeverity", (F.floor(F.col("confidence") * 1e9 + 0.5) / 1e9).alias("confidence"))


@query("filter_censor")
def filter_censor(spark: SparkSession, sf: str) -> DataFrame:
    return api.filter_texts(base.docs(spark, sf)).select("doc_id", "filteredText")


@query("multi_language")
def multi_language(spark: SparkSession, sf: str) -> DataFrame:
    out = api.Detector(spark, Config(fuzzy=False)).multi_language(base.docs(spark, sf), ["en", "fr"])
    return out.select("doc_id", F.size("matches").alias("n"), "primary", "cross_language")


_ALL_HITS = base.HITS_SQL.replace(" AND k.lang = l.language", "").replace("SELECT k.doc_id,", "SELECT k.doc_id, k.lang,")
_DETECT_CONTEXT = _CONTEXT_SQL.replace("FROM hits)", f"FROM hits WHERE word NOT IN {base.in_list(matching.WHITELIST)} AND length(word) >= 2 AND length(t) >= 3)", 1)


_MILD = f"(word IN {base.in_list(matching.COMMON_WORDS)} OR lower(term) IN {base.in_list(matching.COMMON_WORDS)}) AND severity <= 1 AND base_conf < 0.8"


def _with_fuzzy(languages: list[str]) -> str:
    """The hits of a detector in these languages: exact ones, and tokens one edit from a base word."""
    langs, cols = base.in_list(languages), "doc_id, lang, t, idx, start, {end} AS \"end\", {word} AS word, term, language, severity, categories, {conf} AS base_conf, {d} AS distance"
    exact = _ALL_HITS.strip().replace("hits AS (", "exact AS (", 1)
    return f"""{exact}, hits AS (SELECT {cols.format(end='"end"', word="word", conf="base_conf", d="0")} FROM exact WHERE language IN {langs}
  UNION ALL SELECT {cols.format(end="start + length(token)", word="token", conf="base_conf * 0.8::DOUBLE", d="1")} FROM (SELECT * FROM tok WHERE length(token) >= 2) k JOIN (SELECT * FROM lex WHERE NOT is_variation AND language IN {langs}) l
    ON abs(length(token) - length(surface_norm)) <= 1 AND levenshtein(token, surface_norm) = 1)"""


def detect_sql(rest: str, fuzzy: list[str] | None = None) -> str:
    """The detector over four languages without its fuzzy pass, or over the languages given with it: context, overlaps by severity
    and confidence, scores (table `final`)."""
    if fuzzy:
        context = _DETECT_CONTEXT.replace("length(t) >= 3)", f"length(t) >= 3 AND NOT ({_MILD}))", 1)
        out = detect_sql(rest).replace(_ALL_HITS, _with_fuzzy(fuzzy)).replace(_DETECT_CONTEXT, context)
        return out.replace('severity DESC, "end" DESC', 'severity DESC, distance, "end" DESC').replace("h.word = o.word)", "h.word = o.word AND h.distance = o.distance)")
    better = '(o.severity > f.severity OR (o.severity = f.severity AND o.conf > f.conf))'
    take = f'(o.start >= f."end" OR {better})'
    fields = ", ".join(f'CASE WHEN {take} THEN o.{c} ELSE f.{c} END' for c in ("start", '"end"', "severity", "conf"))
    overlap = f""", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, severity DESC, "end" DESC, term, language) AS k FROM g WHERE conf >= 0.3),
v AS (SELECT doc_id, k, k AS kept, start, "end", severity, conf, 1 AS slot FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN {take} THEN o.k ELSE f.kept END, {fields}, CASE WHEN o.start >= f."end" THEN f.slot + 1 ELSE f.slot END FROM v f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
w AS (SELECT doc_id, slot, arg_max(kept, k) AS kept FROM v GROUP BY doc_id, slot),
final AS (SELECT h.* FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.kept JOIN h ON h.doc_id = o.doc_id AND h.start = o.start AND h."end" = o."end" AND h.term = o.term AND h.language = o.language AND h.word = o.word)"""
    return f"WITH RECURSIVE {base.lexicon_sql()}, {base.NORM_SQL}, {base.TOKENS_SQL}, {_ALL_HITS}" + _DETECT_CONTEXT + overlap + " " + rest


_PER_DOC = """, k AS (SELECT doc_id, count(*) AS n, max(severity) AS s, avg(final) AS a FROM final GROUP BY doc_id)
SELECT norm.doc_id, coalesce(n, 0) > 0 AS "hasProfanity", CAST(coalesce(n, 0) AS INT) AS "totalMatches", CAST(coalesce(s, 1) AS INT) AS "maxSeverity",
floor((CASE WHEN n IS NULL THEN 1.0 ELSE least(1.0, greatest(0.1, a * (0.7 + least(1.0, length(text)::DOUBLE / 100) * 0.2 + least(1.0, n::DOUBLE / 5) * 0.1))) END)::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM norm LEFT JOIN k USING (doc_id)"""


ORACLES["detect"] = detect_sql(_PER_DOC.replace("* 1000 + 0.5) / 1000", "* 1e9 + 0.5) / 1e9"), _FOUR)
_SHOWN = "CASE WHEN length(norm.text) = length(norm.t) THEN norm.text ELSE trim(regexp_replace(norm.text, '\\s+', ' ', 'g')) END"
_SOFT = _GRADUAL.replace("conf", "final")
ORACLES["filter_censor"] = detect_sql(f""", sh AS (SELECT doc_id, {_SHOWN} AS t FROM norm), z AS (SELECT f.*, substr(sh.t, start::INT + 1, ("end" - start)::INT) AS shown, coalesce(lag("end") OVER (PARTITION BY f.doc_id ORDER BY start), 0) AS gap, sh.t AS whole FROM (SELECT * EXCLUDE (t) FROM final WHERE final >= 0.5) f JOIN sh USING (doc_id)),
x AS (SELECT doc_id, string_agg(substr(whole, gap::INT + 1, (start - gap)::INT) || {_SOFT.replace("word", "shown")}, '' ORDER BY start) AS head, max("end") AS last, min(start) AS first FROM z GROUP BY doc_id)
SELECT sh.doc_id, CASE WHEN head IS NULL THEN sh.t ELSE {tidied_sql('head || substr(sh.t, last::INT + 1)', 'first = 0')} END AS "filteredText" FROM sh LEFT JOIN x USING (doc_id)""", ["en"])


@query("detect_exact", detect_sql(_PER_DOC))
def detect_exact(spark: SparkSession, sf: str) -> DataFrame:
    out = api.detect(base.docs(spark, sf), Config(languages=_FOUR, fuzzy=False))
    return out.select("doc_id", "hasProfanity", "totalMatches", "maxSeverity", (F.floor(F.col("confidence") * 1000 + 0.5) / 1000).alias("confidence"))


@query("detect_matches", detect_sql('SELECT doc_id, start, "end", word, term, language, severity, final AS confidence FROM final'))
def detect_matches(spark: SparkSession, sf: str) -> DataFrame:
    out = api.Detector(spark, Config(languages=_FOUR, fuzzy=False)).matches(base.docs(spark, sf)).select("doc_id", F.explode("matches").alias("m"))
    return out.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.word", F.col("m.match").alias("term"), "m.language", "m.severity", "m.confidence")


@query("stream_detect", detect_sql('SELECT norm.lang, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS matches FROM norm LEFT JOIN (SELECT doc_id, count(*) AS n FROM final GROUP BY doc_id) USING (doc_id) GROUP BY norm.lang'))
def stream_detect(spark: SparkSession, sf: str) -> DataFrame:
    """The batch detector over a stream of the documents' files; the result is what the sink has then."""
    from ..streaming.detect import detect_stream, read_documents, write_results

    where = shared_folder(spark, "stream")
    source = read_documents(spark, f"{sf}/documents*", files_per_trigger=25)
    stream = detect_stream(source, Config(languages=_FOUR, fuzzy=False)).select("doc_id", "lang", "totalMatches")
    write_results(stream, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema("doc_id long, lang string, totalMatches int").parquet(f"{where}/out").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("totalMatches").alias("matches"))
