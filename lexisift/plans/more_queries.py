"""Further queries of the engine: lexicon forms and loaders, fuzzy scores, enhanced results, roll-ups, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..config import Config
from ..functions import charmap, langid
from ..functions import text as tx
from ..operators import matching, redaction, results
from ..session import shared_folder, staged
from ..sources import lexicon as lx
from . import base
from . import queries as core
from .base import hits_sql, q, tokens_sql
from .queries import by_doc, query


# ---------------------------------------------------------------- lexicon


@query("lexicon_json", f"WITH {base.CORPUS_SQL} SELECT lang, word, severity, array_to_string(categories, ',') AS categories, array_to_string(variations, ',') AS variations FROM en WHERE lang IN ('en', 'fr')")
def lexicon_json(spark: SparkSession, sf: str) -> DataFrame:
    """The entries written as JSON folders and read again, two languages of them."""
    where = shared_folder(spark, "lexicon")
    lx.write_json(base.corpus_entries(spark, sf), where)
    return lx.read_json(spark, where, ["en", "fr"]).select("lang", "word", "severity", F.array_join("categories", ",").alias("categories"), F.array_join("variations", ",").alias("variations"))


@query("lexicon_maps", f"""WITH {base.CORPUS_SQL} SELECT lang, 'profanity' AS kind, word AS key, '' AS value FROM en UNION ALL SELECT lang, 'severity', word, CAST(severity AS VARCHAR) FROM en
UNION ALL SELECT lang, 'variations', word, unnest(variations) FROM en UNION ALL SELECT lang, 'categories', unnest(categories), word FROM en""")
def lexicon_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The entries as the maps of a language's folder, an item a row, so that no language is a row of its own."""
    return lx.map_rows(base.corpus_entries(spark, sf))


@query("lexicon_sizes", f"""WITH {base.CORPUS_SQL} SELECT lang, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS characters,
CAST(2 * sum(length('{{"word":"' || word || '","severity":' || severity || ',"categories":[' || array_to_string(list_transform(categories, lambda c: '"' || c || '"'), ',') || '],"variations":[' || array_to_string(list_transform(variations, lambda c: '"' || c || '"'), ',') || ']}}')) AS BIGINT) AS bytes FROM en GROUP BY lang""")
def lexicon_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return lx.sizes(base.corpus_entries(spark, sf))


@query("lexicon_languages", f"WITH {base.CORPUS_SQL}, wanted AS (SELECT unnest(['en', 'fr', 'xx']) AS lang) SELECT w.lang, count(e.word) AS words, count(e.word) > 0 AS available FROM wanted w LEFT JOIN en e ON e.lang = w.lang GROUP BY w.lang")
def lexicon_languages(spark: SparkSession, sf: str) -> DataFrame:
    return lx.availability(base.corpus_entries(spark, sf), ["en", "fr", "xx"])


@query("lexicon_custom", f"WITH {base.CORPUS_LEXICON_SQL} SELECT language AS lang, surface, term, base_conf FROM lex WHERE language = 'en' UNION ALL SELECT * FROM (VALUES ('en', 'zorble', 'zorble', 0.9::DOUBLE), ('en', 'z0rble', 'zorble', 0.9::DOUBLE))")
def lexicon_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Custom words of a language that is loaded join the lexicon at 0.9; those of another don't."""
    own = lx.from_entries(spark, [{"language": "en", "word": "zorble", "severity": 3, "categories": ["general"], "variations": ["z0rble"]}, {"language": "xx", "word": "other", "severity": 3, "categories": ["general"]}])
    return lx.with_custom(base.corpus_lexicon(spark, sf).where("lang = 'en'"), own).select("lang", "surface", "term", "base_conf")


# ---------------------------------------------------------------- fuzzy


_NEAR = """, nt AS (SELECT doc_id, lang, unnest(regexp_extract_all(t, '[A-Za-z0-9_]+')) AS word FROM norm WHERE length(t) >= 3),
nw AS (SELECT DISTINCT lang, word FROM nt WHERE length(word) >= 2),
nd AS (SELECT w.lang, w.word, l.term, l.severity, levenshtein(w.word, l.surface_norm) AS d FROM nw w JOIN lex l ON l.language = w.lang AND NOT l.is_variation AND abs(length(w.word) - length(l.surface_norm)) <= 2 WHERE levenshtein(w.word, l.surface_norm) BETWEEN 1 AND 2),
nf AS (SELECT nt.doc_id, nt.word, nd.term, nd.severity, CAST(nd.d AS INT) AS distance, greatest(0.5, 1 - 0.2::DOUBLE * nd.d)::DOUBLE AS confidence FROM nt JOIN nd ON nd.lang = nt.lang AND nd.word = nt.word)"""
_COMMON = base.in_list(matching.COMMON_WORDS)


def _of_documents(spark: SparkSession) -> DataFrame:
    """The lexicon of the languages that the documents are in."""
    return base.lexicon(spark).where(F.col("lang").isin("en", "fr", "de", "es"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.normed(spark, sf).withColumn("langs", F.array("lang"))
    found = matching.automaton_matches(rows, base.lexicon(spark), 2, languages="langs")
    return matching.hit_rows(found.withColumn("candidates", F.filter("candidates", lambda m: m["distance"] > 0))).withColumn("distance", F.round((1 - F.col("base_conf")) / 0.2).cast("int"))


@query("fuzzy_confidence", tokens_sql(_NEAR + " SELECT doc_id, word, term, distance, floor(confidence * 100 + 0.5) / 100 AS confidence, count(*) AS n FROM nf GROUP BY ALL"))
def fuzzy_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens within two edits of a base word and the confidence that the edits leave."""
    return _near(spark, sf).groupBy("doc_id", "word", "term", "distance", tx.round2(F.col("base_conf")).alias("confidence")).agg(F.count("*").alias("n"))


@query("fuzzy_common_words", tokens_sql(_NEAR + f""" SELECT doc_id, count(*) AS n, count(*) FILTER (word IN {_COMMON} OR lower(term) IN {_COMMON}) AS common FROM nf
WHERE word NOT IN {base.in_list(matching.WHITELIST)} AND NOT ((word IN {_COMMON} OR lower(term) IN {_COMMON}) AND severity <= 1 AND confidence < 0.8) GROUP BY doc_id"""))
def fuzzy_common_words(spark: SparkSession, sf: str) -> DataFrame:
    """The row filters over fuzzy hits, where mild common words of little confidence go."""
    kept = matching.keep(_near(spark, sf))
    common = F.lower("word").isin(matching.COMMON_WORDS) | F.lower("term").isin(matching.COMMON_WORDS)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(common).alias("common"))


@query("fuzzy_nearest", tokens_sql("""SELECT token, surface, CAST(distance AS INT) AS distance FROM (SELECT token, surface_norm AS surface, levenshtein(token, surface_norm) AS distance, min(levenshtein(token, surface_norm)) OVER (PARTITION BY token) AS least
FROM (SELECT DISTINCT token FROM tok WHERE length(token) >= 2) t, (SELECT DISTINCT surface_norm FROM lex WHERE NOT is_variation AND n_tokens = 1 AND language IN ('en', 'fr', 'de', 'es')) l WHERE abs(length(token) - length(surface_norm)) <= 2 AND levenshtein(token, surface_norm) <= 2)
QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, surface) = 1"""))
def fuzzy_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest surface of each token within two edits."""
    words = matching.token_list(base.normed(spark, sf)).where(F.length("token") >= 2)
    known = _of_documents(spark).where("not is_variation and n_tokens = 1").select(F.col("surface_norm").alias("surface"))
    return matching.lowest_distance(matching.near_pairs(words, known, 2), ["token"])


@query("remainder_search", f"""WITH {base.lexicon_sql()}, {base.NORM_SQL}, s AS (SELECT doc_id, lower(t) AS t, unnest(range(greatest(0, length(t) - 30), length(t)))::INT AS start FROM norm WHERE length(t) > 0),
r AS (SELECT doc_id, start, substr(t, start + 1, 30) AS word FROM s WHERE start = 0 OR NOT regexp_matches(substr(t, start, 1), '[a-z0-9]'))
SELECT doc_id, start, CAST(start + length(word) AS INT) AS "end", term, word, CAST(min(levenshtein(word, surface_norm)) AS INT) AS distance FROM r JOIN (SELECT * FROM lex WHERE language IN ('en', 'fr', 'de', 'es')) ON abs(length(word) - length(surface_norm)) <= 2 AND levenshtein(word, surface_norm) <= 2 GROUP BY doc_id, start, term, word""")
def remainder_search(spark: SparkSession, sf: str) -> DataFrame:
    """Whole remainders of texts within two edits of a surface, the nearest for each."""
    return matching.remainder_search(base.normed(spark, sf), _of_documents(spark), 2)


@query("fuzzy_prefix", f"""WITH {base.lexicon_sql()}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM documents),
d AS (SELECT DISTINCT lower(surface_norm) AS surface FROM lex WHERE NOT is_variation AND n_tokens = 1 AND language IN ('en', 'fr', 'de', 'es'))
SELECT token, surface, CAST(levenshtein(token, surface) AS INT) AS distance FROM w JOIN d ON length(token) > 2 AND abs(length(token) - length(surface)) <= 2 AND levenshtein(token, surface) <= 2""")
def fuzzy_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Words of any case near a surface, met by the delete variants of their first five characters."""
    words = base.docs(spark, sf).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))).alias("token"))
    known = _of_documents(spark).where("not is_variation and n_tokens = 1").select(F.col("surface_norm").alias("surface"))
    return matching.fuzzy_pairs(words, known, 2, prefix=5, case_sensitive=False)


_ALIKE = f"1 - {base.edits_sql('lower(w)', 'pattern')}::DOUBLE / greatest(length(lower(w)), length(pattern))"


@query("similar_places", f"""WITH s AS (SELECT doc_id, string_split_regex(text, '{base.SPACE_SQL}+') AS w, regexp_extract_all(text, '{base.SPACE_SQL}+') AS b FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(w) AS w, unnest(list_resize(list_transform(b, lambda x: length(x)), len(w), 0)) AS b, unnest(range(len(w))) AS i FROM s),
o AS (SELECT doc_id, w, coalesce(sum(length(w) + b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT doc_id, pattern, w AS match, floor(({_ALIKE}) * 1000 + 0.5) / 1000 AS similarity, CAST(start AS INT) AS start, CAST(start + length(w) AS INT) AS "end"
FROM o, (SELECT unnest([{', '.join(map(q, core._PATTERNS))}]) AS pattern) WHERE w <> '' AND {_ALIKE} >= 0.75""")
def similar_places(spark: SparkSession, sf: str) -> DataFrame:
    """The words that are like a pattern, with their offsets."""
    rows = base.docs(spark, sf).select("doc_id", F.explode(matching.similar_places(F.col("text"), core._PATTERNS, 0.75)).alias("m"))
    return rows.select("doc_id", "m.pattern", "m.match", (F.floor(F.col("m.similarity") * 1000 + 0.5) / 1000).alias("similarity"), "m.start", "m.end")


_PATTERN = "united states"


@query("fuzzy_match_flag", f"SELECT n_nationkey, 1 - levenshtein(lower(n_name), '{_PATTERN}')::DOUBLE / greatest(length(n_name), {len(_PATTERN)}) >= 0.8 AS alike FROM nation")
def fuzzy_match_flag(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", tx.fuzzy_match(F.col("n_name"), F.lit(_PATTERN)).alias("alike"))


# ---------------------------------------------------------------- results


_SENTENCE = "CASE WHEN length(rr) >= length(word) THEN trim(ll || rr) ELSE '' END"


@query("enhanced_matches", hits_sql(f""", p AS (SELECT *, substr(t, 1, start::INT) AS h FROM hits), e AS (SELECT *, regexp_extract(h, '[^.!?]*$') AS ll, regexp_extract(substr(t, start::INT + 1), '^[^.!?]*') AS rr FROM p)
SELECT doc_id, start, word, term, CAST(len(string_split(h, chr(10))) AS INT) AS line, CAST(length(string_split(h, chr(10))[-1]) + 1 AS INT) AS col, trim(substr(t, greatest(start - 50, 0)::INT + 1, (start - greatest(start - 50, 0))::INT)) AS before, trim(substr(t, "end"::INT + 1, 50)) AS after,
{_SENTENCE} AS sentence, lower(word) <> lower(term) AS fuzzy, CAST(levenshtein(word, term) AS INT) AS edits FROM e"""))
def enhanced_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each match with its place, wide context, sentence, and edits from the term."""
    m = base.with_matches(spark, sf).select("doc_id", F.explode(results.enhance(F.col("matches"), F.col("norm"))).alias("m"))
    return m.select("doc_id", F.col("m.start").cast("long").alias("start"), "m.word", F.col("m.match").alias("term"), F.col("m.position.lineNumber").alias("line"), F.col("m.position.columnStart").alias("col"), "m.context.before", "m.context.after", "m.context.sentence", F.col("m.isFuzzyMatch").alias("fuzzy"), F.col("m.editDistance").alias("edits"))


@query("document_categories", hits_sql(f"""SELECT n.doc_id, c.category, CAST(coalesce(k, 0) AS INT) AS n FROM norm n CROSS JOIN (SELECT unnest([{', '.join(map(q, lx.CORE_CATEGORIES))}]) AS category) c
LEFT JOIN (SELECT doc_id, category, count(*) AS k FROM (SELECT doc_id, unnest(categories) AS category FROM hits) GROUP BY doc_id, category) h ON h.doc_id = n.doc_id AND h.category = c.category"""))
def document_categories(spark: SparkSession, sf: str) -> DataFrame:
    """A document's matches by category, the core ones from 0."""
    return base.with_matches(spark, sf).select("doc_id", F.explode(results.category_distribution(F.col("matches"), lx.CORE_CATEGORIES)).alias("category", "n"))


@query("document_languages", hits_sql("SELECT doc_id, language, CAST(count(*) AS INT) AS n FROM hits GROUP BY doc_id, language"))
def document_languages(spark: SparkSession, sf: str) -> DataFrame:
    return base.with_matches(spark, sf).select("doc_id", F.explode(results.language_distribution(F.col("matches"))).alias("language", "n"))


_TURN_HITS = base.NORM_SQL.replace("doc_id, text, lang, source", "conv_id * 1000 + turn AS doc_id, text, NULL AS lang, conv_id AS source").replace("FROM documents", "FROM conversations")


@query("merge_conversations", f"""WITH {base.lexicon_sql()}, {_TURN_HITS}, {base.TOKENS_SQL}, {core._ALL_HITS}, d AS (SELECT n.source AS conv_id, n.doc_id, n.text, count(h.doc_id) AS n, greatest(1, coalesce(max(severity), 1)) AS s FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY ALL)
SELECT conv_id, CAST(length(string_agg(text, ' ' ORDER BY doc_id)) AS INT) AS characters, CAST(sum(n) AS INT) AS "totalMatches", CAST(max(s) AS INT) AS "maxSeverity", count(*) AS results,
floor((avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0, greatest(0.1, (0.7 + least(1.0, length(text)::DOUBLE / 100) * 0.2 + least(1.0, n::DOUBLE / 5) * 0.1)))::DOUBLE END)) * 1000 + 0.5) / 1000 AS confidence FROM d GROUP BY conv_id""")
def merge_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The results of a conversation's turns, matched in all languages, as one."""
    from ..operators import scoring

    turns = base.spread(spark.read.parquet(f"{sf}/conversations.parquet")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "text")
    out = matching.automaton_matches(matching.normalized(turns), base.lexicon(spark)).withColumn("matches", matching.by_start(F.col("candidates")))
    languages = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["language"])))
    out = out.withColumns({"languages": languages, "confidence": scoring.document_confidence(F.col("matches"), F.col("text")), "maxSeverity": results.max_severity(F.col("matches"))})
    merged = results.merge(out, "conv_id")
    return merged.select("conv_id", F.length("text").alias("characters"), "totalMatches", "maxSeverity", "results", (F.floor(F.col("confidence") * 1000 + 0.5) / 1000).alias("confidence"))


_TRUST = "CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0, greatest(0.1, (0.7 + least(1.0, length(text)::DOUBLE / 100) * 0.2 + least(1.0, {n}::DOUBLE / 5) * 0.1)))::DOUBLE END"


@query("compare_results", hits_sql(f""", d AS (SELECT n.doc_id, n.text, count(h.doc_id) AS na, count(h.doc_id) FILTER (severity >= 2) AS nb, greatest(1, coalesce(max(severity), 1)) AS sa, greatest(1, coalesce(max(severity) FILTER (severity >= 2), 1)) AS sb FROM norm n LEFT JOIN hits h ON h.doc_id = n.doc_id GROUP BY ALL),
f AS (SELECT doc_id, nb - na AS n, sb - sa AS s, {_TRUST.format(n="nb")} - {_TRUST.format(n="na")} AS c FROM d),
g AS (SELECT *, concat_ws(' ', CASE WHEN n > 0 THEN n || ' more matches found.' WHEN n < 0 THEN -n || ' fewer matches found.' END, CASE WHEN s > 0 THEN 'Higher severity detected.' WHEN s < 0 THEN 'Lower severity detected.' END, CASE WHEN abs(c) > 0.1 THEN 'Confidence ' || CASE WHEN c > 0 THEN 'increased' ELSE 'decreased' END || ' by ' || printf('%.2f', abs(c)) || '.' END) AS parts FROM f)
SELECT doc_id, CAST(n AS INT) AS "matchesDiff", CAST(s AS INT) AS "severityDiff", floor(c * 1000 + 0.5) / 1000 AS "confidenceDiff", CASE WHEN parts = '' THEN 'Results are similar.' ELSE parts END AS summary FROM g"""))
def compare_results(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of a text against those of severity 2 or more: counts, severities and confidences."""
    from ..operators import scoring

    m = base.with_matches(spark, sf)

    def side(x: Column) -> dict[str, Column]:
        return {"totalMatches": F.size(x), "maxSeverity": results.max_severity(x), "confidence": scoring.document_confidence(x, F.col("text"))}

    c = results.comparison(side(F.col("matches")), side(F.filter("matches", lambda x: x["severity"] >= 2)))
    c["confidenceDiff"] = F.floor(c["confidenceDiff"] * 1000 + 0.5) / 1000
    return m.select("doc_id", *[v.alias(k) for k, v in c.items()])


_COUNTS = ", ".join(f"CAST(count(*) FILTER (x.language = '{k}') AS INT) AS {k}" for k in ("en", "fr"))


@query("language_matches", core.detect_sql(f"SELECT norm.doc_id, {_COUNTS}, count(DISTINCT x.language) > 1 AS cross_language FROM norm LEFT JOIN final x ON x.doc_id = norm.doc_id GROUP BY norm.doc_id").replace("k ON k.token", "k ON k.token").replace("FROM g WHERE conf >= 0.3)", "FROM (SELECT *, doc_id * 10 + CASE language WHEN 'en' THEN 1 ELSE 2 END AS part FROM g WHERE language IN ('en', 'fr')) WHERE conf >= 0.3)").replace("PARTITION BY doc_id ORDER BY start, severity DESC", "PARTITION BY part ORDER BY start, severity DESC").replace("v AS (SELECT doc_id, k, k AS kept", "v AS (SELECT part AS doc_id, k, k AS kept").replace("UNION ALL SELECT o.doc_id, o.k, CASE", "UNION ALL SELECT o.part, o.k, CASE").replace("ON o.doc_id = f.doc_id AND o.k = f.k + 1)", "ON o.part = f.doc_id AND o.k = f.k + 1)").replace("ON o.doc_id = w.doc_id AND o.k = w.kept", "ON o.part = w.doc_id AND o.k = w.kept"))
def language_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of two detectors, one for each language, from one pass over the texts."""
    out = api.Detector(spark, Config(fuzzy=False)).multi_language(base.docs(spark, sf), ["en", "fr"])
    n = lambda code: F.coalesce(F.get(F.filter("by_language", lambda x: x["result_language"] == code), F.lit(0))["n"], F.lit(0))
    return out.select("doc_id", n("en").alias("en"), n("fr").alias("fr"), "cross_language")


_RANKED = core._langid_sql().split("t AS (SELECT doc_id")[0].rstrip().rstrip(",")


@query("selected_languages", _RANKED + """ SELECT s.doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(list(r.language) FILTER (r.n <= 3 AND r.c >= 0.1), []), CASE WHEN count(r.language) = 0 THEN ['en'] ELSE [] END, ['fr', 'de']), lambda l: list_contains(['en', 'fr', 'de', 'es'], l)))), ',') AS languages
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id""")
def selected_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Detected, configured and primary languages, as far as they are loaded."""
    found = base.docs(spark, sf).select("doc_id", langid.detect(F.col("text")).alias("f"))
    chosen = api.selected_languages(F.col("f"), ["fr"], "de", ["en", "fr", "de", "es"])
    return found.select("doc_id", F.array_join(F.array_sort(chosen), ",").alias("languages"))


@query("batch_filter", core.ORACLES["censor_full"])
def batch_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Texts redacted by matches that come as a table of their own."""
    from ..operators import scoring

    found = staged(base.found(spark, sf).select("doc_id", "norm", "candidates"), "found")  # both sides come from one pass
    texts = found.select("doc_id", F.col("norm").alias("text"))
    matches = found.select("doc_id", scoring.resolve_overlaps(F.col("candidates")).alias("matches"))
    return api.batch_filter(texts, matches).select("doc_id", F.col("filteredText").alias("filtered"))


@query("apply_filter", core.ORACLES["censor_plain"])
def apply_filter(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import scoring

    rows = base.found(spark, sf).select("doc_id", F.col("norm").alias("text"), scoring.resolve_overlaps(F.col("candidates")).alias("matches"))
    return api.apply_filter(rows, "censor", "#", structure=False).select("doc_id", F.col("filteredText").alias("filtered"))


# ---------------------------------------------------------------- text forms


by_doc("unicode_nfc", lambda c: {"form": tx.unicode_form("NFC")(c)}, {"form": "nfc_normalize(text)"})
by_doc("accents_removed", lambda c: {"plain": tx.remove_diacritics(c)}, {"plain": "strip_accents(text)"})
by_doc("bidi_removed", lambda c: {"plain": tx.remove_bidi(c)}, {"plain": "trim(regexp_replace(text, '[\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', '', 'g'))"})
by_doc("lower_tr", lambda c: {"low": tx.lower_in(c, "tr")}, {"low": "lower(translate(text, 'İI', 'iı'))"})
by_doc("lower_de", lambda c: {"low": tx.lower_in(c, "de")}, {"low": "replace(lower(text), 'ß', 'ss')"})


def _folded_sql(language: str) -> str:
    out, rules = "text", tx.LANGUAGE_FOLDS[language]
    one = {a: b for a, b in rules.items() if len(b) == 1}
    if one:
        out = f"translate({out}, {q(''.join(one))}, {q(''.join(one.values()))})"
    for a, b in rules.items():
        if len(b) > 1:
            out = f"replace({out}, {q(a)}, {q(b)})"
    return out


_FOLDED = [k for k in ("de", "fr", "es", "pt") if k in tx.LANGUAGE_FOLDS]
by_doc("language_folds", lambda c: {k: tx.fold_language(c, k) for k in _FOLDED}, {k: _folded_sql(k) for k in _FOLDED})
by_doc("characters_normalized", lambda c: {"plain": charmap.normalize_characters(c, "de")}, {"plain": "lower(" + core._SEPARATED.format(core.cap_sql(f"translate({core._DE.replace('text', core._ALIKE.replace('text', core._LEET, 1), 1)}, {q(charmap.DIACRITICS[0])}, {q(charmap.DIACRITICS[1])})", 3, 1)) + ")"})
by_doc("searchable", lambda c: {"plain": tx.prepare_for_search(c)}, {"plain": f"trim({core._SPREAD})"})
by_doc("comparable", lambda c: {"plain": tx.clean_for_comparison(c)}, {"plain": core._CLEANED})


@query("redaction_custom_table", core.ORACLES["custom_replace"])
def redaction_custom_table(spark: SparkSession, sf: str) -> DataFrame:
    """Custom replacements added to and dropped from settings."""
    from ..operators import scoring

    r = redaction.with_custom(redaction.with_custom(redaction.Redaction(), {"Idiot": "[CUSTOM]", "th*": "[WILD]", "scum": "[GONE]"}), {}, drop=["scum"])
    m = base.found(spark, sf).withColumn("matches", scoring.resolve_overlaps(F.col("candidates")))
    return m.select("doc_id", redaction.redact(F.col("norm"), F.col("matches"), r).alias("filtered"))
