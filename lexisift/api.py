"""The detector over DataFrames: one plan from texts to matches, results and redacted texts."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import config as cfg
from .config import Config
from .functions import langid
from .functions.text import let, normalize
from .operators import matching, redaction, results, scoring
from .operators.redaction import Redaction
from .sources import lexicon as lx

__version__ = "0.1.0"


def shown(text: Column, norm: Column) -> Column:
    """The form of the text closest to the original whose offsets are those of norm: the text itself, else
    with its space and contractions normalised, else without accents too; the case is always kept."""
    near = normalize(text, preserve_case=True, accents=False)
    n = F.length(norm)
    return F.when(F.length(text) == n, text).when(F.length(near) == n, near).otherwise(normalize(text, preserve_case=True))


class Detector:
    """Settings and a lexicon; every method is a transformation of a DataFrame with doc_id and text."""

    def __init__(self, spark: SparkSession, config: Config = cfg.DEFAULT, entries: DataFrame | None = None) -> None:
        self.spark, self.config = spark, config
        self.entries = entries if entries is not None else lx.built_in(spark)

    # ---- lexicon and settings

    def lexicon(self) -> DataFrame:
        """The surfaces of the configured languages (auto: all), admitted by severity and category."""
        c = self.config
        mine = self.entries if "auto" in c.languages else self.entries.where(F.col("lang").isin(c.languages))
        out = lx.surfaces(lx.admitted(mine, c.min_severity, c.categories))
        return lx.with_custom(out, lx.from_entries(self.spark, c.custom_words)) if c.custom_words else out

    def with_config(self, **values) -> Detector:
        errors, _, settings = cfg.check(values, self.config)
        if settings is None:
            raise ValueError("; ".join(errors))
        return Detector(self.spark, settings, self.entries)

    def add_custom_words(self, words: list[dict]) -> Detector:
        return self.with_config(custom_words=[*self.config.custom_words, *words])

    def stats(self) -> DataFrame:
        return lx.stats(self.entries)

    # ---- matching

    def _candidates(self, docs: DataFrame) -> DataFrame:
        """docs with norm, languages and candidates."""
        c = self.config
        out = docs.withColumn("norm", normalize(F.col("text")) if c.normalize else F.col("text"))
        if "auto" in c.languages:
            out = out.withColumn("languages", langid.languages_for(F.col("text"), langid.detect(F.col("text"))))
        else:
            out = out.withColumn("languages", F.array(*map(F.lit, c.languages)))
        return matching.automaton_matches(out, self.lexicon(), c.max_distance, c.unicode_borders, "languages")

    def _scored(self, candidates: Column, norm: Column, languages: Column) -> Column:
        """Filtered, weighed and resolved candidates with their last confidence; `max_matches` bounds what is looked at,
        the languages taking their turns, and fuzzy ones only while less than half of it is spent."""
        c = self.config
        if c.max_matches:
            candidates = scoring.budget(candidates, languages, c.max_matches, max(1, c.max_matches // 2))
        kept = self._kept(candidates)
        if c.context:
            kept = scoring.in_context(kept, norm)
        kept = scoring.resolve_overlaps(kept)
        return F.coalesce(F.transform(kept, lambda m: m.withField("confidence", scoring.final_confidence(m["confidence"], m["word"], m["match"], m["severity"]))), F.array())

    def matches(self, docs: DataFrame) -> DataFrame:
        """docs with norm, languages and matches."""
        return self._candidates(docs).withColumn("matches", self._scored(F.col("candidates"), F.col("norm"), F.col("languages"))).drop("candidates")

    def _kept(self, found: Column) -> Column:
        c = self.config
        barred = [*matching.WHITELIST, *map(str.lower, c.whitelist)]
        mild = lambda m: (F.lower(m["word"]).isin(matching.COMMON_WORDS) | F.lower(m["match"]).isin(matching.COMMON_WORDS)) & (m["severity"] <= 1) & (m["confidence"] < 0.8)
        return F.filter(found, lambda m: ~F.lower(m["word"]).isin(barred) & (F.length(m["word"]) >= c.min_word_length) & ~mild(m))

    # ---- results

    def analyze(self, docs: DataFrame, redact: Redaction | None = None) -> DataFrame:
        """One result row per document, clean ones included."""
        m, t = F.col("matches"), F.col("text")
        out = self.matches(docs)
        out = out.withColumns({"hasProfanity": F.size(m) > 0, "totalMatches": F.size(m), "maxSeverity": results.max_severity(m), "confidence": scoring.document_confidence(m, t)})
        if redact is not None:
            out = out.withColumn("shown", shown(t, F.col("norm"))).withColumn("filteredText", redaction.redact(F.col("shown"), m, redact)).drop("shown")
        return out

    def analyze_enhanced(self, docs: DataFrame, redact: Redaction | None = None) -> DataFrame:
        m, t = F.col("matches"), F.col("text")
        out = self.analyze(docs, redact)
        return out.withColumns({"enhanced": results.enhance(m, F.col("norm")), "statistics": results.statistics(m, t, lx.CORE_CATEGORIES), "textContext": results.text_context(t), "warnings": results.warnings(m, t, self.config.languages == ["auto"]), "recommendations": results.recommendations(m, t)})

    def analyze_with(self, docs: DataFrame, **options) -> DataFrame:
        """`analyze` with options of one call: a filter's mode, and which columns come back (see config.Options).

        max_length is checked only: texts are analysed whole."""
        errors, _, o = cfg.check_options(options)
        if o is None:
            raise ValueError("; ".join(errors))
        out = self.analyze(docs) if o.filter_mode == "detect_only" else self.filter(docs, o.filter_mode)
        return out.drop(*[c for c, keep in (("matches", o.include_matches), ("confidence", o.include_confidence)) if not keep])

    def filter(self, docs: DataFrame, mode: str = "censor") -> DataFrame:
        """docs with filteredText, by the detector's own redaction settings."""
        return self.analyze(docs, replace(redaction.DETECTOR, mode=mode, char=self.config.replacement_char, structure=self.config.preserve_structure))

    def is_profane(self, docs: DataFrame) -> DataFrame:
        return self.matches(docs).withColumn("profane", F.size("matches") > 0)

    def is_clean(self, docs: DataFrame) -> DataFrame:
        return self.matches(docs).withColumn("clean", F.size("matches") == 0)

    def safe(self, docs: DataFrame, level: str = "moderate") -> DataFrame:
        return self.analyze(docs, redaction.safe(level))

    def per_language(self, docs: DataFrame, languages: list[str]) -> DataFrame:
        """A result for each document and language, with the language's detected confidence beside it."""
        found = langid.detect(F.col("text"))
        parts = None
        for code in languages:
            one = self.with_config(languages=[code]).analyze(docs).withColumn("lang_confidence", F.greatest(F.lit(0.1), langid.confidence_of(found, code)))
            one = one.withColumn("result_language", F.lit(code))
            parts = one if parts is None else parts.unionByName(one)
        return parts

    def multi_language(self, docs: DataFrame, languages: list[str]) -> DataFrame:
        """The union of all languages' matches, matches by language, whether several have any, the primary language, and its result.

        One pass over the texts with the lexicon of all the languages; each language's candidates are then filtered, weighed and
        resolved on their own, inside the row, as a detector of that language alone would.  The primary language is the one detected
        with the highest confidence (0.1 where it isn't), the first of equal ones; `result` (hasProfanity, totalMatches, maxSeverity,
        confidence, matches) is made of its matches alone."""
        one = self.with_config(languages=languages)
        out = one._candidates(docs)

        def part(code: str) -> Column:
            mine = F.filter("candidates", lambda m: m["language"] == code)
            return F.struct(F.lit(code).alias("language"), one._scored(mine, F.col("norm"), F.array(F.lit(code))).alias("matches"))

        found = langid.detect(F.col("text"))

        def whole(x: Column) -> Column:
            parts = x["parts"]
            rank = [F.struct(F.greatest(F.lit(0.1), langid.confidence_of(x["found"], code)).alias("c"), F.lit(-i).alias("k")) for i, code in enumerate(languages)]
            first = F.get(parts, -F.array_max(F.array(*rank))["k"])
            counts = F.filter(F.transform(parts, lambda p: F.struct(p["language"].alias("result_language"), F.size(p["matches"]).alias("n"))), lambda n: n["n"] > 0)
            every = F.flatten(F.transform(parts, lambda p: p["matches"]))
            return let(first, lambda f: F.struct(every.alias("matches"), F.sort_array(counts).alias("by_language"), f["language"].alias("primary"), one._result(f["matches"], F.col("text")).alias("result"), (F.size(counts) > 1).alias("cross_language")))

        # the parts are made once and held; as columns of their own they would be made anew for each column that names them
        both = F.struct(F.array(*map(part, languages)).alias("parts"), found.alias("found"))
        return out.select("doc_id", let(both, whole).alias("_r")).select("doc_id", "_r.*")

    @staticmethod
    def _result(m: Column, text: Column) -> Column:
        fields = {"hasProfanity": F.size(m) > 0, "totalMatches": F.size(m), "maxSeverity": results.max_severity(m), "confidence": scoring.document_confidence(m, text), "matches": m}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    def add_language(self, code: str) -> Detector:
        """The detector with one more language; a language that it has changes nothing."""
        return self if code in self.config.languages else self.with_config(languages=[*self.config.languages, code])

    def remove_language(self, code: str) -> Detector:
        """The detector without a language; the last one stays."""
        left = [x for x in self.config.languages if x != code]
        return self.with_config(languages=left) if left else self


def selected_languages(found: Column, configured: list[str], primary: str | None, loaded: list[str], threshold: float = 0.1) -> Column:
    """The languages to analyse: detected ones from the threshold on, configured ones and the primary one, as far as they are loaded."""
    detected = F.transform(F.filter(found, lambda e: e["confidence"] >= threshold), lambda e: e["language"])
    wanted = F.array_union(detected, F.array(*map(F.lit, [*configured, *([primary] if primary else [])])))
    return F.array_intersect(wanted, F.array(*map(F.lit, loaded)))


def batch_filter(texts: DataFrame, matches: DataFrame, redact: Redaction = Redaction(), key: str = "doc_id") -> DataFrame:
    """Redacts texts (key, text) by matches that were found elsewhere (key, matches); the two must have the same keys, each once.

    One join finds whatever doesn't fit: a key of only one side, or one that occurs twice in either, raises in its row."""
    each = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(f"_n_{name}"), *[F.first(c).alias(c) for c in rows.columns if c != key])
    both = each(texts, "texts").join(each(matches, "matches"), key, "full")
    wrong = F.when(F.col("_n_matches").isNull(), F.lit("no matches for ")).when(F.col("_n_texts").isNull(), F.lit("no text for ")).when((F.col("_n_texts") > 1) | (F.col("_n_matches") > 1), F.lit("repeated key "))
    stop = F.raise_error(F.concat(wrong, F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("array<" + matching.MATCH + ">")
    both = both.withColumn("matches", F.when(wrong.isNotNull(), stop).otherwise(F.col("matches"))).drop("_n_texts", "_n_matches")
    return both.withColumn("filteredText", redaction.redact(F.col("text"), matching.by_start(F.col("matches")), redact))


def apply_filter(docs: DataFrame, mode: str = "censor", char: str = "*", structure: bool = True) -> DataFrame:
    """The older call: docs with text and matches, three settings, filteredText."""
    return docs.withColumn("filteredText", redaction.redact(F.col("text"), F.col("matches"), Redaction(mode=mode, char=char, structure=structure)))


def measured(out: DataFrame, phase: str) -> tuple[DataFrame, Observation]:
    """out with counters of a phase (texts, characters, matches), which are filled when an action has run."""
    seen = Observation(phase)
    return out.observe(seen, F.count("*").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.size("matches")), F.lit(0)).alias("matches")), seen


class PerformanceMonitor:
    """Count, total and mean of the seconds of named operations, and characters a millisecond."""

    def __init__(self) -> None:
        self.times: dict[str, list[float]] = {}
        self.characters: dict[str, int] = {}

    def run(self, name: str, out: DataFrame):
        """Runs a detector's plan to a sink that keeps nothing; returns the phase's counters."""
        plan, seen = measured(out, name)
        began = time.perf_counter()
        plan.write.format("noop").mode("overwrite").save()
        self.times.setdefault(name, []).append(time.perf_counter() - began)
        self.characters[name] = self.characters.get(name, 0) + seen.get["characters"]
        return seen.get

    def metrics(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "total": sum(v), "average": sum(v) / len(v), "charactersPerMs": self.characters[k] / max(sum(v) * 1000, 1e-9)} for k, v in self.times.items()}


# ---- quick start

#: The settings of the quick functions, changed by `configure`.
_quick = cfg.DEFAULT


def configure(**values) -> Config:
    """Changes the settings of detect, filter_texts, filter_enhanced and is_clean; `reset` takes that back."""
    global _quick
    _quick = cfg.ConfigManager(_quick).update(**values)
    return _quick


def reset() -> Config:
    global _quick
    _quick = cfg.DEFAULT
    return _quick


def detect(docs: DataFrame, config: Config | None = None, entries: DataFrame | None = None) -> DataFrame:
    return Detector(docs.sparkSession, config or _quick, entries).analyze(docs)


def detect_enhanced(docs: DataFrame, config: Config | None = None) -> DataFrame:
    return Detector(docs.sparkSession, config or cfg.PRESETS["comprehensive"]).analyze_enhanced(docs)


def filter_texts(docs: DataFrame, mode: str = "censor", config: Config | None = None) -> DataFrame:
    return Detector(docs.sparkSession, config or _quick).filter(docs, mode)


def filter_enhanced(docs: DataFrame, redact: Redaction = Redaction(), config: Config | None = None) -> DataFrame:
    return Detector(docs.sparkSession, config or _quick).analyze(docs, redact)


def is_clean(docs: DataFrame, config: Config | None = None) -> DataFrame:
    return Detector(docs.sparkSession, config or _quick).is_clean(docs)


def batch_detect(docs: DataFrame) -> DataFrame:
    """The performance preset in all languages."""
    return Detector(docs.sparkSession, replace(cfg.PRESETS["performance"], languages=["auto"])).analyze(docs)


def smart_config(docs: DataFrame, rows: int = 3) -> Config:
    """Settings for the languages of the first few texts (1000 characters of them)."""
    text = docs.orderBy("doc_id").limit(rows).agg(F.left(F.concat_ws(" ", F.collect_list("text")), F.lit(1000)).alias("text"))
    found = text.select(langid.detect(F.col("text")).alias("f")).first()["f"]
    return replace(cfg.DEFAULT, languages=[e["language"] for e in found])


def factory(name: str) -> Config:
    """Named settings: english ... arabic, performance, comprehensive, development, production, testing."""
    codes = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "russian": "ru", "chinese": "zh", "japanese": "ja", "arabic": "ar"}
    if name in codes:
        return cfg.for_language(codes[name])
    return cfg.ENVIRONMENTS.get(name) or cfg.PRESETS[name]


def configured(spark: SparkSession, name: str = "comprehensive", languages: list[str] | None = None, **own) -> Detector:
    """A detector of a preset's settings, for the given languages (all), with a caller's own values over them."""
    return Detector(spark, cfg.preset(name)).with_config(**{"languages": languages or ["auto"], **own})


def collection(spark: SparkSession, languages: list[str], **own) -> dict[str, Detector]:
    """A detector for each language, by its own settings where it has any."""
    return {code: Detector(spark, cfg.for_language(code)).with_config(**own) for code in languages}


def library_info() -> dict:
    return {"version": __version__, "languages": cfg.LANGUAGES, "presets": sorted(cfg.PRESETS), "modes": list(redaction.MODES)}


def health_check(spark: SparkSession) -> dict:
    """Four checks: detection, redaction, language, settings."""
    docs = spark.createDataFrame([(1, "you idiot"), (2, "good morning to everyone")], "doc_id long, text string")
    checks = {}

    def run(name, f):
        try:
            checks[name] = bool(f())
        except Exception:
            checks[name] = False

    run("detection", lambda: detect(docs).where("hasProfanity").count() == 1)
    run("redaction", lambda: "idiot" not in filter_texts(docs).where("doc_id = 1").first()["filteredText"])
    run("language", lambda: docs.select(langid.primary(langid.detect(F.col("text"))).alias("l")).count() == 2)
    run("settings", lambda: not cfg.validate({"languages": ["en"]})[0])
    bad = sum(not v for v in checks.values())
    return {"status": "healthy" if bad == 0 else "warning" if bad < 2 else "error", "checks": checks}
