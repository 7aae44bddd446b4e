"""Results of documents: statistics, text context, advice, match details, merging, comparing, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMOJI, let, split_words
from . import places
from .scoring import trim_space, windows

# The tone word lists, the advice and the patterns.
AGGRESSIVE = ["hate", "angry", "furious", "rage", "kill", "destroy", "fight"]
POSITIVE = ["love", "happy", "great", "awesome", "wonderful", "amazing"]
NEGATIVE = ["sad", "terrible", "awful", "horrible", "disgusting", "hate"]
PATTERNS = {
    "hasUrls": r"(?i)(https?://[^\s]+)|(www\.[^\s]+\.[^\s]+)",
    "hasEmails": r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "hasMentions": r"@[A-Za-z0-9_]+",
    "hasHashtags": r"#[A-Za-z0-9_]+",
    "hasEmojis": EMOJI,
    "hasRepeatedChars": r"(.)\1{2,}",
    "hasAllCaps": r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])",
}
WARN_SHORT = "Very short text - results may be less reliable"
WARN_LOW = "Some matches have low confidence - manual review recommended"
WARN_AUTO = "Auto language detection enabled - specify languages for better performance"
ADVISE_DENSE = "High profanity density detected - consider comprehensive content review"
ADVISE_SEVERE = "Severe profanity detected - immediate action recommended"
ADVISE_REVIEW = "Consider complete content review due to high severity language"
ADVISE_MODERATE = "High profanity density detected - consider content moderation"
ADVISE_SOCIAL = "Social media content may need community guidelines review"
ADVISE_TONE = "Aggressive tone detected - consider tone moderation"


def text_patterns(c: Column) -> dict[str, Column]:
    return {name: c.rlike(p) for name, p in PATTERNS.items()}


def text_type(c: Column) -> Column:
    p = text_patterns(c)
    return F.when(p["hasMentions"] | p["hasHashtags"], "social_media").when(p["hasEmails"], "email").when((F.length(c) < 200) & p["hasEmojis"], "chat").when(F.length(c) > 300, "article").otherwise("unknown")


def count_words(c: Column) -> Column:
    return F.size(split_words(c))


def _hits(c: Column, words: list[str]) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])"))


def emotional_tone(c: Column) -> dict[str, Column]:
    """Shares of three word lists; neutral is 1 without any such word, else 0."""
    counts = {"aggressive": _hits(c, AGGRESSIVE), "positive": _hits(c, POSITIVE), "negative": _hits(c, NEGATIVE)}
    total = sum(counts.values(), F.lit(0))
    return {k: F.when(total > 0, n / total).otherwise(0.0) for k, n in counts.items()} | {"neutral": F.when(total > 0, 0.0).otherwise(1.0)}


def max_severity(matches: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(matches, lambda m: m["severity"])), F.lit(1)))


def severity_distribution(matches: Column) -> Column:
    count = lambda s: F.size(F.filter(matches, lambda m: m["severity"] == s))
    return F.create_map(*[x for s in range(1, 5) for x in (F.lit(s), count(s))])


def category_distribution(matches: Column, core: list[str]) -> Column:
    """Counts of all categories met, the core ones from 0."""
    all_ = F.flatten(F.transform(matches, lambda m: m["categories"]))
    names = F.array_union(F.array(*map(F.lit, core)), all_)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(all_, lambda x: x == n))))


def language_distribution(matches: Column) -> Column:
    langs = F.transform(matches, lambda m: m["language"])
    names = F.array_distinct(langs)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(langs, lambda x: x == n))))


def confidence_buckets(matches: Column) -> dict[str, Column]:
    n = lambda lo, hi: F.size(F.filter(matches, lambda m: (m["confidence"] >= lo) & (m["confidence"] < hi)))
    return {"high": n(0.8, 9.0), "medium": n(0.5, 0.8), "low": n(-9.0, 0.5)}


def statistics(matches: Column, text: Column, core: list[str]) -> Column:
    words = count_words(text)
    n = F.size(matches)
    mean = F.when(n > 0, F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["confidence"]) / n).otherwise(0.0)
    unique = F.size(F.array_distinct(F.transform(matches, lambda m: F.lower(m["match"]))))
    buckets = confidence_buckets(matches)
    return F.struct(
        words.alias("totalWords"), unique.alias("uniqueProfaneWords"), F.when(words > 0, n / words).otherwise(0.0).alias("profanityDensity"),
        severity_distribution(matches).alias("severityDistribution"), category_distribution(matches, core).alias("categoryDistribution"), language_distribution(matches).alias("languageDistribution"),
        mean.alias("averageConfidence"), F.struct(*[c.alias(k) for k, c in buckets.items()]).alias("confidenceDistribution"),
    )


def text_context(text: Column) -> Column:
    return F.struct(text_type(text).alias("textType"), F.lit("middle").alias("readingLevel"), F.struct(*[c.alias(k) for k, c in text_patterns(text).items()]).alias("patterns"), F.struct(*[c.alias(k) for k, c in emotional_tone(text).items()]).alias("emotionalTone"))


def warnings(matches: Column, text: Column, auto: bool = False) -> Column:
    given = [F.when(F.length(text) < 10, WARN_SHORT), F.when(F.exists(matches, lambda m: m["confidence"] < 0.5), WARN_LOW)] + [F.lit(WARN_AUTO)] * auto
    return F.filter(F.array(*given), lambda x: x.isNotNull())


def recommendations(matches: Column, text: Column) -> Column:
    n = F.size(matches)
    some = n > 0
    low = F.size(F.filter(matches, lambda m: m["confidence"] < 0.6))
    given = [
        F.when(n > F.size(F.split(text, " ")) * 0.2, ADVISE_DENSE),
        F.when(F.exists(matches, lambda m: m["severity"] >= 4), ADVISE_SEVERE),
        F.when(some & (max_severity(matches) >= 3), ADVISE_REVIEW),
        F.when(some & (n / F.greatest(count_words(text), F.lit(1)) > 0.1), ADVISE_MODERATE),
        F.when(some & (text_type(text) == "social_media"), ADVISE_SOCIAL),
        F.when(some & (emotional_tone(text)["aggressive"] > 0.3), ADVISE_TONE),
        F.when(low > 0, F.concat(low.cast("string"), F.lit(" matches have low confidence - manual review recommended"))),
    ]
    return F.filter(F.array(*given), lambda x: x.isNotNull())


def _counts(text: Column, matches: Column) -> Column:
    """For each match, by start: line feeds, words and sentence marks before it, and the last line feed (-1 without one).

    The text between one match and the next is searched once; running sums make the rest."""
    last = F.lit(-1)

    def between(parts: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(matches, i - 1)["start"])

            def body(seg: Column) -> Column:
                piece, ahead = seg["text"], seg["ahead"]
                tail = F.locate("\n", F.reverse(piece))
                return F.struct(F.regexp_count(piece, F.lit("\n")).alias("lines"), F.regexp_count(ahead, F.lit(r"(?<=\S)\s")).alias("words"), F.regexp_count(piece, F.lit("[.!?]")).alias("marks"), F.when(tail == 0, last).otherwise(m["start"] - tail).alias("feed"))

            # a word's end is seen from the character before
            return let(F.struct(places.cut(parts, at, m["start"]).alias("text"), places.cut(parts, F.greatest(at - 1, F.lit(0)), m["start"]).alias("ahead")), body)

        return F.transform(matches, one)

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[k] + b[k]).alias(k) for k in ("lines", "words", "marks")], F.greatest(a["feed"], b["feed"]).alias("feed"))

    zero = F.struct(*[F.lit(0).alias(k) for k in ("lines", "words", "marks")], last.alias("feed"))
    return F.when(F.size(matches) > 0, places.running(let(places.chunks(text), between), zero, add)).otherwise(F.array().cast("array<struct<lines:int,words:int,marks:int,feed:int>>"))


def positions(text: Column, matches: Column) -> Column:
    """For each match, by start: line and column from 1, word and sentence numbers from 0."""

    def one(m: Column, n: Column) -> Column:
        # without a line feed before it the column is the offset + 1, as for one at -1
        column = m["start"] - n["feed"]
        return F.struct((n["lines"] + 1).alias("lineNumber"), column.alias("columnStart"), (column + m["end"] - m["start"]).alias("columnEnd"), n["words"].alias("wordIndex"), n["marks"].alias("sentenceIndex"))

    return F.zip_with(matches, _counts(text, matches), one)


def wide_contexts(text: Column, matches: Column) -> Column:
    """For each match: fifty characters on either side and the sentence that holds it."""

    def index(t: Column) -> Column:
        return F.struct(places.chunks(t).alias("parts"), places.sentences(t, "[.!?]").alias("s"))

    def one(m: Column, ix: Column) -> Column:
        left, right = windows(m, ix["parts"], 50)
        s = ix["s"]
        whole = let(places.last_up_to(s["starts"], m["start"]), lambda a: F.when(F.get(s["starts"], a) + F.get(s["lengths"], a) >= m["end"], trim_space(F.get(s["pieces"], a))).otherwise(""))
        return F.struct(left.alias("before"), right.alias("after"), whole.alias("sentence"))

    return places.by_match(text, matches, index, one)


def suggestions(word: Column, categories: Column) -> Column:
    """A partial mask, a full mask, then what the categories suggest."""
    # Suggestions by category.
    by = {"general": ["[censored]", "[removed]", "***"], "sexual": ["[inappropriate content]", "[explicit content removed]"], "violence": ["[violent content]", "[aggressive language]"], "hate_speech": ["[hate speech removed]", "[offensive content]"]}
    n = F.length(word)
    none = F.array().cast("array<string>")
    partial = F.when(n > 3, F.array(F.concat(F.substring(word, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(word, -1, 1)))).otherwise(none)
    more = [F.when(F.array_contains(categories, k), F.array(*map(F.lit, v))).otherwise(none) for k, v in by.items()]
    return F.array_distinct(F.concat(partial, F.array(F.repeat(F.lit("*"), n)), *more))


def reason(confidence: Column, severity: Column, categories: Column) -> Column:
    given = [F.when(confidence < 0.7, "fuzzy match"), F.when(severity >= 3, "high severity"), F.when(F.array_contains(categories, "hate_speech"), "hate speech"), F.when(F.array_contains(categories, "sexual"), "sexual content"), F.when(F.array_contains(categories, "violence"), "violent content")]
    out = F.array_join(F.filter(F.array(*given), lambda x: x.isNotNull()), ", ")
    return F.when(out == "", "profanity detected").otherwise(out)


def enhance(matches: Column, text: Column) -> Column:
    """Matches, by start, with position, context, suggestions, reason and edit distance."""
    ordered = F.array_sort(matches, lambda a, b: a["start"] - b["start"])

    def one(m: Column, about: Column) -> Column:
        fields = [m[k].alias(k) for k in ("word", "match", "start", "end", "severity", "categories", "language", "confidence")]
        return F.struct(*fields, about["position"].alias("position"), about["context"].alias("context"), suggestions(m["word"], m["categories"]).alias("suggestions"), reason(m["confidence"], m["severity"], m["categories"]).alias("reason"), (F.lower(m["word"]) != F.lower(m["match"])).alias("isFuzzyMatch"), F.levenshtein(m["word"], m["match"]).alias("editDistance"), m["confidence"].alias("rawScore"))

    def body(found: Column) -> Column:
        about = F.zip_with(positions(text, found), wide_contexts(text, found), lambda p, c: F.struct(p.alias("position"), c.alias("context")))
        return F.zip_with(found, about, one)

    return let(ordered, body)


def merge(results: DataFrame, key: str) -> DataFrame:
    """One result for each key: texts joined, matches and languages put together, confidence averaged.

    A key's texts become one value of its row, so keys are conversations, pages or the like; `roll_up` serves keys
    that hold any number of documents."""
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "text", "matches")))
    numbers = [F.avg("confidence").alias("confidence"), F.max("maxSeverity").alias("maxSeverity"), F.sum(F.size("matches")).cast("int").alias("totalMatches"), F.count("*").alias("results")]
    out = results.groupBy(key).agg(ordered.alias("r"), F.array_distinct(F.flatten(F.collect_set("languages"))).alias("languages"), *numbers)
    pick = lambda f: F.transform("r", lambda x: x[f])
    return out.select(key, F.array_join(pick("text"), " ").alias("text"), F.flatten(pick("matches")).alias("matches"), "languages", "confidence", "maxSeverity", "totalMatches", "results")


def roll_up(results: DataFrame, key: str) -> DataFrame:
    """The numbers of a merge for keys of any size: only combined sums, a maximum and a mean."""
    return results.groupBy(key).agg(F.count("*").alias("results"), F.sum(F.size("matches")).alias("totalMatches"), F.max("maxSeverity").alias("maxSeverity"), F.avg("confidence").alias("confidence"))


def comparison(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Differences of two results and their summary; each with totalMatches, maxSeverity, confidence."""
    n, s, c = b["totalMatches"] - a["totalMatches"], b["maxSeverity"] - a["maxSeverity"], b["confidence"] - a["confidence"]
    parts = F.concat_ws(
        " ",
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" more matches found."))).when(n < 0, F.concat(F.abs(n).cast("string"), F.lit(" fewer matches found."))),
        F.when(s > 0, "Higher severity detected.").when(s < 0, "Lower severity detected."),
        F.when(F.abs(c) > 0.1, F.concat(F.lit("Confidence "), F.when(c > 0, "increased").otherwise("decreased"), F.lit(" by "), F.format_string("%.2f", F.abs(c)), F.lit("."))),
    )
    return {"matchesDiff": n, "severityDiff": s, "confidenceDiff": c, "summary": F.when(parts == "", "Results are similar.").otherwise(parts)}


def to_json(include_text: bool = False, pretty: bool = False) -> Column:
    """A result row as JSON (columns matches, languages, confidence, maxSeverity, and the texts if asked)."""
    found = F.transform("matches", lambda m: F.struct(m["word"].alias("word"), m["severity"].alias("severity"), m["categories"].alias("categories"), m["confidence"].alias("confidence"), F.struct(m["start"].alias("start"), m["end"].alias("end")).alias("position")))
    fields = [(F.size("matches") > 0).alias("hasProfanity"), F.size("matches").alias("totalMatches"), F.col("maxSeverity"), F.col("languages").alias("detectedLanguages"), F.col("confidence"), found.alias("matches")]
    if include_text:
        fields += [F.col("text").alias("originalText"), F.col("filteredText")]
    return F.to_json(F.struct(*fields), {"pretty": "true"} if pretty else {})
