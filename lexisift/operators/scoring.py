"""Context of a match, its confidence, and overlap resolution; works on columns of rows or of array elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE, let, round2
from . import places

# Words and limits of the context rules.
NEGATING = ["not", "don't", "doesn't", "never", "hardly", "barely"]
TECHNICAL = ["medical", "technical", "definition", "terminology", "glossary", "dictionary", "research", "study", "analysis", "academic"]
SURROUNDING = ["damn", "hell", "crap", "shit", "fuck", "ass", "bitch"]
WINDOW, LEAST_CONFIDENCE = 25, 0.3


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def windows(m: Column, parts: Column, width: int = WINDOW) -> tuple[Column, Column]:
    """What stands before and after a match, without space at the ends."""
    return trim_space(places.cut(parts, F.greatest(F.lit(0), m["start"] - width), m["start"])), trim_space(places.cut(parts, m["end"], m["end"] + width))


def contexts(text: Column, matches: Column, sentence: bool = False) -> Column:
    """For each match: `m`, where its sentence starts (lo), the sentence's length without space around it (size), the windows before and
    after (left, right), and the sentence itself if asked for.

    A sentence starts behind the last period before the match and ends at the next period that doesn't follow the match at once."""

    def index(t: Column) -> Column:
        return F.struct(places.chunks(t).alias("parts"), places.sentences(t).alias("s"))

    def one(m: Column, ix: Column) -> Column:
        s = ix["s"]
        first, last = places.last_up_to(s["starts"], m["start"]), places.last_up_to(s["starts"], m["end"] + 1)

        def body(at: Column) -> Column:
            a, b = at["a"], at["b"]
            lo, hi = F.get(s["starts"], a), F.get(s["starts"], b) + F.get(s["lengths"], b)
            size = F.greatest(F.lit(0), hi - F.get(s["right"], b) - lo - F.get(s["left"], a))
            left, right = windows(m, ix["parts"])
            whole = [trim_space(places.cut(ix["parts"], lo, hi)).alias("sentence")] if sentence else []
            return F.struct(m.alias("m"), lo.alias("lo"), size.alias("size"), left.alias("left"), right.alias("right"), *whole)

        return let(F.struct(first.alias("a"), last.alias("b")), body)

    return places.by_match(text, matches, index, one)


def negated(left: Column) -> Column:
    """A negating word among the last three before the match."""
    words = F.split(F.regexp_replace(F.lower(left), SPACE + "+", " "), " ")
    return F.arrays_overlap(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), F.array(*map(F.lit, NEGATING)))


def technical(left: Column, right: Column) -> Column:
    return F.lower(F.concat(left, F.lit(" "), right)).rlike("|".join(TECHNICAL))


def quoted(left: Column, right: Column) -> Column:
    return left.rlike("[\"']") & right.rlike("[\"']")


def surrounded(left: Column, right: Column) -> Column:
    around = F.concat(left, F.lit(" "), right)
    words = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(SURROUNDING) + r")(?![A-Za-z0-9_])"
    return around.rlike(words) | around.rlike(r"[!@#$%^&*]{2,}") | around.rlike("[A-Z]{3,}")


def clamp(c: Column, lo: float = 0.1, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def context_confidence(context: Column) -> Column:
    """Short sentences and places near their ends count less, strong words around count more."""

    def body(a: Column) -> Column:
        place = a["m"]["start"] - a["lo"]
        c = F.when(a["size"] < 10, 0.8).otherwise(1.0)
        c = c * F.when((place < 5) | (place > a["size"] - 10), 0.9).otherwise(1.0)
        return clamp(c * F.when(surrounded(a["left"], a["right"]), 1.2).otherwise(1.0))

    return let(context, body)


def final_confidence(confidence: Column, word: Column, term: Column, severity: Column) -> Column:
    c = confidence * F.when(F.lower(word) == F.lower(term), 1.1).otherwise(1.0)
    c = c * F.when(F.length(term) <= 3, 0.8).otherwise(1.0)
    c = c * F.when(severity >= 3, 1.1).otherwise(1.0)
    c = c * F.when(word.rlike("[0-9]"), 0.7).otherwise(1.0)
    return round2(clamp(c))


def resolve_overlaps(matches: Column) -> Column:
    """A sweep by start, the more severe first: a span that overlaps the last kept one replaces it if it is
    more severe, or as severe and surer.  Ties: fewer edits, longer, then term and language."""

    def ordered(found: Column) -> Column:
        key = lambda m: [x.alias(f"k{i}") for i, x in enumerate((m["start"], -m["severity"], m["distance"], -m["end"], m["match"], m["language"]))]
        return F.transform(F.array_sort(F.transform(found, lambda m: F.struct(*key(m), m.alias("m")))), lambda x: x["m"])

    def step(kept: Column, m: Column) -> Column:
        last = F.element_at(kept, -1)
        better = (m["severity"] > last["severity"]) | ((m["severity"] == last["severity"]) & (m["confidence"] > last["confidence"]))
        overlap = m["start"] < last["end"]
        return F.when((F.size(kept) == 0) | ~overlap, F.concat(kept, F.array(m))).when(better, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(m))).otherwise(kept)

    return let(matches, lambda found: F.aggregate(ordered(found), F.slice(found, 1, 0), step))


def budget(candidates: Column, languages: Column, most: int, fuzzy_below: int) -> Column:
    """At most so many candidates of a text, spent language by language in the languages' order.

    A language's exact ones come first, by end, the longer first; its fuzzy ones follow, word by word in the order of their first places,
    the nearest base words first, each at all its places; they are left out where `fuzzy_below` or more were taken before the language."""
    none = F.slice(candidates, 1, 0)

    def by(found: Column, key: Callable[[Column], list[Column]]) -> Column:
        return F.transform(F.array_sort(F.transform(found, lambda m: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key(m))], m.alias("m")))), lambda x: x["m"])

    def step(kept: Column, code: Column) -> Column:
        mine = F.filter(candidates, lambda m: m["language"] == code)
        exact = F.slice(by(F.filter(mine, lambda m: m["distance"] == 0), lambda m: [m["end"], m["start"], m["match"]]), F.lit(1), F.greatest(F.lit(0), most - F.size(kept)))

        def then(found: Column) -> Column:
            near = F.filter(mine, lambda m: m["distance"] > 0)
            first = lambda m: F.array_min(F.transform(F.filter(near, lambda x: x["word"] == m["word"]), lambda x: x["start"]))
            fuzzy = F.slice(by(near, lambda m: [first(m), m["distance"], m["match"], m["start"]]), F.lit(1), F.greatest(F.lit(0), most - F.size(found)))
            return F.when(F.size(kept) < fuzzy_below, F.concat(found, fuzzy)).otherwise(found)

        return let(F.concat(kept, exact), then)

    return F.aggregate(languages, none, step)


def first_per_start(matches: Column) -> Column:
    """The shortest span of each start."""
    ordered = F.array_sort(matches, lambda a, b: F.when(F.struct(a["start"], a["end"]) < F.struct(b["start"], b["end"]), -1).when(F.struct(a["start"], a["end"]) > F.struct(b["start"], b["end"]), 1).otherwise(0))
    return F.aggregate(ordered, F.slice(matches, 1, 0), lambda kept, m: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["start"] == m["start"]), kept).otherwise(F.concat(kept, F.array(m))))


def document_confidence(matches: Column, text: Column) -> Column:
    """1 without matches; else their average, weighted by the text's length and their number."""
    n = F.size(matches)
    mean = F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["confidence"]) / n
    c = mean * (0.7 + F.least(F.lit(1.0), F.length(text) / 100) * 0.2 + F.least(F.lit(1.0), n / 5) * 0.1)
    return F.when(n == 0, F.lit(1.0)).otherwise(clamp(c))


def in_context(matches: Column, text: Column) -> Column:
    """The context filter over an array of matches: negated and technical ones go, quoted ones count less."""

    def weigh(a: Column) -> Column:
        gone = negated(a["left"]) | technical(a["left"], a["right"])
        trust = a["m"]["confidence"] * F.when(quoted(a["left"], a["right"]), 0.7).otherwise(1.0) * context_confidence(a)
        return a["m"].withField("confidence", F.when(gone, F.lit(-1.0)).otherwise(trust))

    return F.filter(F.transform(contexts(text, matches), weigh), lambda m: m["confidence"] >= LEAST_CONFIDENCE)
