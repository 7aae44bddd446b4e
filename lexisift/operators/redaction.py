"""Redaction of spans: censor, remove, replace or only detect, as a fold over ascending disjoint spans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from . import places

# Default replacements.
BY_CATEGORY = {
    "general": ["inappropriate", "unsuitable"],
    "sexual": ["[inappropriate content]", "[explicit content]"],
    "violence": ["[violent content]", "[aggressive language]"],
    "hate_speech": ["[offensive content]", "[inappropriate language]"],
    "discrimination": ["[discriminatory content]", "[offensive language]"],
    "substance_abuse": ["[substance reference]", "[inappropriate content]"],
    "religious": ["[religious content]", "[potentially offensive]"],
    "political": ["[political content]", "[controversial content]"],
}
BY_SEVERITY = {1: "inappropriate", 2: "offensive", 3: "[removed]", 4: "[content removed]"}
MODES = ("censor", "remove", "replace", "detect_only")


@dataclass(frozen=True)
class Redaction:
    mode: str = "censor"
    char: str = "*"
    structure: bool = True
    custom: dict[str, str] = field(default_factory=dict)
    sentences: bool = False
    least: float = 0.0
    gradual: bool = False
    categories: dict[str, list[str]] = field(default_factory=lambda: dict(BY_CATEGORY))

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


#: The detector's own settings, and the three levels of safety.
DETECTOR = Redaction(gradual=True, sentences=True, least=0.5, categories={})
SAFE = {
    "strict": Redaction(mode="remove", least=0.3, structure=False),
    "moderate": Redaction(mode="censor", least=0.5, gradual=True),
    "lenient": Redaction(mode="replace", least=0.7, gradual=True),
}


def censor(word: Column, r: Redaction) -> Column:
    """Letters to the character, digits to #, the rest kept; without structure the character throughout."""
    if not r.structure:
        return F.repeat(F.lit(r.char), F.length(word))
    letters = "".join(chr(c) for c in (*range(65, 91), *range(97, 123)))
    return F.translate(word, letters + "0123456789", r.char * 52 + "#" * 10)


def partial(word: Column, share: float, char: str) -> Column:
    """A mask of that share in the middle."""
    n = F.length(word)
    masked = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    at = F.floor((n - masked) / 2).cast("int")
    inner = F.concat(F.substring(word, F.lit(1), at), F.repeat(F.lit(char), masked), F.substring(word, at + masked + 1, n))
    return F.when(n <= 2, F.repeat(F.lit(char), n)).otherwise(inner)


def by_intensity(word: Column, severity: Column, confidence: Column, full: Column, char: str) -> Column:
    x = severity * confidence
    return F.when(x < 1.5, partial(word, 0.3, char)).when(x < 2.5, partial(word, 0.6, char)).when(x < 3.5, partial(word, 0.8, char)).otherwise(full)


def replacement(severity: Column, categories: Column, r: Redaction) -> Column:
    """The first category that has replacements chooses by severity; else the severity's own word."""
    fallback = F.when(severity == 1, BY_SEVERITY[1]).when(severity == 2, BY_SEVERITY[2]).when(severity == 3, BY_SEVERITY[3]).when(severity == 4, BY_SEVERITY[4]).otherwise("[censored]")
    known = {k: v for k, v in r.categories.items() if v}
    if not known:
        return fallback
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    first = F.get(F.filter(categories, lambda c: c.isin(list(known))), F.lit(0))
    choices = F.try_element_at(table, first)
    at = F.least(F.floor((severity - 1) * F.size(choices) / 4).cast("int"), F.size(choices) - 1)
    return F.coalesce(F.get(choices, at), fallback)


def custom(word: Column, term: Column, table: dict[str, str]) -> Column:
    """The surface, then the term, then the first pattern with * that is found; else null."""
    import re

    exact = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    out = [F.try_element_at(exact, F.lower(word)), F.try_element_at(exact, F.lower(term))]
    for pattern, new in table.items():
        if "*" in pattern:
            out.append(F.when(word.rlike("(?i)" + ".*".join(map(re.escape, pattern.split("*")))), F.lit(new)))
    return F.coalesce(*out)


def new_word(m: Column, word: Column, r: Redaction) -> Column:
    """What stands for one match."""
    if r.mode == "detect_only":
        return word
    full = {"censor": lambda: censor(word, r), "remove": lambda: F.lit(""), "replace": lambda: replacement(m["severity"], m["categories"], r)}[r.mode]()
    out = by_intensity(word, m["severity"], m["confidence"], full, r.char) if r.gradual and r.mode == "censor" else full
    return F.coalesce(custom(word, m["match"], r.custom), out) if r.custom else out


def qualifying(matches: Column, text: Column, r: Redaction) -> Column:
    """Spans sure enough and inside the text."""
    return F.filter(matches, lambda m: (m["confidence"] >= r.least) & (m["start"] >= 0) & (m["start"] < m["end"]) & (m["end"] <= F.length(text)))


def spans_replaced(text: Column, matches: Column, r: Redaction) -> Column:
    """The text with each span replaced; spans must be ascending and disjoint.

    What lies between one span and the next is cut from the text's chunks once, and all pieces are joined at the end."""

    def body(x: Column) -> Column:
        parts, spans = x["parts"], x["spans"]

        def piece(m: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
            return F.concat(places.cut(parts, at, m["start"]), new_word(m, places.cut(parts, m["start"], m["end"]), r))

        return F.concat(F.array_join(F.transform(spans, piece), ""), places.cut(parts, F.get(spans, F.size(spans) - 1)["end"], F.length(text)))

    return F.when(F.size(matches) > 0, let(F.struct(places.chunks(text).alias("parts"), matches.alias("spans")), body)).otherwise(text)


def tidy_sentences(c: Column, at_start: Column) -> Column:
    """Spacing around punctuation and capitals after sentence ends; the first letter too if a span began the text."""
    c = F.regexp_replace(c, r"\s{2,}", " ")
    c = F.regexp_replace(c, r"([^\s,.;:!?])\s+([,.;:!?])", "$1$2")
    c = F.regexp_replace(c, r"([,.;:!?])([a-zA-Z])", "$1 $2")
    # an upper-case letter after a sentence's end: pieces up to each such letter, their last letter raised
    spaced = F.regexp_replace(c, r"([.!?])\s*([a-z])", "$1 $2")
    pieces = F.regexp_extract_all(spaced, F.lit(r"(?s).*?(?:[.!?] [a-z]|$)"), F.lit(0))
    raised = lambda p: F.when(p.rlike(r"(?s)[.!?] [a-z]$"), F.concat(F.left(p, F.length(p) - 1), F.upper(F.right(p, F.lit(1))))).otherwise(p)
    c = F.trim(F.array_join(F.transform(pieces, raised), ""))
    return F.when(at_start & c.rlike("^[a-z]"), F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)


def redact(text: Column, matches: Column, r: Redaction = Redaction()) -> Column:
    """The redacted text."""
    ok = qualifying(matches, text, r)
    if r.mode == "detect_only":
        return text
    out = spans_replaced(text, ok, r)
    if r.sentences:
        out = F.when(F.size(ok) > 0, tidy_sentences(out, F.exists(ok, lambda m: m["start"] == 0))).otherwise(text)
    return out


def details(text: Column, matches: Column, r: Redaction = Redaction()) -> Column:
    """What was done to each span: original, replacement, place, confidence, method."""
    method = "custom" if r.mode == "detect_only" else r.mode

    def one(m: Column) -> Column:
        word = F.substring(text, m["start"] + 1, m["end"] - m["start"])
        how = F.when(custom(word, m["match"], r.custom).isNotNull(), "custom").otherwise(method) if r.custom and r.mode != "detect_only" else F.lit(method)
        return F.struct(word.alias("originalWord"), new_word(m, word, r).alias("replacement"), m["start"].alias("start"), m["end"].alias("end"), m["confidence"].alias("confidence"), how.alias("method"))

    return F.transform(qualifying(matches, text, r), one)


def safe(level: str = "moderate") -> Redaction:
    return SAFE[level]


def with_custom(r: Redaction, table: dict[str, str], drop: list[str] = ()) -> Redaction:
    """The settings with custom replacements added and dropped."""
    return replace(r, custom={k: v for k, v in {**r.custom, **{a.lower(): b for a, b in table.items()}}.items() if k not in drop})


def with_category(r: Redaction, category: str, words: list[str]) -> Redaction:
    return replace(r, categories={**r.categories, category: list(words)})
