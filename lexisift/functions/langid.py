"""Rule-based language identification: scripts, letter frequencies, marker words and patterns, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, process, split_words

# Scripts, letter rates in percent, marker words, patterns and weights.
SCRIPT_CLASSES = {
    "zh": r"[\x{4e00}-\x{9fff}]",
    "ja": r"[\x{3040}-\x{30ff}]",
    "ar": r"[\x{0600}-\x{06ff}]",
    "ru": r"[\x{0400}-\x{04ff}]",
    "hi": r"[\x{0900}-\x{097f}]",
    "ko": r"[\x{ac00}-\x{d7af}]",
}
#: Letter rates in percent; tables for more languages are a parameter of the functions below, in this form.
RATES = {
    "en": {"e": 12.7, "t": 9.1, "a": 8.2, "o": 7.5, "i": 7.0, "n": 6.7, "s": 6.3, "h": 6.1, "r": 6.0, "d": 4.3, "l": 4.0, "c": 2.8, "u": 2.8, "m": 2.4, "w": 2.4, "f": 2.2, "g": 2.0, "y": 2.0, "p": 1.9, "b": 1.3, "v": 1.0, "k": 0.8, "j": 0.15, "x": 0.15, "q": 0.1, "z": 0.07},
    "es": {"e": 13.7, "a": 12.5, "o": 8.7, "s": 8.0, "r": 6.9, "n": 6.7, "i": 6.2, "l": 4.97, "d": 5.9, "t": 4.6, "c": 4.7, "u": 3.9, "m": 3.2, "p": 2.5, "b": 1.4, "g": 1.0, "v": 0.9, "y": 0.9, "q": 0.9, "h": 0.7, "f": 0.7, "z": 0.5, "j": 0.4, "ñ": 0.3, "x": 0.2, "k": 0.1},
    "fr": {"e": 17.3, "s": 7.9, "a": 7.6, "i": 7.5, "t": 7.2, "n": 7.1, "r": 6.6, "u": 6.3, "l": 5.5, "o": 5.3, "d": 3.7, "c": 3.3, "p": 3.0, "m": 3.0, "é": 1.9, "f": 1.1, "b": 0.9, "v": 1.6, "h": 0.7, "g": 0.9, "y": 0.3, "q": 1.4, "j": 0.5, "x": 0.4, "à": 0.5, "è": 0.3, "z": 0.1},
    "de": {"e": 17.4, "n": 9.8, "i": 7.6, "s": 7.3, "r": 7.0, "a": 6.5, "t": 6.2, "d": 5.1, "h": 4.8, "u": 4.4, "l": 3.4, "c": 3.1, "g": 3.0, "m": 2.5, "o": 2.5, "b": 1.9, "w": 1.9, "f": 1.7, "k": 1.2, "z": 1.1, "p": 0.8, "v": 0.7, "ü": 0.7, "ä": 0.5, "ö": 0.3, "j": 0.3, "y": 0.04},
}
# fmt: off
MARKERS = {
    "en": ["the", "and", "that", "have", "for", "not", "with", "you", "this", "but", "his", "from", "they", "are", "be", "an", "will", "would", "could", "should", "am", "is", "writing", "some", "english", "language"],
    "es": ["que", "de", "el", "la", "en", "y", "un", "es", "se", "no", "te", "lo", "le", "da", "su", "por", "con", "para", "como", "muy", "mundo", "hola", "gato", "está", "sobre", "mesa", "gusta", "mucho", "comida", "española", "buenos", "días", "cómo", "usted", "hoy"],
    "fr": ["le", "de", "et", "être", "un", "il", "avoir", "ne", "je", "son", "que", "se", "qui", "ce", "dans", "vous", "mon", "ma", "mes", "tout", "bonjour", "monde", "suis", "très", "content", "voir", "france", "beau", "pays", "comment", "allez-vous", "aujourd'hui"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "dem", "nicht", "ein", "eine", "einer", "einen", "hallo", "welt", "bin", "sehr", "glücklich", "heute", "deutschland", "schönes", "land", "wie", "geht", "ihnen"],
    "it": ["che", "di", "il", "un", "a", "è", "per", "una", "in", "del", "la", "non", "le", "si", "da", "questo", "quello", "quella", "quelli", "quelle"],
    "pt": ["que", "de", "o", "a", "e", "do", "da", "em", "um", "para", "é", "com", "não", "uma", "os", "como", "por", "mas", "muito", "qual"],
    "nl": ["de", "het", "een", "van", "in", "is", "op", "dat", "met", "voor", "als", "zijn", "er", "maar", "om", "niet", "wat", "hoe", "waar", "wie"],
}
#: Whole words, word endings, more whole words, and single letters that speak for a language.
WORDS = {
    "en": ["the", "and", "that", "have", "for", "not", "with", "you", "this", "but", "his", "from", "they", "are", "be", "am", "is"],
    "es": ["que", "de", "el", "la", "en", "y", "un", "es", "se", "no", "te", "lo", "le", "da", "su", "por", "con", "para", "como", "muy"],
    "fr": ["le", "de", "et", "être", "un", "il", "avoir", "ne", "je", "son", "que", "se", "qui", "ce", "dans", "vous", "mon", "ma", "mes", "tout"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "dem", "nicht", "ein", "eine"],
    "it": ["che", "di", "il", "un", "a", "è", "per", "una", "in", "del", "la", "non", "le", "si", "da"],
    "pt": ["que", "de", "o", "a", "e", "do", "da", "em", "um", "para", "é", "com", "não", "uma", "os"],
    "nl": ["de", "het", "een", "van", "in", "is", "op", "dat", "met", "voor", "als", "zijn", "er", "maar", "om"],
}
ENDINGS = {
    "en": ["ing", "ed", "ly"],
    "es": ["ción", "mente"],
    "fr": ["ment", "tion"],
    "de": ["ung", "lich"],
    "it": ["zione", "mente"],
    "pt": ["ção", "mente"],
    "nl": ["lijk", "heid"],
}
MORE_WORDS = {
    "es": ["está", "gato", "mesa", "gusta", "comida", "buenos", "días", "cómo", "está", "usted", "hoy"],
    "fr": ["suis", "très", "content", "voir", "france", "beau", "pays", "comment", "allez-vous", "aujourd'hui"],
    "de": ["bin", "sehr", "glücklich", "heute", "deutschland", "schönes", "land", "wie", "geht", "ihnen"],
}
# fmt: on
LETTERS = {"es": "áéíóúüñ¿¡", "fr": "àâäéèêëïîôöùûüÿç", "de": "äöüß", "it": "àáèéìíîòóùúü", "pt": "áàâãéêíóôõúç"}
PATTERN_WEIGHT, RATE_WEIGHT, SCRIPT_WEIGHT, LEAST, FALLBACK = 0.65, 0.10, 0.25, 0.08, 0.11
#: A word border that knows only ASCII word characters.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_WORD = "[A-Za-z0-9_]"


def prepared(c: Column) -> Column:
    """What the engine gets: the processor's output with punctuation and space kept."""
    return process(c, keep_space=True, punctuation=False)


def _sampled(x: Column) -> Column:
    words = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s\x{feff}]", " ")
    return F.trim(F.regexp_replace(words, SPACE + "+", " "))


def sample(c: Column, most: int = 200) -> Column:
    """The first characters of a text's words in lower case; a text's beginning gives them, unless it holds too few of them."""
    # one character more than wanted: then no blank at the cut is one at the end, and no letter's case depends on what follows
    short = lambda x: let(_sampled(F.substring(x, 1, 4 * most)), lambda s: F.when(F.length(s) > most + 1, s).otherwise(_sampled(x)))
    return F.substring(let(c, short), 1, most)


def _enough(c: Column, most: int = 200) -> Column:
    """`prepared`, or its beginning where that has the whole sample and no script is counted in the rest.

    So it is where each character is processed by itself, whatever stands beside it, and makes none of a counted script: those before
    U+0300, and some of punctuation, currencies, arrows, shapes and emoji."""
    apart = r"[\x{300}-\x{10ffff}&&[^\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{2122}\x{2190}-\x{21ff}\x{2500}-\x{27bf}\x{1f300}-\x{1faff}]]"
    short = let(prepared(F.substring(c, 1, 8 * most)), lambda x: F.when(F.length(_sampled(F.substring(x, 1, 4 * most))) > most + 1, x))
    return F.coalesce(F.when((F.length(c) > 8 * most) & ~c.rlike(apart), short), prepared(c))


def script_counts(c: Column) -> Column:
    """The characters of each script, and `n`, those that are no white space, worked out where a text has any of a script."""
    any_ = r"[\x{0400}-\x{d7af}&&[" + "".join(p[1:-1] for p in SCRIPT_CLASSES.values()) + "]]"
    count = [F.length(F.regexp_replace(c, SPACE + "+", "")).alias("n"), *[F.regexp_count(c, F.lit(p)).alias(k) for k, p in SCRIPT_CLASSES.items()]]
    return F.when(c.rlike(any_), F.struct(*count)).when(c.isNotNull(), F.struct(*[F.lit(0).alias(k) for k in ("n", *SCRIPT_CLASSES)]))


def script_confidence(c: Column, counts: Column | None = None) -> dict[str, Column]:
    """0 to 0.9 by the share of a script's characters; Han beside kana counts less.  `counts`: script_counts, where it is at hand."""
    counts = script_counts(c) if counts is None else counts
    n, count = counts["n"], {k: counts[k] for k in SCRIPT_CLASSES}
    share = lambda k, f: F.when(n > 0, F.least(count[k] / n * f, F.lit(1.0))).otherwise(0.0)
    cut = lambda x: F.when(x > 0.05, x * 0.9).otherwise(0.0)
    both = (count["zh"] > 0) & (count["ja"] > 0)
    out = {k: F.when(both, 0.0).otherwise(cut(share(k, 4))) for k in SCRIPT_CLASSES}
    out["ja"] = F.when(both, share("ja", 4) * 0.9).otherwise(cut(share("ja", 4)))
    out["zh"] = F.when(both, share("zh", 2) * 0.5).otherwise(cut(share("zh", 4)))
    return out


def _letter_counts(c: Column, letters: list[str]) -> Column:
    """(n, counts): a text's length, and how often each of the letters stands in it, in their order."""

    def of(x: Column) -> Column:
        counts = F.transform(F.array(*map(F.lit, letters)).cast("array<string>"), lambda k: F.length(x) - F.length(F.replace(x, k, F.lit(""))))
        return F.struct(F.length(x).alias("n"), counts.alias("counts"))

    return let(c, of)  # named many times: worked out anew for each letter, it would take most of a text's time


def _rates_alike(counted: Column, letters: list[str], table: dict[str, float]) -> Column:
    n, counts = counted["n"], counted["counts"]
    expected = F.array(*[F.struct(F.lit(letters.index(k)).alias("i"), F.lit(v).alias("r")) for k, v in table.items()])

    def term(a: Column, e: Column) -> Column:
        return a + F.greatest(F.lit(0.0), e["r"] - F.abs(F.get(counts, e["i"]) / n * 100 - e["r"]))

    return F.when(n > 0, F.aggregate(expected, F.lit(0.0), term) / sum(table.values())).otherwise(0.0)


def rate_similarity(plain: Column, table: dict[str, float]) -> Column:
    """How much of a language's letter rates a text without white space matches."""
    return let(_letter_counts(plain, list(table)), lambda x: _rates_alike(x, list(table), table))


def rate_confidences(c: Column, rates: dict[str, dict[str, float]] = RATES) -> Column:
    """Similarity of a text's letter rates to a language's, times 0.4, where above 0.15: a field a language, of letters counted once."""
    letters = list(dict.fromkeys(k for table in rates.values() for k in table))

    def judged(x: Column) -> Column:
        of = {lang: let(_rates_alike(x, letters, table), lambda s: F.when(s > 0.15, s * 0.4).otherwise(0.0)) for lang, table in rates.items()}
        return F.struct(x["n"].alias("n"), *[v.alias(k) for k, v in of.items()])

    return let(_letter_counts(F.regexp_replace(c, SPACE, ""), letters), judged)


def _alternatives(words: list[str]) -> str:
    return _EDGE + "(?:" + "|".join(dict.fromkeys(words)) + ")" + _EDGE


def patterns_of(lang: str) -> list[str]:
    out = [_alternatives(WORDS[lang])] + [_EDGE + f"[A-Za-z0-9_]+{e}" + _EDGE for e in ENDINGS[lang]]
    if lang in MORE_WORDS:
        out.append(_alternatives(MORE_WORDS[lang]))
    if lang in LETTERS:
        out.append(f"[{LETTERS[lang]}]")
    return out


def _bordered(words: list[str]) -> str:
    """`_alternatives`, of a border's two forms only the one that a word's first or last character leaves."""
    inside = lambda ch: ch.isascii() and (ch.isalnum() or ch == "_")
    ends = lambda w: w + ("(?!" if inside(w[-1]) else "(?=") + _WORD + ")"
    every = list(dict.fromkeys(words))
    begin = {"(?<!": [w for w in every if inside(w[0])], "(?<=": [w for w in every if not inside(w[0])]}
    return "(?:" + "|".join(f"{edge}{_WORD})(?:" + "|".join(map(ends, ws)) + ")" for edge, ws in begin.items() if ws) + ")"


def _counted(lang: str) -> list[str]:
    """Patterns with the hits of `patterns_of` in all.  No word has two of a language's endings, so these share a pattern."""
    out = [_bordered(WORDS[lang]), f"(?<!{_WORD}){_WORD}+(?:{'|'.join(ENDINGS[lang])})(?!{_WORD})"]
    if lang in MORE_WORDS:
        out.append(_bordered(MORE_WORDS[lang]))
    return [*out, f"[{LETTERS[lang]}]"] if lang in LETTERS else out


def _share(marks: Column, hits: Column, words: Column) -> Column:
    n = F.greatest(words, F.lit(1))
    return marks / n * 0.7 + hits / n * 0.3


def marker_score(c: Column, lang: str) -> Column:
    """0.7 of the share of marker words and 0.3 of pattern hits for each word."""
    marks = list(dict.fromkeys(MARKERS[lang]))
    hits = sum((F.regexp_count(c, F.lit("(?i)" + p)) for p in _counted(lang)), F.lit(0))
    return let(split_words(c), lambda words: _share(F.size(F.filter(words, lambda w: w.isin(marks))), hits, F.size(words)))


def marker_scores(c: Column) -> Column:
    """marker_score of every language, a field each.

    Between blanks alone, ASCII words are what the patterns' borders leave: such a text is cut once, and its few words that any
    language knows are looked up for each.  Other texts are searched by the patterns."""
    every = lambda *lists: list(dict.fromkeys(w for x in lists for ws in x.values() for w in ws))
    size = lambda words, test: F.size(F.filter(words, test))
    ended = lambda endings: f"{_WORD}(?:{'|'.join(endings)})$"

    def looked_up(x: Column) -> Column:
        def of(lang: str) -> Column:
            hits = size(x["known"], lambda w: w.isin(WORDS[lang])) + size(x["ended"], lambda w: w.rlike(ended(ENDINGS[lang])))
            if lang in MORE_WORDS:
                hits = hits + size(x["known"], lambda w: w.isin(MORE_WORDS[lang]))
            return _share(size(x["marks"], lambda w: w.isin(MARKERS[lang])), hits, x["n"])

        return F.struct(*[of(lang).alias(lang) for lang in MARKERS])

    def cut(words: Column) -> Column:
        lower = F.transform(words, F.lower)
        marks, known = F.filter(words, lambda w: w.isin(every(MARKERS))), F.filter(lower, lambda w: w.isin(every(WORDS, MORE_WORDS)))
        return F.struct(F.size(words).alias("n"), marks.alias("marks"), known.alias("known"), F.filter(lower, lambda w: w.rlike(ended(every(ENDINGS)))).alias("ended"))

    quick = let(let(F.filter(F.split(c, " "), lambda w: w != ""), cut), looked_up)
    return F.when(c.rlike("[^A-Za-z0-9_ ]"), F.struct(*[marker_score(c, lang).alias(lang) for lang in MARKERS])).otherwise(quick)


def pattern_confidences(c: Column) -> Column:
    """What a text's marker words and patterns say for a language, a field each."""
    sure = lambda s: F.when(s > 0.02, F.least(s * 2.8, F.lit(1.0))).otherwise(0.0)
    return let(marker_scores(c), lambda x: F.struct(*[sure(x[lang]).alias(lang) for lang in MARKERS]))


def detect(c: Column, rates: dict[str, dict[str, float]] = RATES) -> Column:
    """At most three (language, confidence, sample), the surest first; en at 0.11 where nothing is sure."""
    fallback = F.array(F.struct(F.lit("en").alias("language"), F.lit(FALLBACK).alias("confidence"), F.lit("").alias("sample")))

    def combined(e: Column) -> Column:
        x = F.least(e["p"] * PATTERN_WEIGHT + e["r"] * RATE_WEIGHT + e["s"] * SCRIPT_WEIGHT, F.lit(1.0))
        lifted = let(F.when(e["s"] > 0, F.least(x * 8, F.lit(1.0))).otherwise(x), lambda y: F.when((y > 0.5) & (y < 0.8), F.least(y * 1.1, F.lit(1.0))).otherwise(y))
        return F.struct(lifted.alias("c"), e["k"].alias("k"), e["language"].alias("language"), e["s"].alias("s"))

    def judge(engine: Column) -> Column:
        def with_sample(both: Column) -> Column:
            part = both["part"]
            script = script_confidence(engine, both["counts"])
            rate, pattern = {k: both["rate"][k] for k in rates}, {k: both["pattern"][k] for k in MARKERS}
            names = list(dict.fromkeys([*pattern, *rate, *script]))
            got = lambda d, x: d.get(x, F.lit(0.0))
            raw = F.array(*[F.struct(got(pattern, x).alias("p"), got(rate, x).alias("r"), got(script, x).alias("s"), F.lit(-k).alias("k"), F.lit(x).alias("language")) for k, x in enumerate(names)])

            def choose(all_: Column) -> Column:
                best = F.slice(F.sort_array(F.filter(all_, lambda e: e["c"] > LEAST), False), 1, 3)
                strong = F.exists(all_, lambda e: e["s"] > 0.6)
                named = F.transform(best, lambda e: F.struct(e["language"].alias("language"), e["c"].alias("confidence"), F.substring(part, 1, 50).alias("sample")))
                return let(named, lambda found: F.when((~strong & (F.length(engine) < 10)) | (F.size(found) == 0), fallback).otherwise(found))

            return let(F.transform(raw, combined), choose)

        first = F.struct(sample(engine).alias("part"), script_counts(engine).alias("counts"))
        said = lambda p: [rate_confidences(p, rates).alias("rate"), pattern_confidences(p).alias("pattern")]
        return let(let(first, lambda x: F.struct(x["part"].alias("part"), x["counts"].alias("counts"), *said(x["part"]))), with_sample)

    return F.when(_blank(c), fallback).otherwise(let(_enough(c), judge))


def _blank(c: Column) -> Column:
    """Null, or white space alone: the first other character ends the search."""
    return F.coalesce(~c.rlike("[^" + SPACE[1:]), F.lit(True))


def detect_sync(c: Column) -> Column:
    """`detect`, with a blank text at the confidence of the one-text form, 0.1."""
    return F.when(_blank(c), F.array(F.struct(F.lit("en").alias("language"), F.lit(0.1).alias("confidence"), F.lit("").alias("sample")))).otherwise(detect(c))


def primary(found: Column) -> Column:
    return F.coalesce(F.get(found, F.lit(0))["language"], F.lit("en"))


def mixed(found: Column, threshold: float = 0.3) -> Column:
    return (F.size(found) > 1) & (F.get(found, F.lit(1))["confidence"] > threshold)


def confidence_of(found: Column, language: str) -> Column:
    return F.coalesce(F.get(F.filter(found, lambda e: e["language"] == language), F.lit(0))["confidence"], F.lit(0.0))


def multiple_scripts(c: Column) -> Column:
    """More than one of seven scripts."""
    flags = [c.rlike(p) for p in SCRIPT_CLASSES.values()] + [c.rlike("[a-zA-Z]")]
    return sum((f.cast("int") for f in flags), F.lit(0)) > 1


def languages_for(c: Column, found: Column) -> Column:
    """The languages to match in: those above 0.1 in texts of several scripts, else above 0.5; en if none."""
    threshold = F.when(multiple_scripts(c), 0.1).otherwise(0.5)
    sure = F.transform(F.filter(found, lambda e: e["confidence"] > threshold), lambda e: e["language"])
    return let(sure, lambda ok: F.when(F.size(ok) == 0, F.array(F.lit("en"))).otherwise(ok))
