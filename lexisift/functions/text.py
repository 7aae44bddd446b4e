"""Scalar text functions as Column expressions: case, space, accents, punctuation, words, distances."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and word lists whose results must be the same everywhere.
# A class's parts are tried one by one for each character: those beyond ASCII stand behind one range, so that most characters meet few.
SPACE = r"[\s[\x{a0}-\x{feff}&&[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
PUNCTUATION = r"[\p{Punct}[\x{a1}-\x{2e7f}&&[\x{a1}-\x{bf}\x{2000}-\x{206f}\x{2e00}-\x{2e7f}]]]"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"
BIDI = r"[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{061c}]"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{1F3FB}-\x{1F3FF}]"
)
RTL = r"[\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}\x{fb1d}-\x{fb4f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
SCRIPTS = {
    "hasAscii": r"[\x{20}-\x{7e}]",
    "hasLatin": r"[\x{80}-\x{ff}]",
    "hasExtendedLatin": r"[\x{100}-\x{24f}]",
    "hasCyrillic": r"[\x{400}-\x{4ff}]",
    "hasArabic": r"[\x{600}-\x{6ff}]",
    "hasHebrew": r"[\x{590}-\x{5ff}]",
    "hasCJK": r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]",
    "hasEmoji": EMOJI,
}
CONTRACTIONS = {
    "don't": "do not",
    "doesn't": "does not",
    "didn't": "did not",
    "won't": "will not",
    "can't": "cannot",
    "isn't": "is not",
    "aren't": "are not",
    "wasn't": "was not",
    "weren't": "were not",
    "haven't": "have not",
    "hasn't": "has not",
    "hadn't": "had not",
    "wouldn't": "would not",
    "shouldn't": "should not",
    "couldn't": "could not",
}
DIGIT_LETTERS = ("0134578", "oieastb")
SUBSTITUTIONS = {"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7", "b": "8"}
LANGUAGE_FOLDS = {
    "en": {**dict(zip("çñáàâäãåéèêëíìîïóòôöõúùûüýÿ", "cnaaaaaaeeeeiiiiooooouuuuyy", strict=True))},
    "fr": {"œ": "oe", "æ": "ae", "ß": "ss"},
    "de": {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"},
    "es": {"ñ": "n", "ç": "c"},
    "pt": {"ã": "a", "õ": "o", "ç": "c"},
    "it": {"ç": "c"},
}


def _accents() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character and marks, and their bases."""
    pairs = []
    for lo, hi in ((0xC0, 0x24F), (0x386, 0x3CE), (0x400, 0x4F9), (0x1E00, 0x1EFF)):
        for c in map(chr, range(lo, hi + 1)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
            if base != c and len(base) == 1:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASES = _accents()
MARKS = "".join(map(chr, range(0x300, 0x370)))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c with c worked out once, for bodies that name it many times."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip_accents(c: Column) -> Column:
    """Accents off letters of the Latin, Greek and Cyrillic alphabets; combining marks dropped."""
    return F.translate(c, ACCENTED + MARKS, BASES)


def collapse_space(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def expand_contractions(c: Column) -> Column:
    """Fifteen English contractions, wherever they stand; one pass finds the texts that have any."""

    def all_(x: Column) -> Column:
        for short, long in CONTRACTIONS.items():
            x = F.regexp_replace(x, f"(?i){short}", long)
        return x

    return F.when(c.rlike("(?i)n't"), all_(c)).otherwise(c)


def normalize(c: Column, preserve_case: bool = False, whitespace: bool = True, accents: bool = True, contractions: bool = True) -> Column:
    """The pipeline's normaliser: case, space, accents, contractions."""
    if not preserve_case:
        c = F.lower(c)
    if whitespace:
        c = collapse_space(c)
    if accents:
        c = strip_accents(c)
    return expand_contractions(c) if contractions else c


def cap_runs(c: Column, least: int = 3, keep: int = 2) -> Column:
    """Runs of one character, at least `least` long, cut to `keep`."""
    return F.regexp_replace(c, r"(?s)(.)\1{%d,}" % (least - 1), "$1" * keep)


def normalize_short(c: Column) -> Column:
    c = F.regexp_replace(collapse_space(F.lower(c)), r"""[_\-.!@#$%^&()+=\[\]{}|\\:;"'<>,?~`*]""", "")
    return cap_runs(F.translate(c, *DIGIT_LETTERS))


def normalize_long(c: Column) -> Column:
    c = F.regexp_replace(collapse_space(F.lower(c)), r"[_\-.!@#$%^&*]", "")
    for digit, letter in zip(*DIGIT_LETTERS, strict=True):
        c = F.regexp_replace(c, f"(?<![A-Za-z0-9_]){digit}(?![A-Za-z0-9_])", letter)
    return cap_runs(c, 4)


def normalize_text(c: Column) -> Column:
    """The quick normaliser: texts of at most 50 characters take the short way."""
    return F.when(F.length(c) <= 50, normalize_short(c)).otherwise(normalize_long(c))


def split_words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.regexp_replace(c, SPACE, " "), " "), lambda w: w != "")


def extract_words(c: Column) -> Column:
    """Words of ASCII word characters, longer than one."""
    return F.filter(F.transform(split_words(c), lambda w: F.regexp_replace(w, "[^A-Za-z0-9_]", "")), lambda w: F.length(w) > 1)


def extract_letters(c: Column, least: int = 2, most: int = 50) -> Column:
    """Words of ASCII letters of the processed text, by length (`least` is 1 or more)."""
    letters = F.regexp_replace(process(c, keep_space=True), f"[^a-zA-Z{SPACE[1:]}+", "")
    return F.filter(F.split(letters, SPACE + "+"), lambda w: F.length(w).between(max(1, least), most))


def word_variations(c: Column) -> Column:
    """All whole-letter substitutions, letter by letter, without repeats."""
    out = F.array(c)

    def with_others(letter: str, others: str) -> Callable[[Column], Column]:
        return lambda v: F.array(v, *[F.replace(v, F.lit(letter), F.lit(o)) for o in others])

    for letter, others in SUBSTITUTIONS.items():
        out = F.flatten(F.transform(out, with_others(letter, others)))
    return F.array_distinct(out)


def fold_language(c: Column, language: str) -> Column:
    """The letters of one language written out."""
    rules = LANGUAGE_FOLDS.get(language, {})
    one = {a: b for a, b in rules.items() if len(b) == 1}
    if one:
        c = F.translate(c, "".join(one), "".join(one.values()))
    for a, b in rules.items():
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lower_in(c: Column, language: str) -> Column:
    """Lower case with the rules of Turkish and German."""
    if language == "tr":
        return F.lower(F.translate(c, "İI", "iı"))
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss")) if language == "de" else F.lower(c)


def _changing(form: str) -> str:
    """A class of the characters that the form may change: those from U+0300 on, and before them those it changes alone."""
    kept = [k for k in range(0x300) if unicodedata.normalize(form, chr(k)) == chr(k)]
    first = [k for k in kept if k - 1 not in kept]
    last = [k for k in kept if k + 1 not in kept]
    return rf"[\x{{80}}-\x{{10ffff}}&&[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(first, last, strict=True)) + "]]"


def unicode_form(form: str) -> Callable[[Column], Column]:
    """A function to the Unicode form NFC, NFD, NFKC or NFKD: ICU's, which comes with Spark, called inside the JVM.

    A text that has only characters that the form leaves alone (none before U+0300 joins another) passes as it is.  The text is worked
    out once: a call by reflection is not deterministic to Spark, so no plan shares what is named twice around it."""
    call = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFD": ("decompose", False), "NFKD": ("decompose", True)}
    name, compatible = call[form]

    def to_form(c: Column) -> Column:
        return let(c, lambda x: F.when(x.rlike(_changing(form)), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(name), x, F.lit(compatible))).otherwise(x))

    return to_form


def remove_diacritics(c: Column) -> Column:
    """The combining marks of every script's decomposed letters dropped (U+0300 to U+036F), the rest composed again."""
    plain = lambda x: unicode_form("NFC")(F.regexp_replace(unicode_form("NFD")(x), r"[\x{300}-\x{36f}]+", ""))
    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), plain(x)).otherwise(x))


def remove_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def remove_punctuation(c: Column, keep_space: bool = False) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ") if keep_space else F.regexp_replace(c, PUNCTUATION + "+", "")


def remove_bidi(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BIDI, ""))


def process(
    c: Column,
    language: str = "en",
    form: str | None = "NFKC",
    diacritics: bool = True,
    rtl: bool = True,
    keep_space: bool = False,
    control: bool = True,
    zero_width: bool = True,
    lowercase: bool = True,
    punctuation: bool = True,
    emoji: bool = False,
    most: int | None = None,
) -> Column:
    """The configurable processor, step by step; `form` names a Unicode form, `most` cuts a text first."""
    if most is not None:
        c = F.substring(c, 1, most)
    if form:
        c = unicode_form(form)(c)
    if control:
        c = F.regexp_replace(c, r"\p{C}+", "")
    if zero_width and not control:  # control characters include them
        c = F.regexp_replace(c, ZERO_WIDTH, "")
    if rtl and language in ("ar", "he"):
        c = remove_bidi(c)
    if not (language == "en" and diacritics):  # English letters lose their accents only, which `diacritics` does
        c = fold_language(c, language)
    if lowercase:
        c = lower_in(c, language)
    if diacritics:
        c = remove_diacritics(c)
    if punctuation:
        c = remove_punctuation(c, keep_space)
    if emoji:
        c = remove_emoji(c)
    return F.trim(c if keep_space else collapse_space(c))


def clean_for_comparison(c: Column) -> Column:
    return process(c)


def prepare_for_search(c: Column) -> Column:
    return process(c, keep_space=True)


def clean_for_detection(c: Column, language: str = "en") -> Column:
    return process(c, language)


def has_rtl(c: Column) -> Column:
    return c.rlike(RTL)


def scripts(c: Column) -> dict[str, Column]:
    """Which kinds of characters a text holds."""
    return {name: c.rlike(pattern) for name, pattern in SCRIPTS.items()}


def text_stats(c: Column) -> dict[str, Column]:
    flags = scripts(c)
    kinds = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return {"length": F.length(c), "wordCount": F.size(extract_letters(c)), "charCount": F.length(F.regexp_replace(c, SPACE, "")), "isRTL": has_rtl(c), "hasMultipleScripts": kinds > 1} | flags


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, 1 for two empty texts; case-insensitive."""
    a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def fuzzy_match(text: Column, pattern: Column, threshold: float = 0.8) -> Column:
    return similarity(text, pattern) >= threshold


def round2(c: Column) -> Column:
    """Half up to two places, on doubles."""
    return F.floor(c * 100 + 0.5) / 100
