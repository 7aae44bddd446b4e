"""Obfuscated characters: leetspeak, look-alikes, diacritics, repetition, separators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, collapse_space, let

# What stands for what.
LEET = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "i", "(": "c", ")": "c", "[": "c", "]": "c", "{": "c", "}": "c", "<": "c", ">": "c"}
#: All letters that a symbol may stand for; an empty string means that it may be left out.
LEET_CHOICES = {
    "0": ["o", "O"], "1": ["i", "I", "l", "L"], "2": ["z", "Z"], "3": ["e", "E"], "4": ["a", "A"],
    "5": ["s", "S"], "6": ["g", "G"], "7": ["t", "T", "l", "L"], "8": ["b", "B"], "9": ["g", "G", "q", "Q"],
    "@": ["a", "A"], "$": ["s", "S"], "!": ["i", "I", "l", "L"], "+": ["t", "T"], "|": ["i", "I", "l", "L"],
    "/": ["/", "i", "I", "l", "L"], "\\": ["\\", "i", "I", "l", "L"],
    **{c: ["c", "C"] for c in "()[]{}<>"}, **{c: [""] for c in "_-.,;:\"'`~^*&%#="},
}
CYRILLIC = ("аеорсухѕАВЕКМНОРСТУХ", "aeopcyxsABEKMHOPCTYX")
GREEK = ("αβγδεζηθικλμνξοπρστυφχψω", "abydeznoiklmvxoppstufxyw")
GREEK_UPPER = ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "ABGDEZHOIKLMNXOPPSTYFXYW")
SIGNS = ("∀∈∅≡≈⊂⊃⊄⊅ıİłŁøØđĐðÐþÞ", "AEO==CCCCiIlLoOdDdDpP")
WRITTEN_OUT = {"∞": "oo", "≠": "!=", "≤": "<=", "≥": ">=", "ß": "ss"}
DIACRITICS = ("àáâãåèéêëìíîïòóôõùúûýÿñç", "aaaaaeeeeiiiioooouuuyync")
DIACRITICS_OF = {
    "de": {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"},
    "fr": {"æ": "ae", "œ": "oe", "ç": "c"},
    "es": {"ñ": "n"},
    "pt": {"ã": "a", "õ": "o", "ç": "c"},
}
SEPARATORS = r"[_\-.~*+=|\\/<>]+"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"

_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_ALIKE = CYRILLIC[0] + GREEK[0] + GREEK_UPPER[0] + SIGNS[0] + _WIDE
_ALIKE_TO = CYRILLIC[1] + GREEK[1] + GREEK_UPPER[1] + SIGNS[1] + unicodedata.normalize("NFKC", _WIDE)
#: A class of each kind, for the tests below.
LEET_CLASS = "[" + "".join("\\" + c if not c.isalnum() else c for c in LEET_CHOICES) + "]"
ALIKE_CLASS = "[" + _ALIKE + "".join(WRITTEN_OUT) + "]"
ACCENT_CLASS = "[" + DIACRITICS[0] + "äöüßÄÖÜæœ" + "]"
REPEATED = r"(?s)(.)\1{2,}"


def normalize_leet(c: Column) -> Column:
    """Each symbol to the first letter that it stands for."""
    return F.translate(c, "".join(LEET), "".join(LEET.values()))


def normalize_alike(c: Column) -> Column:
    """Look-alike characters of other alphabets to Latin ones."""
    c = F.translate(c, _ALIKE, _ALIKE_TO)
    for a, b in WRITTEN_OUT.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_diacritics(c: Column, language: str = "en") -> Column:
    """The language's own letters first, then the general ones."""
    for a, b in DIACRITICS_OF.get(language, {}).items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, *DIACRITICS)


def normalize_repetition(c: Column, most: int = 2) -> Column:
    """Runs of three or more of a character cut to at most `most`."""
    return F.regexp_replace(c, REPEATED, "$1" * min(most, 3)) if most <= 3 else F.regexp_replace(c, r"(?s)(.)\1{%d,}" % most, "$1" * most)


def remove_separators(c: Column) -> Column:
    return collapse_space(F.regexp_replace(F.regexp_replace(c, SEPARATORS, ""), INVISIBLE, ""))


def normalize_characters(c: Column, language: str = "en") -> Column:
    """All of the above in turn, in lower case."""
    c = normalize_repetition(normalize_diacritics(normalize_alike(normalize_leet(c)), language), 1)
    return F.lower(remove_separators(c))


def has_leet(c: Column) -> Column:
    return c.rlike(LEET_CLASS)


def has_alike(c: Column) -> Column:
    return c.rlike(ALIKE_CLASS)


def has_diacritics(c: Column) -> Column:
    return c.rlike(ACCENT_CLASS)


def has_repetition(c: Column) -> Column:
    return c.rlike(REPEATED)


def has_separators(c: Column) -> Column:
    return c.rlike(SEPARATORS)


def obfuscation(c: Column) -> dict[str, Column]:
    """Five flags and the level that their number gives."""
    flags = {"hasLeetspeak": has_leet(c), "hasHomographs": has_alike(c), "hasDiacritics": has_diacritics(c), "hasRepetition": has_repetition(c), "hasSeparators": has_separators(c)}
    # each flag is worked out once and counted from the array that holds them
    given = F.array(*flags.values())
    level = let(F.size(F.filter(given, lambda f: f)), lambda n: F.when(n == 0, "none").when(n == 1, "low").when(n == 2, "medium").otherwise("high"))
    return flags | {"obfuscationLevel": level}


def leet_variations(c: Column, most: int | None = None) -> Column:
    """One symbol replaced at a time, by each letter that it may stand for."""
    table = F.create_map(*[x for k, v in LEET_CHOICES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def at(i: Column) -> Column:
        own = F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.substring(c, i, F.lit(1)))), F.lit(0)), F.array().cast("array<string>"))
        return F.transform(own, lambda r: F.concat(F.substring(c, F.lit(1), i - 1), r, F.substring(c, i + 1, F.length(c))))

    changed = F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), at))
    out = F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, changed).otherwise(F.array().cast("array<string>"))))
    return F.slice(out, 1, most) if most else out


def character_variations(c: Column, language: str = "en", leet: bool = True, alike: bool = True, diacritics: bool = True, repetition: bool = True, most: int | None = None) -> Column:
    """The forms a text may stand for, without separators, none empty, none twice."""
    forms = [c] + [normalize_leet(c)] * leet + [normalize_alike(c)] * alike + [normalize_diacritics(c, language)] * diacritics + [normalize_repetition(c)] * repetition
    out = F.array(*forms)
    if leet:
        out = F.concat(out, leet_variations(c))
    out = F.array_distinct(F.filter(F.transform(out, remove_separators), lambda v: v != ""))
    barred = F.lit(False)
    if not alike:
        barred = barred | has_alike(c)
    if not diacritics:
        barred = barred | has_diacritics(c)
    out = F.when(barred, F.array(c)).otherwise(out)
    return F.slice(out, 1, most) if most else out


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")
