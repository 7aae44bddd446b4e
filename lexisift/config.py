"""Detector settings: defaults, presets, validation, history."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from .sources.lexicon import CORE_CATEGORIES

# Language codes and the values of presets.
LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "nl", "sv", "pl", "ru", "tr", "ar", "he", "hi", "zh", "ja", "ko"]
SEVERITY = {"LOW": 1, "MEDIUM": 2, "MODERATE": 2, "HIGH": 3, "SEVERE": 4}


@dataclass(frozen=True)
class Config:
    languages: list[str] = field(default_factory=lambda: ["en"])
    min_severity: int = 1
    categories: list[str] = field(default_factory=lambda: list(CORE_CATEGORIES))
    fuzzy: bool = True
    fuzzy_threshold: float = 0.8
    custom_words: list[dict] = field(default_factory=list)
    whitelist: list[str] = field(default_factory=list)
    alternate_scripts: bool = True
    normalize: bool = True
    replacement_char: str = "*"
    preserve_structure: bool = True
    context: bool = True
    min_word_length: int = 2
    unicode_borders: bool = False
    max_matches: int | None = None

    @property
    def max_distance(self) -> int:
        """Edits allowed: 1 from 0.8 on, else 3 * threshold rounded down, at least 1."""
        if not self.fuzzy:
            return 0
        return 1 if self.fuzzy_threshold >= 0.8 else max(1, int(3 * self.fuzzy_threshold))


DEFAULT = Config()
PRESETS = {
    "default": DEFAULT,
    "performance": replace(DEFAULT, languages=["en"], min_severity=2, fuzzy=False, normalize=False, alternate_scripts=False),
    "comprehensive": replace(DEFAULT, languages=["auto"], fuzzy_threshold=0.7),
    "strict": replace(DEFAULT, min_severity=3, fuzzy_threshold=0.9, categories=["general", "sexual", "hate_speech"]),
    "lenient": replace(DEFAULT, fuzzy_threshold=0.6),
}
#: A second set, with other meanings of the same names.
UTILITY_PRESETS = {
    "default": replace(DEFAULT, languages=["auto"]),
    "strict": replace(DEFAULT, languages=["auto"], fuzzy_threshold=0.6),
    "lenient": replace(DEFAULT, languages=["auto"], min_severity=2, fuzzy=False, categories=["hate_speech", "discrimination"]),
    "family_friendly": replace(DEFAULT, languages=["auto"], fuzzy_threshold=0.9),
}
ENVIRONMENTS = {"development": DEFAULT, "production": DEFAULT, "testing": replace(DEFAULT, languages=["en"], fuzzy=False)}
BY_LANGUAGE = {
    "en": {"fuzzy_threshold": 0.8, "normalize": True, "alternate_scripts": False},
    "es": {"fuzzy_threshold": 0.7, "normalize": True, "alternate_scripts": True},
    "fr": {"fuzzy_threshold": 0.7, "normalize": True, "alternate_scripts": False},
    "de": {"fuzzy_threshold": 0.8, "normalize": True, "alternate_scripts": False},
    "ru": {"fuzzy_threshold": 0.7, "normalize": True, "alternate_scripts": True},
    "zh": {"fuzzy_threshold": 0.9, "normalize": False, "alternate_scripts": True},
    "ja": {"fuzzy_threshold": 0.9, "normalize": False, "alternate_scripts": True},
    "ar": {"fuzzy_threshold": 0.7, "normalize": True, "alternate_scripts": True},
}


def preset(name: str) -> Config:
    return PRESETS[name]


def session_values(spark) -> dict:
    """The settings that a session's spark.lexisift.* keys give; severities out of range and other text than numbers are left out."""
    def number(kind, ok):
        def read(v: str):
            try:
                x = kind(v)
            except ValueError:
                return None
            return x if ok(x) else None

        return read

    truth = lambda v: v == "true"
    read = {"languages": lambda v: [x.strip() for x in v.split(",")], "min_severity": number(int, lambda x: 1 <= x <= 4), "fuzzy": truth, "fuzzy_threshold": number(float, lambda x: 0 <= x <= 1), "normalize": truth, "replacement_char": str}
    given = {k: spark.conf.get(f"spark.lexisift.{k}", None) for k in read}
    found = {k: read[k](v) for k, v in given.items() if v}
    return {k: v for k, v in found.items() if v is not None}


def environment(name: str | None = None, spark=None) -> Config:
    """The environment's settings; spark.lexisift.* keys of a session win over them."""
    out = ENVIRONMENTS.get(name or "development", DEFAULT)
    return out if spark is None else _sound(session_values(spark), out)


def for_language(code: str, **own) -> Config:
    """One language's settings; the caller's own values win."""
    return replace(DEFAULT, **({"languages": [code]} | BY_LANGUAGE.get(code, {}) | own))


class _Notes:
    """What a rule has to say: errors, which spoil the settings, and warnings, which mend them."""

    def __init__(self) -> None:
        self.errors: list[str] = []
        self.warnings: list[str] = []

    def distinct(self, values, what: str, key=lambda x: x) -> list:
        """The values without later ones of the same key, each of which is warned of."""
        out: dict = {}
        for v in values:
            if key(v) in out:
                self.warnings.append(f"{what} {v} is given twice")
            else:
                out[key(v)] = v
        return list(out.values())

    def known(self, values, ok, what: str) -> list:
        self.warnings.extend(f"unknown {what} {v!r}, left out" for v in values if not ok(v))
        return [v for v in values if ok(v)]


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _languages(value, notes: _Notes):
    if not isinstance(value, list) or not value:
        notes.errors.append("languages must be a list of at least one language")
        return None
    good = notes.distinct(notes.known(value, lambda x: isinstance(x, str) and x in [*LANGUAGES, "auto"], "language"), "language")
    if not good:
        notes.warnings.append("no language is left: auto")
    if "auto" in good and len(good) > 1:
        notes.warnings.append("auto stands beside other languages")
    return good or ["auto"]


def _severity(value, notes: _Notes):
    if isinstance(value, bool) or value not in set(SEVERITY.values()):
        notes.errors.append("min_severity must be 1, 2, 3 or 4")
    return value


def _categories(value, notes: _Notes):
    if not isinstance(value, list):
        notes.errors.append("categories must be a list")
        return None
    good = notes.distinct(notes.known(value, lambda x: x in CORE_CATEGORIES, "category"), "category")
    if not good:
        notes.warnings.append("no category is left: all of them")
    return good or list(CORE_CATEGORIES)


def _threshold(value, notes: _Notes):
    if not _is_number(value) or not 0 <= value <= 1:
        notes.errors.append("fuzzy_threshold must be a number between 0 and 1")
    elif value < 0.5:
        notes.warnings.append("a fuzzy_threshold below 0.5 finds many false matches")
    elif value > 0.95:
        notes.warnings.append("a fuzzy_threshold above 0.95 finds few variations")
    return value


def _custom_words(value, notes: _Notes):
    """Words alone or dictionaries; what a dictionary lacks or has wrong gets its default."""
    if not isinstance(value, list):
        notes.errors.append("custom_words must be a list")
        return None
    out = []
    for w in value:
        entry = {"word": w} if isinstance(w, str) else w
        word = entry.get("word") if isinstance(entry, dict) else None
        if not isinstance(word, str) or not word.strip():
            notes.warnings.append(f"custom word {w!r} has no word, left out")
            continue
        severity = entry.get("severity", 2)
        if severity not in set(SEVERITY.values()):
            notes.warnings.append(f"custom word {word}: severity {severity!r} becomes 2")
            severity = 2
        categories = entry.get("categories")
        out.append({**entry, "word": word.strip(), "language": entry.get("lang") or entry.get("language") or "en", "severity": severity, "categories": categories if isinstance(categories, list) and categories else ["general"]})
    seen, kept = set(), []
    for entry in out:
        key = (entry["word"].lower(), entry["language"])
        if key in seen:
            notes.warnings.append(f"custom word {entry['word']} is given twice")
        else:
            kept.append(entry)
        seen.add(key)
    return kept


def _whitelist(value, notes: _Notes):
    if not isinstance(value, list):
        notes.warnings.append("whitelist must be a list, left out")
        return []
    good = notes.known(value, lambda x: isinstance(x, str) and x.strip() != "", "exception")
    return notes.distinct([x.strip() for x in good], "exception", str.lower)


def _replacement_char(value, notes: _Notes):
    if not isinstance(value, str) or not value:
        notes.warnings.append("replacement_char must be one character: *")
        return "*"
    if len(value) > 1:
        notes.warnings.append("replacement_char must be one character: the first")
    return value[0]


def _flag(value, notes: _Notes) -> bool:
    return bool(value)


def _count(name: str, none: bool = False):
    def rule(value, notes: _Notes):
        if not (none and value is None) and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
            notes.errors.append(f"{name} must be a whole number from 1 on")
        return value

    return rule


_RULES = {
    "languages": _languages,
    "min_severity": _severity,
    "categories": _categories,
    "fuzzy_threshold": _threshold,
    "custom_words": _custom_words,
    "whitelist": _whitelist,
    "replacement_char": _replacement_char,
    "min_word_length": _count("min_word_length"),
    "max_matches": _count("max_matches", none=True),
} | dict.fromkeys(["fuzzy", "alternate_scripts", "normalize", "preserve_structure", "context", "unicode_borders"], _flag)


def check(values: dict, base: Config = DEFAULT) -> tuple[list[str], list[str], Config | None]:
    """(errors, warnings, settings): the settings of base with the mended values; None where there are errors."""
    notes, good = _Notes(), {}
    for name, value in values.items():
        if name in _RULES:
            good[name] = _RULES[name](value, notes)
        else:
            notes.errors.append(f"unknown setting {name}")
    if notes.errors:
        return notes.errors, notes.warnings, None
    out = replace(base, **good)
    if not out.fuzzy and out.fuzzy_threshold != DEFAULT.fuzzy_threshold:
        notes.warnings.append("fuzzy_threshold has no effect without fuzzy")
    if out.fuzzy and len(out.languages) > 5:
        notes.warnings.append("fuzzy matching in many languages is slow")
    if out.min_severity == SEVERITY["HIGH"] and len(out.categories) > 3:
        notes.warnings.append("a high severity in many categories finds little")
    both = {w["word"].lower() for w in out.custom_words} & {x.lower() for x in out.whitelist}
    notes.warnings += [f"{w} is both a custom word and an exception" for w in sorted(both)]
    return [], notes.warnings, out


def validate(values: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) of settings given as a dictionary."""
    return check(values)[:2]


def quick_validate(values) -> bool:
    """Whether settings are a dictionary, can be written as JSON and have no errors."""
    try:
        json.dumps(values)
    except (TypeError, ValueError, RecursionError):
        return False
    return isinstance(values, dict) and not validate(values)[0]


def sanitize(values: dict) -> Config:
    """The mended settings; the defaults where there are errors."""
    return check(values)[2] or DEFAULT


@dataclass(frozen=True)
class Options:
    """What one analysis returns; at most max_length characters may be asked for."""

    filter_mode: str = "detect_only"
    include_matches: bool = True
    include_confidence: bool = True
    measure_performance: bool = False
    max_length: int = 100_000


#: The modes of a filter, and the greatest max_length.
FILTER_MODES = ("censor", "remove", "replace", "detect_only")
GREATEST_LENGTH = 10_000_000


def check_options(values: dict) -> tuple[list[str], list[str], Options | None]:
    """(errors, warnings, options); None where there are errors."""
    errors, warnings, good = [], [], {}
    for name in ("include_matches", "include_confidence", "measure_performance"):
        if name in values:
            good[name] = bool(values[name])
    mode = values.get("filter_mode", "detect_only")
    if mode not in FILTER_MODES:
        errors.append(f"unknown filter_mode {mode}")
    most = values.get("max_length", Options.max_length)
    if not _is_number(most) or not most >= 0:
        errors.append("max_length must be a number from 0 on")
    elif most > GREATEST_LENGTH:
        warnings.append("a very large max_length may be slow")
    if errors:
        return errors, warnings, None
    return errors, warnings, Options(**good, filter_mode=mode, max_length=int(min(most, GREATEST_LENGTH)))


def _sound(values: dict, base: Config) -> Config:
    errors, _, out = check(values, base)
    if out is None:
        raise ValueError("; ".join(errors))
    return out


class ConfigManager:
    """Settings with a history of the last ten, listeners, JSON files."""

    def __init__(self, config: Config = DEFAULT) -> None:
        self.config, self.history, self.listeners = config, [], []

    def _to(self, new: Config) -> Config:
        changed = self.diff(self.config, new)
        self.history = [*self.history, self.config][-10:]
        self.config = new
        for f in self.listeners:
            f(new, changed)
        return new

    def update(self, **values) -> Config:
        return self._to(_sound(values, self.config))

    def use(self, name: str) -> Config:
        return self._to(PRESETS[name])

    def optimize_for(self, code: str) -> Config:
        return self._to(replace(self.config, **BY_LANGUAGE.get(code, {})))

    def revert(self, steps: int = 1) -> Config:
        if not 1 <= steps <= len(self.history):
            raise ValueError("no such step")
        target = self.history[-steps]
        self.history = self.history[:-steps]
        self.config = target
        return target

    def reset(self) -> Config:
        return self._to(DEFAULT)

    def dispose(self) -> None:
        """Forgets history and listeners."""
        self.history, self.listeners = [], []

    def override(self, spark) -> Config:
        """The settings with the session's spark.lexisift.* keys over them."""
        found = session_values(spark)
        return self.update(**found) if found else self.config

    def listen(self, f: Callable) -> Callable[[], None]:
        self.listeners.append(f)
        return lambda: self.listeners.remove(f)

    @staticmethod
    def diff(a: Config, b: Config) -> list[str]:
        x, y = asdict(a), asdict(b)
        return [k for k in x if x[k] != y[k]]

    def export(self) -> str:
        return json.dumps(asdict(self.config), indent=2)

    def load(self, text: str) -> Config:
        return self._to(_sound(json.loads(text), DEFAULT))

    def save_file(self, path: str) -> None:
        Path(path).write_text(self.export())

    def load_file(self, path: str) -> Config:
        return self.load(Path(path).read_text())


def config_hash(config: Config) -> str:
    """A short name of the settings, for lineage."""
    h = 0
    for ch in json.dumps(asdict(config), sort_keys=True):
        h = (31 * h + ord(ch) + (1 << 31)) % (1 << 32) - (1 << 31)
    digits, n = "", abs(h)
    while True:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        if not n:
            return digits
