"""Candidates: exact (an automaton inside the row, or an equi-join of word sequences for large lexicons) and fuzzy (delete variants)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, let, normalize, similarity, split_words
from ..session import staged
from ..sources.lexicon import delete_variants

PIECES = "[a-z0-9]+|[^a-z0-9]+"
WORDS = "[A-Za-z0-9_]+"
#: Surfaces that an automaton is built of; larger lexicons are matched by joins.
AUTOMATON_ROWS = 200_000
#: Units of a surface that make its key; the rest of a longer one is compared in the row.
KEY_UNITS = 9
#: Keys of surfaces, and pairs of near words, that are sent to all tasks; more of them are joined by a shuffle.
SENT_ROWS = 1_000_000
#: Bytes of text that a worker of the automaton turns into Python strings at a time.
SLICE_BYTES = 4 << 20
#: First units of surfaces that are listed in the plan of the joins; beginnings with another unit make no keys.  With more, all do.
LISTED_UNITS = 4_000
MATCH = "struct<word:string,match:string,start:int,end:int,severity:int,categories:array<string>,language:string,confidence:double,distance:int>"

# Default exceptions.
WHITELIST = [
    "assess", "assessment", "classic", "glass", "class", "pass", "bass", "mass", "grass", "brass", "assistance",
    "associate", "assumption", "expression", "impression", "depression", "aggression", "regression", "progression",
    "succession", "text", "context", "pretext", "subtext", "texture", "this", "that", "these", "those", "with", "from",
    "and", "the", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our",
]
COMMON_WORDS = ["god", "gay", "sex", "sexy", "kill", "die", "dead", "hate", "stupid", "idiot", "moron", "bad"]


def normalized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `norm`, the text that spans refer to."""
    return docs.withColumn("norm", normalize(F.col(text)))


def token_list(docs: DataFrame) -> DataFrame:
    """The different tokens of all texts, a row each: one of each text first, then of all."""
    return docs.select(F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0)))).alias("token")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """A row per token: doc_id, idx (number among the pieces), token; no text is carried along."""
    pieces = F.regexp_extract_all("norm", F.lit(PIECES), F.lit(0))
    return docs.select("doc_id", F.posexplode(pieces).alias("idx", "token")).where(F.col("token").rlike("^[a-z0-9]"))


def by_start(found: Column) -> Column:
    """Matches by start, then end, term and language."""
    return F.transform(F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"), m.alias("m")))), lambda x: x["m"])


def hit_rows(found: DataFrame) -> DataFrame:
    """A row per candidate: the columns of found, start, end, word, term, language, severity, categories, base_conf."""
    rows = found.withColumn("_m", F.explode("candidates")).drop("candidates")
    return rows.select("*", "_m.start", "_m.end", "_m.word", F.col("_m.match").alias("term"), "_m.language", "_m.severity", "_m.categories", F.col("_m.confidence").alias("base_conf")).drop("_m")


def fuzzy_pairs(words: DataFrame, dictionary: DataFrame, distance: int = 1, prefix: int | None = None, case_sensitive: bool = True) -> DataFrame:
    """(token, surface, distance) of all pairs within the edit distance.

    Both sides' delete variants are joined by equality; no pair within the distance is lost, and the
    distance itself is checked on those that meet, where they meet.  With `prefix`, variants are made of so many first
    characters only: fewer variants, more pairs to check, the same pairs found.  Without case_sensitive,
    both sides are lowered.  Where the surfaces' variants (counted before) are few enough to be sent, tokens meet them where they are."""
    side = lambda rows, c: rows.select((F.col(c) if case_sensitive else F.lower(c)).alias(c)).distinct()
    q = delete_variants(side(words, "token"), "token", distance, prefix)
    d = staged(delete_variants(side(dictionary, "surface"), "surface", distance, prefix).select("surface", "variant"), "variants")
    met = q.join(F.broadcast(d) if d.count() <= SENT_ROWS else d, "variant")
    near = met.select("token", "surface").withColumn("distance", F.levenshtein("token", "surface", distance)).where("distance >= 0")
    return near.distinct()


def near_pairs(words: DataFrame, dictionary: DataFrame, distance: int = 1) -> DataFrame:
    """(token, surface, distance) of all pairs within the edit distance, met by segments instead of delete variants.

    A token cut into distance + 1 segments has one that stands unchanged in any surface within the distance, at most so many places away: a
    token makes distance + 1 keys, whatever its length, and a surface a few for each length that a token near it may have.  Where the
    surfaces' keys (counted before) are few enough to be sent, tokens meet them where they are, and only those that meet are shuffled."""
    parts = distance + 1
    size = lambda n, s: F.floor(n / parts).cast("int") + (F.lit(s) >= parts - n % parts).cast("int")
    start = lambda n, s: s * F.floor(n / parts).cast("int") + F.greatest(F.lit(0), s - parts + n % parts)
    n = F.length("token")
    keys = F.array(*[F.struct(n.alias("n"), F.lit(s).alias("s"), F.substring("token", start(n, s) + 1, size(n, s)).alias("seg")) for s in range(parts)])
    m = F.length("surface")
    k = F.col("n")
    at = [F.struct(F.lit(s).alias("s"), F.when((start(k, s) + d >= 0) & (start(k, s) + d + size(k, s) <= m), F.substring("surface", start(k, s) + d + 1, size(k, s))).alias("seg")) for s in range(parts) for d in range(-distance, distance + 1)]
    known = dictionary.select("surface").where(m > 0).distinct().select("surface", F.explode(F.sequence(F.greatest(F.lit(1), m - distance), m + distance)).alias("n"))
    known = staged(known.select("surface", "n", F.explode(F.array_distinct(F.array(*at))).alias("k")).select("surface", "n", "k.s", "k.seg").where("seg is not null"), "segments")
    tokens_ = words.select("token").where(n > 0)
    if known.count() <= SENT_ROWS:
        met = tokens_.select("token", F.explode(keys).alias("k")).select("token", "k.*").join(F.broadcast(known), ["n", "s", "seg"])
    else:
        met = tokens_.distinct().select("token", F.explode(keys).alias("k")).select("token", "k.*").join(known, ["n", "s", "seg"])
    met = met.withColumn("distance", F.levenshtein("token", "surface", distance)).where("distance >= 0")
    return met.select("token", "surface", "distance").distinct()


def fuzzy_hits(docs: DataFrame, lexicon: DataFrame, distance: int = 1, least: int = 2) -> DataFrame:
    """A row per token near a base word (not a variation), exact ones left out: doc_id, idx, token, the lexicon's columns."""
    t = tokens(docs).where(F.length("token") >= least)
    base = lexicon.where("not is_variation and n_tokens = 1").withColumn("surface", F.col("surface_norm"))
    pairs = near_pairs(t, base, distance).where("distance > 0")
    info = base.select("surface", F.col("lang").alias("language"), "term", "severity", "categories", "base_conf")
    return t.join(pairs, "token").join(info, "surface")


def remainder_search(docs: DataFrame, lexicon: DataFrame, distance: int = 1, width: int = 30) -> DataFrame:
    """doc_id, start, end, word, term, distance: words near the whole remainder of a text (at most `width` characters) from a word's start.

    A remainder longer than every word and the distance together is near none, so only starts close to a text's end
    leave their row, without the text before them; they meet the words by segments (`near_pairs`).  Of equal (start, end, word) the least distance stays."""
    words = lexicon.select(F.col("surface_norm").alias("surface"), "term").distinct()
    longest = (words.agg(F.max(F.length("surface"))).first()[0] or 0) + distance
    most = min(width, longest)
    # the end of a text, with the character before it; `skip`, what stands before that
    rows = docs.select("doc_id", F.lower("norm").alias("t"), F.length("norm").alias("n")).where("n > 0")
    rows = rows.select("doc_id", F.greatest(F.lit(0), F.col("n") - most - 1).alias("skip"), "n", F.right("t", F.lit(most + 1)).alias("t"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n") - 1)
    rows = rows.select("doc_id", "skip", "t", F.explode(starts).alias("start")).withColumn("at", F.col("start") - F.col("skip"))
    rows = rows.where((F.col("start") == 0) | ~F.substring("t", F.col("at"), F.lit(1)).rlike("[a-z0-9]"))
    rows = staged(rows.select("doc_id", "start", F.substring("t", F.col("at") + 1, F.lit(width)).alias("token")), "remainders")
    near = rows.join(near_pairs(rows.select("token").distinct(), words, distance), "token").join(words, "surface")
    found = near.select("doc_id", "start", (F.col("start") + F.length("token")).alias("end"), F.col("token").alias("word"), "term", "distance")
    return lowest_distance(found, ["doc_id", "start", "end", "term"])


def lowest_distance(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the nearest: a combined minimum, no window."""
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min(F.struct("distance", *[c for c in rest if c != "distance"])).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def places_of(pieces: Column, wanted: Column) -> Column:
    """(word, start) of those pieces of a text that are among the wanted ones, from one pass over a text that has any."""
    none = F.array().cast("array<struct<word:string,start:int>>")

    def step(a: Column, p: Column) -> Column:
        here = F.when(F.array_contains(wanted, p), F.concat(a["out"], F.array(F.struct(p.alias("word"), a["at"].alias("start"))))).otherwise(a["out"])
        return F.struct((a["at"] + F.length(p)).alias("at"), here.alias("out"))

    return F.when(F.size(wanted) == 0, none).otherwise(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"]))


def similar_places(text: Column, patterns: list[str], threshold: float = 0.8) -> Column:
    """(pattern, match, similarity, start, end) of the words between white space that are like a pattern, as an array of
    the row; words in order, a word's patterns in theirs.  Words are judged once each; offsets come from one pass over a text that has any."""
    if not patterns:
        return F.when(text.isNotNull(), F.array().cast("array<struct<pattern:string,match:string,similarity:double,start:int,end:int>>"))
    every = F.array(*map(F.lit, patterns))
    alike = lambda w: F.filter(every, lambda p: similarity(w, p) >= threshold)

    def placed(pieces: Column) -> Column:
        words = F.filter(F.array_distinct(pieces), lambda w: F.exists(every, lambda p: similarity(w, p) >= threshold))
        return let(words, lambda found: places_of(pieces, found))

    places = let(F.regexp_extract_all(text, F.lit(f"{SPACE}+|[^{SPACE[1:]}+"), F.lit(0)), placed)
    rows = F.transform(places, lambda x: F.transform(alike(x["word"]), lambda p: F.struct(p.alias("pattern"), x["word"].alias("match"), similarity(x["word"], p).alias("similarity"), x["start"].alias("start"), (x["start"] + F.length(x["word"])).alias("end"))))
    return F.flatten(rows)


def similar_pairs(words: DataFrame, patterns: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(w, pattern, similarity) of all pairs of a word and a pattern that are similar enough (threshold above 0), each pair once.

    A word of length n at most d edits from a pattern, cut into d + 1 segments, has one that stands unchanged in the pattern, at most d
    places away.  So a word's segments, for each length that a pattern may have, meet the patterns' substrings at those places by
    equality, and no pair is lost; the similarity itself is worked out for those that meet."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    known = patterns.where(F.length("pattern") > 0).select("pattern", F.lower("pattern").alias("p")).distinct()
    lengths = [r[0] for r in known.select(F.length("p")).distinct().collect()]
    slack = 1e-9
    edits = lambda a, b: F.floor((1 - threshold) * F.greatest(a, b) + slack).cast("int")
    size = lambda n, d, s: F.floor(n / (d + 1)).cast("int") + (s >= d + 1 - n % (d + 1)).cast("int")
    start = lambda n, d, s: s * F.floor(n / (d + 1)).cast("int") + F.greatest(F.lit(0), s - (d + 1 - n % (d + 1)))

    def segments(w: Column) -> Column:
        n = F.length(w)
        near = F.filter(F.array(*map(F.lit, lengths)), lambda m: F.least(n, m) >= threshold * F.greatest(n, m) - slack)
        cut_ = lambda m, d: F.transform(F.sequence(F.lit(0), d), lambda s: F.struct(m.alias("m"), n.alias("n"), s.alias("s"), F.substring(w, start(n, d, s) + 1, size(n, d, s)).alias("seg")))
        return F.flatten(F.transform(near, lambda m: let(edits(n, m), lambda d: cut_(m, d))))

    def substrings(p: Column) -> Column:
        m = F.length(p)

        def placed(n: Column, d: Column) -> Column:
            def of(s: Column) -> Column:
                at = lambda k: F.greatest(F.lit(0), F.least(m - size(n, d, s), start(n, d, s) + k))
                return F.array_distinct(F.transform(F.sequence(-d, d), lambda k: F.struct(m.alias("m"), n.alias("n"), s.alias("s"), F.substring(p, at(k) + 1, size(n, d, s)).alias("seg"))))

            return F.flatten(F.transform(F.sequence(F.lit(0), d), of))

        likely = F.sequence(F.greatest(F.lit(1), F.ceil(threshold * m - slack).cast("int")), F.floor(m / threshold + slack).cast("int"))
        return F.flatten(F.transform(likely, lambda n: let(edits(n, m), lambda d: placed(n, d))))

    if not lengths:
        return words.select("w").limit(0).withColumns({"pattern": F.lit(""), "similarity": F.lit(0.0)})
    left = words.select("w").distinct().where(F.length("w") > 0).select("w", F.explode(segments(F.lower("w"))).alias("k")).select("w", "k.*")
    right = known.select("pattern", F.explode(substrings(F.col("p"))).alias("k")).select("pattern", "k.*")
    met = left.join(right, ["m", "n", "s", "seg"]).select("w", "pattern").distinct()
    return met.withColumn("similarity", similarity(F.col("w"), F.col("pattern"))).where(F.col("similarity") >= threshold)


def similar_words(docs: DataFrame, patterns: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """A row per word of a text (doc_id, w) and pattern that is similar to it: the different words meet the patterns first."""
    words = docs.select("doc_id", F.explode(split_words(F.lower(F.col(text)))).alias("w"))
    return words.join(similar_pairs(words, patterns, threshold), "w")


def best_pattern(c: Column, patterns: list[str], least: float = 0.0) -> Column:
    """(pattern, similarity) of the most similar of a list of patterns, the first of equal ones; null below `least`."""
    scored = F.array(*[F.struct(similarity(c, F.lit(p)).alias("similarity"), F.lit(-i).alias("k"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)])
    best = F.array_max(scored)
    return F.when(best["similarity"] >= least, F.struct(best["pattern"].alias("pattern"), best["similarity"].alias("similarity")))


def keep(hits: DataFrame, min_severity: int = 1, categories: list[str] | None = None, whitelist: list[str] | None = None, least: int = 2) -> DataFrame:
    """The row filters: severity, category, exceptions, length, mild common words."""
    out = hits.where(F.col("severity") >= min_severity)
    if categories:
        out = out.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    out = out.where(~F.lower("word").isin([*WHITELIST, *map(str.lower, whitelist or [])])).where(F.length("word") >= least)
    common = F.lower("word").isin(COMMON_WORDS) | F.lower("term").isin(COMMON_WORDS)
    return out.where(~(common & (F.col("severity") <= 1) & (F.col("base_conf") < 0.8)))


#: The automata of this worker, by the plan's name for the lexicon.
_BUILT: dict[str, tuple] = {}


def index_of(name: str, rows: list[dict]) -> tuple:
    """An automaton of all surfaces, the base words' rows by surface, and the lexicon's columns; built once a worker."""
    if name not in _BUILT:
        import ahocorasick

        if len(_BUILT) >= 8:
            _BUILT.clear()
        automaton, by_surface, base = ahocorasick.Automaton(), {}, {}
        for i, r in enumerate(rows):
            if r["surface_norm"]:
                by_surface.setdefault(r["surface_norm"], []).append(i)
            if not r["is_variation"]:
                base.setdefault(r["surface_norm"], []).append(i)
        for s, ids in by_surface.items():
            automaton.add_word(s, (len(s), ids))
        if by_surface:
            automaton.make_automaton()
        kinds = {"term": pa.string(), "severity": pa.int32(), "categories": pa.list_(pa.string()), "lang": pa.string(), "base_conf": pa.float64()}
        _BUILT[name] = automaton, base, {c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()}
    return _BUILT[name]


def spans_array(counts: list[int], at: list[int], to: list[int], which: list[int], far: list[int], words: list[str], columns: dict[str, pa.Array]) -> pa.Array:
    """The candidates of a batch of texts as a list column; a fuzzy one's confidence falls by 0.2 an edit, to half at most."""
    i, d = pa.array(which, pa.int64()), np.array(far, np.float64)
    conf = columns["base_conf"].take(i).to_numpy(zero_copy_only=False) * np.where(d > 0, np.maximum(0.5, 1 - 0.2 * d), 1.0)
    fields = {"word": pa.array(words, pa.string()), "match": columns["term"].take(i), "start": pa.array(at, pa.int32()), "end": pa.array(to, pa.int32()), "severity": columns["severity"].take(i), "categories": columns["categories"].take(i), "language": columns["lang"].take(i), "confidence": pa.array(conf), "distance": pa.array(far, pa.int32())}
    structs = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32)), structs)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_BYTES of a text column (or one row), so that what Python makes of a batch at a time is bounded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to
    if not batch.num_rows:
        yield batch


def near_words(docs: DataFrame, lexicon: DataFrame, distance: int) -> DataFrame:
    """(token, surface, distance) of the texts' words near a base word, itself left out: a staged table.

    The texts' words meet the base words once for the whole corpus; what is near comes back, not what each task finds anew."""
    # a filter by the text would sink below the texts' distribution over the cores, and be worked out there
    found = F.when(F.length("norm") >= 3, F.array_distinct(F.regexp_extract_all("norm", F.lit(WORDS), F.lit(0))))
    words = docs.select(F.explode(found).alias("token"))
    base = lexicon.where("not is_variation").select(F.col("surface_norm").alias("surface"))
    return staged(near_pairs(words.where(F.length("token") >= 2).distinct(), base, distance).where("distance > 0"), "near")


def automaton_matches(docs: DataFrame, lexicon: DataFrame, distance: int = 0, unicode_borders: bool = False, languages: str | None = None, max_rows: int = AUTOMATON_ROWS) -> DataFrame:
    """docs with `candidates`, all spans of one pass of an automaton over `norm` (any script, symbols in
    surfaces included), and, with distance > 0, words near a base word.  `languages` names an array column that
    restricts each text's languages.

    The lexicon is sent to the executors, at most max_rows surfaces, and so are at most SENT_ROWS pairs of near words; beyond
    either number the same candidates come from `join_matches`."""
    rows = [r.asDict() for r in lexicon.limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        return join_matches(docs, lexicon, distance, unicode_borders, languages)
    pairs: list | None = []
    if distance and docs.isStreaming:
        pairs = None  # a stream's words can't be listed beforehand: each worker looks its own up
    elif distance:
        near = near_words(docs, lexicon, distance)
        pairs = near.limit(SENT_ROWS + 1).collect()
        if len(pairs) > SENT_ROWS:
            return join_matches(docs, lexicon, distance, unicode_borders, languages, near)
    near_by: dict[str, list[tuple[str, int]]] | None = None
    if pairs is not None:
        near_by = {}
        for token, surface, d in pairs:
            near_by.setdefault(token, []).append((surface, d))
    shared, name = docs.sparkSession.sparkContext.broadcast((rows, near_by)), uuid.uuid4().hex
    names = docs.columns
    spot, lang_at = names.index("norm"), names.index(languages) if languages else None
    word = re.compile(WORDS)

    def inner(ch: str) -> bool:
        return ch.isalnum() if unicode_borders else ch.isascii() and ch.isalnum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, near_by = shared.value
        automaton, base, columns = index_of(name, lex)
        langs = [r["lang"] for r in lex]
        near = None if near_by is None else {t: [(d, i) for s, d in found for i in base[s]] for t, found in near_by.items()}
        lookup = near.get if near is not None else own_lookup(base, distance)

        for batch in (part for whole in batches for part in slices(whole, spot)):
            counts, at, to, which, far, words = [], [], [], [], [], []
            allowed = batch.column(lang_at).to_pylist() if lang_at is not None else None
            for k, text in enumerate(batch.column(spot).to_pylist()):
                before = len(at)
                if text and len(text) >= 3:
                    ok = None if allowed is None else set(allowed[k] or ())
                    for last, (n, ids) in automaton.iter(text) if len(automaton) else ():
                        e, s = last + 1, last + 1 - n
                        if (s == 0 or not inner(text[s - 1])) and (e == len(text) or not inner(text[e])):
                            for i in ids:
                                if ok is None or langs[i] in ok:
                                    at.append(s), to.append(e), which.append(i), far.append(0), words.append(text[s:e])
                    if near is None or near:
                        for m in word.finditer(text):
                            for d, i in lookup(m.group()) or ():
                                if ok is None or langs[i] in ok:
                                    at.append(m.start()), to.append(m.end()), which.append(i), far.append(d), words.append(m.group())
                counts.append(len(at) - before)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans_array(counts, at, to, which, far, words, columns)], names=[*names, "candidates"])

    schema = T.StructType([*docs.schema.fields, T.StructField("candidates", T.ArrayType(T._parse_datatype_string(MATCH)))])
    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- a stream's own lookup


def own_lookup(base: dict[str, list[int]], distance: int) -> Callable[[str], list[tuple[int, int]]]:
    """(distance, row) of the base words near a word, found in this worker by delete variants, each different word once."""
    variants: dict[str, set[str]] = {}
    for s in base:
        for v in _deletes(s, distance):
            variants.setdefault(v, set()).add(s)
    near: dict[str, list[tuple[int, int]]] = {}

    def lookup(token: str) -> list[tuple[int, int]]:
        if len(token) < 2:
            return []
        if token not in near:
            if len(near) > 500_000:
                near.clear()
            met = set().union(*(variants.get(v, ()) for v in _deletes(token, distance)))
            near[token] = sorted((d, i) for s in met if 0 < (d := edit_distance(token, s, distance)) <= distance for i in base[s])
        return near[token]

    return lookup


def _deletes(word: str, distance: int) -> set[str]:
    out = {word}
    for _ in range(distance):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


# ---------------------------------------------------------------- lexicons of any size


def units(c: Column, unicode_borders: bool = False) -> Column:
    """A text as a list of runs of alphanumeric characters and single other characters.  A surface stands in a text, between
    borders, exactly where its units are units of the text and no alphanumeric one touches its outer symbols."""
    inner = _inner(unicode_borders)
    return F.regexp_extract_all(c, F.lit(f"[{inner}]+|[^{inner}]"), F.lit(0))


def _inner(unicode_borders: bool) -> str:
    return r"\p{L}\p{N}" if unicode_borders else "A-Za-z0-9"


def _keys(text: Column, sizes: list[int], unicode_borders: bool, firsts: list[str] | None = None) -> Column:
    """(at, key) of all sequences of so many units that may begin a surface: those without an alphanumeric unit before them, and
    with one of the first units, where these are given."""

    def keyed(u: Column) -> Column:
        may = lambda i: (i == 0) | ~F.get(u, i - 1).rlike(f"^[{_inner(unicode_borders)}]")
        begins = F.filter(F.sequence(F.lit(0), F.size(u) - 1), may if firsts is None else lambda i: F.get(u, i).isin(firsts) & may(i))
        long_ = lambda i: F.filter(F.array(*map(F.lit, sizes)), lambda n: i + n <= F.size(u))
        return F.flatten(F.transform(begins, lambda i: F.transform(long_(i), lambda n: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice(u, i + 1, n), "")).alias("key")))))

    return let(units(text, unicode_borders), keyed)


def join_matches(docs: DataFrame, lexicon: DataFrame, distance: int = 0, unicode_borders: bool = False, languages: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """The candidates of `automaton_matches` for a lexicon of any size, without a Python step.

    Sequences of units, as many as surfaces have (at most KEY_UNITS), meet the surfaces by the hash of their text; only numbers are
    shuffled.  The few that meet come back to their row, where the whole surface is compared and its place found.  Keys of up to
    SENT_ROWS surfaces, counted before, are sent to all tasks ahead of that join, so that sequences of no surface never leave theirs.
    Near words come back in the same way.  The rows get numbers, so docs are staged first: a batch table, no stream."""
    spark = docs.sparkSession
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    empty = F.array().cast(f"array<{MATCH}>")
    lex = lexicon.where(F.length("surface_norm") > 0).withColumn("_u", units(F.col("surface_norm"), unicode_borders))
    info = F.struct(F.col("term").alias("match"), F.col("severity").cast("int").alias("severity"), "categories", F.col("lang").alias("language"), F.col("base_conf").alias("confidence"))
    lex = staged(lex.select(F.size("_u").alias("n"), F.get("_u", F.lit(0)).alias("first"), F.xxhash64(F.array_join(F.slice("_u", 1, KEY_UNITS), "")).alias("key"), "surface_norm", "is_variation", info.alias("info")), "surfaces")
    known = lex.groupBy(F.least("n", F.lit(KEY_UNITS)).alias("n")).agg(F.count_distinct("key").alias("keys")).collect()
    out = rows
    if known:
        firsts = [r[0] for r in lex.select("first").distinct().limit(LISTED_UNITS + 1).collect()]
        keys = _keys(F.col("norm"), sorted(r["n"] for r in known), unicode_borders, firsts if len(firsts) <= LISTED_UNITS else None)
        met = rows.where(F.length("norm") >= 3).select("_row", F.explode(keys).alias("k")).select("_row", "k.at", "k.key")
        if sum(r["keys"] for r in known) <= SENT_ROWS:
            met = met.join(F.broadcast(lex.select("key").distinct()), "key", "left_semi")
        hits = met.join(lex.select("key", "n", "surface_norm", "info"), "key").groupBy("_row").agg(F.collect_list(F.struct("at", "n", "surface_norm", "info")).alias("_hits"))
        out = out.join(hits, "_row", "left").withColumn("candidates", F.when(F.col("_hits").isNotNull(), _placed(F.col("norm"), F.array_sort("_hits"), unicode_borders)).otherwise(empty)).drop("_hits")
    else:
        out = out.withColumn("candidates", empty)
    if distance:
        near = near_words(docs, lexicon, distance) if near is None else near
        about = near.join(lex.where("not is_variation").select(F.col("surface_norm").alias("surface"), "info"), "surface").select("token", F.struct("token", "distance", "info").alias("near"))
        words = rows.where(F.length("norm") >= 3).select("_row", F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit(WORDS), F.lit(0)))).alias("token"))
        found = words.join(about, "token").groupBy("_row").agg(F.collect_list("near").alias("_near"))
        out = out.join(found, "_row", "left").withColumn("candidates", F.concat("candidates", F.when(F.col("_near").isNotNull(), _near_placed(F.col("norm"), F.col("_near"))).otherwise(empty))).drop("_near")
    if languages:
        out = out.withColumn("candidates", F.filter("candidates", lambda m: F.coalesce(F.array_contains(F.col(languages), m["language"]), F.lit(False))))
    return out.select(*docs.columns, "candidates")


def _match(word: Column, start: Column, info: Column, distance: Column) -> Column:
    trust = F.when(distance > 0, F.greatest(F.lit(0.5), 1 - 0.2 * distance)).otherwise(1.0)
    return F.struct(word.alias("word"), info["match"].alias("match"), start.alias("start"), (start + F.length(word)).alias("end"), info["severity"].alias("severity"), info["categories"].alias("categories"), info["language"].alias("language"), (info["confidence"] * trust).alias("confidence"), distance.alias("distance"))


def _placed(text: Column, hits: Column, unicode_borders: bool) -> Column:
    """Hits (at, n, surface_norm, info), by unit, that are whole surfaces between borders, as candidates with offsets.

    Offsets come from one walk: the units between one hit and the next are measured once."""

    def body(u: Column) -> Column:
        outer = lambda x: ~F.coalesce(x.rlike(f"^[{_inner(unicode_borders)}]"), F.lit(False))
        whole = lambda h: (F.array_join(F.slice(u, h["at"] + 1, h["n"]), "") == h["surface_norm"]) & (~outer(F.get(u, h["at"] + h["n"] - 1)) | outer(F.get(u, h["at"] + h["n"])))

        def step(a: Column, h: Column) -> Column:
            pos = a["pos"] + F.length(F.array_join(F.slice(u, a["at"] + 1, h["at"] - a["at"]), ""))
            return F.struct(h["at"].alias("at"), pos.alias("pos"), F.concat(a["out"], F.array(_match(h["surface_norm"], pos, h["info"], F.lit(0)))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("pos"), F.array().cast(f"array<{MATCH}>").alias("out"))
        return F.aggregate(F.filter(hits, whole), start, step, lambda a: a["out"])

    return let(units(text, unicode_borders), body)


def _near_placed(text: Column, near: Column) -> Column:
    """Every place of the words in `near` (token, distance, info) as candidates."""
    pieces = F.regexp_extract_all(text, F.lit(f"{WORDS}|[^{WORDS[1:]}"), F.lit(0))
    places = let(pieces, lambda p: places_of(p, F.transform(near, lambda x: x["token"])))
    of = lambda p: F.transform(F.filter(near, lambda x: x["token"] == p["word"]), lambda x: _match(p["word"], p["start"], x["info"], x["distance"]))
    return F.flatten(F.transform(places, of))
