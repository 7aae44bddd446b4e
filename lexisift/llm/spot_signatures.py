"""Document fingerprints: SpotSigs, sets of chains of content words behind common words.

A spot is a common word (function words of four languages) that a content word follows.  Its signature
is the spot and the next CHAIN content words, other common words skipped.  Text without common words
has spots too: the text's start, and, more than GAP words behind the last common one, every content word whose
hash is a multiple of RARE.  All of that depends on the words near by only, so a change in one place
of a text leaves the signatures of all others.

A fingerprint is the set of a text's signatures (the k-th occurrence of one is an element of its own), as sorted
32-bit numbers, little-endian, in hexadecimal.  Likeness is the
Jaccard similarity of two sets.  Pairs are dealt into partitions of similar set lengths and merged a
partition at a time; with a threshold, pairs whose lengths already rule it out are not looked at, and
of the others only the part of the longer set within the range of the shorter one is.

Neighbours by doc_id are found without a sort of the whole table: buckets of doc_ids between quantiles
hold about ROWS_A_BUCKET documents each, the first document of a bucket is also sent to the bucket
before, and a window inside each bucket gives every document its next one.  The first doc_ids of the
buckets are sent to all tasks; their number is that of the buckets.

Defined cases: a null text is empty; texts without words, or with common words only, have one
signature, the hash of their lower-cased bytes, and an empty one has none; equal fingerprints have
likeness 1 (empty ones too), otherwise an empty one 0; a null doc_id comes last; equal doc_ids come in the
order of their texts' hashes, then texts; repeated rows are rows of their own; a lone document is its own next one;
very long texts are steps of their own and read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, binaries, byte_class, distinct_in, give_back, hash_spans, mix, n_partitions, ranges, spans, steps, text_buffer

CHAIN, GAP, RARE = 2, 6, 4
ROWS_A_BUCKET = 20_000

#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), negate=True)

#: Function words of English, German, French and Spanish (fixed values).
# fmt: off
COMMON = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "not", "of", "on", "or", "she", "so", "than", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "when", "which", "who", "will", "with", "you"],
    "de": ["aber", "als", "am", "an", "auch", "auf", "aus", "bei", "bis", "da", "das", "dass", "dem", "den", "der", "des", "die", "du", "ein", "eine", "einem", "einen", "einer", "er", "es", "für", "hat", "ich", "im", "in", "ist", "kann", "mit", "nach", "nicht", "noch", "nur", "oder", "sich", "sie", "sind", "so", "und", "uns", "vom", "von", "vor", "war", "was", "wie", "wir", "zu", "zum", "zur", "über"],
    "fr": ["au", "aux", "avec", "car", "ce", "ces", "cette", "comme", "dans", "de", "des", "donc", "du", "elle", "en", "est", "et", "été", "il", "ils", "je", "la", "le", "les", "leur", "lui", "mais", "ne", "nous", "on", "ou", "où", "par", "pas", "plus", "pour", "qu", "que", "qui", "sa", "sans", "se", "ses", "si", "son", "sont", "sur", "un", "une", "vous", "à"],
    "es": ["a", "al", "como", "con", "de", "del", "desde", "donde", "el", "ella", "en", "entre", "era", "es", "esta", "este", "fue", "ha", "hay", "la", "las", "le", "lo", "los", "más", "me", "mi", "muy", "no", "o", "para", "pero", "por", "porque", "que", "se", "ser", "si", "sin", "sobre", "son", "su", "sus", "también", "un", "una", "y", "ya"],
}
# fmt: on


def _common() -> np.ndarray:
    words = [w.encode() for w in sorted(set().union(*COMMON.values()))]
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hash_spans(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends))


_KNOWN = _common()


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct signatures (32 bits) in ascending order, and their offsets."""
    buf, offs = text_buffer(texts)
    buf = LOWER[buf]
    starts, ends, woffs = spans(buf, offs, WORD)
    rows = len(offs) - 1
    h = hash_spans(buf, starts, ends)
    row = np.repeat(np.arange(rows), np.diff(woffs))
    common = _KNOWN[np.minimum(np.searchsorted(_KNOWN, h), len(_KNOWN) - 1)] == h
    at = np.arange(len(h))
    # how far behind the last common word of the same text (its start counts as one)
    last = np.maximum.accumulate(np.where(common, at, -1)) if len(h) else at
    last = np.maximum(last, woffs[row] - 1)
    content = np.flatnonzero(~common)
    crow = row[content]
    following = np.searchsorted(content, at, side="right")
    # a common word directly before a content word, a chance spot far from any, or the start of a text
    direct = np.zeros(len(h), bool)
    if len(h) > 1:
        direct[:-1] = common[:-1] & ~common[1:] & (row[1:] == row[:-1])
    far = ~common & (at - last > GAP) & (h % np.uint64(RARE) == 0)
    spot = np.flatnonzero(direct | far)
    first = np.searchsorted(content, woffs[:-1])
    begins = np.flatnonzero(np.diff(np.append(first, len(content))) > 0)
    word = np.concatenate([h[spot], np.zeros(len(begins), np.uint64)])
    of = np.concatenate([row[spot], begins])
    chain = np.concatenate([following[spot], first[begins]])
    sig, any_ = mix(word + np.uint64(1)), np.zeros(len(of), bool)
    for k in range(CHAIN):
        n = np.minimum(chain + k, max(0, len(content) - 1))
        here = (chain + k < len(content)) & (crow[n] == of) if len(content) else any_
        sig = np.where(here, mix(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[n]]), sig) if len(content) else sig
        any_ = any_ | here
    sig, of = sig[any_], of[any_]
    bare = np.flatnonzero((np.bincount(of, minlength=rows) == 0) & (np.diff(offs) > 0))
    sig = np.concatenate([sig, hash_spans(buf, offs[:-1][bare], offs[1:][bare])])
    of = np.concatenate([of, bare])
    # a signature's k-th occurrence in its text is an element of its own, so that sets weigh repeated passages
    order = np.lexsort((sig, of))
    sig, of = sig[order], of[order]
    if len(sig):
        new = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])]))
        times = np.arange(len(sig)) - np.repeat(new, np.diff(np.append(new, len(sig))))
        sig = np.where(times > 0, mix(sig + times.astype(np.uint64)), sig)
    return distinct_in((sig >> np.uint64(32)).astype(np.uint32), np.searchsorted(of, np.arange(rows + 1)))


def likeness(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray, at_least: float = 0.0) -> np.ndarray:
    """Jaccard similarity of the k-th set of a and of b (sorted, distinct); 0 for pairs below at_least."""
    na, nb = np.diff(ao), np.diff(bo)
    out = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    least, most = np.minimum(na, nb), np.maximum(na, nb)
    go = np.flatnonzero((least > 0) & (least >= at_least * most))
    # partitions by the logarithm of the longer set's length: sets of one partition are merged together
    part = np.frexp(most[go].astype(np.float64))[1]
    for p in np.unique(part):
        of = go[part == p]
        both = _shared(a, ao, b, bo, of)
        j = both / (na[of] + nb[of] - both)
        out[of] = np.where(j >= at_least, j, 0.0)
    return out


def _shared(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many values the pairs `of` share; values outside the range of the other set are left out first."""
    def side(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray) -> np.ndarray:
        n = xo[of + 1] - xo[of]
        v, pair = x[ranges(xo[of], n)], np.repeat(np.arange(len(of), dtype=np.uint64), n)
        inside = (v >= np.repeat(y[yo[of]], n)) & (v <= np.repeat(y[yo[of + 1] - 1], n))
        return (pair[inside] << np.uint64(32)) | v[inside]

    both = np.sort(np.concatenate([side(a, ao, b, bo), side(b, bo, a, ao)]), kind="stable")
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(of))


def _bytes(h: np.ndarray, offs: np.ndarray) -> pa.Array:
    return binaries(h.astype("<u4").view(np.uint8), offs * 4)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each bucket's last ones only there to be next ones: (row, guest, text, edited, ...) to fingerprints and likenesses."""
    held: tuple | None = None
    names: list[str] = []

    def compared(row: pa.RecordBatch, own: tuple, edited: tuple, follow: tuple) -> pa.RecordBatch:
        mine = pa.array(~row.column("guest").to_numpy(zero_copy_only=False))
        cols = [*(row.column(c) for c in names), _bytes(*own), _bytes(*edited), pa.array(likeness(*own, *edited)), pa.array(likeness(*own, *follow))]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).filter(mine)

    def cut(x: tuple, lo: int, hi: int) -> tuple:
        h, o = x
        return h[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]

    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("text", "edited", "guest")]
        for part in steps(batch, "text"):
            own, edited = signatures(part.column("text")), signatures(part.column("edited"))
            if held:
                yield compared(*held, cut(own, 0, 1))
            n = part.num_rows
            if n > 1:
                yield compared(part.slice(0, n - 1), cut(own, 0, n - 1), cut(edited, 0, n - 1), cut(own, 1, n))
            last = part.slice(n - 1, 1)
            keep = pa.RecordBatch.from_arrays([last.column(c) for c in (*names, "guest")], names=[*names, "guest"])
            held = keep, cut(own, n - 1, n), cut(edited, n - 1, n)
    if held:
        yield compared(*held, (np.zeros(0, np.uint32), np.zeros(2, np.int64)))
    give_back()


def with_next(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows (key, text) with `next_text`, the text of the next row by falling key (after the last: the first), sorted within
    buckets.  Behind a bucket's rows stand those of equal first key of the bucket after it, marked `guest`, as its last row's next one."""
    spark = rows.sparkSession
    number = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    count = rows.count()
    wanted = max(n_partitions(spark), -(-count // ROWS_A_BUCKET))
    quantiles = rows.select(number.alias("k")).where(F.col("k") > F.lit(float("-inf"))).approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if count and wanted > 1 else []
    splits = [float("-inf"), *sorted(set(quantiles) - {float("-inf"), float("inf")}), float("inf")]
    keyed = rows.withColumn("_k", number)
    keyed = Bucketizer(splits=splits, inputCol="_k", outputCol="_b").transform(keyed) if len(splits) > 2 else keyed.withColumn("_b", F.lit(0.0))
    cut = keyed.withColumn("bucket", (F.lit(len(splits) - 2) - F.col("_b")).cast("int")).drop("_b")
    firsts = cut.groupBy("bucket").agg(F.max("_k").alias("_k")).orderBy("bucket").collect()
    before = [(r["bucket"], r["_k"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    sent = spark.createDataFrame(before, "bucket int, _k double, _to int")
    both = cut.join(F.broadcast(sent), ["bucket", "_k"], "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("guest"))
    dealt = both.withColumn("_p", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there)))).select(*rows.columns, "_p.bucket", "_p.guest")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last(key), F.xxhash64(text), text)
    return dealt.withColumn("next_text", F.lead(text).over(order))


def edited(text: Column, following: Column) -> Column:
    """The last third of the text's code points replaced by the first as many of the following text."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the edited text's digest), fingerprint and edited_fingerprint (binary: sorted 32-bit
    signatures), near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = with_next(rows).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    out = out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "guest", "text", "edited")
    return out.mapInArrow(_fingerprinted, "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
