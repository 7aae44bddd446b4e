"""Fuzzy line dedup by MinHash, as DataFrame functions only.

Lines are cut at line feeds; blank lines (blanks only) stay and take no part.  A line's set is its
distinct shingles of SHINGLE characters (UTF-16 units; a shorter line is one shingle).

Signatures: a shingle's hash is mixed into three base hashes, and each XOR with a constant is one
permutation, of which the least and the greatest value are kept: PERMUTATIONS permutations give twice
as many slots.  Shingles leave their line by `explode` and end in one aggregation of code-generated
minima and maxima, combined on the map side.  Longer lines take their slots from the shingles whose hash
ends in some zero bits (VIEWS), 20 at least as a rule; views overlap, so that two similar lines stand in
one view at least.  A band is ROWS slots of different base hashes; 14 bands of 3 slots miss a pair of
similarity 0.8 with probability 4e-5, the sampling of the views makes it about 2e-3 where it is coarsest.

Candidates, in two steps; together they compare or join all lines that share a bucket:

1. In a bucket every line meets the bucket's centre only, a line drawn for this bucket.  Pairs are confirmed by exact
   Jaccard similarity of the full sets, and distributed union-find joins them.
2. In buckets of three lines or more that still hold several components, all lines of different components meet,
   however many these are: a large bucket is dealt to blocks, and every two blocks meet in a place of their own.  Of all
   buckets that two lines share the one with the least key makes the pair.

A pair's full sets are made only if its profiles allow it, which leaves out no similar pair: the sizes of the two sets, and a
bitmap of each in which every shingle turns one bit, so that bitmaps differ in no more bits than there are shingles
that one line has and the other lacks (a ninth of both sizes together at most, where 0.8 or more is similar).  With the
sizes known, one intersection of the sets confirms a pair.

The first line (by doc_id, then text hash, then place) of each component stays.

Only narrow tables are shuffled whole: slots of different lines, band keys with counts.  Texts are read
again for the lines that share a bucket.  Keys and hashes that pick rows are sent to all executors up to
BROADCAST_ROWS, which is checked, and joined by a shuffle beyond; large keys of those joins are split by
adaptive execution, and counts and minima are combined before the shuffle.

Defined cases: a null text stays null; texts of blank lines stay as they are; a document that loses
all its lines is left out by `dedup_lines`; rows with equal doc_id and text are one document and keep
the same lines; a null doc_id comes first in the order; ties are broken by text hash and place; a line
of any length is handled whole, CHUNK shingles at a time; an empty table gives no rows; other columns pass
through under their names, whatever they are.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import drop_staged
from .graph import connected_components

SHINGLE = 8
BANDS, ROWS, BASES = 14, 3, 3
PERMUTATIONS = BANDS * ROWS // 2
SIMILAR = (80, 100)
#: Rows of one number or two up to which a table that picks rows is sent to all executors.
BROADCAST_ROWS = 1_000_000
#: Shingles that a line gives at a time.
CHUNK = 1 << 16
#: Views: lines of so many shingles at most, and the zero bits that their sampled shingles' hashes end in.
VIEWS = [(96, 0), (384, 2), (1536, 4), (1 << 31, 6)]
#: A line stands in the next view too from this share of a view's most shingles.
OVERLAP = 0.8
#: Words of 64 bits of a line's profile (a power of two), and lines of a block of an open bucket, about.
PROFILE, BLOCK = 16, 512
#: A bit that keeps a shingle that isn't sampled behind all that are.
_BEHIND = 1 << 40

_draw = random.Random(20250311)
_XOR = [_draw.getrandbits(64) - (1 << 63) for _ in range(PERMUTATIONS)]
#: Slot k is the minimum of permutation k, slot PERMUTATIONS + k its maximum; permutation k uses base k % BASES.
_ORDER = [[b, b + BANDS, b + 2 * BANDS] for b in range(BANDS)]


#: Spark's setting that removes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of many slots are combined in one hash map; a second, small one before it costs more than it saves.
_ONE_MAP = {"spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}


def staged(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """A staged table; the shuffle files behind it, which nothing reads again, go as soon as it is written. The settings hold for its writing."""
    conf = df.sparkSession.conf
    wanted = {_CLEANUP: "true"} | (settings or {})
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        return common.staged(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("text is not null")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, h (hash of the line), line, of all lines that aren't blank."""
    cut = _rows(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return cut.where("trim(line) != ''").select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), "line")


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _shingle(units: Column, at: Column) -> Column:
    """Hash of the shingle that begins at the given character."""
    return F.xxhash64(F.substring(units, 2 * at + 1, F.lit(2 * SHINGLE)))


def _last(units: Column) -> Column:
    """Where the last shingle begins."""
    return F.greatest(F.floor(F.octet_length(units) / 2).cast("int") - SHINGLE, F.lit(0))


def shingle_rows(units: DataFrame, *keep: str) -> DataFrame:
    """h, the columns kept, i (from 0), s: the shingle hashes of lines (h, u, last), with repeats."""
    u = units.select("h", *keep, "u", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(CHUNK))).alias("lo"))
    u = u.select("h", *keep, "u", F.explode(F.sequence("lo", F.least(F.col("lo") + (CHUNK - 1), "last"))).alias("i"))
    return u.select("h", *keep, "i", _shingle(F.col("u"), F.col("i")).alias("s"))


def units_of(lines: DataFrame) -> DataFrame:
    """h, u (UTF-16 units), last of lines (h, line)."""
    return lines.select("h", _units(F.col("line")).alias("u")).withColumn("last", _last(F.col("u")))


def shingles_of(line: Column) -> Column:
    """The shingle hashes of a line with repeats, as an array; the array of one binds the line's units."""
    places = lambda u: F.sequence(F.lit(1), 2 * _last(u) + 1, F.lit(2))
    one = F.transform(F.array(_units(line)), lambda u: F.transform(places(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * SHINGLE)))))
    return one[0]


def band_keys(lines: DataFrame) -> DataFrame:
    """h, keys, occurs (how often): the band keys of each different line of (h, line), a row for each view."""
    n = F.col("last") + 1
    view = lambda share: sum((F.when(n > int(most * share), 1).otherwise(0) for most, _ in VIEWS[:-1]), F.lit(0))
    viewed = units_of(lines).select("h", "u", "last", F.explode(F.sequence(view(1), view(OVERLAP))).alias("v"))
    mask = F.lit(0).cast("long")
    for k, (_, bits) in enumerate(VIEWS):
        mask = F.when(F.col("v") == k, F.lit((1 << bits) - 1).cast("long")).otherwise(mask)
    s = shingle_rows(viewed.withColumn("mask", mask), "v", "mask").withColumn("taken", F.col("s").bitwiseAND(F.col("mask")) == 0)
    # the first shingle stands in for a sample that is empty
    flag = lambda on: F.when(on, F.lit(_BEHIND)).otherwise(F.lit(0).cast("long"))
    bases = [F.shiftrightunsigned(b, 32).alias(f"b{k}") for k, b in enumerate((F.col("s"), F.xxhash64("s"), F.xxhash64("s", F.lit(7))))]  # 32 bits tell slots apart and pack better
    s = s.where("taken or i = 0").select("h", "v", "i", flag(~F.col("taken")).alias("behind"), flag(F.col("taken")).alias("ahead"), *bases)
    # the flags are set once a base, above its bits, so that a slot costs one XOR and one comparison
    s = s.select("h", "v", "i", *[F.col(f"b{k}").bitwiseOR(F.col(f)).alias(f"{f}{k}") for k in range(BASES) for f in ("behind", "ahead")])
    slots = []
    for k, c in enumerate(_XOR):
        x = F.lit((c >> 32) + (1 << 31))  # the greatest of 32 bits turned: the order of signed numbers
        slots += [F.min(F.col(f"behind{k % BASES}").bitwiseXOR(x)).alias(f"s{k}"), F.max(F.col(f"ahead{k % BASES}").bitwiseXOR(x)).alias(f"s{PERMUTATIONS + k}")]
    signed = s.groupBy("h", "v").agg(F.count(F.when(F.col("i") == 0, 1)).alias("occurs"), *slots)
    return signed.select("h", "occurs", F.array(*[F.xxhash64(F.lit(b), "v", *[F.col(f"s{k}") for k in ks]) for b, ks in enumerate(_ORDER)]).alias("keys"))


def _picked(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """rows whose `on` stands in the staged table wanted: sent to all executors where it is small enough."""
    small = wanted.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if small else wanted, on, "left_semi")


def profiles_of(texts: DataFrame) -> DataFrame:
    """h, n, p0..: of different lines (h, line) how many shingles the set has, and a bitmap in which each of them turns one bit."""
    # lines are dealt before they are cut, so that no shingle is shuffled; a shingle turns its own word only
    sets = texts.repartition("h").select("h", F.array_distinct(shingles_of(F.col("line"))).alias("set"))
    # apart from the sets, so that it becomes generated code; of plain `explode` Spark infers a filter that makes the sets again
    rows = sets.select("h", F.explode_outer("set").alias("s"))
    bits = rows.select("h", F.shiftright("s", 6).bitwiseAND(F.lit(PROFILE - 1)).alias("word"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    words = bits.groupBy("h", "word").agg(F.bit_xor("bit").alias("bits"), F.count("*").alias("n"))
    of = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"p{k}") for k in range(PROFILE)]
    return words.groupBy("h").agg(F.sum("n").alias("n"), *of)


def _profile(profiles: DataFrame, x: str) -> DataFrame:
    return profiles.toDF(*[x if c == "h" else f"{c}{x}" for c in profiles.columns])


def _possible(similar: tuple[int, int]) -> Column:
    """Whether lines a and b can be similar, by their profiles: bits in which these differ are shingles that one of them lacks."""
    num, den = similar
    apart = sum((F.bit_count(F.col(f"p{k}a").bitwiseXOR(F.col(f"p{k}b"))) for k in range(PROFILE)), F.lit(0))
    return (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & ((den + num) * apart <= (den - num) * (F.col("na") + F.col("nb")))


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, na, nb: their sets' sizes) whose full sets are similar."""
    num, den = similar
    side = lambda x: texts.select(F.col("h").alias(x), F.col("line").alias(f"l{x}"))
    both = F.size(F.array_intersect(shingles_of(F.col("la")), shingles_of(F.col("lb"))))  # without repeats
    return pairs.join(side("a"), "a").join(side("b"), "b").where((num + den) * both >= num * (F.col("na") + F.col("nb"))).select("a", "b")


def buckets_of(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged tables: a, b, the pairs of each bucket's centre with its other lines; key, a, h, the buckets with three different
    lines or more and their centre; h, the lines that occur more than once."""
    bands = [f"k{b}" for b in range(BANDS)]  # columns are written and read faster than an array
    signed = staged(band_keys(lines).select("h", "occurs", *[F.get("keys", F.lit(b)).alias(k) for b, k in enumerate(bands)]), "bands", _ONE_MAP)
    repeated = staged(signed.where("occurs > 1").select("h").distinct(), "repeated")
    keys = signed.select("h", F.explode(F.array(*bands)).alias("key")).where("key is not null")
    drawn = F.expr("h ^ key")  # its least is another line's in each bucket; of two lines one has the least and one the greatest
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("k"), F.min(drawn).alias("a"), F.max(drawn).alias("b")).where("k > 1").select("key", "k", F.expr("a ^ key").alias("a"), F.expr("b ^ key").alias("b")), "shared", _ONE_MAP)
    large = staged(shared.where("k > 2").select("key", "a"), "large")
    small = large.count() <= BROADCAST_ROWS
    members = staged(keys.join(F.broadcast(large) if small else large, "key").select("key", "a", "h"), "members")
    drop_staged(signed)
    drop_staged(large)
    pairs = shared.where("k = 2").select("a", "b").unionByName(members.where("a != h").select("a", F.col("h").alias("b")))
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    drop_staged(shared)
    return pairs, members, repeated


def open_pairs(members: DataFrame, labels: DataFrame, profiles: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b, na, nb: all pairs of different components in a bucket that can be similar, and their sets' sizes."""
    named = members.join(labels.withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("label", "h").alias("label"))
    state = named.groupBy("key").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    opened = named.join(state.where("lo != hi").select("key", "k"), "key")
    # a line has BANDS keys in each of its views at most
    lists = opened.groupBy("h", "label").agg(F.collect_list(F.struct("key", "k")).alias("all")).join(profiles, "h")
    opened = lists.withColumn("keys", F.col("all.key")).select("*", F.inline("all")).drop("all")
    # a bucket's lines are dealt to blocks, and every two blocks meet in a place of their own
    blocks = F.ceil(F.col("k") / BLOCK)
    dealt = opened.withColumn("own", F.pmod(F.xxhash64("h"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "k")
    side = lambda x: dealt.toDF(*[c if c in ("key", "i", "j") else x if c == "h" else f"{c}{x}" for c in dealt.columns])
    met = side("a").join(side("b"), ["key", "i", "j"]).where("a < b and labela != labelb and (i = j or owna != ownb)")
    first = F.array_min(F.array_intersect("keysa", "keysb")) == F.col("key")  # a pair is made in one bucket only
    return met.where(first & _possible(similar)).select("a", "b", "na", "nb")


def line_components(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """node, label: the components of the lines that are linked with any other."""
    return _components(docs, similar)[0]


def _components(docs: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """node, label: the components of the lines that are linked with any other; h, the lines that occur more than once."""
    lines = lines_of(docs).select("h", "line")
    pairs, members, repeated = buckets_of(lines)
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "ends")
    texts = staged(_picked(lines, ends, "h").dropDuplicates(["h"]), "texts")
    drop_staged(ends)
    profiles = staged(profiles_of(texts), "profiles", _ONE_MAP)
    possible = pairs.join(_profile(profiles, "a"), "a").join(_profile(profiles, "b"), "b").where(_possible(similar)).select("a", "b", "na", "nb")
    links = staged(_confirmed(possible, texts, similar), "links")
    drop_staged(pairs)
    labels = connected_components(links)
    more = staged(open_pairs(members, labels, profiles, similar), "pairs")
    drop_staged(members)
    drop_staged(profiles)
    more = staged(_confirmed(more, texts, similar), "links")
    drop_staged(texts)
    if more.isEmpty():
        return labels, repeated
    # components of components
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    joined = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = connected_components(staged(joined.where("a != b").distinct(), "links"))
    known = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left")
    return staged(known.select("node", F.coalesce("last", "label").alias("label")).unionByName(merged).distinct(), "components"), repeated


def duplicate_lines(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, th, dropped: the places of the lines that go, for the documents that lose any."""
    labels, repeated = _components(docs, similar)
    # only lines that occur again or are linked can go
    named = staged(repeated.join(labels.withColumnRenamed("node", "h"), "h", "full").select("h", F.coalesce("label", "h").alias("label")), "named")
    seen = lines_of(docs).select("h", "doc_id", "th", "pos")
    small = named.count() <= BROADCAST_ROWS
    places = staged(seen.join(F.broadcast(named) if small else named, "h").select("label", F.struct("doc_id", "th", "pos").alias("o")), "places")
    keepers = staged(places.groupBy("label").agg(F.min("o").alias("keeper")), "keepers")
    small = keepers.count() <= BROADCAST_ROWS // 2
    gone = places.join(F.broadcast(keepers) if small else keepers, "label").where(~F.col("o").eqNullSafe(F.col("keeper"))).select("o.doc_id", "o.th", "o.pos")
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))  # no more than a document's lines


def dedup_lines(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents without their duplicate lines, all other columns as they are."""
    columns = docs.columns
    named = docs.select(*[docs[c] for c in columns], docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))).toDF(*[f"c{i}" for i in range(len(columns))], "k_doc", "k_th")
    gone = duplicate_lines(docs, similar).toDF("g_doc", "g_th", "dropped")
    joined = named.join(gone, F.col("k_doc").eqNullSafe(F.col("g_doc")) & (F.col("k_th") == F.col("g_th")), "left")
    text = f"c{columns.index('text')}"
    left = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("dropped", i))
    joined = joined.withColumn("left", F.when(F.col("dropped").isNotNull(), F.array_join(left, "\n")))
    joined = joined.where(F.col("dropped").isNull() | (F.trim(F.translate("left", "\n", "")) != ""))
    out = [F.coalesce("left", text) if f"c{i}" == text else F.col(f"c{i}") for i in range(len(columns))]
    return joined.select(*out).toDF(*columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    gone = duplicate_lines(docs).toDF("g_doc", "g_th", "dropped")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("th") == F.col("g_th")), "left")
    n = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
