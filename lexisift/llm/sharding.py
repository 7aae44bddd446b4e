"""Sharding: a hierarchical weighted hash tree.

A row descends region, rack and shard levels.  At each level every child draws -ln(u) / weight from a
hash of the row's key and the child's path, and the least draw wins, so each child gets rows in
proportion to its weight, and a weight that changes moves rows only into or out of that child.  A
child's weight is the number of shards below it.  A new shard opens a region of its own: of all
children at all levels only that new one draws anew, so rows move into the new shard and nowhere else
(law `key`: the key and the tree decide).

All of it is DataFrame functions.  Slots are numbered in salted parts of a shard, whose sizes are
summed beforehand, so that no task holds a whole shard.

Defined cases: a null text has 0 bytes and the crc32 of nothing; a null doc_id is the key "null";
equal doc_ids meet in one shard; repeated rows get slots of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tree: regions, each a list of racks, each a list of shard numbers.
Tree = list[list[list[int]]]
ROWS_A_PART = 250_000


def even_tree(regions: int = 4, racks: int = 5, shards: int = 2) -> Tree:
    n = iter(range(regions * racks * shards))
    return [[[next(n) for _ in range(shards)] for _ in range(racks)] for _ in range(regions)]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of an md5 of key and path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _nested(x: object) -> Column:
    return F.array(*map(_nested, x)) if isinstance(x, list) else F.lit(x)


def _winner(key: Column, above: Column, weights: Column) -> Column:
    """(draw, child) with the least draw among the children below the node `above`, whose weights are given."""
    return F.array_min(F.transform(weights, lambda w, i: F.struct(_draw(key, F.concat(above, i.cast("string")), w.cast("double")).alias("draw"), i.alias("child"))))


def place(rows: DataFrame, key: Column, tree: Tree) -> DataFrame:
    """rows with `_region` (draw, child), `_rack`, `_leaf` and `shard`: one level's draws after another."""
    weights = [sum(map(len, region)) for region in tree]
    racks = [[len(rack) for rack in region] for region in tree]
    ones = [[[1] * len(rack) for rack in region] for region in tree]
    rows = rows.withColumn("_region", _winner(key, F.lit("r"), _nested(weights)))
    region = F.col("_region.child")
    rows = rows.withColumn("_rack", _winner(key, F.concat(F.lit("r"), region, F.lit("/k")), F.get(_nested(racks), region))["child"])
    rack = F.col("_rack")
    rows = rows.withColumn("_leaf", _winner(key, F.concat(F.lit("r"), region, F.lit("/k"), rack, F.lit("/s")), F.get(F.get(_nested(ones), region), rack))["child"])
    return rows.withColumn("shard", F.get(F.get(F.get(_nested(tree), region), rack), F.col("_leaf")).cast("int"))


def assign_shards(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard), grown_shard (with one more shard)."""
    tree = tree or even_tree()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    n_shards = sum(len(rack) for region in tree for rack in region)
    if sorted(s for region in tree for rack in region for s in rack) != list(range(n_shards)):
        raise ValueError("shards are numbered from 0 without gaps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = place(rows, key, tree)
    # the grown tree: the old regions' draws stand, the new region of weight 1 draws beside them
    moves = _draw(key, F.lit(f"r{len(tree)}"), F.lit(1.0)) < F.col("_region.draw")
    rows = rows.select("doc_id", "size", "text_crc32", "shard", F.when(moves, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("grown_shard"))
    count = docs.count()  # column pruning leaves the footers' row counts
    parts = max(1, -(-count // (ROWS_A_PART * n_shards)))
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int")
    rows = rows.withColumn("_part", salt)
    # rows a (shard, part): a few numbers for each, summed where the rows are
    sizes = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    slots = rows.withColumn("_k", F.row_number().over(inside) - 1)
    out = slots.join(first, ["shard", "_part"]) if parts > 1 else slots.withColumn("_first", F.lit(0))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_k")).cast("long").alias("slot"), "grown_shard")


def op7(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
