"""Where things are in a text: an index made once for each text, asked once for each match.

A substring of a long text is found by walking from its start, so cutting one for each match costs length times matches.  Here a text is
cut into chunks and into sentences once; a match bisects their offsets and touches the chunk or two that it lies in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE, let

#: Characters of a chunk, and elements that a running sum handles at once.
CHUNK, BLOCK = 512, 128


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, lo: Column, hi: Column) -> Column:
    """The characters from lo to before hi of a text in chunks."""
    first = F.floor(lo / CHUNK).cast("int")
    n = F.floor((F.greatest(hi, lo + 1) - 1) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(parts, first + 1, n), ""), lo - first * CHUNK + 1, F.greatest(hi - lo, F.lit(0)))


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What `add` (associative) has put together up to each element; block by block, so that the work grows with the elements."""
    none = F.slice(F.array(zero), 1, 0)

    def within(x: Column, head: Column) -> Column:
        step = lambda a, v: let(add(a["at"], v), lambda c: F.struct(c.alias("at"), F.concat(a["out"], F.array(c)).alias("out")))
        return F.aggregate(x, F.struct(head.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def body(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, zero, add))
        heads = F.slice(F.concat(F.array(zero), within(totals, zero)), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, heads, within))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    return let(let(values, blocks), body)


def last_up_to(offsets: Column, at: Column) -> Column:
    """The last index of ascending offsets, the first of which is 0, whose offset is not beyond `at`."""

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        return let(mid, lambda m: F.when(F.get(offsets, m) <= at, F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(offsets).cast("double"))).cast("int") + 1)
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(offsets).alias("hi")), step, lambda a: a["lo"])


def sentences(text: Column, marks: str = r"\.") -> Column:
    """The text's pieces between the marks: offsets (of their starts), lengths, and the white space at their two ends."""

    def body(pieces: Column) -> Column:
        n = F.transform(pieces, lambda p: F.length(p))
        ends = running(F.transform(n, lambda x: x + 1), F.lit(0), lambda a, b: a + b)
        starts = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(pieces))
        left = F.transform(pieces, lambda p: F.length(p) - F.length(F.regexp_replace(p, f"^{SPACE}+", "")))
        right = F.transform(pieces, lambda p: F.length(p) - F.length(F.regexp_replace(p, f"{SPACE}+$", "")))
        return F.struct(starts.alias("starts"), n.alias("lengths"), left.alias("left"), right.alias("right"), pieces.alias("pieces"))

    return let(F.split(text, marks, -1), body)


def by_match(text: Column, matches: Column, index: Callable[[Column], Column], one: Callable[[Column, Column], Column]) -> Column:
    """one(match, index of the text) for each match; a text without matches isn't indexed."""
    return let(matches, lambda found: let(F.when(F.size(found) > 0, index(text)), lambda ix: F.transform(found, lambda m: one(m, ix))))
