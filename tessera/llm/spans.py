"""Spans of text with their places, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks put around matches; a text's own become HIDDEN, which no pattern knows either.
OPEN, CLOSE, HIDDEN = "\ue000", "\ue001", "\ue002"
#: Characters before a match that are kept with it.
WINDOW = 40
#: Pieces of a text in a block.
BLOCK = 128
MATCH = "struct<kind:int,start:long,stop:long,body:string,before:string,after:string>"
MATCHES = f"array<{MATCH}>"


def marked_free(text: Column) -> Column:
    """A text with no marks of its own, of the same length."""
    return F.translate(text, OPEN + CLOSE, HIDDEN * 2)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: elsewhere a value named twice, or within a lambda, is computed each time."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as array<struct(kind, start, stop, body, before, after)>, in code points.

    Matches are wrapped in marks, the text is split at them, and lengths of the pieces give the places. Pieces are taken in
    blocks of BLOCK: a first fold finds where each block starts, a second one the matches in it, so that no fold carries
    more than a block's matches or a place for each block, and the work is in proportion to the text.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    none, long = F.array().cast(MATCHES), "array<struct<at:long,tail:string>>"

    def moved(a: Column, p: Column) -> Column:
        tail = F.right(F.concat(a["tail"], F.translate(F.right(p, F.lit(WINDOW + 1)), CLOSE, "")), F.lit(WINDOW))
        return F.struct((a["at"] + F.length(p) - 1).cast("long").alias("at"), tail.alias("tail"))

    def head(a: Column, b: Column) -> Column:
        here = F.struct(a["at"].alias("at"), a["tail"].alias("tail"))
        return bound(F.aggregate(b, here, moved), lambda e: F.struct(e["at"].alias("at"), e["tail"].alias("tail"), F.concat(a["heads"], F.array(here)).alias("heads")))

    def step(a: Column, p: Column) -> Column:
        n = F.instr(p, CLOSE) - 1
        found = F.struct(
            F.lit(kind).alias("kind"), a["at"].alias("start"), (a["at"] + n).alias("stop"), F.substr(p, F.lit(1), n).alias("body"),
            a["tail"].alias("before"), F.substr(p, n + 2, F.lit(1)).alias("after"),
        ).cast(MATCH)
        return bound(moved(a, p), lambda m: F.struct(m["at"].alias("at"), m["tail"].alias("tail"), F.concat(a["found"], F.array(found)).alias("found")))

    def inside(b: Column, h: Column) -> Column:
        return F.aggregate(b, F.struct(h["at"].alias("at"), h["tail"].alias("tail"), none.alias("found")), step)["found"]

    def listed(ps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(2), F.size(ps), F.lit(BLOCK)), lambda k: F.slice(ps, k, F.lit(BLOCK)))
        first = F.struct(F.length(ps[0]).cast("long").alias("at"), F.right(ps[0], F.lit(WINDOW)).alias("tail"), F.array().cast(long).alias("heads"))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, first, head)["heads"], inside)))

    return bound(parts, lambda ps: F.when(F.size(ps) > 1, listed(ps)).otherwise(none))
