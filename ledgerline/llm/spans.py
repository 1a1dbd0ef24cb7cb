"""Regular-expression matches with their places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128
CONTEXT = 40  # characters before a match that are kept with it
MATCH = "array<struct<start:int,end:int,match:string,before:string>>"


def matches(text: Column, pattern: str, likely: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: start, end (code points, end exclusive), match, and what stands before it.

    Places are sums of the lengths of pieces between matches and of matches, added
    up in chunks so that a text with very many matches does not cost their square.
    ``likely`` is a cheap necessary condition. A null text has no matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("match"))
    # The piece after the last match has none.
    parts = F.filter(parts, lambda x: x["match"].isNotNull())

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        item = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["piece"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(item)).alias("out"))

    def empty(kind: str) -> Column:
        return F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")),
        lambda c: F.aggregate(F.slice(parts, c * CHUNK + 1, CHUNK), empty(MATCH), add),
    )
    based = F.aggregate(
        chunks, empty(f"array<struct<base:int,items:{MATCH}>>"),
        lambda done, c: F.struct(
            (done["at"] + c["at"]).alias("at"),
            F.concat(done["out"], F.array(F.struct(done["at"].alias("base"), c["out"].alias("items")))).alias("out"),
        ),
    )["out"]
    moved = F.flatten(F.transform(based, lambda c: F.transform(c["items"], lambda m: F.struct(
        (m["start"] + c["base"]).alias("start"), (m["end"] + c["base"]).alias("end"), m["match"].alias("match"), m["before"].alias("before")
    ))))
    some = F.regexp_like(text, F.lit(pattern)) if likely is None else likely
    return F.when(some & F.regexp_like(text, F.lit(pattern)), moved).otherwise(F.array().cast(MATCH))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
