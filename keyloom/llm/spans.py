"""Spans of pattern matches in whole texts, in DataFrame functions alone.

Positions count code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches summed in one go; carries pass from one run to the next.
RUN = 256
SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>>: the leftmost non-overlapping matches of a pattern that matches no empty text.

    Starts are running sums of the lengths of the pieces between matches and of
    the matches; runs of RUN keep the cost of very many matches near linear.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return located(found, F.split(text, pattern, -1))


def located(found: Column, pieces: Column) -> Column:
    both = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"))
    none = F.array().cast(SPAN)

    def one(s: Column, x: Column) -> Column:
        start = s["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

    def run(s: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(s["all"], at, F.lit(RUN)), F.struct(s["pos"].alias("pos"), none.alias("out")), one)
        return F.struct(inner["pos"].alias("pos"), F.concat(s["out"], F.array(inner["out"])).alias("out"), s["all"].alias("all"))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"), both.alias("all"))
    whole = F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(RUN)), start, run, lambda s: F.flatten(s["out"]))
    few = F.aggregate(both, F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out")), one, lambda s: s["out"])
    return F.when(F.size(found) == 0, none).when(F.size(found) <= RUN, few).otherwise(whole)


def when_has(test: Column, value: Column) -> Column:
    """``value`` where a cheap test says that the text may hold a match, else no spans."""
    return F.when(test, value).otherwise(F.array().cast(SPAN))


def tagged(by_kind: dict[str, Column]) -> Column:
    """All spans as array<struct<start, nr, end, kind>>, by start, then by the order of kinds."""
    def tag(kind: str, nr: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(nr).alias("nr"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(tag(k, i, c) for i, (k, c) in enumerate(by_kind.items()))))


def joined(tags: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(tags, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(start: Column, end: Column, tags: Column) -> Column:
    """Whether [start, end) meets none of the spans."""
    return F.forall(tags, lambda s: (s["end"] <= start) | (s["start"] >= end))
