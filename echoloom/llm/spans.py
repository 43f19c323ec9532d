"""Matches of a regular expression as spans, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, regex: str) -> Column:
    """Array of (s, e, m): leftmost non-overlapping matches, code points, end exclusive.

    The text between matches and the matches themselves give all places by adding up lengths.
    """
    both = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("l"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["l"]
        more = F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))
        return F.when(x["m"].isNull(), acc).otherwise(more)

    return F.when(text.rlike(regex), F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(none())


def labelled(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def counted(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def listed(all_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, found: Column) -> Column:
    """text with each span replaced by <KIND>; spans (kind, s, e), of which overlapping ones become one."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["s"], -x["e"], x["kind"], x["e"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        fresh = F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"))
        longer = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when((x["s"] >= acc["at"]), fresh).otherwise(longer)

    named = F.transform(order, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    whole = F.aggregate(named, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
