"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source s has a token target T_s. Rates stay as close as they can (in relative entropy) to one
copy of each document, subject to the token constraints and to at most ``most`` copies; the
solution is r_d = min(most, exp(lambda_s x_d)), with x_d the document's size in mean sizes of its
source. The convex dual is solved by Newton iterations on log tokens, bracketed so that they
cannot run off. Documents of equal source and size have equal rates, so each iteration aggregates
the table of such classes, not the documents. Rates are then rounded: every class takes whole
copies, and leftover tokens are filled by classes in order, largest first, until none fits.
Within a class extra copies go to the documents of least content hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import numbered
from .common import WORD, bounded_join, cut, packed

_BUCKETS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null; null sources have one of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """skey, source_size and target of each source; sources: skey, source, source_size, a written table.

    Weights repeat over the sources by code point, null last. Sources whose part of ``share``
    times all tokens would pass ``most`` times their size stop there, and the excess goes to the
    rest by weight until none is above: the level of the rest rises with each round of stops. Only
    sums come to the driver, and sources are numbered in ranges, however many there are.
    """
    placed = numbered(sources.withColumn("_no", F.col("source").isNull()), [F.col("_no"), F.col("source")], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut(placed.select("skey", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")))
    total = share * float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, before = 0.0, None
    while True:
        over = F.col("cap") < level * F.col("w")
        got = weighed.agg(_exact(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"), _exact(F.when(over, 0.0).otherwise(F.col("w"))).alias("free"), F.sum(over.cast("long")).alias("stopped")).first()
        if not got["free"] or got["stopped"] == before:
            break
        level, before = (total - got["caps"]) / got["free"], got["stopped"]
    return weighed.select("skey", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target") if got["free"] else F.col("cap").alias("target"))


def _exact(c: Column) -> Column:
    """A sum that doesn't depend on the order of its terms, so that reruns agree."""
    return F.sum(c.cast("decimal(34,9)")).cast("double")


def solve_dual(classes: DataFrame, goals: DataFrame, most: float, rounds: int = 40, near: float = 1e-7) -> DataFrame:
    """skey and lam: the multiplier of each source. classes: skey, size, n; goals: skey, source_size, target."""
    docs = classes.groupBy("skey").agg(F.sum("n").alias("docs"))
    state = goals.join(docs, "skey").select(
        "skey", "target", (F.col("source_size") / F.col("docs")).alias("unit"), F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"),
        ((F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size"))).alias("done"),
    )
    state = cut(state)
    for _ in range(rounds):
        x = F.col("size") / F.col("unit")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(60.0)))
        got, slope = F.col("n") * F.col("size") * F.least(rate, F.lit(most)), F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)
        sums = classes.where("size > 0").join(state.where("not done"), "skey").groupBy("skey").agg(_exact(got).alias("g"), _exact(slope).alias("dg"))
        step = F.col("lam") - F.col("g") * (F.log("g") - F.log("target")) / F.col("dg")
        lo, hi = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("g") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        moved = state.join(sums, "skey", "left").withColumn("lo2", lo).withColumn("hi2", hi)
        inside = (F.col("dg") > 0) & (step > F.col("lo2")) & (step < F.col("hi2"))
        done = F.col("done") | (F.abs(F.col("g") - F.col("target")) <= near * F.col("target")) | F.col("g").isNull()
        state = cut(
            moved.select(
                "skey", "target", "unit", F.when(done, F.col("lam")).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"),
                F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), done.alias("done"),
            )
        )
        if state.where("not done").limit(1).count() == 0:
            break
    return state.select("skey", "lam", "unit")


def _rounded(classes: DataFrame, most: int) -> DataFrame:
    """Adds m, whole copies of each class, to skey, size, n, target, rate: their tokens meet each target."""
    want = F.col("n") * F.col("rate")
    now = classes.withColumn("m", F.least(F.floor(want + 1e-9), F.col("n") * most)).withColumn("part", want - F.col("m"))
    now = now.withColumn("hash", F.xxhash64("skey", "size"))
    largest = [F.col("size").desc(), F.col("hash")]
    gap, room = F.col("gap"), (F.col("size") > 0) & (F.col("m") < F.col("n") * most)
    for order in ([F.col("part").desc(), F.col("hash")], largest, largest, largest, largest):
        now = now.withColumn("gap", F.col("target") - F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("skey")))
        fits = room & (F.col("size") <= gap)
        run = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(Window.partitionBy("skey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        now = now.withColumn("m", F.col("m") + F.when(fits & (run <= gap), 1).otherwise(0))
    # one class may pass the target if that comes nearer to it
    now = now.withColumn("gap", F.col("target") - F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("skey")))
    nearest = F.row_number().over(Window.partitionBy("skey").orderBy(~room, F.abs(F.col("size") - gap), "hash"))
    now = now.withColumn("m", F.col("m") + F.when(room & (nearest == 1) & (F.col("size") < 2 * gap), 1).otherwise(0))
    return now.select("skey", "size", "n", "m")


def copies_by_class(base: DataFrame, weights: list[float], share: float, most: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(classes: skey, size, n, whole, extra_below; goals: skey, source_size, target).

    base: skey, source, size, h. A document takes ``whole`` copies, and one more if its h (then
    unsigned) is below extra_below or equal to it.
    """
    classes = cut(base.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    sources = cut(classes.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.first("source").alias("source")))
    goals = cut(targets(sources, weights, share, most))
    lam = solve_dual(classes, goals, most)
    full = F.col("target") >= most * F.col("source_size")
    rate = F.when(full, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("unit"), F.lit(60.0)))))
    rated = classes.join(goals, "skey").join(lam, "skey").withColumn("rate", F.when(F.col("source_size") == 0, 1.0).otherwise(rate))
    rounded = cut(_rounded(rated.select("skey", "size", "n", "target", "rate"), most))
    split = rounded.withColumn("whole", F.floor(F.col("m") / F.col("n"))).withColumn("k", F.col("m") - F.col("whole") * F.col("n")).drop("m")
    # the k-th smallest hash of a class: first its bucket, by counts, then its rank within that bucket alone
    some = split.where("k > 0").select("skey", "size", "k")
    # (buckets of a class are counted before any shuffle, and a class meets its bucket's rows alone)
    hashed = base.select("skey", "size", "h", F.shiftrightunsigned("h", 54).cast("int").alias("bucket"))
    per = hashed.groupBy("skey", "size", "bucket").agg(F.count("*").alias("c")).join(some, ["skey", "size"])
    upto = F.sum("c").over(Window.partitionBy("skey", "size").orderBy("bucket"))
    crossing = cut(per.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("skey", "size", "bucket", (F.col("k") - F.col("upto") + F.col("c")).alias("nth")))
    unsigned = F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy(unsigned))
    near = bounded_join(hashed, crossing, ["skey", "size", "bucket"], "inner", broadcast_rows)
    last = near.withColumn("rank", rank).where("rank = nth").select("skey", "size", unsigned.alias("extra_below"))
    return cut(split.select("skey", "size", "n", "whole").join(last, ["skey", "size"], "left")), goals


def _copies(h: Column) -> Column:
    extra = h.bitwiseXOR(F.lit(-(2**63)).cast("long")) <= F.col("extra_below")
    return F.col("whole") + F.coalesce(extra.cast("long"), F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", broadcast_rows: int = 300_000) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs.

    Null texts have size 0 and take one copy; a null source is a source of its own; ids may be
    null. Rows equal in id and text share their hash, so they are taken alike, and a class of
    nothing else may miss its whole number of copies by their number. Every value is settled by
    the rows alone, so reruns agree. An empty table gives no rows; other columns are not read.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    base = cut(named.select("doc_id", "source", source_key(F.col("source")).alias("skey"), size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")))
    classes, goals = copies_by_class(base, list(weights), share, most, broadcast_rows)
    of_class = cut(classes.join(goals, "skey"))
    out = bounded_join(base, of_class, ["skey", "size"], "inner", broadcast_rows, counted="n").withColumn("copies", _copies(F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", broadcast_rows: int = 300_000) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns are kept. Cases are as in ``mix``."""
    rows = packed(docs, skey=source_key(F.col(f"`{source}`")), source=F.col(f"`{source}`"), size=size_of(F.col(f"`{text}`")), h=F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    base = cut(rows.select("skey", "source", "size", "h"))
    classes, _ = copies_by_class(base, list(weights), share, most, broadcast_rows)
    taken = bounded_join(rows.drop("source"), classes, ["skey", "size"], "inner", broadcast_rows, counted="n").withColumn("copies", _copies(F.col("h"))).where("copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
