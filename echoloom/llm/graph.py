"""Connected components by alternating large and small stars.

Every round is two aggregations and two equi-joins on the edges; a component of any diameter
becomes a star in O(log n) rounds. A hub's edges stay spread over tasks: its minimum is broadcast
to them. Nothing is collected but one row of checksums each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def _large(edges: DataFrame, n: int, files: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n").coalesce(files))
    return spread_join(both, least, "u", counted="n", total=2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, n: int, files: int) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(files))
    moved = spread_join(edges, least, "u", counted="n", total=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: Edges to a file of the tables between rounds: small graphs are not written as hundreds of files.
FILE = 20_000


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. Node ids
    may be of any type with an order.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    if state[0]:
        for _ in range(rounds):
            files = max(4, -(-state[0] // FILE))
            now = cut(_small(cut(_large(now, state[0], files).coalesce(files)), state[0], files).coalesce(files))
            state, last = _state(now), state
            if state == last:
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
