"""Duplicate groups: greedy clustering around pivots, and reports of them."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CompareConfig
from ..runtime import numbered, settle
from . import compare as cmp
from .similar import linked


def _greedy(links: DataFrame) -> DataFrame:
    """(id, role) of the files of undecided links, settled in one task in order of ids. links: (a, b) with role_a, of a file that is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy(), np.array(b.column("role_a").to_pylist(), object)) for b in batches]
        if not parts:
            return
        a, b, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        roles = {int(x): r for x, r in zip(a, known, strict=True) if r != "open"}
        ids, lower = np.unique(np.concatenate([a, b])), {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            lower.setdefault(y, []).append(x)
        opened = []
        for i in ids.tolist():
            if i not in roles:
                roles[i] = "member" if any(roles[x] == "pivot" for x in lower.get(i, ())) else "pivot"
                opened.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(opened, pa.int64()), pa.array([roles[i] for i in opened], pa.string())], ["id", "role"])

    return links.coalesce(1).mapInArrow(run, "id bigint, role string")


def pivots(edges: DataFrame, in_one_task: int = 1_000_000) -> DataFrame:
    """(pivot, member), the pivot among its members, of edges (a < b). Pivots that no file joins are left out.

    A file is a pivot if none of its lower neighbours is one; else it joins its lowest pivot
    neighbour. Each round settles the files whose lower neighbours are all settled as members, so
    the groups are those of a greedy pass in order of ids; nothing is collected but counts. Long
    chains settle slowly: once at most ``in_one_task`` undecided links are left (pairs of numbers), one task
    settles them in order of ids. Until then every round settles the lowest open files, so rounds end.
    """
    links = settle(edges.select("a", "b").distinct())
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    state = settle(nodes.withColumn("role", F.lit("open")))
    while True:
        low = links.join(state.select(F.col("id").alias("a"), F.col("role").alias("role_a")), "a")
        seen = low.groupBy("b").agg(F.max(F.col("role_a") == "open").alias("waits"), F.max(F.col("role_a") == "pivot").alias("near"))
        role = F.when(F.col("role") != "open", F.col("role")).when(F.coalesce("near", F.lit(False)), "member").when(F.coalesce("waits", F.lit(False)), "open").otherwise("pivot")
        state = settle(state.join(seen, F.col("id") == F.col("b"), "left").select("id", role.alias("role")))
        opened = state.where("role = 'open'").select(F.col("id").alias("b"))
        left = settle(links.join(opened, "b").join(state.select(F.col("id").alias("a"), F.col("role").alias("role_a")), "a"))
        undecided = left.limit(in_one_task + 1).count()
        if undecided <= in_one_task:
            break
    if undecided:
        rest = _greedy(left.select("a", "b", "role_a")).select("id", F.col("role").alias("late"))
        state = settle(state.join(rest, "id", "left").select("id", F.coalesce("late", "role").alias("role")))
    chosen = state.where("role = 'pivot'").select(F.col("id").alias("pivot"))
    member = state.where("role = 'member'").select(F.col("id").alias("member"))
    joined = settle(links.join(chosen, links.a == chosen.pivot).join(member, links.b == member.member).groupBy("member").agg(F.min("pivot").alias("pivot")).select("pivot", "member"))
    return joined.unionAll(joined.select("pivot", F.col("pivot").alias("member")).distinct())


def duplicate_edges(fps: DataFrame, c: CompareConfig = CompareConfig(), sliding: bool = False) -> DataFrame:  # noqa: B008
    """Match rows of all pairs that are duplicates. Pairs that fail the candidate test or the Jaccard filter are never scored."""
    return cmp.compare(linked(fps, c), fps, c, sliding).where("is_duplicate")


def duplicate_groups(fps: DataFrame, c: CompareConfig = CompareConfig(), sliding: bool = False) -> DataFrame:  # noqa: B008
    """(group_id, file_ids, avg_similarity) of groups of two files or more, with the mean similarity of all their pairs.

    Pairs that the quick filter rejects count 0 in the mean.
    """
    matches = settle(cmp.compare(linked(fps, c), fps, c, sliding).select("a", "b", "similarity_score", "is_duplicate"))
    of = settle(pivots(matches.where("is_duplicate")))
    within = matches.join(of.select(F.col("member").alias("a"), F.col("pivot").alias("pa")), "a").join(of.select(F.col("member").alias("b"), F.col("pivot").alias("pb")), "b").where("pa = pb")
    sums = within.groupBy(F.col("pa").alias("pivot")).agg(F.sum("similarity_score").alias("total"))
    groups = of.groupBy("pivot").agg(F.sort_array(F.collect_list("member")).alias("file_ids"), F.count("*").alias("n"))
    mean = F.coalesce("total", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)
    return groups.join(sums, "pivot", "left").select(F.col("pivot").alias("group_id"), "file_ids", mean.alias("avg_similarity"))


def ordered(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("avg_similarity"), "group_id")


def with_paths(groups: DataFrame, fps: DataFrame) -> DataFrame:
    each = groups.select("group_id", F.explode("file_ids").alias("file_id")).join(fps.select("file_id", "file_path"), "file_id", "left")
    paths = each.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("file_id", "file_path"))), lambda x: x["file_path"]).alias("file_paths"))
    return groups.join(paths, "group_id")


def summary(groups: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.size("file_ids")), F.lit(0)).cast("bigint")
    return groups.agg(F.count("*").alias("n_groups"), total.alias("total_files"), (total - F.count("*")).alias("savings"))


def _percent(mean):
    return F.format_string("%.2f%%", F.floor(10000 * mean + 0.5) / 100)


def csv_rows(groups: DataFrame) -> DataFrame:
    """group_no (from 1, in report order), similarity as a percentage and file, one row for each file."""
    files = "file_paths" if "file_paths" in groups.columns else "file_ids"
    placed = numbered(groups, [F.desc("avg_similarity"), F.col("group_id")], "group_no")
    return placed.select((F.col("group_no") + 1).alias("group_no"), _percent(F.col("avg_similarity")).alias("similarity"), F.explode(files).alias("file"))


def write_json(groups: DataFrame, path: str) -> None:
    """Groups as JSON lines, written by the executors; ``report`` gives one array."""
    ordered(groups).write.mode("overwrite").json(path)


def write_csv(groups: DataFrame, path: str) -> None:
    """Header Group, Similarity, File; every field quoted and quotes escaped."""
    csv_rows(groups).toDF("Group", "Similarity", "File").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def text_tree(groups: DataFrame) -> str:
    return "\n".join(report(groups, "text"))


def report(groups: DataFrame, form: str) -> Iterator[str]:
    """Lines of a report: a text tree, one JSON array of groups, or CSV. For people, so groups come to the driver one by one, in order."""
    rows = ordered(groups).toLocalIterator()
    if form == "text":
        for i, g in enumerate(rows, 1):
            files = g["file_paths"] if "file_paths" in g.asDict() else g["file_ids"]
            yield f"Group {i} ({100 * g['avg_similarity']:.2f}% similar):"
            yield from (f"  {'└─' if k == len(files) - 1 else '├─'} {f}" for k, f in enumerate(files))
    elif form == "json":
        sep = "["
        for g in rows:
            own = {"fileIds": g["file_ids"], **({"filePaths": g["file_paths"]} if "file_paths" in g.asDict() else {}), "avgSimilarity": g["avg_similarity"]}
            yield sep + "\n" + textwrap.indent(json.dumps(own, indent=2, ensure_ascii=False), "  ")
            sep = ","
        yield "[]" if sep == "[" else "]"
    elif form == "csv":
        quoted = lambda v: '"' + str(v).replace('"', '""') + '"'
        yield "Group,Similarity,File"
        for i, g in enumerate(rows, 1):
            yield from (f"{i},{100 * g['avg_similarity']:.2f}%,{quoted(f)}" for f in (g["file_paths"] if "file_paths" in g.asDict() else g["file_ids"]))
    else:
        raise ValueError(f"no report form {form}")
