"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns (emails, addresses, cards, phones) are the seeds. What stands around a seed - one or
two words before it, one or two after it, a word on either side, or a word beside it with the
seed's own form, digits and letters normalised - is a lexical pattern of its kind. Patterns and
the instances they extract form a bipartite graph, scored in turns: a pattern's confidence is the
lower bound of the mean score of its distinct instances, so it wants support as well as purity; an
instance's score is one for a seed of the kind, else what its confident patterns leave after a
noisy-or. Patterns of high confidence and enough distinct seeds then mark unseen identifiers:
words with several digits that no base pattern matched. Texts are read once; the graph holds only
contexts of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, cut, packed, row_key, small
from .spans import counted, labelled, listed, masked, none, spans

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive runs and lookbehinds that only spare scanning: a match can
#: begin at the start of a run of its first class, or where the last match ended, nowhere else.
#: Repeated groups are possessive, which the engine walks in a loop and not by recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An unseen identifier: a word of six or more characters with four digits at least.
WORD = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9]*+[0-9]){4}[^\x20\x09-\x0D]*+"


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; the confidence a pattern needs, a lower bound at ``z`` standard errors; distinct seeds it needs."""

    rounds: int = 5
    confidence: float = 0.6
    z: float = 2.33
    seeds: int = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Base matches by kind, (s, e, m); matches that fail their test are dropped without another try."""
    some = text.rlike("[0-9]")
    of = lambda test, rx: F.when(test, spans(text, rx)).otherwise(none())
    size = lambda m: F.length(_digits(m))
    byte = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = lambda p: F.coalesce(F.when(byte(p), F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int") <= 255), F.lit(False))
    return {
        "email": of(text.contains("@"), EMAIL),
        "ip": F.filter(of(some, IP), lambda x: F.forall(F.split(x["m"], r"\."), small)),
        "card": F.filter(of(some, CARD), lambda x: F.when((size(x["m"]) >= 13) & (size(x["m"]) <= 19), _luhn(_digits(x["m"]))).otherwise(False)),
        "phone": F.filter(of(text.contains("+"), PHONE), lambda x: (size(x["m"]) >= 9) & (size(x["m"]) <= 15)),
    }


#: Characters looked at on either side of a span.
WINDOW = 80


def form(m: Column) -> Column:
    """An instance with runs of digits as 9 and runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(m, r"\pL+", "a"), "[0-9]+", "9")


def _contexts(text: Column, found: Column, kind: str) -> Column:
    """(kind, s, e, instance, patterns) of spans; a word that the window's edge cuts is no context."""

    def one(x: Column) -> Column:
        left = F.lower(F.substr(text, F.greatest(x["s"] - (WINDOW - 1), F.lit(1)), F.least(x["s"], F.lit(WINDOW))))
        right = F.lower(F.substr(text, x["e"] + 1, F.lit(WINDOW)))
        left = F.when(x["s"] > WINDOW, F.regexp_replace(left, r"^\pL+", "")).otherwise(left)
        right = F.when(F.length(right) == WINDOW, F.regexp_replace(right, r"\pL+$", "")).otherwise(right)
        before, after = (F.regexp_extract_all(c, F.lit(r"\pL+"), F.lit(0)) for c in (left, right))
        l2, l1, r1, r2 = F.try_element_at(before, F.lit(-2)), F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1)), F.try_element_at(after, F.lit(2))
        own = F.concat(F.lit("_:"), form(x["m"]))
        gap, made = F.lit("_"), lambda *parts: F.concat(*[p for i, part in enumerate(parts) for p in ([F.lit(" ")] * (i > 0) + [part])])  # noqa: E731; null where a part is
        patterns = F.array(made(l2, l1, gap), made(gap, r1, r2), made(l1, gap, r1), made(l1, gap), made(gap, r1), made(l1, own), made(own, r1))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.array_compact(patterns).alias("patterns"))

    return F.transform(found, one)


def _scan(rows: DataFrame) -> DataFrame:
    """doc_id, rk, base (kind, s, e) in order, seen: contexts of base spans and of other words with digits."""
    text = F.coalesce("text", F.lit(""))
    found = rows.select("doc_id", "rk", text.alias("text")).select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    base = F.concat(*[labelled(F.col(k), k) for k in KINDS])
    words = F.when(F.col("text").rlike("[0-9]"), spans(F.col("text"), WORD)).otherwise(none())
    free = lambda w, b: F.filter(w, lambda x: (x["e"] - x["s"] >= 6) & ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    found = found.select("doc_id", "rk", "text", *KINDS, base.alias("base"), words.alias("words"))
    seen = F.concat(*[_contexts(F.col("text"), F.col(k), k) for k in KINDS], _contexts(F.col("text"), free(F.col("words"), F.col("base")), ""))
    return found.select("doc_id", "rk", "base", seen.alias("seen"))


def lower_bound(mean: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a mean of n scores from 0 to 1."""
    return (mean + z * z / (2 * n) - z * F.sqrt(mean * (1 - mean) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def confident_patterns(seen: DataFrame, b: Bootstrap, broadcast_rows: int = 300_000) -> DataFrame:
    """(kind, pattern, confidence) of the patterns to trust. seen: kind ('' for unseen words), m, pattern.

    Only patterns with seeds enough enter the graph. Confidences are rounded, so reruns agree.
    """
    if b.rounds < 1:
        raise ValueError("rounds must be 1 at least")
    graph = cut(seen.groupBy("pattern", F.xxhash64("m").alias("i"), F.col("kind").alias("is")).agg(F.count("*").alias("n")))
    seeds = cut(graph.where("is <> ''").groupBy(F.col("is").alias("kind"), "pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= b.seeds))
    edges = cut(bounded_join(graph, seeds, "pattern", "inner", broadcast_rows).select("kind", "pattern", "i", (F.col("is") == F.col("kind")).alias("seed")))
    score = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for k in range(b.rounds):
        rated = score.groupBy("kind", "pattern").agg(F.round(F.avg("score"), 9).alias("mean"), F.count("*").alias("n"))
        confidence = F.round(lower_bound(F.col("mean"), F.col("n"), b.z), 9)
        trusted = cut(rated.select("kind", "pattern", confidence.alias("confidence")).where(F.col("confidence") >= b.confidence))
        if k < b.rounds - 1 and not small(trusted, 0):
            held = bounded_join(edges.where("not seed"), trusted, ["kind", "pattern"], "inner", broadcast_rows)
            learnt = cut(held.groupBy("kind", "i").agg((1 - F.product(1 - F.col("confidence"))).alias("learnt")))
            score = bounded_join(edges, learnt, ["kind", "i"], "left", broadcast_rows)
            score = cut(score.select("kind", "pattern", "i", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("learnt", F.lit(0.0))).alias("score")))
    return trusted


def _bootstrapped(scan: DataFrame, b: Bootstrap, broadcast_rows: int) -> DataFrame:
    """(rk, more): spans (kind, s, e) that confident patterns add to rows of that key."""
    each = scan.where(F.size("seen") > 0).select("rk", F.explode("seen").alias("x")).select("rk", "x.kind", "x.s", "x.e", "x.m", F.explode("x.patterns").alias("pattern"))
    trusted = confident_patterns(each, b, broadcast_rows).select(F.col("kind").alias("as"), "pattern", "confidence")
    marked = bounded_join(each.where("kind = ''"), trusted, "pattern", "inner", broadcast_rows)
    best = marked.groupBy("rk", "s", "e").agg(F.max(F.struct("confidence", "as")).alias("b")).select("rk", F.struct(F.concat(F.lit("like_"), F.col("b.as")).alias("kind"), "s", "e").alias("x"))
    return best.groupBy("rk").agg(F.sort_array(F.collect_set("x")).alias("more"))


def find(docs: DataFrame, bootstrap: Bootstrap = Bootstrap(), doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 300_000) -> DataFrame:  # noqa: B008
    """(doc_id, base, more) for each row of docs: arrays of (kind, s, e), code points, end exclusive.

    base: by kind as in KINDS, then start. more: what the method adds, kind ``like_<kind>``, by
    kind and start. Null text counts as empty; ids may be null or repeated, every row gets a row;
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scan = cut(_scan(rows.withColumn("rk", row_key(F.col("doc_id"), F.col("text")))))
    more = cut(_bootstrapped(scan, bootstrap, broadcast_rows))
    out = bounded_join(scan, more, "rk", "left", broadcast_rows)
    return out.select("doc_id", "base", F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from ``find``'s spans."""
    n = [counted("base", k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, bootstrap: Bootstrap = Bootstrap(), doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", broadcast_rows: int = 300_000) -> DataFrame:  # noqa: B008
    """The rows of docs with every span, base or added, replaced by its kind in angle brackets.

    A column named by ``length``, if there is one, gets the new length. All rows and columns stay;
    null texts stay null. Only spans are joined to the texts, by content key.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scan = _scan(rows.withColumn("rk", row_key(F.col("doc_id"), F.col("text"))))
    scan = cut(scan.where(F.size("seen") > 0))
    more = _bootstrapped(scan, bootstrap, broadcast_rows)
    of = cut(scan.join(more, "rk", "left").select("rk", F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int>>"))).alias("found")).where(F.size("found") > 0).groupBy("rk").agg(F.first("found").alias("found")))
    joined = bounded_join(packed(docs, rk=row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))), of, "rk", "left", broadcast_rows, wide=True)
    clean = F.when(F.col("found").isNull(), F.col(f"_row.`{text}`")).otherwise(masked(F.col(f"_row.`{text}`"), F.col("found")))
    out = joined.select(F.col("_row"), clean.alias("clean"))
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col("clean").alias(c))
        elif c == length:
            cols.append(F.length("clean").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"_row.`{c}`").alias(c))
    return out.select(*cols)
