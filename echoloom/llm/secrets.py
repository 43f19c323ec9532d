"""Secret scans through a trigram inverted index, in DataFrame operations only.

A rule's regular expression is turned into a Boolean query over trigrams that every match must
hold: from its syntax tree come the exact strings a part can match while they are few, and else
the trigrams of its ends, joined by and / or. The index keeps postings (trigram, document) for
the trigrams that some query names, over text in lower case. Intersecting postings gives each
rule's candidates, and only those are verified by the rule. Rules without a mandatory trigram scan
every text.
"""

from __future__ import annotations

import re._constants as sc
import re._parser as sp
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, cut, row_key
from .spans import counted, listed, none, spans


@dataclass(frozen=True)
class Rule:
    """kind; a regex in the syntax Java and Python share; group and the least characters it must have."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Base rules first, as their kinds are listed; what follows is added by this operator.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")

#: A query: None holds for any text; ("tri", t); ("and", [..]); ("or", [..]).
Query = tuple | None
MOST_EXACT, MOST_CLASS = 64, 16


def _and(parts: list[Query]) -> Query:
    flat = []
    for p in parts:
        flat += [] if p is None else p[1] if p[0] == "and" else [p]
    flat = list({repr(p): p for p in flat}.values())
    return None if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    flat = list({repr(p): p for p in parts}.values())
    return flat[0] if len(flat) == 1 else ("or", flat)


def _of_strings(strings: set[str] | None) -> Query:
    if not strings:
        return None
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass
class _Part:
    """exact: all strings the part matches, if few; else the strings it may begin and end with; query: what holds besides."""

    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    query: Query = None


_ANY = _Part(None, {""}, {""})


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST_EXACT else None


def _concat(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and (both := _cross(a.exact, b.exact)) is not None:
        return _Part(both, both, both)
    middle = _cross(a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix)
    query = _and([a.query, b.query, _of_strings(a.exact), _of_strings(b.exact), _of_strings(middle)])
    prefix = (_cross(a.exact, b.prefix) or a.exact) if a.exact is not None else a.prefix
    suffix = (_cross(a.suffix, b.exact) or b.exact) if b.exact is not None else b.suffix
    return _Part(None, {x[:3] for x in prefix}, {x[-3:] for x in suffix}, query)


def _alternatives(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_EXACT:
        every = set().union(*(p.exact for p in parts))
        return _Part(every, every, every)
    query = _or([_and([p.query, _of_strings(p.exact), None]) for p in parts])
    ends = lambda own, n: {x[:3] if n else x[-3:] for p in parts for x in (p.exact if p.exact is not None else own(p))}
    prefix, suffix = ends(lambda p: p.prefix, True), ends(lambda p: p.suffix, False)
    return _Part(None, prefix if len(prefix) <= MOST_EXACT else {""}, suffix if len(suffix) <= MOST_EXACT else {""}, query)


def _parts(tree) -> _Part:
    out = _Part({""}, {""}, {""})
    for op, arg in tree:
        if op is sc.LITERAL:
            c = {chr(arg).lower()}
            part = _Part(c, c, c) if chr(arg).isascii() else _ANY
        elif op is sc.IN:
            chars: set[str] | None = set()
            for kind, v in arg:
                if kind is sc.LITERAL:
                    chars.add(chr(v).lower())
                elif kind is sc.RANGE and v[1] - v[0] < 64:
                    chars |= {chr(i).lower() for i in range(v[0], v[1] + 1)}
                else:
                    chars = None
                    break
            part = _Part(chars, chars, chars) if chars and len(chars) <= MOST_CLASS and all(c.isascii() for c in chars) else _ANY
        elif op is sc.SUBPATTERN:
            part = _parts(arg[-1])
        elif op is sc.BRANCH:
            part = _alternatives([_parts(x) for x in arg[1]])
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _parts(inner)
            if (low, high) == (0, 1):
                part = _alternatives([one, _Part({""}, {""}, {""})])
            elif low == 0:
                part = _ANY
            elif low == high == 1:
                part = one
            else:
                part = one
                for _ in range(min(low, 4) - 1):
                    part = _concat(part, one)
                if (low, min(low, 4)) != (high, low):
                    part = _Part(None, part.exact if part.exact is not None else part.prefix, part.exact if part.exact is not None else part.suffix, _and([part.query, _of_strings(part.exact)]))
        elif op in (sc.AT, sc.ASSERT, sc.ASSERT_NOT):
            continue  # looks, matches no text
        else:
            part = _ANY
        out = _concat(out, part)
    return out


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query, in lower case, that any text with a match fulfils; None if there is none."""
    part = _parts(sp.parse(regex))
    strings = part.exact
    return _and([part.query, _of_strings(strings)]) if strings is not None else _and([part.query, _of_strings(part.prefix), _of_strings(part.suffix)])


def conjunctions(query: Query, most: int = 64) -> list[frozenset[str]]:
    """The query as alternatives of trigram sets. Where they would be too many, conditions are left out: candidates then grow, none is lost."""
    if query is None:
        return [frozenset()]
    kind, arg = query
    if kind == "tri":
        return [frozenset([arg])]
    if kind == "or":
        out = list(dict.fromkeys(c for p in arg for c in conjunctions(p, most)))
        out = [c for c in out if not any(o < c for o in out)]
        return out if len(out) <= most else [frozenset()]
    now = [frozenset()]
    for p in arg:
        more = list(dict.fromkeys(a | b for a in now for b in conjunctions(p, most)))
        now = more if len(more) <= most else now
    return [c for c in now if not any(o < c for o in now)]


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, rk): the documents that hold each of the trigrams. keyed: rk, text."""
    low = keyed.select("rk", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("rk", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(rk, rules): for each document the rules whose query its postings fulfil."""
    codes = {t: i for i, t in enumerate(sorted({t for q in queries.values() for c in q for t in c}))}
    # a document's postings meet as numbers with a bit for each trigram, 62 to a number
    words = range(-(-len(codes) // 62))
    bits = lambda ts, w: sum(1 << codes[t] % 62 for t in ts if codes[t] // 62 == w)
    bit = F.create_map(*[x for t in codes for x in (F.lit(t), F.array(*[F.lit(bits([t], w)).cast("long") for w in words]))])
    held = index.select("rk", F.element_at(bit, F.col("trigram")).alias("b")).groupBy("rk").agg(*[F.bit_or(F.col("b")[w]).alias(f"held{w}") for w in words])
    all_of = lambda c: reduce(and_, [F.col(f"held{w}").bitwiseAND(F.lit(bits(c, w)).cast("long")) == bits(c, w) for w in words if bits(c, w)])
    each = []
    for kind, query in queries.items():
        test = None
        for c in query:
            test = all_of(c) if test is None else test | all_of(c)
        each.append(F.when(test, F.lit(kind)))
    return held.select("rk", F.array_compact(F.array(*each)).alias("rules")).where(F.size("rules") > 0)


def _verified(text: Column, rule: Rule) -> Column:
    found = spans(text, rule.regex)
    if not rule.least:
        return found
    if not rule.group:
        return F.filter(found, lambda x: x["e"] - x["s"] >= rule.least)
    return F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], rule.regex, rule.group)) >= rule.least)


def _placed(own: Column, place: int, kind: str) -> Column:
    return F.transform(own, lambda x: F.struct(x["s"].alias("s"), F.lit(place).alias("i"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 300_000) -> DataFrame:
    """(doc_id, found) for each row of docs: array of (kind, s, e) by start, then kind as the rules list them.

    Spans are leftmost and non-overlapping within a rule, code points, end exclusive; matches
    that fail the rule's test are dropped without another try. Null text counts as empty; ids may
    be null or repeated, every row gets a row; an empty table gives no rows; other columns are not read.
    """
    queries = {r.kind: conjunctions(trigram_query(r.regex)) for r in rules}
    indexed = {k: q for k, q in queries.items() if all(q)}
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("rk", row_key(F.col("doc_id"), F.col("text")))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for c in q for t in c})
        chosen = cut(candidates(postings(keyed, trigrams), indexed))
        keyed = bounded_join(keyed, chosen, "rk", "left", broadcast_rows, wide=True)
    cols = []
    for i, r in enumerate(rules):
        own = _verified(F.col("text"), r)
        if r.kind in indexed:
            own = F.when(F.array_contains("rules", r.kind), own).otherwise(none())
        cols.append(_placed(own, i, r.kind))
    placed = F.array_sort(F.concat(*cols))
    return keyed.select("doc_id", F.transform(placed, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("found"))


def digest(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """The columns of the contract from ``find``'s spans."""
    of = F.filter("found", lambda x: x["kind"].isin(*base))
    n = [counted("found", k) for k in base]
    return found.select("doc_id", *n, F.sha2(listed(of).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


