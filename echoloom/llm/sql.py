"""DuckDB SQL of the operators that SQL can express, for whole tables."""

from __future__ import annotations


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(kind: str, place: int, regex: str, passes: str) -> str:
    """A list of structs (s, i, e, kind) of a regex's matches m that pass; places add up from the text between matches."""
    rx = _quoted(regex)
    return f"""list_transform(list_filter(list_transform(generate_series(1, len(regexp_extract_all(t, {rx}))), lambda k: {{
      's': CAST(list_sum(list_transform(string_split_regex(t, {rx})[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {rx})[1:k-1], lambda x: length(x))), 0) AS BIGINT),
      'm': regexp_extract_all(t, {rx})[k]}}), lambda z: {passes.replace("{rx}", rx)}), lambda z: {{'s': z.s, 'i': {place}, 'e': z.s + length(z.m), 'kind': '{kind}'}})"""


def _digest(found: str, kinds: tuple[str, ...], columns: str) -> str:
    """Digest columns from (doc_id, found), found in its order."""
    joined = lambda rows: f"coalesce(array_to_string(list_transform({rows}, lambda z: z.kind || ':' || z.s || ':' || z.e), ','), '')"
    base = "list_filter(found, lambda z: z.kind IN (" + ", ".join(f"'{k}'" for k in kinds) + "))"
    counts = ", ".join(f"len(list_filter(found, lambda z: z.kind = '{k}')) AS n_{k}" for k in kinds)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {found} AS found FROM d) SELECT doc_id, {counts}, sha256({joined(base)}) AS base_sha256{columns.format(spans=joined('found'))} FROM f"


_DIGITS = "regexp_replace(z.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda p: CASE WHEN p % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), p, 1) AS INT) ELSE (CAST(substr(reverse({_DIGITS}), p, 1) AS INT) * 2) // 10 + (CAST(substr(reverse({_DIGITS}), p, 1) AS INT) * 2) % 10 END)) % 10 = 0"
_SIZED = lambda low, high: f"length({_DIGITS}) BETWEEN {low} AND {high}"
_PERSONAL = [
    _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _spans("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(z.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS HUGEINT), 0) > 255)) = 0"),
    _spans("card", 2, r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN {_SIZED(13, 19)} THEN {_LUHN} ELSE false END"),
    _spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", _SIZED(9, 15)),
]
#: op5's columns but the spans that its method adds, which no SQL finds.
BASE_PERSONAL_DATA = _digest("list_concat(list_concat(list_concat(" + "), ".join(_PERSONAL[:1]) + f", {_PERSONAL[1]}), {_PERSONAL[2]}), {_PERSONAL[3]})", ("email", "ip", "card", "phone"), "")

_SECRET = [
    _spans("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(z.m, {rx}, 2)) >= 6"),
    _spans("access", 1, "AKIA[A-Z0-9]+", "length(z.m) >= 20"),
    _spans("hex", 2, "[0-9a-f]{24,}", "true"),
    _spans("github", 3, "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    _spans("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    _spans("pem", 5, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
    _spans("slack", 6, "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
]
SECRETS = _digest("list_sort(flatten([" + ", ".join(_SECRET) + "]))", ("assign", "access", "hex"), ", {spans} AS spans")


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    """Rules by length, and blocks carried over redirects and canonical links: reach over nodes, to a fixed point."""
    listed = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0], r[1]))
    fits = lambda h, p: f"(host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)})"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {_quoted(value(h, p, v))}" for h, p, v in listed) + " END"
    parts = lambda u: f"""translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
      CASE WHEN contains({u}, '://') THEN translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END END AS node"""  # noqa: E731
    attr = lambda name: rf"""(?i)\b{name}\s*=\s*["'']?([^"''\s>]+)"""
    return f"""
        WITH RECURSIVE tags AS (
          SELECT url, html, regexp_extract_all(html, '(?i)<link\\b[^>]*>') AS links, regexp_extract_all(html, '(?i)<meta\\b[^>]*>') AS metas FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
        named AS (
          SELECT url, unnest(list_transform(list_filter(links, lambda x: regexp_matches(x, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')), lambda x: regexp_extract(x, '{attr("href")}', 1))) AS t FROM tags UNION ALL
          SELECT url, unnest(list_transform(list_filter(metas, lambda x: regexp_matches(x, '(?i)\\bproperty\\s*=\\s*["'']?og:url\\b')), lambda x: regexp_extract(x, '{attr("content")}', 1))) FROM tags UNION ALL
          SELECT url, unnest(list_transform(list_filter(metas, lambda x: regexp_matches(x, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')), lambda x: regexp_extract(x, '(?i)\\bcontent\\s*=\\s*["'']?[^"''>]*?url\\s*=\\s*([^"''\\s>;]+)', 1))) FROM tags UNION ALL
          SELECT url, unnest(regexp_extract_all(html, '(?i)\\blocation(?:\\.href)?\\s*=\\s*["'']([^"''\\s]+)["'']', 1)) FROM tags),
        aimed AS (SELECT url, replace(t, '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM named WHERE t <> ''),
        ends AS (
          SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || t WHEN starts_with(t, '/') THEN site || t ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || t END AS target FROM aimed),
        tied AS (SELECT x.*, y.node AS other FROM (SELECT target, {parts("url")} FROM ends) x, LATERAL (SELECT {parts("x.target")}) y WHERE x.node <> y.node),
        ties AS (SELECT node AS a, other AS b FROM tied UNION SELECT other, node FROM tied),
        sites AS (SELECT node, host, path FROM tied UNION SELECT other, h, p FROM (SELECT other, y.host AS h, y.path AS p FROM tied, LATERAL (SELECT {parts("tied.target")}) y)),
        bad(node) AS (SELECT node FROM sites WHERE {case(lambda h, p, v: v)} = 'block' UNION SELECT b FROM bad JOIN ties ON a = bad.node),
        own AS (SELECT page_id, {parts("coalesce(url, '')")} FROM pages)
        SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, coalesce({case(lambda h, p, v: v)}, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM own"""
