"""URL filters with redirect equivalence, DataFrame functions only.

A page's own rule decides it. Otherwise its alias class does: URLs linked by
redirects (``meta http-equiv=refresh``) and canonical links form a graph whose
connected components are found by star contraction (``graph.py``); a component
that holds a URL blocked by rule blocks its members without a rule of their
own. Allow takes precedence: a URL that a rule allows stays allowed whatever it
is linked to, and with ``shield=True`` one allowed URL also frees the members
of its component that have no rule.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
alias and no rule; a null page body has no links; all canonical and refresh
tags of a page count but for those in comments; links to other schemes, empty
and fragment-only links are no aliases; ``.`` and ``..`` in a link's path are
resolved; of rules that fit, the longest string wins, and allow wins over block
if two rules are equal; repeated rows are judged alike; an empty table gives an
empty result; extra columns pass through under any name but that of a result
column, which the result's replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import connected_components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""
COMMENT = r"(?s)<!--.*?-->"
AMPERSAND = r"(?i)&(?:amp|#38|#x26);"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def _path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules fit into an expression")
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    tests = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("action"))) for h, p, v in order]
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule: string, action: string>")


def _resolve(target: Column, host: Column, path: Column) -> Column:
    """What follows the scheme of a link found on a page, made absolute; null if it leads to no other URL."""
    t = F.regexp_replace(F.regexp_replace(target, AMPERSAND, "&"), r"#.*$", "")
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.lit("/"))
    return (
        F.when(t == "", None)
        .when(t.rlike(r"(?i)^https?://"), _after_scheme(t))
        .when(t.startswith("//"), F.substr(t, F.lit(3)))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("/"), F.concat(host, t))
        .when(t.startswith("?"), F.concat(host, path, t))
        .otherwise(F.concat(host, folder, t))
    )


def _undotted(path: Column) -> Column:
    """A path without segments . and .. in it."""
    parts = F.split(path, "/")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(path, F.lit("/.")), F.array_join(F.concat(kept, ends), "/")).otherwise(path)


def _identity(rest: Column, undot: bool = False) -> Column:
    """Lower-cased host, then path and query as they stand, or the path with dots resolved."""
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    path = _undotted(_path(rest)) if undot else _path(rest)
    return F.when(_host(rest) != "", F.concat(_host(rest), path, query))


def filter_urls(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", shield: bool = False, default: str = "allow") -> DataFrame:
    """``pages`` without the page bodies, with host, path, rule and verdict."""
    rest = _after_scheme(F.col(f"`{url_col}`").cast("string"))
    # the caller's columns travel in a struct, so no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict")], F.lit(0).alias("__end"))
    base = pages.select(row.alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"), F.coalesce(_host(rest), F.lit("")).alias("host"), F.coalesce(_path(rest), F.lit("")).alias("path"), _identity(rest).alias("node"))
    base = base.withColumn("matched", matched_rule(F.col("host"), F.col("path"), rules))
    plain = F.when(F.contains("html", F.lit("<!--")), F.regexp_replace("html", COMMENT, "")).otherwise(F.col("html"))
    tags = lambda tag, part: F.transform(F.regexp_extract_all(F.col("plain"), F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, part, 1))
    # a generator between two steps keeps the optimiser from inlining one expression into the other many times over
    found = base.where(F.col("node").isNotNull() & F.col("html").isNotNull()).select("node", "host", "path", F.explode(F.array(plain)).alias("plain"))
    found = found.select("node", "host", "path", F.explode(F.concat(tags(CANONICAL, HREF), tags(REFRESH, TARGET))).alias("t")).where("t <> ''")
    found = found.select("node", F.explode(F.array(_resolve(F.col("t"), F.col("host"), F.col("path")))).alias("rest"))
    found = found.select(F.col("node").alias("a"), F.explode(F.array(_identity(F.col("rest"), undot=True))).alias("b"))
    edges = materialise(found.where("b is not null and a <> b").distinct(), "url-edges")
    own = F.col("matched.action")
    other = [F.col(f"row.`{c}`") for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict")]
    names = ["host", "path", F.col("matched.rule").alias("rule")]
    if not edges.limit(1).count():  # no aliases: every URL is a component of its own
        return base.select(*other, *names, F.coalesce(own, F.lit(default)).alias("verdict"))
    comp = materialise(connected_components(edges), "url-components")
    node = F.col("node")
    judged = comp.withColumn("action", matched_rule(_host(node), _path(node), rules)["action"])
    verdict = F.when(F.max(F.col("action") == "allow") & F.lit(shield), "allow").when(F.max(F.col("action") == "block"), "block")
    decided = judged.groupBy("component").agg(verdict.alias("class")).where("class is not null")
    aliases = materialise(comp.join(decided, "component").select("node", "class"), "url-aliases")
    return base.drop("html").join(aliases, "node", "left").select(*other, *names, F.coalesce(own, "class", F.lit(default)).alias("verdict"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict (``shield`` off)."""
    low = f"'{UPPER}', '{LOWER}'"
    host = lambda x: f"translate(regexp_extract({x}, '^[^/?#]*', 0), {low})"
    path = lambda x: f"regexp_extract({x}, '^[^/?#]*([^?#]*)', 1)"
    ident = lambda x: f"CASE WHEN {host(x)} <> '' THEN {host(x)} || {path(x)} || coalesce(regexp_extract({x}, '^[^?#]*(\\?[^#]*)?', 1), '') END"
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in order) + " END"
    quote = lambda x: x.replace("'", "''")
    after = lambda x: f"CASE WHEN instr({x}, '://') > 0 THEN substr({x}, instr({x}, '://') + 3) END"
    found = lambda tag, part: f"list_transform(regexp_extract_all(regexp_replace(html, '{COMMENT}', '', 'g'), '{quote(tag)}', 0), lambda x: regexp_replace(regexp_replace(regexp_extract(x, '{quote(part)}', 1), '{AMPERSAND}', '&', 'g'), '#.*$', ''))"
    undot = lambda p: f"""CASE WHEN contains({p}, '/.') THEN array_to_string(list_concat(list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]),
  lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END), CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') ELSE {p} END"""  # noqa: E731
    whole = lambda x: f"CASE WHEN {host(x)} <> '' THEN {host(x)} || ({undot(path(x))}) || coalesce(regexp_extract({x}, '^[^?#]*(\\?[^#]*)?', 1), '') END"
    return f"""
WITH RECURSIVE
p0 AS (SELECT page_id, html, {after('url')} AS rest FROM pages),
p AS (SELECT page_id, html, coalesce({host('rest')}, '') AS host, coalesce({path('rest')}, '') AS path, {ident('rest')} AS node FROM p0),
t AS (SELECT node, host, path, unnest(list_concat({found(CANONICAL, HREF)}, {found(REFRESH, TARGET)})) AS t FROM p WHERE node IS NOT NULL AND html IS NOT NULL),
l AS (SELECT node, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '(?i)^https?://') THEN {after('t')} WHEN starts_with(t, '//') THEN substr(t, 3)
  WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '/') THEN host || t WHEN starts_with(t, '?') THEN host || path || t
  ELSE host || CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || t END AS rest FROM t),
d AS (SELECT DISTINCT node AS a, {whole('rest')} AS b FROM l),
e AS (SELECT a, b FROM d WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM d WHERE b IS NOT NULL AND a <> b),
n AS (SELECT a AS node, {host('a')} AS host, {path('a')} AS path FROM (SELECT DISTINCT a FROM e)),
r AS (SELECT node FROM n WHERE {case(1)} = 'block' UNION SELECT e.b FROM r JOIN e ON e.a = r.node)
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN p.node IN (SELECT node FROM r) THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""
