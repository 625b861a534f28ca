"""URL filter whose block decisions reach redirect and canonical aliases.

A page is judged by the longest rule that fits its host and path.  Pages that
redirect to one another or name one another as canonical are one component;
where a rule blocks one of them, those of its aliases that no rule judges are
blocked as well, also where the blocked one is only a link's target and no row
of the table.  A page that a rule allows stays allowed.
Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.scratch import Scratch
from tidemark.llm.text import ascii_lower

#: (verdict, host, path) of the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
         ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Up to so many rules are one expression; more are a table that hosts' suffixes are joined with.  Both judge alike.
INLINE = 200
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """A-Z lower-cased; empty for null and for text without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What redirects compare: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def _ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; of equal length the one with the longer host, then the first given."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))


def judged(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.

    Of rules of equal length that both fit, as ``com`` + ``/abc`` and ``x.com`` + ``/a`` do, the one
    with the longer host holds; of equal rules the first.
    """
    out = None
    for verdict, at, start in _ordered(rules):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def with_rules(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, host: str = "host", path: str = "path", out: str = "own") -> DataFrame:
    """``rows`` with ``judged`` as the column ``out``.

    Rules may be a table (verdict, host, path) of any length: each distinct host and
    path is joined on the host's suffixes, and its best rule is found by an aggregate.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE:
            return rows.withColumn(out, judged(rules, F.col(host), F.col(path)))
        rules = rows.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(rules)], "__n long, verdict string, host string, path string")
    else:
        rules = rules.select(F.monotonically_increasing_id().alias("__n"), "verdict", "host", "path")
    places = rows.select(F.col(host).alias("__host"), F.col(path).alias("__path")).distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.select("__host", "__path", F.explode(suffixes).alias("__at"))
    known = rules.select("__n", "verdict", F.col("host").alias("__at"), F.col("path").alias("__start"))
    fits = each.join(known, "__at").where(F.startswith("__path", "__start"))
    order = F.struct(F.length(F.concat("__at", "__start")), F.length("__at"), -F.col("__n"))
    best = fits.groupBy("__host", "__path").agg(F.max_by(F.struct(F.concat("__at", "__start").alias("rule"), "verdict"), order).alias(out))
    return rows.join(best, (F.col(host) == F.col("__host")) & (F.col(path) == F.col("__path")), "left").drop("__host", "__path")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page's redirect or canonical link makes one.

    Relative links are resolved against the page: ``?query`` keeps its path, ``.`` and ``..`` are taken
    out, and ``&amp;`` in the attribute is an ampersand.  Pages without ``://`` have none.
    """
    target = lambda pattern: F.regexp_extract_all(F.col(html), F.lit(pattern), 1)
    found = (pages.where(F.col(html).contains("<") & F.col(url).contains("://"))
             .select(F.col(url).alias("u"), F.explode(F.concat(target(CANONICAL), target(REFRESH))).alias("to"))
             .withColumn("to", F.regexp_replace("to", "(?i)&amp;", "&")))
    base = F.concat(F.lit("x://"), host_of(F.col("u")))
    folder = F.regexp_replace(path_of(F.col("u")), r"[^/]*$", "")
    absolute = (F.when(F.col("to").contains("://"), F.col("to"))
                .when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to")))
                .when(F.col("to").startswith("/"), F.concat(base, F.col("to")))
                .when(F.col("to").startswith("?"), F.concat(base, path_of(F.col("u")), F.col("to")))
                .when(F.col("to").startswith("#"), F.col("u"))
                .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), F.col("to"))))
    absolute = F.when(F.col("to").contains("://"), absolute).otherwise(_without_dots(absolute))
    # A text without ``://`` is no node, so that such texts are not one another's aliases.
    return found.select(node_of(F.col("u")).alias("a"), node_of(absolute).alias("b")).where("a <> b and a <> '' and b <> ''")


def _without_dots(url: Column) -> Column:
    """The URL with ``.`` and ``..`` taken out of its path."""
    path = path_of(url)
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)))
    folder = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    plain = F.concat(F.lit("x://"), host_of(url), F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), folder)), rest)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), plain).otherwise(url)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, key: str = "page_id",
                url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, alias_of) for each row of ``pages``.

    ``edges`` (a, b) adds redirects known from elsewhere, as URLs.  Repeated
    rows are judged alike, null urls have empty host and path and are allowed.
    ``alias_of`` is the least node of the page's component, null outside of any.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    links = alias_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> '' and b <> ''"))
    groups = connected_components(links, scratch)
    seen = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        node_of(F.col(url)).alias("node"))
    seen = with_rules(seen, rules)
    # A node is host, path and query, so all nodes are judged, whether they are rows or not.
    whole = F.concat(F.lit("x://"), F.col("node"))
    blocked = (with_rules(groups.withColumns({"host": host_of(whole), "path": path_of(whole)}), rules).where("own.verdict = 'block'")
               .select("component").distinct().withColumn("tainted", F.lit(True)))
    aliases = groups.join(blocked, "component", "left").select("node", F.col("component").alias("alias_of"), "tainted")
    # Pages without a URL are no node, and many; the key of their join is spread over keys that nothing has.
    at = F.when(F.col("node") == "", F.concat(F.lit(" "), F.xxhash64(key).cast("string"))).otherwise(F.col("node"))
    rows = seen.withColumn("node", at).join(aliases, "node", "left")
    inherited = F.when(F.col("tainted"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(key, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", inherited).alias("verdict"), "alias_of")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("alias_of")


#: The rules' part, which is all where no page redirects or names another as canonical; the given pages have no such
#: links, and tests plant some.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, place, start) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (SELECT page_id, arg_max(place || start, length(place || start)) AS rule, arg_max(verdict, length(place || start)) AS verdict
         FROM h JOIN r ON (host = place OR ends_with(host, '.' || place)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (page_id)
"""
