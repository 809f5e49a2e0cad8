"""URL filtering: rules decide a url; redirect and canonical edges carry blocks to the aliases of a blocked url.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule with a host and is allowed;
repeated urls share a node; of rules of one length the allowing one wins; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terncube.llm.runtime import Scratch, ascii_lower, components

#: Rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def with_parts(df: DataFrame, url: str, host: str = "host", path: str = "path", query: str | None = None) -> DataFrame:
    """Add host (A-Z lower-cased), path and, if asked for, the query with its question mark."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    out = {host: ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), path: F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}
    if query:
        out[query] = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    return df.withColumns(out)


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) gain rule and rule_verdict, null where no rule fits. Every host is exploded into its suffixes
    at dots and joined to the rules on the suffix: work per url follows the labels of its host, not the number of rules.
    Distinct (host, path) pairs are judged once, so hot urls cost one row."""
    key = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = key.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    best = (
        suffixes.join(r, "suffix")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("suffix") + F.length("rule_path")).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), F.concat("suffix", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    )
    return urls.join(best, ["host", "path"], "left")


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between urls as the pages state them: link rel=canonical and meta refresh, resolved against the page."""
    tagged = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(r"html rlike '(?i)canonical|refresh'")
    tags = tagged.select("url", F.explode(F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")).alias("tag"))
    value = r"""\s*=\s*["']?\s*"""
    target = F.when(F.col("tag").rlike(rf"(?is)<link\b[^>]*\brel{value}canonical\b"), F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s"'>]+)""", 0)).when(
        F.col("tag").rlike(rf"(?is)<meta\b[^>]*\bhttp-equiv{value}refresh\b"), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?[^"'>]*""", 0)
    )
    href = F.trim(F.replace(F.regexp_replace(target, r"""(?is)^(?:href|url)\s*=\s*["']?|["']\s*$""", ""), F.lit("&amp;"), F.lit("&")))
    found = with_parts(tags.select("url", href.alias("href")).where("href <> '' and not startswith(href, '#')"), "url", "h", "p").where("h <> ''")
    full = (
        F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href"))
        .when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(F.col("href").startswith("/"), F.concat(F.lit("http://"), "h", "href"))
        .when(F.col("href").startswith("?"), F.concat(F.lit("http://"), "h", "p", "href"))
        .otherwise(F.concat(F.lit("http://"), "h", F.regexp_replace(F.when(F.col("p") == "", "/").otherwise(F.col("p")), r"[^/]*$", ""), "href"))
    )
    return found.select(F.col("url").alias("a"), full.alias("b")).where("b is not null")


def without_dots(path):
    """A path without the segments . and .. (which takes the one before it away); one that ends in them ends in a slash."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    shorter = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == ".", done).when(s == "..", shorter(done)).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _node(df: DataFrame, url: str, out: str) -> DataFrame:
    """The node of a url: host, path (a missing one is /, dot segments resolved) and query; scheme and fragment do not tell
    urls apart."""
    parts = with_parts(df, url, "_h", "_p", "_q")
    node = F.when(F.col("_h") != "", F.concat("_h", F.when(F.col("_p") == "", "/").otherwise(without_dots(F.col("_p"))), "_q"))
    return parts.withColumn(out, node).drop("_h", "_p", "_q")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """Judge every page: (key, url, host, path, rule, verdict, component).

    A url that a rule fits gets that rule's verdict: an explicit allow is never overturned. Any other url is blocked if
    a url in its component of redirect and canonical edges, be it a page or only named, is blocked by a rule, and else
    allowed. redirects: optional further edges (a, b) between urls."""
    scratch = Scratch(pages.sparkSession)
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    judged = longest_rule(with_parts(base, "url"), rules)
    links = redirects.select("a", "b") if redirects is not None else None
    if html:
        own = page_edges(pages, url, html)
        links = own if links is None else links.unionByName(own)
    if links is None:
        links = pages.sparkSession.createDataFrame([], "a string, b string")
    edges = scratch.cut(_node(_node(links, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a is not null and b is not null").distinct())
    comp = components(edges, scratch)
    named = with_parts(comp.withColumn("u", F.concat(F.lit("http://"), "node")), "u")
    alias = longest_rule(named, rules).select("node", "component", (F.col("rule_verdict") == "block").alias("bad"))
    blocked = alias.groupBy("component").agg(F.max(F.coalesce("bad", F.lit(False))).alias("blocked"))
    reach = alias.select("node", "component").join(blocked, "component")
    out = _node(judged, "url", "node").join(reach, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "url", "host", "path", "rule", verdict.alias("verdict"), "component")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


#: No page of the given tables holds an edge, so rules alone decide there; edges are tested on fixtures.
OP1_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best WHERE k = 1
"""
