"""URL rules, and decisions that pass along redirects and canonical links.

A rule has a host and a path; it fits its host and every subdomain where the url's path starts with the rule's, and the
longest one wins. Pages that redirect to, or name as canonical, one address are aliases of it. A page without a rule of its
own is allowed where any alias is allowed by a rule, else blocked where any alias is blocked by one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import cut
from phonoframe.llm.graph import connected_components

CANONICAL = r"""(?i)[\s"']rel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|'(?:[^']*\s)?canonical[\s']|canonical(?=[\s/>]))"""  # one of rel's words
MAX_RULES = 10_000  # rules are part of the plan, so their number is bounded


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that fits; equally long ones: the first. Null: none."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule string, verdict string>")


def html_links(html: Column) -> Column:
    """Targets of canonical links and of redirects by a refresh header, as they are written."""
    html = F.coalesce(html.cast("string"), F.lit(""))
    attribute = r"""=\s*["']?([^"'\s>]+)"""
    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(CANONICAL))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = F.concat(F.transform(canonical, lambda t: F.regexp_extract(t, r"(?i)\bhref" + attribute, 1)), F.transform(refresh, lambda t: F.regexp_extract(t, r"(?i)\burl" + attribute, 1)))
    return F.filter(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def without_dots(path: Column) -> Column:
    """A path without its segments `.` and `..`, as in RFC 3986; others stay as they are."""
    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(walked, tail), "/"))).otherwise(path)


def address(url: Column) -> Column:
    """A url without its fragment and dot segments, its host in lower case; null where there is no `://`."""
    host, path = host_path(url)
    return F.when(url.contains("://"), F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host, without_dots(path), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)))


def resolved(target: Column, url: Column) -> Column:
    """A link's target against the page's address; null for a fragment alone and for schemes without `://`."""
    host, path = host_path(url)
    origin = F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/"))
    whole = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
    whole = whole.when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target)).when(target.startswith("/"), F.concat(origin, target))
    return whole.when(target.startswith("?"), F.concat(origin, path, target)).otherwise(F.concat(origin, folder, target))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): a row per input row.

    redirects: more edges (src string, dst string) between urls, if any. Relative link targets are taken against the page's
    address. Every node of the links, crawled or not, is judged by the rules. Nodes are addresses, by a hash of 64 bits; a
    target that many pages share is one node with many edges. Rows with a null url, or without `://`, are allowed and have no
    aliases. Repeated rows are aliases of each other. An empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), (F.col(html_col) if html_col else F.lit(None)).alias("html"))
    host, path = host_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    whole = F.transform(html_links(F.col("html")), lambda t: resolved(t, F.col("url")))
    rows = cut(rows.select("page_id", "host", "path", "best", F.xxhash64(address(F.col("url"))).alias("node"), address(F.col("url")).isNotNull().alias("named"), F.filter(F.transform(whole, address), lambda t: t.isNotNull()).alias("to")))
    edges = rows.where("named and size(to) > 0").select(F.col("node").alias("src"), F.explode("to").alias("t"))
    targets, edges = edges.select("t"), edges.select("src", F.xxhash64("t").alias("dst"))
    if redirects is not None:
        pair = redirects.select(address(F.col("src").cast("string")).alias("a"), address(F.col("dst").cast("string")).alias("b")).where("a is not null and b is not null")
        edges = edges.union(pair.select(F.xxhash64("a"), F.xxhash64("b")))
        targets = targets.union(pair.select(F.explode(F.array("a", "b"))))
    there = host_path(F.col("t"))
    judged = rows.where("named").select("node", "best").union(targets.distinct().select(F.xxhash64("t"), best_rule(*there, rules))).where("best is not null")
    linked = connected_components(edges).withColumnRenamed("node", "at")
    nameless = rows.where("not named").select("page_id", "host", "path", "best", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("boolean").alias("blocked"))
    rows = rows.where("named").join(linked, F.col("node") == F.col("at"), "left").withColumn("group", F.coalesce("component", "node"))
    judged = judged.join(linked, F.col("node") == F.col("at"), "left").withColumn("group", F.coalesce("component", "node"))
    said = cut(judged.groupBy("group").agg(F.max(F.col("best.verdict") == "allow").alias("allowed"), F.max(F.col("best.verdict") == "block").alias("blocked")).withColumnRenamed("group", "g"))  # stored, so that a hub's rows can be split
    rows = rows.join(said, F.col("group") == F.col("g"), "left").select("page_id", "host", "path", "best", "allowed", "blocked").union(nameless)
    passed = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", passed).alias("verdict"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(verdict, h, pre)),
m AS (SELECT page_id, h || pre AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC) AS rn
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND rn = 1
"""
