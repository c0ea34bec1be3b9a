"""URL filters with redirect equivalence, in DataFrame functions only.

A rule is ``host/path-prefix``; it fits its host and all subdomains when the url's path starts with
the rule's path, and the longest fitting rule decides. A url without a fitting rule takes the
decision of its aliases: urls are joined by the canonical links and meta refreshes of pages and by
given redirects, and decisions spread over the connected components of those edges. In a component,
an allow rule wins over any block rule; a component with neither is allowed.

Every canonical link and refresh of a page counts, with its attributes in any order and case, outside
of comments, scripts and styles. Targets are resolved against the page's url (RFC 3986: by scheme,
host, path, query or folder, with ``.`` and ``..``). Urls are the same node when they differ in the
case of scheme or host, a default port, an empty path or the fragment only. Other spellings
(``www.``, tracking parameters, a trailing slash) are different urls unless an edge joins them.

Defined results: a url that is null or has no ``://`` has an empty host and path, no aliases and
verdict allow; null or empty html has no links; very long html is read whole, in time proportional to
its length. Repeated rows are judged alike. An empty table gives an empty result. Columns of the
pages other than the id, url and html are not returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
REFRESH = r"""(?i)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)"""
# Character references that occur in urls.
REFERENCES = (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&"))
PORTS = {"http": "80", "https": "443"}


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def scheme_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)


def node_of(url: Column) -> Column:
    """A url as a node of the alias graph; null without ``://``."""
    scheme, host, path = scheme_of(url), host_of(url), path_of(url)
    for name, port in PORTS.items():
        host = F.when((scheme == name) & host.endswith(f":{port}"), F.regexp_replace(host, ":[0-9]+$", "")).otherwise(host)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` ((action, rule) pairs, a few hundred at most) that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without ``.`` and ``..`` segments."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.size(segments) - 1
    dots = F.get(segments, last).isin(".", "..")
    kept = F.aggregate(segments, F.lit(""), lambda done, s: F.when(s == ".", done).when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), s)))
    return F.when(~path.rlike(r"/\.{1,2}(/|$)"), path).otherwise(F.concat(kept, F.when(dots, "/").otherwise("")))


def absolute(target: Column, page: Column) -> Column:
    """A link's target as a url; null where it is empty, a fragment alone, or of a scheme without ``://``."""
    path = F.regexp_replace(path_of(page), "[^/]*$", "")
    site = F.concat(scheme_of(page), F.lit("://"), F.regexp_extract(page, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when(target.startswith("//"), F.concat(scheme_of(page), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, without_dots(own), rest))
        .when(target.startswith("?"), F.concat(site, path_of(page), target))
        .otherwise(F.concat(site, without_dots(F.concat(F.when(path == "", "/").otherwise(path), own)), rest))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted in either way or bare; empty without one."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def targets(html: Column) -> Column:
    """All targets of canonical links and refreshes, as they are written; null for a page that cannot have any."""
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), 0)

    def target(tag: Column) -> Column:
        canonical = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"
        found = F.when(tag.rlike("(?i)^<link"), F.when(canonical, attribute(tag, "href"))).when(refresh, F.regexp_extract(attribute(tag, "content"), REFRESH, 1))
        for written, meant in REFERENCES:
            found = F.replace(found, F.lit(written), F.lit(meant))
        return F.regexp_replace(found, r"^\s+|\s+$", "")

    return F.when(html.rlike("(?i)canonical|refresh"), F.array_compact(F.transform(tags, target)))


def edges(pages: DataFrame, url_col: str, html_col: str | None, redirects: DataFrame | None) -> DataFrame | None:
    """(url, target) of all links and redirects, or None without a source of them."""
    out = None
    if html_col:
        linked = pages.filter(F.col(url_col).contains("://")).select(F.col(url_col).alias("url"), F.explode(targets(F.col(html_col))).alias("target"))
        out = linked.select("url", absolute(F.col("target"), F.col("url")).alias("target"))
    if redirects is not None:
        given = redirects.select(F.col(f"`{redirects.columns[0]}`").alias("url"), F.col(f"`{redirects.columns[1]}`").alias("target"))
        out = given if out is None else out.unionByName(given)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str | None = "html", id_col: str = "page_id", redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``redirects``: optional (source, target) urls."""
    allow = [r for action, r in rules if action == "allow"]
    action_of = lambda rule: F.when(rule.isNull(), None).when(rule.isin(allow), "allow").otherwise("block")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = base.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("action", action_of(F.col("rule")))
    found = edges(pages, url_col, html_col, redirects)
    inherited = F.lit(None).cast("boolean")
    ends = None if found is None else stored(found.select("url", "target", node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).filter("a is not null and b is not null"))
    if ends is not None and not ends.isEmpty():
        groups = stored(components(ends).withColumnRenamed("node", "key"))
        # urls without a node, or without edges, meet nothing and each other nowhere
        own = own.withColumn("key", F.coalesce(node_of(F.col("url")), F.concat(F.lit("none:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
        own = own.join(broadcast_if_small(groups), "key", "left")
        # rules also decide on urls that are only linked, without a page
        ends_of = ends.select(F.explode(F.array("url", "target")).alias("url")).distinct().select(node_of(F.col("url")).alias("key"), action_of(fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)).alias("action"))
        linked = ends_of.filter("action is not null").join(broadcast_if_small(groups), "key").select("component", "action")
        # one flag a component, from partial maxima
        decisions = own.filter("component is not null and action is not null").select("component", "action").unionByName(linked)
        decided = stored(decisions.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed")))
        own = own.withColumn("component", F.coalesce("component", F.col("key"))).join(broadcast_if_small(decided), "component", "left")
        inherited = F.col("allowed")
    return own.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.coalesce(inherited, F.lit(True)), "allow").otherwise("block")).alias("verdict"))
