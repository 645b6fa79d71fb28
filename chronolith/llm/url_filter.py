"""URL filters with redirect equivalence, in DataFrame operations alone.

A rule has a host, a path and a verdict; it fits its host and all subdomains if the url's path starts with the rule's
path, and the longest fitting rule decides. Urls that redirect to each other, or name each other as canonical, are
aliases: connected components over these edges (`<link rel=canonical>`, `<meta http-equiv=refresh>` and any given
redirects). Within a group of aliases a block passes to every url that no rule fits, unless an alias is explicitly
allowed: an explicit allow takes precedence over a passed-on block, and a url's own rule over both. A url that neither a
rule nor an alias decides is allowed.

Rules are met by an equi-join on the host's suffixes, so that a long list of rules is no loop over them, and each distinct
url is judged once.

Links are read from tags outside of comments, scripts, styles, templates and text fields. Html is cut at what opens these and
then into tags that end at the next angle bracket, so that no input makes a pattern go over the same text again and again. A comment that is
never closed reaches to the end. In a link, the character references that urls need are decoded.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and no alias, and is allowed. A null
html has no links. Aliases are compared without fragment, with host in lower case. Repeated rows are judged each; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of HTML: elements whose content is no markup, and the references that stand for a url's own characters.
RAW = "script|style|template|textarea|title|noscript|iframe"
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
#: A tag; quoted values may hold a closing bracket, but no opening one.
TAG = r"""(?is)<(?:link|meta)(?=[\s/])[^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+){0,64}>"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; null without scheme."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def _absolute(base: Column, link: Column) -> Column:
    """A link as it stands in a page of url `base`."""
    for reference, plain in REFERENCES:
        link = F.replace(link, F.lit(reference), F.lit(plain))
    scheme, site = F.substring_index(base, "://", 1), F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^[^:]*://[^/?#]*(/(?:[^?#]*/)?)?", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^[^?#]*", 0), link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(link, r"^(?:[.]/)+", "")))
    )


def _without(html: Column, opens: str, closes: str) -> Column:
    """Html without what stands from each `opens` to the next `closes` (patterns)."""
    parts = F.split(html, opens)
    after = lambda p: F.get(F.split(p, closes, 2), F.lit(1))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.coalesce(after(p), F.lit(""))), ""))


def link_tags(html: Column) -> Column:
    """The link and meta tags that are markup."""
    plain = _without(_without(html, "<!--", "-->"), rf"(?i)<(?:{RAW})(?=[\s/>])", rf"(?i)</(?:{RAW})(?=[\s/>])")
    return F.regexp_extract_all(plain, F.lit(TAG), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; empty where it has none."""
    at = rf"""(?is)[\s"'/]{name}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
    return F.concat(*(F.regexp_extract(tag, at, k) for k in (1, 2, 3)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): normal urls of a page and of what it names as canonical or refreshes to."""
    linked = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
    tags = linked.select("url", F.explode(link_tags(F.col("html"))).alias("tag"))
    is_canonical = F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    is_refresh = F.lower(F.trim(attribute(F.col("tag"), "http-equiv"))) == "refresh"
    to = F.regexp_extract(attribute(F.col("tag"), "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"'\s]+)", 1)
    link = F.when(F.col("tag").rlike("(?i)^<link"), F.when(is_canonical, F.trim(attribute(F.col("tag"), "href")))).otherwise(F.when(is_refresh, to))
    each = tags.select("url", link.alias("link")).where("link <> ''")
    return each.select(normal_url(F.col("url")).alias("u"), normal_url(_absolute(F.col("url"), F.col("link"))).alias("v"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the longest fitting rule for the distinct urls of a one-column table; urls without one are left out.

    `rules` has rule_host, rule_path and verdict ('allow' or 'block'). Of equally long rules a block decides.
    """
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = parts.where("host <> ''").select("url", "path", F.explode(F.array_distinct(suffix)).alias("rule_host"))
    named = rules.select("rule_host", "rule_path", "verdict", F.concat("rule_host", "rule_path").alias("rule"))
    fit = each.join(named, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict. `redirects` may give more edges, as from_url and to_url."""
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(normal_url(F.col("from_url")), normal_url(F.col("to_url"))))
    groups = connected_components(edges)
    decided = match_rules(groups.select(F.col("node").alias("url")), rules)
    told = groups.join(decided, groups["node"] == decided["url"]).groupBy("component").agg(F.min("verdict").alias("passed"))  # 'allow' comes before 'block'
    passed = groups.join(told, "component").select("node", "passed")
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    own = match_rules(urls, rules)
    keyed = urls.withColumn("node", normal_url(F.col("url"))).join(passed, "node", "left").select("url", "passed")
    judged = keyed.join(own, "url", "left").select("url", "rule", F.coalesce("verdict", "passed", F.lit("allow")).alias("verdict"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    out = rows.join(judged, "url", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
