"""URL rules, and block decisions that follow redirects and canonical links.

A page's own rule decides first: of all rules whose host is the page's host or
a parent domain of it and whose path starts the page's path, the longest wins
(longer host, then longer path). Pages without a rule take the decision of
their group: urls joined by redirects (meta refresh) and canonical links are
one site under several names, found as connected components. A group that holds
a blocked url is blocked, unless it also holds an explicitly allowed one: an
explicit allow takes precedence. All else is allowed.

Urls are compared without scheme and fragment, with the host in lower case.
Relative targets are resolved against the page's host, and its path where they
start with neither a slash nor a scheme.

Rows: a null url, or one without ``://``, has an empty host and path, no rule
and is no alias of anything; a null html has no links. Rows that repeat a
page_id or url are judged alike, one output row for each input row. Built-in
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import components, kept

# (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# rel is a list of words; one of them must be the link's
_REL = r"""(?:"\s*(?:[^"\s>]+\s+)*canonical(?=[\s"])|'\s*(?:[^'\s>]+\s+)*canonical(?=[\s'])|canonical(?=[\s/>]))"""
_CANONICAL = rf"(?is)<link\b(?=[^>]*\brel\s*=\s*{_REL})[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://``, up to a slash, question mark or hash."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query: what two names of one url must share; null without a host."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def rule_of(own_host: Column, own_path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null for none."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((own_host == domain) | F.endswith(own_host, F.lit("." + domain))) & F.startswith(own_path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + prefix).alias("rule"))).otherwise(found)
    return found


def links(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that a redirect or canonical link joins, all of a page but those in comments."""
    url, html = F.col("url"), F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "")
    with_links = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    named = with_links.select(
        address(url).alias("a"), host(url).alias("own_host"), path(url).alias("own_path"),
        F.explode(F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), 1), F.regexp_extract_all(html, F.lit(_REFRESH), 1))).alias("target"),
    ).where("a IS NOT NULL AND target <> ''")
    target = F.regexp_replace("target", "&amp;", "&")
    base = F.concat(F.lit("x://"), F.col("own_host"))
    folder = F.regexp_replace("own_path", r"[^/]*\z", "")
    whole = (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("x:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(base, target))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), target))
    )
    return named.select("a", address(whole).alias("b")).where("b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and the group it belongs to."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    url = F.col("url")
    own = rule_of(F.col("host"), F.col("path"), rules)
    rows = kept(
        pages.select("page_id", address(url).alias("address"), host(url).alias("host"), path(url).alias("path"))
        .withColumn("own", own).select("page_id", "address", "host", "path", "own.rule", "own.verdict"),
        "rows",
    )
    # names as 64-bit numbers; links, targets that are no page included
    number = F.xxhash64
    edges = kept(links(pages).select(number("a").alias("a"), number("b").alias("b"), F.col("b").alias("target")), "links")
    groups = components(edges.select("a", "b"))
    x = F.concat(F.lit("x://"), F.col("target"))
    ruled = rows.where("address IS NOT NULL AND rule IS NOT NULL").select(number("address").alias("id"), "verdict").union(
        edges.select(F.col("b").alias("id"), rule_of(host(x), path(x), rules)["verdict"].alias("verdict")).where("verdict IS NOT NULL")
    )
    decided = ruled.join(groups, "id").groupBy("component").agg(
        F.max((F.col("verdict") == "allow").cast("int")).alias("allowed")
    ).select("component", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("decision"))
    by_name = kept(groups.join(decided, "component", "left").select("id", "component", "decision"), "decisions")
    return rows.withColumn("id", number("address")).join(by_name, "id", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "decision", F.lit("allow")).alias("verdict"),
        F.col("component").alias("alias_group"),
    )
