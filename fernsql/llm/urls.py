"""URL filter with redirect equivalence.

A rule (``host/path``) fits its host and all its subdomains if the url's path starts with the rule's; of those that
fit the longest wins (of equal length: allow, then the lesser text). Redirects and canonical links are edges between
urls; connected components over them are aliases of one another. A block by a rule anywhere in a component, be
it of a linked url that isn't in the table, blocks every alias that no rule allows: an explicit rule on a url
always comes before what its aliases hand on. Everything else is allowed.

A url's node is the url without fragment, scheme and host in lower case; links are resolved by RFC 3986. Null urls and urls without ``://`` have
empty host and path, no rule and no node. Repeated rows each get the verdict. Hosts, hot urls and hot components are
never gathered: verdicts of a component meet by partial aggregation, and go back to its urls by ``join_hot``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot
from .components import connected_components

PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"
#: Rules up to this number go to each task; beyond it they are joined by shuffle.
BROADCAST_RULES = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 2)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))


def node(url: Column) -> Column:
    """The url's node, null where there is no ``://``."""
    whole = F.concat(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit("://"), host(url), path(url), F.regexp_extract(url, PARTS, 4))
    return F.when(F.contains(url, F.lit("://")), whole)


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, said) of the nodes that a rule (verdict, rule) fits."""
    rules = rules.select(F.col("rule"), F.col("verdict").alias("said")).filter("rule is not null and verdict in ('allow', 'block')").distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("rule") - F.instr("rule", "/") + 1).distinct().collect())  # distinct lengths of rules' paths
    small = rules.count() <= BROADCAST_RULES
    labels = F.split("host", r"\.")
    parts = urls.select("node", host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    suffixes = parts.select("node", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    tries = suffixes.select("node", "host", "path", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).filter(F.length("path") >= F.col("n"))
    tries = tries.select("node", F.concat("host", F.expr("left(path, n)")).alias("rule"))
    fit = tries.join(F.broadcast(rules) if small else rules, "rule")
    best = F.min_by(F.struct("rule", "said"), F.struct(-F.length("rule"), "said", "rule"))
    return fit.groupBy("node").agg(best.alias("best")).select("node", "best.rule", "best.said")


def _undotted(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments, by RFC 3986."""
    segments = F.split(path, "/", -1)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s))))
    end = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def _absolute(base: Column, link: Column) -> Column:
    """A link resolved against the url of its page."""
    scheme, place = F.regexp_extract(base, PARTS, 1), F.regexp_extract(base, PARTS, 2)
    root = F.concat(scheme, F.lit("://"), place)
    folder = F.regexp_extract(F.when(path(base) == "", "/").otherwise(path(base)), r"(?s)^(.*/)", 1)
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .when(link.startswith("#"), base)
        .when(link != "", F.concat(root, folder, link))
    )
    return F.concat(F.regexp_extract(whole, PARTS, 1), F.lit("://"), F.regexp_extract(whole, PARTS, 2), _undotted(path(whole)), F.regexp_extract(whole, PARTS, 4))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): the nodes of pages and of all their canonical links and refresh redirects."""
    canonical = F.regexp_extract_all("html", F.lit(r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)"""), F.lit(1))
    refresh = F.regexp_extract_all("html", F.lit(r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)"""), F.lit(1))
    href = F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    target = F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    linked = pages.filter(F.contains("url", F.lit("://")) & F.expr("html rlike '(?i)canonical|http-equiv'"))
    both = linked.select("url", F.explode(F.concat(href, target)).alias("link")).filter("link != ''").withColumn("link", F.replace(F.col("link"), F.lit("&amp;"), F.lit("&")))
    return both.select(node(F.col("url")).alias("a"), node(_absolute(F.col("url"), F.col("link"))).alias("b")).filter("b is not null")


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component): redirects are further edges (source, target), urls both."""
    scratch = Scratch(spark, "urls")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")).filter("a is not null and b is not null"))
    edges = scratch.save(edges.distinct(), "edges")
    components = connected_components(edges, scratch)
    keyed = pages.select("page_id", "url", node(F.col("url")).alias("node"))
    own = keyed.filter("node is not null").groupBy("node").agg(F.count("*").alias("pages"))
    judged = scratch.save(judge(own.select("node").unionAll(components.select("node")).distinct(), rules), "judged")
    blocks = components.join(judged.select("node", F.col("said")), "node", "left").groupBy("component").agg(F.max(F.coalesce(F.col("said") == "block", F.lit(False))).alias("blocked"), F.count("*").alias("nodes"))
    aliases = join_hot(components, blocks, ["component"], "nodes")
    verdict = F.coalesce("said", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict")
    # A page table may hold one url very often, and many rows without one; these meet nothing.
    known = scratch.save(own.join(judged, "node", "left").join(aliases, "node", "left").select("node", "pages", "rule", verdict, "component"), "known")
    judged_pages = join_hot(keyed.filter("node is not null"), known, ["node"], "pages").select("page_id", "url", "rule", "verdict", "component")
    others = keyed.filter("node is null").select("page_id", "url", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("component"))
    return judged_pages.unionAll(others).select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", "verdict", "component")
