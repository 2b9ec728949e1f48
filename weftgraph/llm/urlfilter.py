"""URL rules that follow redirects and canonical links (operator 5); DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import LOWER, UPPER, broadcast_if_small, cut
from weftgraph.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # begins with /

    @property
    def name(self) -> str:
        return self.host + self.path


#: the rules of the registered query; a rule list is a parameter of at most some thousand entries
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
#: an attribute of its own, not the end of another's name, and its value with or without quotes
_VALUE = r"(?is)(?<![^\s\"'/]){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag; empty if it isn't there."""
    return F.concat(*[F.regexp_extract(tag, _VALUE.format(name), k) for k in (1, 2, 3)])


def page_links(html: Column) -> Column:
    """All canonical links and refreshes of a page, without those in comments."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, "")
    links = F.filter(F.regexp_extract_all(bare, F.lit(_LINK), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(bare, F.lit(_META), F.lit(0)), lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    targets = F.concat(
        F.transform(links, lambda t: F.trim(attribute(t, "href"))),
        F.transform(metas, lambda t: F.trim(F.regexp_extract(attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))),
    )
    return F.array_distinct(F.transform(F.filter(targets, lambda t: t != ""), lambda t: F.regexp_replace(t, "&amp;", "&")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the contract cuts them; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct(verdict, rule)`` of the longest rule that fits; block wins among equal names; else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name, r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("rule"))).otherwise(found)
    return found


def canonical(url: Column) -> Column:
    """A url without scheme, fragment, tracking parameters and last slash: equal forms are one page."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|fbclid|gclid|ref|ref_src)="))), "&")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.|:(80|443)$", ""), F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def absolute(link: Column, base: Column) -> Column:
    """A link as seen from a page: absolute, without scheme, from the root, a query of the page, or beside the page."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    joined = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), base)
        .when(link != "", F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), link))
    )
    # . and .. of the path, however many; at the root .. stays there
    head, rest = F.regexp_extract(joined, r"(?s)^([^?#]*?://[^/?#]*)", 1), F.regexp_extract(joined, r"(?s)^[^?#]*([?#].*)$", 1)
    path = F.regexp_extract(joined, r"(?s)^[^?#]*?://[^/?#]*/([^?#]*)", 1)
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), none, step)
    open_end = F.when(path.rlike(r"(?:^|/)\.\.?$") & (F.size(parts) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(head, F.lit("/"), F.array_join(parts, "/"), open_end, rest)).otherwise(joined)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_of`` for every row.

    The longest fitting rule decides. A url without one is blocked if any url that redirects or
    canonical links join it to is blocked by a rule and none is allowed by one; else it is allowed. Urls at both ends of
    every edge count, whether or not they have a page row.
    All links of a page are read, comments left out, and those of ``redirects(url, target)``, if given. ``alias_of`` is
    the smallest canonical form of the group. A null url has empty host and path, no rule, no
    alias, and is allowed; null html has no links. Repeated rows are judged alike. An empty
    table gives no rows. Other columns are ignored, whatever their names; a very long page is searched whole, in linear time.
    """
    rows = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), page_links(F.col("html")).alias("targets")))
    host, path = host_and_path(F.col("url"))
    judged = rows.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("node")).withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))

    links = rows.where(F.size("targets") > 0).select("url", F.explode("targets").alias("target")).where("url is not null")
    links = links.select("url", absolute(F.col("target"), F.col("url")).alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select("url", absolute(F.col("target"), F.col("url")).alias("target")).where("url is not null and target is not null"))
    edges = cut(links.select(canonical(F.col("url")).alias("a"), canonical(F.col("target")).alias("b"), "url", "target").where("a is not null and b is not null"))
    roots = cut(connected_components(edges))

    def told_by(node: str, url: str) -> DataFrame:
        return edges.select(F.col(node).alias("node"), longest_rule(*host_and_path(F.col(url)), rules).alias("r"))

    named = judged.where("node is not null")
    told = named.select("node", "r").union(told_by("a", "url")).union(told_by("b", "target")).where("r is not null")
    told = told.groupBy("node").agg(F.max(F.col("r.verdict") == "block").alias("blocks"), F.max(F.col("r.verdict") == "allow").alias("allows"))
    group = F.coalesce("root", "node")
    groups = told.join(roots, "node", "left").groupBy(group.alias("group")).agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows"))
    blocked = groups.where("blocks and not allows").select("group")
    out = named.join(broadcast_if_small(roots), "node", "left").withColumn("group", group)

    def shown(df: DataFrame, verdict: Column) -> DataFrame:
        return df.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.col("group").alias("alias_of"))

    # a page without rule can only be blocked through another url of its group
    ruled = shown(out.where("r is not null"), F.col("r.verdict"))
    free = shown(out.where("r is null").join(blocked.withColumn("hit", F.lit(True)), "group", "left"), F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    # without a host there is no alias, and no key to join on
    nameless = shown(judged.where("node is null").withColumn("group", F.col("node")), F.coalesce(F.col("r.verdict"), F.lit("allow")))
    return ruled.unionByName(free).unionByName(nameless)
