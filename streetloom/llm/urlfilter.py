"""URL rules, and block decisions that follow redirects and canonical links.

A rule names a host with all its subdomains and the beginning of a path; the
longest fitting rule decides. URLs that redirect to each other or name each
other as canonical are one resource: their connected component takes over an
explicit allow of any member, else an explicit block, else nothing. Everything
here is a DataFrame expression, join or aggregation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.graph.components import connected_components
from streetloom.plans.shared import materialise

from .common import columns_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """The URL without its fragment and with scheme and host in lower case: the identity of a resource. Null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), tail))


def decide(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule (of two equally long ones the allowing), or nulls.

    The rules are a parameter of the query and become one expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(set(rules), key=lambda r: (len(r.name), r.verdict == "allow")):
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"not a verdict: {rule.verdict}")
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_REFRESH = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*['\"]?([^\"'\s>]+)"


def _absolute(base: Column, link: Column) -> Column:
    """A link as a URL; a path from the root takes scheme and host of ``base``. Other relative links: null."""
    scheme = F.substring_index(base, "://", 1)
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(scheme, F.lit("://"), host_of(base), link))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: addresses of each page and of its canonical link or refresh redirect."""
    hot = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).where(F.instr(url_col, "://") > 0)
    tags = hot.select(F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(html_col, F.lit(_TAG), F.lit(0))).alias("tag"))
    link = F.when(F.col("tag").rlike(r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"), F.regexp_extract("tag", _HREF, 1))
    link = link.when(F.col("tag").rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract("tag", _REFRESH, 1))
    found = tags.select("url", link.alias("link")).where("link <> ''")
    return found.select(address_of(F.col("url")).alias("a"), address_of(_absolute(F.col("url"), F.col("link"))).alias("b")).where("a <> b")


def judge(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
    redirects: DataFrame | None = None, default: str = "allow",
) -> DataFrame:
    """Verdict of every page.

    Returns ``id_col, url_col, host, path, rule, verdict, component``: a page
    takes the verdict of its own rule; else, if its component holds an address
    that a rule allows, allow; else, if it holds one that a rule blocks, block;
    else ``default``. Edges come from the pages (``html_col``; None: none) and
    from ``redirects`` (columns ``source, target``). A URL that is null or has
    no ``://`` has no host, fits no rule and has no aliases. Repeated rows come
    back as often as they came.
    """
    columns_of(pages, id_col, url_col)
    url = F.col(url_col)
    edges = page_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        own = redirects.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b"))
        edges = own if edges is None else edges.unionByName(own)
    judged = pages.select(F.col(id_col), url, host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    judged = judged.withColumn("own", decide(F.col("host"), F.col("path"), rules))
    if edges is None:
        judged = judged.withColumn("component", F.lit(None).cast("string")).withColumn("reached", F.lit(None).cast("string"))
    else:
        member = connected_components(edges, "a", "b")
        own = decide(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
        # "allow" sorts before "block", so the least verdict is the one that takes precedence.
        group = member.groupBy("component").agg(F.min(own).alias("reached"))
        aliases = materialise(member.join(group, "component").select(F.col("node").alias("address"), "component", "reached"))
        judged = judged.join(aliases, "address", "left")
    verdict = F.coalesce(F.col("own")["verdict"], F.col("reached"), F.lit(default))
    return judged.select(id_col, url_col, "host", "path", F.col("own")["rule"].alias("rule"), verdict.alias("verdict"), "component")
