"""URL block lists with redirect equivalence, in DataFrame operations only.

Pages that redirect to each other or name each other canonical are one resource under several addresses. A blocked address blocks
its aliases that no rule names: components over redirect and canonical-link edges carry the decision. An explicit allow comes first, on the
address itself by the longest rule, and in a component: one allowed address there and no unnamed alias is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Fits host and its subdomains where a url's path starts with path."""

    host: str
    path: str
    verdict: str  # "block" or "allow"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """name or verdict of the longest rule that fits; null if none does. The rules become one CASE, longest first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


#: Character references that occur in addresses; & itself comes last.
_REFERENCES = [("&(quot|#34|#x22);", '"'), ("&(apos|#39|#x27);", "'"), ("&(lt|#60|#x3c);", "<"), ("&(gt|#62|#x3e);", ">"), ("&(amp|#38|#x26);", "&")]


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value without the white space around it, its character references resolved."""
    quoted = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    value = F.when(quoted != "", quoted).otherwise(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""", 1))
    for reference, character in _REFERENCES:
        value = F.regexp_replace(value, f"(?i){reference}", character)
    return F.trim(value)


def resolved(base: Column, link: Column) -> Column:
    """An absolute address for a link on the page base: absolute, //host/path, /path, or relative to base's folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.when(bare.rlike(r"(?s)://[^/]*/"), F.regexp_extract(bare, r"(?s)^(.*/)", 1)).otherwise(F.concat(bare, F.lit("/")))
    return F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("?"), F.concat(bare, link)).otherwise(F.concat(folder, link))


def address(url: Column) -> Column:
    """The key of a resource: the url without its fragment, which no server sees, its scheme and host in lower case (A-Z)."""
    whole = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^([^#]*)", 1)
    origin = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(origin, UPPER, UPPER.lower()), F.substr(whole, F.length(origin) + 1))


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst: from each page to every address that a canonical link or a refresh redirect of it names."""
    tags = lambda pattern: F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))
    canonical = F.transform(tags(r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)"""), lambda tag: _attribute(tag, "href"))
    redirect = F.transform(tags(r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)"""), lambda tag: F.trim(F.regexp_extract(_attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1)))
    links = pages.where("url is not null").select("url", F.explode(F.concat(canonical, redirect)).alias("link")).where("link <> ''")
    return links.select(address(F.col("url")).alias("src"), address(resolved(F.col("url"), F.col("link"))).alias("dst")).distinct()


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Each row of pages (page_id, url, html) with host, path, rule, verdict and component (null: no links).

    redirects: further edges (src, dst), such as a crawler's log of HTTP redirects. Null urls and those without :// have an empty host
    and path; no rule fits them. Rows that repeat a url, or write its scheme or host in another case, share its verdict. Null html has no links;
    of several canonical links or redirects in a page each counts. Other columns of pages are ignored; an empty table gives an empty result. Without a rule the verdict is block where the component
    holds a blocked address and no allowed one, else allow. Hot components are split by the join, no group is collected.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    named = named.withColumns({"rule": matched(F.col("host"), F.col("path"), rules, "name"), "own": matched(F.col("host"), F.col("path"), rules, "verdict"), "key": address(F.col("url"))})
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.where("src is not null and dst is not null").select(address(F.col("src")), address(F.col("dst"))))
    group = stored(components(stored(edges.where("src <> dst"), "links")), "aliases")
    node = F.col("node")
    decided = group.select("component", matched(host_of(node), path_of(node), rules, "verdict").alias("v")).groupBy("component").agg(F.max(F.when(F.col("v") == "block", 1).otherwise(0)).alias("blocked"), F.max(F.when(F.col("v") == "allow", 1).otherwise(0)).alias("allowed"))
    blocked = stored(decided.where("blocked = 1 and allowed = 0").select("component"), "blocked")
    aliases = stored(group.join(blocked.withColumn("bad", F.lit(True)), "component", "left"), "verdicts")
    out = named.join(aliases.select(F.col("node").alias("key"), "component", "bad"), "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "component")
