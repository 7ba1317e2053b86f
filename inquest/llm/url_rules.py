"""URL filters: rules by host and path, and block decisions that reach the aliases of a URL.

Pages that redirect to each other or name each other as canonical are one resource under several addresses. Their
addresses are nodes, redirects and canonical links are edges, and connected components, found by joins, are the groups
of aliases. A rule that fits an address decides about it; a block decision on any address of a group also reaches the
addresses of the group that no rule fits. An explicit allow always stands, whatever the aliases of its address say.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import if_small, in_arrow, stored, text_of
from inquest.operators.components import components

ALLOW, BLOCK = "allow", "block"
#: Verdict and host with path. A plan holds them as literals: some hundreds at most.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for null and without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased, with a port where one is given; empty for null and without `://`."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path up to `?` or `#`; empty for null and without `://`."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What a server is asked for: host, path and query. Fragments and the scheme are left out; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)))


def _longest_first(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of rules of one length an allow comes first."""
    return sorted(rules, key=lambda r: (-len(r[1]), r[0] != ALLOW))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and its subdomains, where the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(_longest_first(rules)):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def rules_by_join(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct addresses (host, path) -> (_host, _path, _own): the longest of any number of rules (verdict, rule) that fits each.

    An address meets rules by the ends of its host and by the starts of its path, of those lengths alone that rules of
    the host have: equal keys, so neither a host of many rules nor one of many pages is compared pair by pair.
    """
    parts = rules.select("verdict", "rule", F.regexp_extract("rule", "^([^/]*)", 1).alias("at"), F.regexp_extract("rule", "^[^/]*(.*)", 1).alias("begin")).distinct()
    parts = stored(parts, "url-rules")
    labels = F.split("host", "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = addresses.where("host <> ''").select("host", "path", F.explode(ends).alias("at"))
    sizes = stored(parts.select("at", F.length("begin").alias("size")).distinct(), "rule-sizes")
    keyed = named.join(if_small(sizes), "at").where(F.length("path") >= F.col("size")).withColumn("begin", F.substring(F.col("path"), F.lit(1), F.col("size")))
    met = keyed.join(if_small(parts), ["at", "begin"])
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), (F.col("verdict") == ALLOW), F.col("rule")))
    return met.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(best.alias("_own"))


def decided(rows: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Rows with host and path and `_own`, the struct (rule, verdict) of the longest rule that fits, else null. A short list of rules is part of the plan, a table is joined."""
    if not isinstance(rules, DataFrame):
        return rows.withColumn("_own", rule_for(F.col("host"), F.col("path"), rules))
    found = stored(rules_by_join(rows.select("host", "path").distinct(), rules), "rules-of-urls")
    return rows.join(if_small(found), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b.*?(?:</\1|\Z)|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_REFRESH = re.compile(r"\s*[0-9.]+\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']+)", re.I)


def targets_of(url: str, page: str) -> list[str]:
    """The absolute targets of canonical links and refresh redirects of a page; malformed ones are left out."""
    base, found = url, []
    for m in _PART.finditer(page):
        if not m[2]:
            continue
        named = {a[1].lower(): markup.unescape(a[2] or a[3] or a[4] or "").strip() for a in _ATTRIBUTE.finditer(m[3])}
        tag, to = m[2].lower(), None
        if tag == "base":
            base = _joined(url, named.get("href", "")) or base
        elif tag == "link" and "canonical" in named.get("rel", "").lower().split():
            to = named.get("href")
        elif tag == "meta" and named.get("http-equiv", "").lower() == "refresh" and (r := _REFRESH.match(named.get("content", ""))):
            to = r[1].strip()
        if to and not to.startswith("#"):
            found.append(_joined(base, to))
    return [t for t in found if t]


def _joined(base: str, to: str) -> str | None:
    try:
        return urljoin(base, to) if to else None
    except ValueError:
        return None


def declared_links(pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """Pages -> (source, target): addresses that a page declares to be the same resource. Only pages that name a link reach Python."""
    some = pages.select(text_of(url).alias("url"), text_of(content).alias("html")).where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    schema = pa.schema([("source", pa.string()), ("target", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(u, t) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()) for t in targets_of(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], schema=schema)

    return in_arrow(some, run, "source string, target string")


def blocked_aliases(links: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES) -> DataFrame:
    """Links (source, target) of URLs -> distinct `address`es of groups that hold a blocked address."""
    ends = links.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b")).where("a is not null and b is not null")
    groups = stored(components(ends), "alias-groups")
    as_url = F.concat(F.lit("://"), F.col("node"))
    judged = decided(groups.select("component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules)
    blocked = stored(judged.where(F.col("_own")["verdict"] == BLOCK).select("component").distinct(), "blocked-groups")
    return groups.join(if_small(blocked), "component", "left_semi").select(F.col("node").alias("address"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, url: str = "url", content: str = "html") -> DataFrame:
    """Every page with `host`, `path`, `rule` (the longest that fits, else null) and `verdict`, allow or block.

    `rules` are a short list, or a table (verdict, rule) of any size. `redirects` (source, target) are edges known from elsewhere, such as a crawler's log, besides those that pages
    declare. Null urls and urls without `://` have an empty host and path, no rule and no aliases, and are allowed; null
    and empty html declares nothing; long html is searched whole. Repeated rows and urls stay and get the same verdict;
    of rules of one length an allow wins. An empty table gives an empty result. Columns of `pages` named `host`,
    `path`, `rule`, `verdict`, `_address`, `_alias` or `_own` are replaced or left out.
    """
    made = ("host", "path", "rule", "verdict", "_address", "_alias", "_own")
    kept = [c for c in pages.columns if c not in made and c != content]
    links = declared_links(pages, url, content)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    blocked = stored(blocked_aliases(links, rules), "blocked-aliases")
    at = text_of(url)
    own = pages.select(*kept, host_of(at).alias("host"), path_of(at).alias("path"), address_of(at).alias("_address"))
    met = decided(own, rules).join(if_small(blocked.withColumnRenamed("address", "_alias")), F.col("_address") == F.col("_alias"), "left")
    verdict = F.coalesce(F.col("_own")["verdict"], F.when(F.col("_alias").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW))
    return met.select(*kept, "host", "path", F.col("_own")["rule"].alias("rule"), verdict.alias("verdict"))


def verdicts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict."""
    return judge(pages.select("page_id", "url", "html")).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")


#: Canonical links and refreshes with absolute targets, as generated pages have them, and the closure of their groups.
SQL = """
WITH RECURSIVE urls AS (
  SELECT page_id, html, coalesce(url, '') AS url,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS asked FROM urls
), links AS (
  SELECT host || asked AS a, unnest(regexp_extract_all(html, '<link rel="canonical" href="[a-z]+://([^"#]*)', 1)) AS b FROM named
  UNION SELECT host || asked, unnest(regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]+; *url=[a-z]+://([^"#]*)', 1)) FROM named
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/?]*') AS host, regexp_extract(a, '^[^/?]*([^?]*)', 1) AS path FROM both_ways),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
parts AS (SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
node_rules AS (
  SELECT node, arg_max(verdict, length(rule)) AS verdict FROM nodes JOIN parts ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY node
), reached AS (
  SELECT node FROM node_rules WHERE verdict = 'block' UNION SELECT b FROM reached JOIN both_ways ON a = node
), page_rules AS (
  SELECT page_id, host, path, asked, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM named LEFT JOIN parts ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND host || asked IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict FROM page_rules
"""
