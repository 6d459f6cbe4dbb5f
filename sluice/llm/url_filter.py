"""URL filters with redirect equivalence, in DataFrame functions alone.

Rules judge a URL by host and path. Redirect and canonical-link edges join URLs into components; a URL without a rule
takes the decision of its aliases, where an explicit allow goes before any block. A URL's own rule goes before both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: (host, path, verdict) (fixed values of the contract).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a browser takes no tags from, the tags that state links, an attribute of a tag, where a refresh goes, and a character reference.
_SKIPPED = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
_TAGS = r"""(?is)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+>"""
_ATTRIBUTE = r"""(?is)[\s"'/]%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?["']?([^"'\s]+)"""
_ENTITY = r"(?s)^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);(.*)$"


def _after(url: Column) -> Column:
    """What follows the first ://; empty without it, or of null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def _place(url: Column) -> Column:
    """Host and path together: up to a question mark or hash."""
    return F.substring_index(F.substring_index(_after(url), "#", 1), "?", 1)


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; without ://, or of null, empty."""
    return F.translate(F.substring_index(_place(url), "/", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    place = _place(url)
    return F.when(F.contains(place, F.lit("/")), F.substr(place, F.instr(place, "/"))).otherwise("")


def _without_dots(path: Column) -> Column:
    """A path from the root without its segments . and .. (which takes the segment before it along)."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    resolved = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda held, s: F.when(s == ".", held).when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(s))),
        lambda held: F.concat(F.lit("/"), F.array_join(held, "/"), F.when((F.size(held) > 0) & path.rlike(r"/\.{1,2}\z"), "/").otherwise("")),
    )
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), resolved).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL as a node: its host, path (without . and .. segments) and query, without scheme and fragment; null without a host."""
    host, path = host_of(url), path_of(url)
    query = F.substr(F.substring_index(_after(url), "#", 1), F.length(host) + F.length(path) + 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(_without_dots(path)), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of rule (host and path together) and verdict; null without one. rules is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, in quotes or bare; empty without one."""
    return F.concat(*[F.regexp_extract(tag, _ATTRIBUTE % name, k) for k in (1, 2, 3)])


def _decoded(text: Column) -> Column:
    """The text with its character references read: &amp; &lt; &gt; &quot; &apos; and numbers; others stay as they are."""

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, _ENTITY, 1)
        number = F.when(F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x", F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("long")
        sign = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for entity, meant in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            sign = F.when(name == entity, meant).otherwise(sign)
        return F.coalesce(F.concat(sign, F.regexp_extract(part, _ENTITY, 2)), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), read), ""))).otherwise(text)


def links(pages: DataFrame) -> DataFrame:
    """url, target: a row for each canonical link and redirect that a page's html states, as an absolute URL; pages without one are left out.

    Comments and scripts state nothing. Character references in attributes are read. Targets may be absolute, or
    relative to the scheme, host, folder or path of the page; fragments alone and other schemes (mailto:) are no links.
    """
    rows = pages.select(pages["url"], pages["html"]).filter(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").isNotNull())
    # one step a projection: an expression that is used again is computed once
    rows = rows.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _SKIPPED, ""), F.lit(_TAGS), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    is_link = tag.rlike("(?i)^<link")
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    stated = F.when(is_link & canonical, _attribute(tag, "href")).when(~is_link & refresh, _attribute(tag, "content")).otherwise("")
    rows = rows.select("url", is_link.alias("is_link"), stated.alias("stated")).filter("stated <> ''").select("url", "is_link", _decoded(F.col("stated")).alias("stated"))
    goal = F.when(F.col("is_link"), F.regexp_replace("stated", r"^\s+|\s+\z", "")).otherwise(F.regexp_extract("stated", _REFRESH, 1))
    rows = rows.select("url", goal.alias("t"))
    t = F.col("t")
    rows = rows.filter((t != "") & ~t.rlike(r"(?i)^url\s*=") & ~t.startswith("#")).select("url", "t", F.regexp_extract("url", r"(?s)^(.*?)://", 1).alias("scheme"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("url", "t", "scheme", "path", F.concat("scheme", F.lit("://"), "host").alias("base"), F.concat(F.lit("/"), F.regexp_extract("path", r"(?s)^/(.*/)", 1)).alias("folder"))
    whole = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat("scheme", F.lit(":"), "t")).when(t.startswith("/"), F.concat("base", "t"))
    whole = whole.when(t.startswith("?"), F.concat("base", F.when(F.col("path") == "", "/").otherwise(F.col("path")), "t")).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
    return rows.select("url", whole.otherwise(F.concat("base", "folder", "t")).alias("target"))


def aliases(edges: DataFrame) -> DataFrame:
    """node, component: each URL of an edge (a, b) with the smallest URL that it reaches.

    URLs are numbered first, so that rounds move numbers however long the URLs are.
    """
    n = edges.count()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    nodes = common.staged(nodes.withColumn("id", F.monotonically_increasing_id()), "url-numbers")
    for side in ("a", "b"):
        table = nodes.select(F.col("node").alias(side), "c", F.col("id").alias(f"{side}_id"))
        edges = common.join_spread(edges, table, side, "c", 2 * n, ("a", "b")).drop("c")
    parts = connected_components(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), one_task=False).withColumnRenamed("node", "id")
    named = common.staged(nodes.select("id", "node").join(parts, "id").select("node", "component"), "url-parts")
    least = named.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c"))
    found = common.join_spread(named, least, "component", "c", 2 * n, ("node",)).select("node", F.col("least").alias("component"))
    found = common.staged(found, "aliases")
    common.drop_staged(named)
    return found


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every page; the verdict of a URL that nothing decides is allow.

    redirects (source_url, target_url) adds edges to those that the pages' html states. Null URLs have empty host and
    path, no rule and no edges. Null html states nothing. Very long URLs and html are read whole. Repeated rows give
    repeated results; an empty table none; other columns are ignored, whatever their names. component is the smallest
    alias, null for URLs without edges.
    """
    common.ready(pages.sparkSession)
    stated = common.staged(links(pages), "links")  # written, so that the nodes' expressions are not unfolded into the links'
    edges = stated.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(redirects["source_url"]).alias("a"), node_of(redirects["target_url"]).alias("b")))
    edges = common.staged(edges, "link-nodes").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    common.drop_staged(stated)

    url = F.col("url")
    rows = pages.select(pages["page_id"], pages["url"].alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "node", "fit.rule", F.col("fit.verdict").alias("own"))
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    groups = aliases(edges)
    url = F.concat(F.lit("x://"), F.col("node"))
    ruled = groups.select("component", host_of(url).alias("host"), path_of(url).alias("path")).select("component", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("own"))
    decided = ruled.groupBy("component").agg(F.max(F.when(F.col("own") == "allow", 1)).alias("allowed"), F.max(F.when(F.col("own") == "block", 1)).alias("blocked"), F.count(F.lit(1)).alias("c"))
    alias = F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block")
    by_node = common.join_spread(groups, decided.select("component", alias.alias("alias"), "c"), "component", "c", groups.count(), ("node",)).select(F.col("node").alias("of"), "component", "alias")
    # URLs without a host have no alias; they are dealt by page, since null would gather them
    key = F.coalesce("node", F.concat(F.lit(" "), F.xxhash64("page_id").cast("string")))
    return rows.withColumn("key", key).join(by_node, F.col("key") == F.col("of"), "left").select("page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"), "component")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ready(spark)
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("component")


def _sql_places(name: str, source: str) -> str:
    """A table expression: the rows of source with rest, host, path, place (the path without . and ..) and node of its url."""
    return rf"""
{name}_rest AS (SELECT *, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM {source}),
{name}_path AS (SELECT *, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM {name}_rest),
{name}_held AS (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(path, '/')[2:], lambda s: [s])),
  lambda h, s: CASE WHEN s[1] = '.' THEN h WHEN s[1] = '..' THEN h[:len(h) - 1] ELSE list_concat(h, s) END) AS held FROM {name}_path),
{name}_place AS (SELECT *, CASE WHEN regexp_matches(path, '/\.{{1,2}}(/|$)') THEN '/' || array_to_string(held, '/') || CASE WHEN len(held) > 0 AND regexp_matches(path, '/\.{{1,2}}$') THEN '/' ELSE '' END
  WHEN path = '' THEN '/' ELSE path END AS place FROM {name}_held),
{name} AS (SELECT *, CASE WHEN host <> '' THEN host || place || regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)', 1) END AS node FROM {name}_place)"""


def _sql_attribute(name: str) -> str:
    quoted = (_ATTRIBUTE % name).replace("'", "''")
    return "(" + " || ".join(f"regexp_extract(tag, '{quoted}', {k})" for k in (1, 2, 3)) + ")"


#: Reads links from html by the same patterns and follows them to their ends.
OP8_SQL = rf"""
WITH RECURSIVE {_sql_places("p", "(SELECT page_id, url, html, row_number() OVER () AS n FROM pages)")},
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{_SKIPPED}', '', 'g'), '{_TAGS.replace("++", "+").replace("*+", "*").replace("}+>", "}>").replace("'", "''")}')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh') AND url IS NOT NULL),
stated AS (SELECT url, regexp_matches(tag, '(?i)^<link') AS is_link, CASE
  WHEN regexp_matches(tag, '(?i)^<link') THEN CASE WHEN list_contains(regexp_split_to_array(lower({_sql_attribute("rel")}), '\s+'), 'canonical') THEN {_sql_attribute("href")} ELSE '' END
  WHEN lower({_sql_attribute("http-equiv")}) = 'refresh' THEN {_sql_attribute("content")} ELSE '' END AS s FROM tags),
numbered AS (SELECT url, is_link, string_split(s, '&')[1] AS head, list_transform(string_split(s, '&')[2:], lambda x: {{'name': regexp_extract(x, '{_ENTITY}', 1), 'rest': regexp_extract(x, '{_ENTITY}', 2), 'text': x,
  'code': CASE WHEN regexp_matches(x, '^#[0-9]{{1,7}};') THEN TRY_CAST(regexp_extract(x, '^#([0-9]+);', 1) AS INT) WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]{{1,6}};') THEN TRY_CAST('0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]+);', 1) AS INT) END}}) AS parts
  FROM stated WHERE s <> ''),
decoded AS (SELECT url, is_link, head || coalesce(array_to_string(list_transform(parts, lambda x: CASE x.name WHEN 'amp' THEN '&' || x.rest WHEN 'lt' THEN '<' || x.rest WHEN 'gt' THEN '>' || x.rest WHEN 'quot' THEN '"' || x.rest WHEN 'apos' THEN chr(39) || x.rest
  ELSE CASE WHEN x.code BETWEEN 1 AND 55295 OR x.code BETWEEN 57344 AND 1114111 THEN chr(x.code) || x.rest ELSE '&' || x.text END END), ''), '') AS s FROM numbered),
said AS (SELECT url, CASE WHEN is_link THEN regexp_replace(s, '^\s+|\s+$', '', 'g') ELSE regexp_extract(s, '{_REFRESH.replace("'", "''")}', 1) END AS t FROM decoded),
based AS (SELECT said.url, t, regexp_extract(said.url, '(?s)^(.*?)://', 1) AS scheme, host, path FROM said JOIN (SELECT DISTINCT url, host, path FROM p) q USING (url) WHERE t <> '' AND NOT regexp_matches(t, '(?i)^url\s*=') AND NOT starts_with(t, '#')),
targets AS (SELECT url AS source, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t
  WHEN starts_with(t, '?') THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  ELSE scheme || '://' || host || '/' || regexp_extract(path, '(?s)^/(.*/)', 1) || t END AS url FROM based),
{_sql_places("g", "targets")},
nodes AS (SELECT node, host, place FROM p UNION SELECT node, host, place FROM g),
e AS (SELECT DISTINCT p.node AS a, g.node AS b FROM g JOIN p ON p.url = g.source WHERE p.node <> g.node),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reached) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
rules(h, pre, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled AS (SELECT node, arg_max(v, length(h || pre)) AS v FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(place, pre) GROUP BY node),
alias AS (SELECT r.node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM r JOIN ruled ON ruled.node = r.reached GROUP BY r.node),
m AS (SELECT n, any_value(page_id) AS page_id, any_value(node) AS node, any_value(host) AS host, any_value(path) AS path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS own
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(own, alias.v, 'allow') AS verdict FROM m LEFT JOIN alias ON alias.node = m.node
"""
