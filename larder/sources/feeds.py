"""Feeds, site maps and robots files as rows, site maps followed breadth first, and which URLs a crawler may fetch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from larder.functions.schema_org import published
from larder.functions.text import clean_or_null, join_url
from larder.functions.urls import origin
from larder.plans.shared import written

ITEM = "kind string, item_url string, title string, at string, ord int"


def _tree(xml: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring((xml or "").strip().encode())
    except (ElementTree.ParseError, ValueError):
        return None


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _inner(e: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    for n in names:
        yield from (x for x in e if _name(x) == n)


def _text(e: ElementTree.Element, *names: str) -> str | None:
    return next((t for x in _inner(e, *names) if (t := "".join(x.itertext()).strip())), None)


def item_link(item: ElementTree.Element) -> str | None:
    """The link of a feed's item: text, or that of no relation or "alternate"; else a permanent guid, an id that is a URL, any other link."""
    other = None
    for x in _inner(item, "link"):
        href = x.get("href") or "".join(x.itertext()).strip()
        if href and (x.get("rel") in (None, "alternate")):
            return href
        other = other or href or None
    guid = next((x for x in _inner(item, "guid") if x.get("isPermaLink") != "false"), None)
    for text in ("".join(guid.itertext()).strip() if guid is not None else None, _text(item, "id")):
        if text and text.lower().startswith(("http://", "https://")):
            return text
    return other


def xml_items(xml: str | None, base: str | None) -> list[dict]:
    """Items of a feed ("item"), children of a site map index ("sitemap") or pages of a site map ("page"); broken XML has none."""
    root = _tree(xml)
    if root is None:
        return []
    if _name(root) in ("sitemapindex", "urlset"):
        kind, tag = ("sitemap", "sitemap") if _name(root) == "sitemapindex" else ("page", "url")
        rows = []
        for e in _inner(root, tag):
            news = next(iter(_inner(e, "news")), None)
            rows.append((kind, _text(e, "loc"), None, _text(e, "lastmod") or (_text(news, "publication_date") if news is not None else None)))
    else:
        items = [*(x for c in _inner(root, "channel") for x in _inner(c, "item")), *_inner(root, "entry", "item")]
        rows = [("item", item_link(i), _text(i, "title"), _text(i, "pubDate", "published", "date", "updated", "modified")) for i in items]
    found = ((k, join_url(u, base), t, at) for k, u, t, at in rows)
    return [{"kind": k, "url": u, "title": t, "at": at} for k, u, t, at in found if u]


def xml_rows(documents: DataFrame) -> DataFrame:
    """The items of XML documents (url, xml and more): all but xml, with kind, item_url, title, published_at and ord."""
    keep = [c for c in documents.columns if c != "xml"]
    schema = StructType([*documents.select(*keep).schema, *StructType.fromDDL(ITEM)])
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(ITEM))]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(batch.column("xml").to_pylist(), batch.column("url").to_pylist(), strict=True)
            rows = [(at, x["kind"], x["url"], x["title"], x["at"], i) for at, (xml, base) in enumerate(pages) for i, x in enumerate(xml_items(xml, base))]
            owner = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in keep), *made], names=schema.names)

    rows = documents.mapInArrow(make, schema)
    return rows.select(*keep, "kind", "item_url", clean_or_null(F.col("title")).alias("title"), published(F.col("at")).alias("published_at"), "ord")


def follow_sitemaps(roots: DataFrame, documents: DataFrame, since: datetime | None = None, most: int = 5, levels: int = 3) -> DataFrame:
    """source_id, url, published_at of the pages that site maps list, indexes followed breadth first from roots (source_id, url).

    documents (url, xml) holds what was fetched. Of an index the newest `most` children count, those that changed before
    since don't; each map is read once, and a source reads at most `most` maps besides its roots. Undated pages pass.
    Each level writes what its maps list and the frontier that follows, so that no map is parsed twice and the work is
    that of the maps that are read, however many levels there are.
    """
    fresh = F.lit(True) if since is None else F.col("published_at").isNull() | (F.col("published_at") > F.lit(since))
    frontier = read = written(roots.select("source_id", "url").distinct(), "frontier")
    budget = frontier.groupBy("source_id").agg((F.count("*") + most).alias("left"))
    pages = []
    for level in range(levels + 1):
        rows = written(xml_rows(frontier.join(documents.select("url", "xml"), "url")).where(fresh), "maps")
        pages.append(rows.where("kind = 'page'").select("source_id", F.col("item_url").alias("url"), "published_at"))
        maps = rows.where("kind = 'sitemap'")
        if level == levels or maps.isEmpty():
            break
        newest = Window.partitionBy("source_id", "url").orderBy(F.col("published_at").desc_nulls_last(), "ord")
        children = maps.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most)
        children = children.groupBy("source_id", F.col("item_url").alias("url")).agg(F.min(F.struct("k", "ord")).alias("at")).join(read, ["source_id", "url"], "left_anti")
        done = read.groupBy("source_id").agg(F.count("*").alias("done"))
        turn = Window.partitionBy("source_id").orderBy("at", "url")
        children = children.withColumn("k", F.row_number().over(turn)).join(budget, "source_id").join(done, "source_id").where(F.col("done") + F.col("k") <= F.col("left"))
        frontier = written(children.select("source_id", "url"), "frontier")
        read = read.union(frontier)
    return reduce(DataFrame.union, pages)


def robots_lines(body: str | None) -> list[dict]:
    """Rules of a robots file: group, agents, kind (allow, disallow, delay, sitemap, group), value and the pattern's regular expression.

    User-agent lines in a row share a group. A rule before any agent, and an empty rule, count for nothing.
    """
    out, group, agents, open_ = [], -1, [], False
    for line in (body or "").splitlines():
        name, mark, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "sitemap" and mark:
            out.append({"group": -1, "agents": [], "kind": "sitemap", "value": value, "regex": None})
        elif name == "user-agent" and value:
            if not open_:
                group, agents, open_ = group + 1, [], True
                out.append({"group": group, "agents": agents, "kind": "group", "value": "", "regex": None})
            agents.append(value.lower())
        elif name in ("allow", "disallow", "crawl-delay") and mark and group >= 0:
            open_ = False
            if value:
                body_, end = (value[:-1], "$") if value.endswith("$") else (value, "")
                regex = "^" + ".*".join(f"\\Q{p}\\E" for p in body_.split("*")) + end
                out.append({"group": group, "agents": agents, "kind": "delay" if name == "crawl-delay" else name, "value": value, "regex": regex})
    return out


def robots_rules(files: DataFrame) -> DataFrame:
    """origin, group, agents, kind, value and regex of robots files (origin, body)."""
    def each(bodies: pd.Series) -> pd.Series:
        return bodies.map(robots_lines)

    parse = F.pandas_udf(each, "array<struct<group:int,agents:array<string>,kind:string,value:string,regex:string>>")
    return files.select("origin", F.explode(parse(F.coalesce("body", F.lit("")))).alias("x")).select("origin", "x.*")


def rules_for(rules: DataFrame, user_agent: str) -> DataFrame:
    """The rules of each origin's group for a crawler: that of the longest agent which its product token begins with, else the first of "*"."""
    token = user_agent.split("/")[0].strip().lower()
    named = F.array_max(F.transform(F.filter("agents", lambda a: (a != "*") & F.startswith(F.lit(token), a)), lambda a: F.length(a)))
    fit = F.coalesce(named, F.when(F.array_contains("agents", "*"), F.lit(0)))
    best = rules.where("kind = 'group'").withColumn("fit", fit).where("fit IS NOT NULL").groupBy("origin").agg(F.min_by("group", F.struct(-F.col("fit"), "group")).alias("group"))
    return rules.join(best, ["origin", "group"])


def allowed(urls: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """urls (url and more) with allowed and delay_ms: the longest matching rule decides, allow on a tie, and none allows.

    Origins with no rules are open. All origins' rules for one crawler are joined by origin, so no URL meets another
    origin's.
    """
    own = rules_for(rules, user_agent)
    path = F.concat(F.coalesce(F.nullif(F.regexp_extract("url", r"^[^/]+//[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/")), F.regexp_extract("url", r"(\?[^#]*)", 1))
    decide = own.where("kind IN ('allow', 'disallow')").groupBy("origin").agg(F.collect_list(F.struct("kind", F.length("value").alias("n"), "regex")).alias("__larder_rules"))  # one file's
    delays = own.where("kind = 'delay'").groupBy("origin").agg(F.max(F.when(F.col("value").try_cast("double") >= 0, F.round(F.col("value").try_cast("double") * 1000))).cast("long").alias("delay_ms"))
    rows = urls.withColumn("__larder_origin", origin(F.col("url"))).withColumn("__larder_path", path)
    rows = rows.join(decide.withColumnRenamed("origin", "__larder_origin"), "__larder_origin", "left").join(delays.withColumnRenamed("origin", "__larder_origin"), "__larder_origin", "left")
    hits = F.filter("__larder_rules", lambda r: F.rlike(F.col("__larder_path"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"].alias("n"), (r["kind"] == "allow").alias("open"))))
    return rows.select(*urls.columns, F.coalesce(best["open"], F.lit(True)).alias("allowed"), "delay_ms")


#: Adapters that any site may use: a folder of dishes, and posts, which are told by what they are not.
DIRECTORY, POST = "directory", "post"


def recipe_url(url: Column, base: Column, adapter: Column, patterns: dict[str, str] | None = None) -> Column:
    """Whether a URL is one of a source's recipe pages, by the source's adapter."""
    return F.coalesce(origin(url) == origin(base), F.lit(False)) & recipe_path(url, adapter, patterns)


def recipe_path(url: Column, adapter: Column, patterns: dict[str, str] | None = None) -> Column:
    """Whether the path of a URL of a source is that of one of its recipe pages.

    patterns has the path of a page by the name of a site's own adapter; DIRECTORY and POST are known without it.
    """
    path = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(url, r"^[^/]+//[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/")), "/{2,}", "/")
    post = (path != "/") & ~path.rlike(r"(?i)\.[a-z0-9]{1,6}$") & ~path.rlike(r"(?i)^/(?:about|author|category|contact|feed|page|privacy|search|shop|tag|wp-admin|wp-json)(?:/|$)")
    shape = F.when(adapter == DIRECTORY, path.rlike(r"(?i)^/recipes/[^/]+/?$")).when(adapter == POST, post)
    for name, pattern in (patterns or {}).items():
        shape = shape.when(adapter == name, path.rlike(pattern))
    return F.coalesce(url.rlike("(?i)^https?://") & shape, F.lit(False))
