"""Recipe pages: structured data, the draft of a dish that it gives, and the text of pages without it.

One Arrow function finds a page's JSON-LD blocks, walks their graph and hands out the best recipe node's fields as plain
texts; durations, yields, ratings, dates, hashes and all decisions are column expressions over these.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larder.functions import schema_org as so
from larder.functions.text import clean_or_null, join_url, stable_hash, title_slug, truncated

# Where a node's parts are, and how far a page is followed.
PARTS = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "hasPart", "about")
NODES, DEPTH, STEPS = 5_000, 12, 500
RAW = """blocks int, malformed int, nodes int, name string, description string, images array<string>, yields array<string>, total array<string>, prep array<string>,
 cook array<string>, ingredients array<string>, steps array<struct<name:string,text:string>>, rating_value string, rating_count string, authors array<string>,
 dates array<string>, keywords array<string>, categories array<string>, cuisines array<string>, raw string"""

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
_HIDDEN = re.compile(r"<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_BREAK = re.compile(r"</?(p|div|br|li|ul|ol|tr|h[1-6]|section|article)\b[^>]*>", re.I)
_BLANK = re.compile(r"[\s​‎‏﻿]+")


def clean(value) -> str:
    """A text or number on one line without markup; anything else is empty."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return ""
    if not isinstance(value, str):
        return f"{value:g}" if isinstance(value, float) else str(value)
    text = _BREAK.sub("\n", _HIDDEN.sub(" ", value))
    return _BLANK.sub(" ", html.unescape(re.sub("<[^>]*>", " ", text))).strip()


def _refuse(name: str):
    raise ValueError(name)


def loads(text: str):
    """JSON, at the second try without wrappers, control characters and wrong escapes, line ends inside strings allowed; None if broken."""
    fixed = re.sub(r"^﻿?\s*<!--|-->\s*$|/\*\s*(<!\[CDATA\[|\]\]>)\s*\*/|<!\[CDATA\[|\]\]>", "", text.lstrip("﻿"))
    fixed = re.sub(r"(?<!\\)\\'", "'", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", fixed)).strip()
    for attempt, strict in ((text, True), (fixed, False)):
        try:
            return json.loads(attempt, strict=strict, parse_constant=_refuse)
        except (ValueError, RecursionError):
            pass
    return None


_SURROGATE = re.compile("[\ud800-\udfff]")


def well_formed(value):
    """value with all lone surrogates in its texts replaced; they are legal in JSON and no text."""
    if isinstance(value, str):
        return _SURROGATE.sub("\ufffd", value)
    if isinstance(value, list):
        return [well_formed(v) for v in value]
    return {k: well_formed(v) for k, v in value.items()} if isinstance(value, dict) else value


def listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def types_of(node: dict) -> list[str]:
    return [re.sub(r"^.*[/#]", "", t.strip()).lower() for t in listed(node.get("@type", node.get("type"))) if isinstance(t, str)]


def graph_nodes(values: list) -> list[dict]:
    """All nodes of a page's graph, in order; bounded in number and depth."""
    out: list[dict] = []
    todo = [(v, 0) for v in reversed(values)]
    while todo and len(out) < NODES:
        value, depth = todo.pop()
        if depth > DEPTH:
            continue
        if isinstance(value, list):
            todo += [(v, depth + 1) for v in reversed(value)]
        elif isinstance(value, dict):
            out.append(value)
            todo += [(value[k], depth + 1) for k in reversed(PARTS) if k in value]
    return out


def pick(node: dict, *names: str):
    return next((node[n] for n in names if node.get(n) is not None), None)


def scalars(value, names: tuple[str, ...], refs: dict, depth: int = 4) -> list:
    """The plain values that a value, list or node stands for; nodes are followed by the first of names that they have."""
    if value is None or depth < 0:
        return []
    if isinstance(value, list):
        return [x for v in value for x in scalars(v, names, refs, depth - 1)]
    if isinstance(value, dict):
        ref = value.get("@id")
        return scalars(pick(refs.get(ref, value) if isinstance(ref, str) else value, *names), names, refs, depth - 1)
    return [value]


def texts(value, names: tuple[str, ...], refs: dict) -> list[str]:
    """The texts that a value stands for; numbers that aren't whole are rounded, and those that aren't finite are left out."""
    whole = lambda x: "" if not math.isfinite(x) else str(math.floor(x + 0.5))
    out = (whole(x) if isinstance(x, float) else clean(x) for x in scalars(value, names, refs))
    return [x for x in out if x]


def split_steps(text: str) -> list[str]:
    """The steps in one text: its list items, else its paragraphs, else its lines."""
    for tag in ("li", "p"):
        items = [clean(x) for x in re.findall(rf"<{tag}\b[^>]*>(.*?)(?=<{tag}\b|</{tag}\s*>|</[ou]l\s*>|$)", text, re.I | re.S)]
        if items := [x for x in items if x]:
            return items
    return [x for line in re.split(r"\r?\n+", text) if (x := clean(line))]


def steps_of(value, heading: str | None = None, depth: int = 0) -> Iterator[tuple[str | None, str]]:
    """Heading and text of each step; sections name their steps, a step's name counts unless it is how its text begins."""
    if depth > 6:
        return
    if isinstance(value, str):
        yield from ((heading, x) for x in split_steps(value))
    elif isinstance(value, list):
        for v in value:
            yield from steps_of(v, heading, depth + 1)
    elif isinstance(value, dict):
        name = clean(value.get("name")) or None
        inner = pick(value, "itemListElement", "steps", "itemListElements")
        text = pick(value, "text", "description", "@value")
        if inner is not None:
            yield from steps_of(inner, name or heading if "howtosection" in types_of(value) else heading, depth + 1)
        elif clean(text):
            a, b = (re.sub("[^a-z0-9]", "", x.lower()) for x in (name or "", clean(text)))
            own = name if name and not (b.startswith(a[:40]) or a.startswith(b[:40])) else None
            yield from ((heading or own, x) for x in split_steps(text if isinstance(text, str) else clean(text)))
        elif name:
            yield heading, name


def page_fields(page: str | None, url: str | None) -> dict:
    """What the best recipe node of a page says: of several the one with most ingredients and steps, then the first."""
    blocks = [loads(body) for kind, body in _SCRIPT.findall(page or "") if "ld+json" in kind.lower()]
    nodes = graph_nodes([b for b in blocks if b is not None])
    found = [n for n in nodes if "recipe" in types_of(n)]
    out = {"blocks": len(blocks), "malformed": sum(b is None for b in blocks), "nodes": len(found)}
    if not found:
        return out
    weight = lambda n: 2 * len(listed(pick(n, "recipeIngredient", "ingredients"))) + len(listed(n.get("recipeInstructions"))) + bool(n.get("name"))
    node = max(found, key=weight)
    refs: dict = {}
    for n in nodes:
        if isinstance(n.get("@id"), str) and n["@id"] and len(n) > 1:
            refs.setdefault(n["@id"], n)
    value = ("value", "@value", "duration", "name")
    rating = next((n for r in listed(node.get("aggregateRating")) if isinstance(r, dict) for n in [refs.get(r["@id"], r) if isinstance(r.get("@id"), str) else r] if pick(n, "ratingValue", "@value", "ratingCount", "reviewCount") is not None), {})
    words = lambda v: list(dict.fromkeys(x for item in listed(v) for part in (item.split(",") if isinstance(item, str) else [item]) if (x := clean(part))))
    text = lambda v: None if v is None else str(v)
    images = [u for x in scalars(node.get("image"), ("url", "contentUrl", "@id", "@list"), refs) if isinstance(x, str) and (u := join_url(x, url))]
    steps = [{"name": h, "text": t} for (h, t), _ in zip(steps_of(node.get("recipeInstructions")), range(STEPS), strict=False)]
    return out | {
        "name": clean(pick(node, "name", "headline")) or None, "description": clean(node.get("description")) or None, "images": list(dict.fromkeys(images)),
        "yields": texts(pick(node, "recipeYield", "yield"), value, refs), "total": texts(node.get("totalTime"), value, refs), "prep": texts(node.get("prepTime"), value, refs),
        "cook": texts(node.get("cookTime"), value, refs) + texts(node.get("performTime"), value, refs),
        "ingredients": [x for i in listed(pick(node, "recipeIngredient", "ingredients")) if (x := clean(i))], "steps": steps,
        "rating_value": text(pick(rating, "ratingValue", "@value")), "rating_count": text(pick(rating, "ratingCount", "reviewCount")),
        "authors": [x for a in scalars(pick(node, "author", "creator"), ("name", "@value", "alternateName"), refs) if (x := clean(a))],
        "dates": [x for x in scalars(pick(node, "datePublished", "dateCreated", "uploadDate"), ("@value", "value"), refs) if isinstance(x, str)],
        "keywords": words(node.get("keywords")), "categories": words(node.get("recipeCategory")), "cuisines": words(node.get("recipeCuisine")), "raw": json.dumps(node),
    }


def read_page(page: str | None, url: str | None) -> dict:
    """page_fields, or nothing at all of a page that Python can't get through, such as one nested too deeply."""
    try:
        return well_formed(page_fields(page, url))
    except (ValueError, TypeError, AttributeError, KeyError, OverflowError, RecursionError):
        return {}


def structured(pages: DataFrame) -> DataFrame:
    """pages (url, html and more) with the struct `found`, the fields of RAW. Null pages have no blocks; a page that can't be read has null fields."""
    schema = StructType([*pages.schema, *StructType.fromDDL(f"found struct<{', '.join(f.replace(' ', ':', 1) for f in _split(RAW))}>")])
    kind = to_arrow_schema(schema).field("found").type

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read_page(h, u) for h, u in rows], kind)], names=[*batch.schema.names, "found"])

    return pages.mapInArrow(make, schema)


def _split(ddl: str) -> list[str]:
    return [x.strip() for x in re.split(r",\s+", ddl.replace("\n", " "))]


MISSING = ("title", "image_url", "servings", "total_minutes", "active_minutes", "ingredients", "instructions", "rating", "author", "published_at")


def dish_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """url and the columns to keep, blocks, malformed, nodes and the typed fields of each page's recipe with content_hash and missing; pages without one have nulls. One row a page."""
    f = lambda name: F.col(f"found.{name}")
    first = lambda name: so.first_of(f(name), so.duration_minutes)
    rows = structured(pages).select(
        "url", *keep, f("blocks").alias("blocks"), f("malformed").alias("malformed"), f("nodes").alias("nodes"), truncated(f("name"), 300).alias("title"), truncated(f("description"), 2000).alias("description"),
        F.get(f("images"), F.lit(0)).alias("image_url"), f("images").alias("image_urls"), so.first_of(f("yields"), so.servings).alias("servings"),
        F.array_max(F.transform(f("yields"), lambda y, i: F.struct(F.length(y).alias("n"), (-i).alias("i"), y.alias("text"))))["text"].alias("yield_text"),
        first("total").alias("total"), first("prep").alias("prep_minutes"), first("cook").alias("cook_minutes"), f("ingredients").alias("ingredients"), f("steps").alias("instructions"),
        so.rating(f("rating_value"), f("rating_count")).alias("rating"), truncated(F.nullif(F.array_join(F.array_distinct(f("authors")), ", "), F.lit("")), 200).alias("author"),
        so.first_of(f("dates"), so.published).alias("published_at"), f("keywords").alias("keywords"), f("categories").alias("recipe_category"), f("cuisines").alias("recipe_cuisine"), f("raw").alias("raw_jsonld"),
    )
    either = F.col("prep_minutes").isNotNull() | F.col("cook_minutes").isNotNull()
    total = F.coalesce("total", F.when(either, F.coalesce("prep_minutes", F.lit(0)) + F.coalesce("cook_minutes", F.lit(0))))
    rows = rows.withColumn("total_minutes", total).withColumn("active_minutes", F.col("prep_minutes")).drop("total")
    c = F.col
    content = stable_hash(title=c("title"), servings=c("servings"), total=c("total_minutes"), active=c("active_minutes"), ingredients=c("ingredients"), steps=F.transform("instructions", lambda s: s["text"]), image=c("image_url"))
    lacks = {"ingredients": F.size("ingredients") < 1, "instructions": F.size("instructions") < 1, "rating": F.col("rating.value").isNull()}
    gone = F.array_compact(F.array(*(F.when(lacks.get(n, F.col(n).isNull()), F.lit(n)) for n in MISSING)))
    has = F.col("nodes") > 0
    return rows.withColumn("content_hash", F.when(has, content)).withColumn("missing", F.when(has, gone))


def drafts(found: DataFrame, listed_as: DataFrame | None = None) -> DataFrame:
    """Drafts of dishes from dish_pages(): those with a title and an ingredient. listed_as (url, title, published_at) fills in what a page lacks; of a url listed more than once the latest counts."""
    rows = found
    if listed_as is not None:
        known = listed_as.groupBy("url").agg(F.max(F.struct("published_at", clean_or_null(F.col("title")).alias("title"))).alias("l"))
        known = known.select("url", F.col("l.title").alias("__larder_title"), F.col("l.published_at").alias("__larder_at"))
        rows = rows.join(known, "url", "left").withColumn("title", F.coalesce("title", "__larder_title")).withColumn("published_at", F.coalesce("published_at", "__larder_at")).drop("__larder_title", "__larder_at")
    rows = rows.where(F.col("title").isNotNull() & (F.size("ingredients") > 0))
    lines = F.transform("ingredients", lambda x, i: F.struct(i.alias("position"), x.alias("raw_text")))
    slug = F.coalesce(F.nullif(title_slug(F.col("title")), F.lit("")), F.lit("recipe"))
    return rows.select(F.col("url").alias("source_url"), "content_hash", "title", slug.alias("slug"), "total_minutes", "active_minutes", "servings", "image_url", "author", F.col("rating.value").alias("source_rating"), F.col("rating.count").alias("source_rating_count"), "instructions", "raw_jsonld", "published_at", lines.alias("lines"), "missing")


def missing_profile(found: DataFrame, *by: str) -> DataFrame:
    """Pages, those with a recipe, malformed blocks and how many recipes lack each field, by the given columns."""
    lacks = [F.count_if(F.array_contains("missing", n)).alias(f"no_{n}") for n in MISSING]
    return found.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(F.col("nodes") > 0).alias("recipes"), F.sum("malformed").alias("malformed"), *lacks)


def field_drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """field and n: in how many rows the two tables, of the same columns, disagree; nulls are equal."""
    names = [c for c in expected.columns if c != key]
    both = expected.alias("e").join(actual.alias("a"), key)
    differs = F.array_compact(F.array(*(F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in names)))
    return both.select(F.explode(differs).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


# The markup and headings by which a recipe shows in a page without structured data.
_HEADINGS = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"
_PROP = r"""(?i)itemprop\s*=\s*["'][^"']*\b{}\b"""


def _headed(page: Column, pattern: str) -> Column:
    texts = F.transform(F.regexp_extract_all(page, F.lit(_HEADINGS), 2), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " ")))
    return F.exists(texts, lambda h: h.rlike(pattern))


def fallback_reason(page: Column, has_title: Column, n_ingredients: Column, nodes: Column, malformed: Column) -> Column:
    """Why a page is worth reading as text: incomplete-recipe-jsonld, malformed-recipe-jsonld or visible-recipe-card; null if it isn't."""
    ingredients = page.rlike(_PROP.format("recipeIngredient")) | _headed(page, r"(?i)^(?:ingredients|what you(?:'|’|&#0?39;|&rsquo;|&#8217;)ll need|you will need)\b")
    method = page.rlike(_PROP.format("recipeInstructions")) | _headed(page, r"(?i)^(?:instructions|directions|method|how to make)\b")
    card = page.rlike(r"""(?i)itemtype\s*=\s*["'][^"']*schema\.org/recipe""") | page.rlike(r"""(?i)\b(?:id|class)\s*=\s*["'][^"']*\b(?:recipe-card|wprm-recipe|tasty-recipes|mv-create)\b""")
    whole = has_title & (n_ingredients > 0)
    return (
        F.when(F.coalesce(whole, F.lit(False)), None).when(nodes > 0, "incomplete-recipe-jsonld")
        .when((malformed > 0) & ingredients & method, "malformed-recipe-jsonld").when(card & ingredients & method, "visible-recipe-card")
    )


class PromptText(HTMLParser):
    """Headings, paragraphs and list items of the page's main part, as lines."""

    # What is not read, and the main parts in the order in which they are looked for.
    DROPPED = {"script", "style", "template", "noscript", "svg", "iframe", "nav", "header", "footer", "aside", "form"}
    CLASSES = {"advertisement", "advertising", "ad", "ads", "newsletter", "social-share"}
    ROOTS = ("main", "article", "recipe-card", "wprm-recipe", "tasty-recipes", "mv-create", "body")
    LINES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, bool, set[str], list | None]] = []  # tag, hidden, roots that it is in, its line's parts
        self.lines: list[tuple[set[str], list]] = []
        self.text: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            self.handle_data(" ")
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        _, hidden, roots, _ = self.open[-1] if self.open else ("", False, {""}, None)
        hidden = hidden or tag in self.DROPPED or a.get("aria-hidden") == "true" or bool(classes & self.CLASSES)
        roots = roots | {r for r in self.ROOTS if r in classes or r == tag}
        line: list | None = None
        if tag in self.LINES and not hidden:
            line = []
            self.lines.append((roots, line))
        self.open.append((tag, hidden, roots, line))

    def handle_endtag(self, tag):
        if any(o[0] == tag for o in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        _, hidden, roots, _ = self.open[-1] if self.open else ("", False, {""}, None)
        if not hidden:
            for r in roots:
                self.text.setdefault(r, []).append(data)
            for *_, line in self.open:
                if line is not None:
                    line.append(data)


def prompt_text(page: str | None, most: int = 40_000) -> str:
    """Visible text of the first non-empty main part, at most `most` characters, cut at a line end if that loses less than a quarter."""
    parser = PromptText()
    parser.feed(page or "")
    parser.close()
    squeeze = lambda parts: _BLANK.sub(" ", "".join(parts)).strip()
    root = next((r for r in (*PromptText.ROOTS, "") if squeeze(parser.text.get(r, []))), "")
    out: list[str] = []
    for roots, parts in parser.lines:
        line = squeeze(parts)
        if root in roots and line and (not out or out[-1] != line):
            out.append(line)
    text = "\n".join(out) or squeeze(parser.text.get(root, []))
    if len(text) <= most:
        return text
    cut = text[:most].rfind("\n")
    return text[: cut if cut >= 0.75 * most else most].rstrip()


def with_prompt_text(pages: DataFrame, column: str = "html", into: str = "page_text") -> DataFrame:
    """pages with the text to read where there is no structured data."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(prompt_text)

    return pages.withColumn(into, F.pandas_udf(each, "string")(F.coalesce(F.col(column), F.lit(""))))


def fallbacks(pages: DataFrame) -> DataFrame:
    """url, reason and page_text of the pages (url, html) that are worth reading as text; those without any text are not.

    Each row is judged by its own page, whatever its url; a page that can't be read counts as one without blocks.
    """
    rows = dish_pages(pages, "html")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reason = fallback_reason(F.coalesce("html", F.lit("")), F.col("title").isNotNull(), zero(F.size("ingredients")), zero(F.col("nodes")), zero(F.col("malformed")))
    rows = with_prompt_text(rows.select("url", "html", reason.alias("reason")).where("reason IS NOT NULL"))
    return rows.where("page_text != ''").select("url", "reason", "page_text")
