"""Posts and comments of captured listings, the links in them that a crawler may follow, and the dishes that a post holds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.text import title_slug
from larder.functions.urls import canonical_url, origin
from larder.sources.feeds import recipe_path, recipe_url

SITE = "https://www.reddit.com"
POST = "id string, subreddit string, permalink string, title string, selftext string, selftext_html string, url string, url_overridden_by_dest string, created_utc double, score double, is_self boolean"
LISTING = f"struct<data:struct<after:string,children:array<struct<data:struct<{', '.join(f.replace(' ', ':') for f in POST.split(', '))}>>>>>"
_COMMENT = "struct<id:string,author:string,body:string,score:double,replies:string>"
COMMENTS = f"struct<data:struct<children:array<struct<kind:string,data:{_COMMENT}>>>>"
#: Levels of replies below a comment, and comments of a post, that are read.
DEPTH, MOST = 4, 500


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def posts(pages: DataFrame) -> DataFrame:
    """Posts of listing pages (page, body): rows without an id, subreddit, permalink, title or time are left out. page_after tells of a next page."""
    rows = pages.select("page", F.from_json("body", LISTING).alias("l")).select("page", F.col("l.data.after").alias("page_after"), F.explode("l.data.children").alias("c")).select("page", "page_after", "c.data.*")
    link = F.when(F.col("permalink").startswith("/"), F.concat(F.lit(SITE), F.col("permalink"))).otherwise(F.col("permalink"))
    good = _filled(F.col("id")).isNotNull() & _filled(F.col("subreddit")).isNotNull() & _filled(F.col("permalink")).isNotNull() & _filled(F.col("title")).isNotNull() & F.col("created_utc").isNotNull()
    return rows.where(good).select(
        "page", "page_after", "id", "subreddit", link.alias("permalink"), "title", F.coalesce(_filled(F.col("selftext")), F.lit("")).alias("selftext"), _filled(F.col("selftext_html")).alias("selftext_html"),
        F.coalesce(_filled(F.col("url_overridden_by_dest")), _filled(F.col("url")), link).alias("url"), F.timestamp_micros(F.round(F.col("created_utc") * 1_000_000).try_cast("long")).alias("created_at"), F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("is_self", F.lit(False)).alias("is_self"),
    )


def new_posts(rows: DataFrame, since: datetime | None, min_score: int, limit: int = 200) -> DataFrame:
    """Each post once, those after since with the score, in the order of pages; the first `limit`, newest first."""
    if since is not None:
        rows = rows.where(F.col("created_at") > F.lit(since))
    first = rows.where(F.col("score") >= min_score).groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("page", -F.unix_micros("created_at"))).alias("p"))
    kept = first.select("id", "p.*").orderBy("page", F.col("created_at").desc(), "id").limit(max(1, limit))
    return kept.orderBy(F.col("created_at").desc(), "id")


def coverage(rows: DataFrame, since: datetime | None) -> DataFrame:
    """One row: crossed (a post from before the boundary was seen) and truncated (neither crossed nor the listing's end); truncated scans move no boundary."""
    crossed = F.lit(False) if since is None else F.coalesce(F.bool_or(F.col("created_at") <= F.lit(since)), F.lit(False))
    more = F.coalesce(F.max_by(F.struct("page_after"), "page")["page_after"].isNotNull(), F.lit(False))
    return rows.agg(crossed.alias("crossed"), more.alias("more")).select("crossed", (~F.col("crossed") & F.col("more")).alias("truncated"))


def comments(threads: DataFrame) -> DataFrame:
    """post_id, id, author, body, score and path of the comments of threads (post_id, body: the post's listing and its comments').

    Replies are read DEPTH levels deep and MOST comments of a post in their order. Deleted ones and those of the
    moderating robot are left out, not their replies.
    """
    level = threads.select("post_id", F.array().cast("array<int>").alias("path"), F.get(F.from_json("body", "array<string>"), F.lit(1)).alias("replies"), F.lit(None).cast(_COMMENT).alias("c"))
    for _ in range(DEPTH + 1):  # each comment goes on as it is, beside its replies, so no text is read twice
        own = F.struct("path", F.lit(None).cast("string").alias("replies"), "c")
        answers = F.transform(F.from_json("replies", COMMENTS)["data"]["children"], lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["data"].alias("c")))
        answers = F.transform(F.filter(answers, lambda x: x["kind"] == "t1"), lambda x: F.struct(F.concat("path", F.array(x["i"])).alias("path"), F.when(x["c"]["replies"].startswith("{"), x["c"]["replies"]).alias("replies"), x["c"].alias("c")))
        level = level.select("post_id", F.explode(F.concat(F.array(own), F.coalesce(answers, F.array().cast(f"array<struct<path:array<int>,replies:string,c:{_COMMENT}>>")))).alias("x")).select("post_id", "x.*")
    out = level.where("c IS NOT NULL").select("post_id", "c.id", "c.author", "c.body", F.coalesce("c.score", F.lit(0)).cast("long").alias("score"), "path")
    gone = F.trim("body").rlike(r"(?i)^\[(?:deleted|removed)\]$")
    good = out.where(_filled(F.col("id")).isNotNull() & _filled(F.col("body")).isNotNull() & ~gone & (F.lower(F.coalesce("author", F.lit(""))) != "automoderator"))
    first = Window.partitionBy("post_id").orderBy("path")  # one post's
    return good.withColumn("k", F.row_number().over(first)).where(F.col("k") <= MOST).drop("k")


def top_comments(rows: DataFrame, n: int = 10) -> DataFrame:
    """Each post's best n comments, by score, then id."""
    best = Window.partitionBy("post_id").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def allowed_links(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """id, url and source_id of the links of posts that lead to a known source's recipe pages, each once and in canonical form.

    sources has source_id, base_url and adapter. Links are the post's own, those of its HTML and those in its text;
    links with user names are refused.
    """
    href = F.regexp_extract_all(F.coalesce("selftext_html", F.lit("")), F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), 1)
    plain = F.regexp_extract_all(F.coalesce("selftext", F.lit("")), F.lit(r"(https?://[^\s<>\"'\])]+)"), 1)
    found = rows.select("id", F.posexplode(F.concat(F.array("url"), href, plain)).alias("k", "url"))
    found = found.withColumn("url", F.regexp_replace(F.replace("url", F.lit("&amp;"), F.lit("&")), r"[.,;:!?)\]}]+$", "")).where(F.col("url").rlike("(?i)^https?://") & ~F.col("url").rlike("^[^/]+//[^/?#]*@"))
    known = sources.select("source_id", "base_url", "adapter", origin(F.col("base_url")).alias("at"))
    found = found.withColumn("at", origin(F.col("url"))).join(known, "at").where(recipe_path(F.col("url"), F.col("adapter")))  # of one origin
    return found.withColumn("url", canonical_url(F.col("url"))).groupBy("id", "url").agg(F.min_by("source_id", "k").alias("source_id"), F.min("k").alias("place"))


def redirect_allowed(source_base: Column, adapter: Column, final_url: Column) -> Column:
    """Whether a link of a source still ends at one of its recipe pages."""
    return recipe_url(final_url, source_base, adapter)


def post_source_url(permalink: Column, title: Column, index: Column, total: Column) -> Column:
    """The address of one of a post's dishes: the post's own if it is the only one, else with its name."""
    marker = F.coalesce(F.nullif(title_slug(title), F.lit("")), F.concat(F.lit("recipe-"), (index + 1).cast("string")))
    joint = F.when(F.contains(permalink, F.lit("?")), "&").otherwise("?")
    return F.when(total <= 1, permalink).otherwise(F.concat(permalink, joint, F.lit("recipe="), marker))


def one_per_url(drafts: DataFrame) -> DataFrame:
    """Of drafts (source_url, position and more) with one source_url the first."""
    rest = [c for c in drafts.columns if c != "source_url"]
    return drafts.groupBy("source_url").agg(F.min_by(F.struct(*rest), "position").alias("d")).select("source_url", "d.*")
