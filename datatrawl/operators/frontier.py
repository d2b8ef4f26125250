"""The frontier: which URLs to work on, and what becomes of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl.functions import urls as u
from datatrawl.operators.url_filter import with_maybe
from datatrawl.session import stage

_COLUMNS = ("parent_url", "url", "source", "from_queue")


def valid_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.filter(u.is_valid_url(F.col(column)))


def same_site(df: DataFrame, exact_host: bool = False) -> DataFrame:
    """Rows whose `url` is on the site of `seed_url`."""
    return df.filter(u.on_same_site(F.col("url"), F.col("seed_url"), exact_host))


def not_media(df: DataFrame) -> DataFrame:
    return df.filter(~u.is_media(F.col("url")))


def union_frontier(*sources: DataFrame) -> DataFrame:
    """All collectors feed one frontier."""
    return reduce(DataFrame.unionByName, (s.select(*_COLUMNS) for s in sources))


def first_per_url(frontier: DataFrame) -> DataFrame:
    """One row per URL; collector rows come before sub-pages. Combines before the shuffle."""
    rank = F.struct(~F.col("from_queue"), F.coalesce("parent_url", F.lit("")), F.col("source"))
    first = frontier.groupBy("url").agg(
        F.min_by(F.struct("parent_url", "source", "from_queue"), rank).alias("f"))
    return first.select("f.parent_url", "url", "f.source", "f.from_queue")


def known_urls_anti(frontier: DataFrame, tab_url: DataFrame, url_filter: DataFrame | None = None) -> DataFrame:
    """Leave out URLs that are stored already.

    With `url_filter` (see `operators.url_filter`) only the URLs it may hold meet `tab_url`; the
    others are surely new and are not shuffled. The rows are the same.
    """
    stored = tab_url.select("url")
    if url_filter is None:
        return frontier.join(stored, "url", "left_anti").select(*frontier.columns)
    marked = with_maybe(frontier, url_filter)
    possible = marked.filter("_maybe").join(stored, "url", "left_anti")
    return marked.filter("not _maybe").unionByName(possible).select(*frontier.columns)


def route(frontier: DataFrame, tab_url: DataFrame, pages: DataFrame,
          downloads: DataFrame) -> DataFrame:
    """Add `outcome`: known, unfetchable, expand, discard or store.

    `downloads` has the data links by page_id. Give one row per URL (`first_per_url`).
    """
    known = tab_url.select("url").distinct().withColumn("_known", F.lit(True))
    fetched = pages.select("url", "page_id")
    linked = downloads.select("page_id").distinct().withColumn("_linked", F.lit(True))
    facts = frontier.join(known, "url", "left").join(fetched, "url", "left")
    # Rows without a page would all go to one task; a second key that no page has spreads them.
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("url")).otherwise(F.lit(0).cast("long"))
    linked = linked.withColumn("_spread", F.lit(0).cast("long"))
    facts = facts.withColumn("_spread", spread).join(linked, ["page_id", "_spread"], "left")
    outcome = (
        F.when(F.col("_known"), "known")
        .when(F.col("page_id").isNull(), "unfetchable")
        .when(F.col("_linked"), "store")
        .when(F.col("from_queue"), "expand")
        .otherwise("discard")
    )
    return facts.select(*frontier.columns, "page_id", outcome.alias("outcome"))


def expand(seeds: DataFrame, links: DataFrame, pages: DataFrame, depth: int = 1,
           exact_host: bool = False, exact_url: bool = False) -> DataFrame:
    """Sub-pages within `depth` links of the seeds: frontier columns and `level` (from 1).

    As `expand_one_hop`, from level to level: only the pages that the last level brought are looked
    at, and a page that a seed has reached already is left out, so a cycle ends. Each level is
    written once; the work ends early when a level brings nothing.
    """
    form = (lambda url: url) if exact_url else u.crawl_form
    stored = stage(pages.groupBy(form(F.col("url")).alias("url")).agg(
        F.min("url").alias("page_url"), F.min_by("page_id", "url").alias("page_id")))
    last = seeds.select("page_id", F.col("url").alias("seed_url"), F.col("url").alias("page_url"), "source")
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        targets = last.join(links.select("page_id", "href"), "page_id").select(
            "seed_url", "source",
            form(u.resolve_link(F.col("page_url"), F.col("href"), rfc3986=True)).alias("url"))
        wanted = not_media(same_site(targets, exact_host)).filter(
            F.col("url") != form(F.col("seed_url"))).distinct()
        for before in levels:
            wanted = wanted.join(before.select("seed_url", "source", "url"), ["seed_url", "source", "url"], "left_anti")
        found = stage(wanted.join(stored, "url").withColumn("level", F.lit(level)))
        if found.isEmpty():
            break
        levels.append(found)
        last = found.select("page_id", "seed_url", "page_url", "source")
    every = reduce(DataFrame.unionByName, levels) if levels else found
    return every.select(F.col("seed_url").alias("parent_url"), F.col("page_url").alias("url"), "source",
                        F.lit(False).alias("from_queue"), "level")


def expand_one_hop(seeds: DataFrame, links: DataFrame, pages: DataFrame,
                   exact_host: bool = False,
                   keep: Callable[[DataFrame], DataFrame] = lambda df: df,
                   exact_url: bool = False) -> DataFrame:
    """Sub-pages of the seeds: same-site pages, no media, that their links lead to.

    `seeds` has frontier columns and page_id, `links` page_id and href. The seed itself is no
    sub-page of its own. Filters run before anything is shuffled but the seeds. `keep` is applied
    to the wanted URLs before their pages are looked up, and may write them. URLs are compared in
    their crawl form, and the page's own URL comes out (of several the first in order);
    `exact_url` compares them as they are.
    """
    form = (lambda url: url) if exact_url else u.crawl_form
    parents = seeds.select("page_id", F.col("url").alias("seed_url"), "source")
    targets = parents.join(links.select("page_id", "href"), "page_id").select(
        "seed_url", "source",
        form(u.resolve_link(F.col("seed_url"), F.col("href"), rfc3986=True)).alias("url"))
    wanted = keep(not_media(same_site(targets, exact_host)).filter(
        F.col("url") != form(F.col("seed_url"))).distinct())
    # Written, so that the join shuffles both sides and a URL that many pages link to is split.
    stored = stage(pages.groupBy(form(F.col("url")).alias("url")).agg(F.min("url").alias("page_url")))
    return wanted.join(stored, "url").select(
        F.col("seed_url").alias("parent_url"), F.col("page_url").alias("url"), "source",
        F.lit(False).alias("from_queue"))
