"""Crawl expansion over landed tables, level by level, within the crawl budgets.

First-in-first-out visiting equals the order (level, rank of the parent, position of the link), so each
level is one join with the link table plus a per-domain top-k. Bodies never take part. Every level is
a written table: a lost executor repeats one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import urls
from tonguemap.operators.skew import keep_first, top_k
from tonguemap.operators.stage import stage


def crawl_seeds(starts: DataFrame, discovered: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Start URLs at position 0, then the smallest discovered URLs; (domain, url, pos), first of equals kept."""
    first = starts.select("domain", "url", F.lit(0).alias("pos"))
    known = discovered.select("domain", "url").unionByName(starts.select("domain", "url")).distinct()
    smallest = top_k(known, ["domain"], [F.col("url")], cfg.max_pages, "pos")
    return keep_first(first.unionByName(smallest.select("domain", "url", "pos")), ["domain", "url"], ["pos"])


def page_links(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Link table (src, pos, dst) of the scored crawl, with the per-page link cap."""
    from tonguemap.operators.scored import crawl_targets

    return pages.select(F.col("url").alias("src"), F.posexplode(crawl_targets(cfg)).alias("pos", "dst"))


def _nothing(like: DataFrame, *more: Column) -> DataFrame:
    """Empty (domain, url, ..., rank); the optimizer drops joins with it."""
    return like.select("domain", "url", *more, F.lit(0).cast("long").alias("rank")).where(F.lit(False))


def bfs_scored(seeds: DataFrame, links: DataFrame, fetched: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pages a scored crawl visits: (domain, url, depth, rank).

    ``fetched`` lists the URLs that count as pages: failed fetches do, landed non-HTML does not. A
    target that never landed is passed over.
    """
    landed = stage(fetched.select("url").distinct(), "landed")
    edges = stage(links.select("src", "pos", "dst"), "edges")
    frontier = seeds.select("domain", "url", F.lit(0).cast("long").alias("parent"), "pos")
    visited = _nothing(seeds, F.lit(0).alias("depth"))
    for depth in range(cfg.max_depth + 1):
        fresh = (
            keep_first(frontier, ["domain", "url"], ["parent", "pos"])
            .where(urls.domain_of(F.col("url"), cfg.suffixes) == F.col("domain"))
            .join(visited.select("domain", "url"), ["domain", "url"], "left_anti")
            .join(landed, "url", "left_semi")
        )
        used = visited.groupBy("domain").agg(F.count(F.lit(1)).alias("used"))
        level = (
            top_k(fresh, ["domain"], [F.col("parent"), F.col("pos"), F.col("url")], cfg.max_pages)
            .join(used, "domain", "left")
            .withColumn("rank", F.col("rank") + F.coalesce("used", F.lit(0).cast("long")))
            .where(F.col("rank") <= cfg.max_pages)
            .select("domain", "url", F.lit(depth).alias("depth"), "rank")
        )
        level = stage(level, f"bfs-level{depth}")
        visited = visited.unionByName(level)
        frontier = level.select("domain", F.col("rank").alias("parent"), F.col("url").alias("src")).join(
            edges, "src"
        ).select("domain", F.col("dst").alias("url"), "parent", "pos")
    return visited


def frontier_links(pages: DataFrame) -> DataFrame:
    """Per landed URL the links a site crawl may follow, in document order: (url, targets)."""
    worth = F.filter("web_links", lambda t: urls.site_frontier(t["path"], t["host"]))
    targets = F.transform(worth, lambda t: F.struct(t["url"].alias("url"), t["host"].alias("host")))
    return keep_first(
        pages.select(F.col("requested_url").alias("url"), "seq", targets.alias("targets")), ["url"], ["seq"], ["targets"]
    ).select("url", "targets")


def bfs_site(starts: DataFrame, targets: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pages a site crawl visits: (domain, rank, url, landed).

    One page per domain and round, one join per round. ``starts`` is (domain, url). The queue of a domain
    holds at most ``site_queue_cap`` entries, so its state is one short row; duplicates take up slots.
    """
    text = "array<string>"
    targets = stage(targets.select("url", "targets"), "site-targets")  # read once per round, bodies once in all
    state = starts.select(
        "domain", F.array("url").alias("queue"), F.array().cast(text).alias("visited"),
        F.array().cast("array<boolean>").alias("landed"),
    )
    for _ in range(cfg.site_max_pages):
        numbered = F.transform("queue", lambda q, i: F.struct(q.alias("url"), i.alias("i")))
        state = state.withColumn(
            "pick", F.get(F.filter(numbered, lambda x: ~F.array_contains("visited", x["url"])), F.lit(0))
        ).select(
            "domain", "visited", "landed", F.col("pick.url").alias("url"),
            F.when(F.col("pick").isNull(), F.array().cast(text))
            .otherwise(F.slice("queue", F.col("pick.i") + 2, F.size("queue")))
            .alias("rest"),
        )
        joined = state.join(targets, "url", "left")
        seen = F.when(F.col("url").isNull(), F.col("visited")).otherwise(F.concat("visited", F.array("url")))
        joined = joined.select(
            "domain", "rest", "targets", seen.alias("visited"),
            F.when(F.col("url").isNull(), F.col("landed"))
            .otherwise(F.concat("landed", F.array(F.col("targets").isNotNull())))
            .alias("landed"),
        )
        usable = F.filter(
            F.coalesce("targets", F.array().cast("array<struct<url:string,host:string>>")),
            lambda t: t["host"].contains(F.col("domain")) & ~F.array_contains("visited", t["url"]),
        )
        room = F.greatest(F.lit(cfg.site_queue_cap) - F.size("rest"), F.lit(0))
        state = joined.select(
            "domain", "visited", "landed",
            F.concat("rest", F.transform(F.slice(usable, F.lit(1), room), lambda t: t["url"])).alias("queue"),
        )
    both = F.arrays_zip(F.col("visited").alias("url"), F.col("landed").alias("landed"))
    return state.select("domain", F.posexplode(both).alias("i", "v")).select(
        "domain", (F.col("i") + 1).cast("long").alias("rank"), F.col("v.url").alias("url"), F.col("v.landed").alias("landed")
    )


def http_fallback(domains: DataFrame, fetches: DataFrame) -> DataFrame:
    """Start fetch of each domain: the https one, or the http one where https never answered."""
    answered = fetches.where(F.col("error").isNull()).select("requested_url", "seq", "status_code")
    first = keep_first(answered, ["requested_url"], ["seq"], ["status_code"])
    out = domains.select("domain")
    for s in ("https", "http"):
        hit = first.select(
            F.regexp_extract("requested_url", f"^{s}://([^/?#]+)/?$", 1).alias("domain"),
            F.col("requested_url").alias(f"{s}_url"), F.col("status_code").alias(f"{s}_status"), F.col("seq").alias("seq"),
        ).where(F.col("domain") != "")
        hit = keep_first(hit, ["domain"], ["seq"], [f"{s}_url", f"{s}_status"]).drop("seq")
        out = out.join(hit, "domain", "left")
    return out.select(
        "domain",
        F.coalesce("https_url", "http_url").alias("start_url"),
        F.when(F.col("https_url").isNotNull(), F.col("https_status")).otherwise(F.col("http_status")).alias("status_code"),
        (F.col("https_url").isNull() & F.col("http_url").isNotNull()).alias("fell_back"),
    )


def sitemap_expand(
    roots: DataFrame, children: DataFrame, locs: DataFrame, starts: DataFrame, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Sitemaps a crawl reads: (domain, rank, url, new_urls).

    ``roots`` (domain, pos, url), ``children`` (parent, pos, url) of sitemap indexes, ``locs`` (sitemap, url)
    of page lists, ``starts`` (domain, url). Reading stops at ``max_sitemaps``, or once ``max_sitemap_urls`` URLs are
    known, the start URLs included. Stopping cuts the visiting order short but never changes it, so the
    URL limit is applied to the finished order.

    There is a round per level of the tree, each of which reads ``children``, best a staged table. What was seen is one table, written anew in each round: at most
    ``max_sitemaps`` rows of a domain, whatever the number of rounds.
    """
    frontier = roots.select("domain", F.lit(0).cast("long").alias("p"), "pos", "url")
    seen, level = _nothing(roots, F.lit(0).alias("level")), 0
    while True:
        fresh = keep_first(frontier, ["domain", "url"], ["p", "pos"]).join(
            seen.select("domain", "url"), ["domain", "url"], "left_anti"
        )
        used = seen.groupBy("domain").agg(F.count(F.lit(1)).alias("used"))
        new = (
            top_k(fresh, ["domain"], [F.col("p"), F.col("pos"), F.col("url")], cfg.max_sitemaps)
            .join(used, "domain", "left")
            .withColumn("rank", F.col("rank") + F.coalesce("used", F.lit(0).cast("long")))
            .where(F.col("rank") <= cfg.max_sitemaps)
            .select("domain", "url", F.lit(level).alias("level"), "rank")
        )
        seen = stage(seen.unionByName(new), "sitemaps-seen")
        new = seen.where(F.col("level") == level)
        # every further level adds a sitemap to some domain, so the limit bounds the number of rounds
        if new.isEmpty():
            break
        level += 1
        frontier = (
            new.select("domain", F.col("rank").alias("p"), F.col("url").alias("parent"))
            .join(children.select("parent", "pos", "url"), "parent")
            .where(urls.domain_of(F.col("url"), cfg.suffixes) == F.col("domain"))
            .select("domain", "p", "pos", "url")
        )
    listed = listed_urls(seen, locs, cfg).join(starts.select("domain", "url"), ["domain", "url"], "left_anti")
    first = listed.groupBy("domain", "url").agg(F.min("rank").alias("rank"))
    counted = first.groupBy("domain", "rank").agg(F.count(F.lit(1)).alias("new_urls"))
    begun = starts.select("domain", "url").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("begun"))
    zero = F.lit(0).cast("long")
    ranked = seen.join(counted, ["domain", "rank"], "left").join(begun, "domain", "left").withColumn("new_urls", F.coalesce("new_urls", zero))
    # at most max_sitemaps rows per domain, so this window is small
    before = Window.partitionBy("domain").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce("begun", zero) + F.coalesce(F.sum("new_urls").over(before), F.lit(0))
    return ranked.withColumn("known", known).where(F.col("known") < cfg.max_sitemap_urls).select(
        "domain", "rank", "url", "new_urls"
    )


def listed_urls(sitemaps: DataFrame, locs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(domain, rank, url) of the pages that the sitemaps (domain, rank, url) list on their domain."""
    listed = sitemaps.select("domain", "rank", F.col("url").alias("sitemap")).join(locs.select("sitemap", "url"), "sitemap")
    return listed.where(urls.domain_of(F.col("url"), cfg.suffixes) == F.col("domain")).select("domain", "rank", "url")
