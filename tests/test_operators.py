"""Operators on small hand-made crawls, and against plain Python where the rule is a loop."""

import random
from collections import deque
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT
from tonguemap.operators import discovery, graph, keyed, scored, site, stage
from tonguemap.operators.pages import scored_pages, site_pages
from tonguemap.operators.run import ScoredRun

FETCH = "seq long, requested_url string, final_url string, status_code int, content_type string, body string, error string"


def crawl(spark, rows):
    """rows of (url, body) or (url, body, status, error)"""
    full = [(i + 1, r[0], r[0] if r[1] else None, (r[2:] or (200,))[0], "text/html", r[1], (r[3:] or (None,))[0]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FETCH)


def scored_run(spark, rows):
    return ScoredRun(scored_pages(crawl(spark, rows)))


def test_scores_of_single_signals(spark):
    s = scored_run(spark, [
        ("https://a.com/p", '<html lang="fr"></html>'),
        ("https://b.com/p", '<html lang="en"><body>' + "the and of to " * 40 + "</body></html>"),
        ("https://c.com/p", '<html><link rel="alternate" hreflang="es-MX" href="https://other.net/"></html>'),
        ("https://d.com/it/p", "<html></html>"),
    ])
    got = {(r.domain, r.code): (r.score, r.confidence_label) for r in s.scores.collect()}
    assert got == {
        ("a.com", "fr"): (35, "Low"), ("b.com", "en"): (45, "Low"), ("c.com", "es"): (90, "High"), ("d.com", "it"): (35, "Low"),
    }
    kept = {(r.domain, r.code) for r in s.findings.collect()}
    assert kept == {("b.com", "en"), ("c.com", "es")}
    report = {r.domain: (r.language_count, list(r.languages), r.warning_count) for r in s.report.collect()}
    assert report["a.com"] == (0, [], 0) and report["c.com"] == (1, ["Spanish (High, 90%)"], 0)


def test_text_counts_only_after_trusted_evidence(spark):
    french = "le la de et les des " * 30
    s = scored_run(spark, [
        ("https://a.com/1", f"<html><body>{french}</body></html>"),
        ("https://a.com/2", f'<html lang="fr"><body>{french}</body></html>'),
        ("https://a.com/3", f"<html><body>{french}</body></html>"),
    ])
    assert [(r.seq, r.counts, r.conflict) for r in s.gate.orderBy("seq").collect()] == [(1, False, True), (2, True, False), (3, True, True)]
    kinds = sorted((r.seq, r.type) for r in s.warnings.collect())
    assert kinds == [(1, "suppressed_text_only_language"), (1, "text_signal_conflict"), (3, "text_signal_conflict")]
    assert [(r.code, r.score) for r in s.scores.collect()] == [("fr", 55)]


def test_failed_fetch_is_a_page_and_other_content_is_not(spark):
    rows = [("https://a.com/1", None, None, "timeout"), ("https://a.com/2", "%PDF"), ("https://a.com/3", "<html></html>", 404)]
    df = crawl(spark, rows).withColumn("content_type", F.when(F.col("seq") == 2, "application/pdf").otherwise("text/html"))
    out = {r.seq: r for r in scored_pages(df).collect()}
    assert set(out) == {1, 3} and out[1].fetch_error == "page: https://a.com/1: timeout" and out[3].html_lang is None


def report(spark, rows, probes=None):
    facts = site.site_facts(site_pages(crawl(spark, rows)))
    return {r.domain: (r.status, r.language_count, r.languages, r.review_recommended) for r in site.site_report(facts).collect()}


@pytest.mark.parametrize("first", [-5, -1, 0, 2**62])
def test_site_status_with_any_page_numbers(spark, first):
    rows = [("https://a.com/x", "<html><div id='root'></div></html>", 404), ("https://a.com/y", "<html></html>", 200)]
    df = crawl(spark, rows).withColumn("seq", F.col("seq") - F.lit(1) + F.lit(first))
    (got,) = site.site_report(site.site_facts(site_pages(df))).collect()
    assert (got.status, got.review_recommended) == ("404 - Not Found", "Yes")


def test_site_review_rules(spark):
    es = '<a href="/es/">es</a><a href="/fr/">fr</a>'
    got = report(spark, [
        ("https://none.com/", "<p>x</p>"),
        ("https://two.com/", es), ("https://two.com/b", None, None, "timeout"),
        ("https://spa1.com/", '<div id="root"></div><a href="/es/">'), ("https://spa2.com/", '<div id="root"></div>' + es),
        ("https://one.com/", '<html lang="en"></html>'), ("https://one.com/b", '<div id="root"></div>'),
        ("https://gone.com/", "<html lang='x'>", 404),
    ])
    assert got["none.com"] == ("200 - Success", 0, "-", "Yes")
    assert got["two.com"] == ("Error", 2, "French; Spanish", "Yes")
    assert got["spa1.com"][3] == "Yes" and got["spa2.com"][3] == "No"
    assert got["one.com"] == ("200 - Success", 1, "English", "No")
    assert got["gone.com"] == ("404 - Not Found", 0, "-", "Yes")


def test_report_does_not_depend_on_row_order_or_other_sites(spark):
    rows = [(f"https://s{i % 3}.com/{i}", f'<html lang="{("en", "de", "fr")[i % 3]}"><a href="/{("it", "es")[i % 2]}/">') for i in range(12)]
    whole = report(spark, rows)
    df = crawl(spark, rows)
    shuffled = site.site_report(site.site_facts(site_pages(df.orderBy(F.rand(3)))))
    assert {r.domain: (r.status, r.language_count, r.languages, r.review_recommended) for r in shuffled.collect()} == whole
    for d in whole:
        assert report(spark, [r for r in rows if f"//{d}/" in r[0]])[d] == whole[d]


def test_probing(spark):
    rows = [("https://en.com/", '<html lang="en">'), ("https://es.com/", '<html lang="es">'),
            ("https://tag.com/", '<html lang="en"><link rel="alternate" hreflang="en" href="/">')]
    facts = site.site_facts(site_pages(crawl(spark, rows)))
    gate = site.probe_gate(facts)
    assert [r.site for r in gate.collect()] == ["en.com"]
    candidates = site.probe_candidates(gate)
    assert candidates.count() == 72 and candidates.distinct().count() == 72
    log = spark.createDataFrame([("https://en.com/german/", 301), ("https://en.com/de", 200), ("https://en.com/fr", 404)], "requested_url string, status_code int")
    hits = site.probe_hits(candidates, log)
    assert [tuple(r) for r in hits.collect()] == [("en.com", "de")]
    out = {r.domain: r.languages for r in site.site_report(site.with_probe_hits(facts, hits)).collect()}
    assert out["en.com"] == "English; German"


def test_job_size(spark):
    rows = [("a", f"d{i}") for i in range(50)] + [("b", f"d{i}") for i in range(51)] + [("c", None)]
    out = {r.job_id: r.verdict for r in site.batch_validation(spark.createDataFrame(rows, "job_id string, domain string")).collect()}
    assert out == {"a": "ok", "b": "Maximum 50 domains per request.", "c": "At least one domain is required."}


def fifo(seeds, links, landed, cfg):
    """The scored crawl as a queue: what the level-by-level job has to equal."""
    queue, visited, pages = deque((u, 0) for u in seeds), set(), []
    while queue and len(pages) < cfg.max_pages:
        url, depth = queue.popleft()
        if url in visited or url.split("/")[2] != "a.com":
            continue
        visited.add(url)
        if url not in landed:
            continue
        pages.append((url, depth, len(pages) + 1))
        if depth < cfg.max_depth:
            queue.extend((t, depth + 1) for t in links.get(url, []))
    return pages


def test_scored_crawl_equals_a_queue(spark):
    rnd = random.Random(7)
    names = [f"https://a.com/{i}" for i in range(60)] + ["https://b.com/0"]
    links = {n: rnd.sample(names, rnd.randint(0, 6)) for n in names}
    landed = set(rnd.sample(names, 45)) | {names[0], names[1]}
    edges = spark.createDataFrame([(s, i, t) for s, ts in links.items() for i, t in enumerate(ts)], "src string, pos int, dst string")
    seeds = [names[0], names[1], names[5], names[9]]
    seed_df = spark.createDataFrame([("a.com", u, i) for i, u in enumerate(seeds)], "domain string, url string, pos int")
    landed_df = spark.createDataFrame([(u,) for u in landed], "url string")
    for cap in (4, 12, 100):
        cfg = replace(DEFAULT, max_pages=cap)
        out = graph.bfs_scored(seed_df, edges, landed_df, cfg)
        got = sorted(((r.url, r.depth, r["rank"]) for r in out.collect()), key=lambda x: x[2])
        assert got == fifo(seeds, links, landed, cfg)


def site_fifo(start, targets, cfg):
    queue, visited = [start], []
    while queue and len(visited) < cfg.site_max_pages:
        url = queue.pop(0)
        if url in visited:
            continue
        visited.append(url)
        for t in targets.get(url, []):
            if "a.com" in t and t not in visited and len(queue) < cfg.site_queue_cap:
                queue.append(t)
    return visited


def test_site_crawl_equals_a_queue(spark):
    rnd = random.Random(11)
    names = [f"https://a.com/{i}" for i in range(12)] + ["https://b.net/1"]
    for cap in (3, 20):
        cfg = replace(DEFAULT, site_queue_cap=cap)
        targets = {n: [rnd.choice(names) for _ in range(rnd.randint(0, 9))] for n in rnd.sample(names, 9) + names[:1]}
        df = spark.createDataFrame(
            [(u, [(t, t.split("/")[2]) for t in ts]) for u, ts in targets.items()], "url string, targets array<struct<url:string,host:string>>"
        )
        starts = spark.createDataFrame([("a.com", names[0])], "domain string, url string")
        got = [r.url for r in graph.bfs_site(starts, df, cfg).orderBy("rank").collect()]
        assert got == site_fifo(names[0], targets, cfg)


def test_sitemap_limits(spark):
    roots = spark.createDataFrame([("a.com", 0, "https://a.com/r")], "domain string, pos int, url string")
    children = spark.createDataFrame(
        [("https://a.com/r", i, f"https://a.com/s{i}") for i in range(6)] + [("https://a.com/s0", 0, "https://a.com/r"), ("https://a.com/s0", 1, "https://a.com/t")],
        "parent string, pos int, url string",
    )
    locs = spark.createDataFrame([(f"https://a.com/s{i}", f"https://a.com/p{i}-{k}") for i in range(6) for k in range(3)] + [("https://a.com/s1", "https://a.com/p0-0")], "sitemap string, url string")

    starts = spark.createDataFrame([("a.com", "https://a.com/")], "domain string, url string")

    def run(**limits):
        out = graph.sitemap_expand(roots, children, locs, starts, replace(DEFAULT, **limits)).orderBy("rank").collect()
        return [(r.url.split("/")[-1], r.new_urls) for r in out]

    assert run() == [("r", 0), ("s0", 3), ("s1", 3), ("s2", 3), ("s3", 3), ("s4", 3), ("s5", 3), ("t", 0)]
    assert run(max_sitemaps=3) == [("r", 0), ("s0", 3), ("s1", 3)]
    assert run(max_sitemap_urls=7) == [("r", 0), ("s0", 3), ("s1", 3)]
    assert run(max_sitemap_urls=8) == [("r", 0), ("s0", 3), ("s1", 3), ("s2", 3)]


def test_sitemap_rounds_grow_with_the_depth_of_the_tree(spark, monkeypatch):
    """Many sitemaps, few rounds; what was seen is one table in each of them."""
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, name: written.append(name) or stage.stage(df, name))
    children = [(f"https://a.com/{i}", k, f"https://a.com/{10 * i + k}") for i in range(1, 10) for k in range(10)] + [("https://a.com/95", 0, "https://a.com/1")]
    out = graph.sitemap_expand(
        spark.createDataFrame([("a.com", 0, "https://a.com/1")], "domain string, pos int, url string"),
        spark.createDataFrame(children, "parent string, pos int, url string"), spark.createDataFrame([], "sitemap string, url string"),
        spark.createDataFrame([("a.com", "https://a.com/")], "domain string, url string"))
    assert out.count() == 11 and written.count("sitemaps-seen") == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sitemaps-seen") <= 3


def discovered(spark, starts, robots=(), sitemaps=(), cfg=DEFAULT):
    fetch = "requested_url string, body string, error string"
    names = spark.createDataFrame([(s,) for s in starts], "domain string")
    return discovery.discover(
        discovery.start_urls(names, cfg), spark.createDataFrame(list(robots), fetch), spark.createDataFrame(list(sitemaps), fetch), cfg)


def test_start_urls_and_sitemaps_are_evidence(spark):
    """A crawl of es.a.com has the points of its start URL, and sitemaps add URLs, folders and hosts."""
    found = discovered(
        spark, ["https://es.a.com/", "b.com", " "],
        [("https://es.a.com/robots.txt", "Sitemap: https://a.com/i.xml", None), ("https://b.com/robots.txt", None, "timeout")],
        [("https://a.com/i.xml", "<sitemapindex><sitemap><loc>https://a.com/1.xml</loc></sitemap><sitemap><loc>https://a.com/2.xml</loc></sitemap>"
          "<sitemap><loc>https://a.com/3.xml</loc></sitemap><sitemap><loc>https://other.com/4.xml</loc></sitemap></sitemapindex>", None),
         ("https://a.com/1.xml", "<urlset><url><loc>https://a.com/fr/x</loc></url><url><loc>https://other.com/it/</loc></url></urlset>", None),
         ("https://a.com/2.xml", "<urlset>", None), ("https://a.com/3.xml", None, "client_error: X"), ("https://b.com/unread.xml", None, "timeout")])
    s = ScoredRun(scored_pages(crawl(spark, [("https://a.com/p", '<html lang="fr"></html>'), ("https://a.com/q", None, None, "timeout")])), found)
    assert {(r.domain, r.code, r.score) for r in s.scores.collect()} == {("a.com", "es", 35), ("a.com", "fr", 105)}
    assert sorted(r.url for r in s.discovered.where("domain = 'a.com'").collect()) == ["https://a.com/fr/x", "https://es.a.com/"]
    counts = {r.domain: r for r in s.counts.collect()}
    a, b = counts["a.com"], counts["b.com"]
    assert (a.subdomains, a.sitemaps, a.urls, a.candidate_language_paths, a.pages, a.fetch_errors) == (2, 6, 2, 1, 2, 3)
    assert (b.subdomains, b.sitemaps, b.urls, b.pages, b.fetch_errors) == (1, 2, 1, 0, 1)
    assert sorted(r.line for r in s.errors.collect()) == [
        "page: https://a.com/q: timeout", "robots: https://b.com/robots.txt: timeout", "sitemap: https://a.com/3.xml: client_error: X",
        "sitemap_parse: https://a.com/2.xml: ParseError"]
    assert {r.domain: list(r.languages) for r in s.report.collect()} == {"a.com": ["French (High, 100%)"], "b.com": []}
    docs = {r.domain: r.discovery_counts.sitemaps for r in s.documents().collect()}
    assert docs == {"a.com": 6, "b.com": 2}


def test_public_suffixes_in_a_run(spark):
    cfg = replace(DEFAULT, suffixes=("co.uk", "*.ck", "!www.ck"))
    found = discovered(spark, ["a.co.uk", "https://fr.b.co.uk/", "x.shop.ck", "m.www.ck"], cfg=cfg)
    rows = [("https://www.a.co.uk/", '<html><a href="https://b.co.uk/es/">b</a><a href="/it/">i</a></html>'), ("https://x.shop.ck/", '<html lang="de">')]
    s = ScoredRun(scored_pages(crawl(spark, rows), cfg), found, cfg)
    assert {r.domain for r in s.report.collect()} == {"a.co.uk", "b.co.uk", "x.shop.ck", "www.ck"}
    assert {(r.domain, r.code, r.score) for r in s.scores.collect()} == {("a.co.uk", "it", 70), ("b.co.uk", "fr", 35), ("x.shop.ck", "de", 35)}


def test_report_over_visited_pages(spark):
    """Only pages within the budget count, in the order of the visits."""
    rows = [("https://a.com/3", '<html lang="fr">'), ("https://a.com/", '<html lang="es"><a href="/2">'), ("https://a.com/2", '<html lang="es">')]
    s = ScoredRun(scored_pages(crawl(spark, rows)), discovered(spark, ["a.com"]))
    visits = spark.createDataFrame([("a.com", "https://a.com/", 1), ("a.com", "https://a.com/2", 2)], "domain string, url string, rank long")
    seen = s.visited(visits)
    assert {(r.code, r.score) for r in seen.scores.collect()} == {("es", 70)}
    assert [(r.seq, r.url) for r in seen.pages.orderBy("seq").collect()] == [(1, "https://a.com/"), (2, "https://a.com/2")]


def test_http_fallback(spark):
    rows = [("https://a.com", 1, None, "timeout"), ("http://a.com/", 2, 200, None), ("https://b.com/", 3, 200, None), ("http://b.com", 4, 301, None)]
    fetches = spark.createDataFrame(rows, "requested_url string, seq long, status_code int, error string")
    domains = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string")
    out = {r.domain: (r.start_url, r.fell_back) for r in graph.http_fallback(domains, fetches).collect()}
    assert out == {"a.com": ("http://a.com/", True), "b.com": ("https://b.com/", False), "c.com": (None, False)}


def test_running_count_and_progress(spark):
    steps = spark.range(300).select(
        F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 5).alias("job_id"), F.col("id").alias("step_id"),
        F.timestamp_seconds(F.col("id") * 777 % 90000).alias("ts"),
    )
    rows = keyed.job_progress(steps).join(steps, ["job_id", "step_id"]).orderBy("job_id", "ts", "step_id").collect()
    seen = {}
    for r in rows:
        seen[r.job_id] = seen.get(r.job_id, 0) + 1
        assert r.done == seen[r.job_id]
    assert all((r.status == "complete") == (r.done == r.total) for r in rows)


def test_client_key(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "x"), (None, " y "), ("", "z")], "f string, d string")
    assert [r.k for r in df.select(keyed.client_key(F.col("f"), F.col("d")).alias("k")).collect()] == ["1.2.3.4", "y", "z"]
