"""Written files and streams."""

import json
import os
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonguemap.config import DEFAULT
from tonguemap.operators import keyed, site, stage
from tonguemap.operators.merged import MergedTable
from tonguemap.operators.pages import scored_pages, site_pages
from tonguemap.operators.run import ScoredRun
from tonguemap.plans import inputs
from tonguemap.plans.keyed_queries import _updates
from tonguemap.sinks import reports as sinks
from tonguemap.streaming import jobs

SF = "/root/testdata/sf0.001"


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_summary_files(spark, tmp_path):
    rows = [("b.org", "0", "", "Yes"), ("a|b.com", "1", 'English "US" (High, 90%)', "No")]
    df = spark.createDataFrame(rows, "domain_name string, language_count string, languages string, review_recommended string")
    sinks.write_lines(sinks.summary_markdown(df), str(tmp_path / "md"), "domain_name", head=sinks.MARKDOWN_HEAD)
    assert text_of(tmp_path / "md").splitlines() == [
        *sinks.MARKDOWN_HEAD, '| a\\|b.com | 1 | English "US" (High, 90%) | No |', "| b.org | 0 | _None over threshold_ | Yes |",
    ]
    sinks.write_json(sinks.summary_json(df.orderBy("domain_name").coalesce(1)), str(tmp_path / "json"))
    assert [json.loads(x) for x in text_of(tmp_path / "json").splitlines()][1] == {
        "domain": "b.org", "languageCount": 0, "languages": "", "reviewRecommended": "Yes"}
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert '"English ""US"" (High, 90%)"' in text_of(tmp_path / "csv")


def test_debug_files_are_written_per_domain(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.com", "page", 1, "x"), ("b.org/y", "page", 1, "z")], "domain string, kind string, position long, value string")
    sinks.write_debug(rows, str(tmp_path / "debug"))
    back = spark.read.json(str(tmp_path / "debug")).orderBy("slug").collect()
    assert [(r.slug, r.value) for r in back] == [("a.com", "x"), ("b.org_y", "z")]
    assert len(list((tmp_path / "debug").glob("bucket=*"))) <= sinks.DEBUG_FOLDERS


def test_published_headers(spark, tmp_path):
    summary = spark.createDataFrame([("a.com", "2", "Thai; Urdu", "No")], "domain_name string, language_count string, languages string, review_recommended string")
    sinks.write_summary_csv(summary.coalesce(1), str(tmp_path / "summary"))
    (file,) = (tmp_path / "summary").glob("*.csv")
    assert file.read_text().splitlines() == ["Domain Name,Language Count,Languages,Review Recommended", "a.com,2,Thai; Urdu,No"]
    report = spark.createDataFrame([("b.com", "200 - OK", 1, 'say "x"', "Yes"), ("a.com", "", 0, "-", "No")], "domain string, status string, language_count long, languages string, review_recommended string")
    sinks.write_site_csv(report, str(tmp_path / "site"))
    lines = [x for f in sorted((tmp_path / "site").glob("*.txt")) for x in f.read_text().splitlines()]
    assert lines == ["Domain Name,Status,Language Count,Languages,Review Recommended", 'a.com,"-",0,"-",No', 'b.com,"200 - OK",1,"say ""x""",Yes']


def test_job_states(spark):
    jobs_ = spark.createDataFrame([("a", 2, False), ("b", 2, False), ("c", 2, False), ("d", 2, True), ("e", 0, False)], "job_id string, total long, failed boolean")
    steps = spark.createDataFrame([("a",), ("b",), ("b",), ("d",), ("lost",)], "job_id string")
    got = {r.job_id: (r.done, r.progress, r.status) for r in keyed.job_states(jobs_, steps).collect()}
    assert got == {"a": (1, 50, "running"), "b": (2, 100, "complete"), "c": (0, 0, "queued"), "d": (1, 50, "error"), "e": (0, 100, "complete")}


def test_work_folder_is_the_one_of_the_session(spark):
    assert stage.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_staged_tables_are_dropped_at_the_end_of_a_scope(spark):
    kept = stage.stage(spark.range(3), "kept")
    with stage.dropping_staged(spark):
        inner = stage.stage(spark.range(5), "inner")
        assert inner.count() == 5
        (path,) = {p.rsplit("/", 1)[0] for p in inner.inputFiles()}
    assert kept.count() == 3
    assert not os.path.exists(path.removeprefix("file://"))


def test_a_table_staged_alone_leaves_nothing_else(spark, tmp_path):
    made = []

    def make():
        made.append(stage.stage(spark.range(7), "on-the-way"))
        return made[0].where("id > 2")

    out = stage.stage_alone(spark, make, "result")
    assert out.count() == 4
    folder = os.path.join(stage.work_dir(spark), "tonguemap")
    assert not [n for n in os.listdir(folder) if n.startswith("on-the-way")]


def test_calls_run_together(spark):
    a, b = stage.together(lambda: stage.stage(spark.range(3), "a").count(), lambda: spark.range(5).count())
    assert (a, b) == (3, 5)
    with pytest.raises(ZeroDivisionError):
        stage.together(lambda: 1 / 0, lambda: 1)


def as_rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """The events and pages in four files each, as they would arrive one after the other."""
    root = tmp_path_factory.mktemp("arrivals")
    for name, order in (("events", "ts"), ("pages", "page_id")):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.repartitionByRange(4, order).write.parquet(str(root / name))
    return root


def test_quota_stream_over_several_batches(spark, arrivals):
    cfg = replace(DEFAULT, quota_limit=1, quota_window="1 day")
    def keyed_events(df):
        return df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"))

    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = jobs.read_stream(spark, str(arrivals / "events"), events.schema, files_per_trigger=1)
    # files may be read in any order, so nothing counts as late here
    got = jobs.quota_windows_stream(keyed_events(stream), late_by="60 days", cfg=cfg)
    assert as_rows(got) == as_rows(keyed.quota_windows(keyed_events(events), cfg))


def test_state_stream_over_several_batches(spark, arrivals):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = jobs.read_stream(spark, str(arrivals / "events"), events.schema, files_per_trigger=1)
    got = jobs.latest_state_stream(_updates(stream), ttl_seconds=86400)
    assert as_rows(got) == as_rows(keyed.latest_state(_updates(events), "1 day"))


def test_report_stream_over_several_batches(spark, arrivals):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    stream = jobs.read_stream(spark, str(arrivals / "pages"), pages.schema, files_per_trigger=1)
    got = jobs.site_report_stream(crawl_of(spark, stream))
    whole = site.site_report(site.site_facts(site_pages(inputs.derive(spark, SF, inputs.CRAWL))))
    assert as_rows(got) == as_rows(whole)


def crawl_of(spark, stream):
    return spark.sql(inputs.CRAWL.format(pages="{given}"), given=stream.selectExpr("page_id", f"{inputs.URL} AS url", "html"))


FETCH = "seq long, requested_url string, final_url string, status_code int, content_type string, body string, error string"
FRENCH = "le la de et les des " * 30


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_scored_report_for_any_order_of_batches(spark, tmp_path, order):
    """A trusted page that comes late turns the warnings of the pages after it into points."""
    pages = [
        (1, "https://a.com/1", f"<html><body>{FRENCH}</body></html>"), (2, "https://a.com/2", f'<html lang="fr"><body>{FRENCH}<a href="/es/">'),
        (3, "https://a.com/3", f"<html><body>{FRENCH}</body></html>"), (4, "https://b.com/4", '<html lang="en"><link rel="alternate" hreflang="de" href="/x">'),
    ]
    rows = [(i, url, url, 200, "text/html", body, None) for i, url, body in pages]
    whole = ScoredRun(scored_pages(spark.createDataFrame(rows, FETCH)))
    folder, path = str(tmp_path / "pages"), str(tmp_path / "job")
    for i in order:
        spark.createDataFrame([rows[i]], FETCH).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, spark.createDataFrame([], FETCH).schema)
        got = jobs.language_report_stream(stream, path=path)
    assert as_rows(got) == as_rows(whole.report)
    assert {r.domain: r.warning_count for r in got.collect()} == {"a.com": 3, "b.com": 0}


def test_job_stream_with_timeout(spark, tmp_path):
    ts = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    submitted = [("a", 2, False, ts(0)), ("b", 1, False, ts(0)), ("c", 2, False, ts(5000)), ("d", 1, True, ts(9000)), ("e", 3, False, ts(100))]
    steps = [("a", ts(10)), ("b", ts(20)), ("c", ts(8000)), ("lost", ts(9500)), ("e", ts(9400))]
    folders = [str(tmp_path / n) for n in ("jobs", "steps")]
    kinds = ["job_id string, total long, failed boolean, ts timestamp", "job_id string, ts timestamp"]

    def run(rows, **more):
        for folder, kind, new in zip(folders, kinds, rows):
            if new:
                spark.createDataFrame(new, kind).write.mode("append").parquet(folder)
        streams = [jobs.read_stream(spark, f, spark.createDataFrame([], k).schema) for f, k in zip(folders, kinds)]
        return {r.job_id: (r.done, r.status) for r in jobs.job_states_stream(*streams, path=str(tmp_path / "state"), **more).collect()}

    # steps of a job may come ahead of it
    assert run((submitted[:2], steps[2:])) == {"a": (0, "queued"), "b": (0, "queued")}
    want = {"a": (1, "running"), "b": (1, "complete"), "c": (1, "running"), "d": (0, "error"), "e": (1, "running")}
    assert run((submitted[2:], steps[:2])) == want
    late = run(([], [("lost", ts(9600))]), timeout_seconds=3600)
    assert late == want | {"a": (1, "error")}


def test_state_stream_is_native_and_goes_on(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder, path = str(tmp_path / "events"), str(tmp_path / "job")
    for part in range(3):
        events.where(f"event_id % 3 = {part}").write.mode("append").parquet(folder)
        got = jobs.latest_state_stream(_updates(jobs.read_stream(spark, folder, events.schema)), 86400, path)
    assert as_rows(got) == as_rows(keyed.latest_state(_updates(events), "1 day"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def summed(df):
    batch = [F.max("batch").alias("batch")] if "batch" in df.columns else []
    return df.groupBy("k").agg(F.sum("n").alias("n"), *batch)


def test_many_batches_end_in_few_files(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), summed, every=8, files=1)
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long").coalesce(1)
    for batch in range(100):
        table.append(facts, batch)
    assert {r.k: r.n for r in summed(table.read()).collect()} == {"a": 100, "b": 200}
    assert sum(1 for _ in (tmp_path / "t").rglob("*.parquet")) <= 2 + 2 * 8
    assert len(list((tmp_path / "t").glob("batch=*"))) <= 16 and len(list((tmp_path / "t" / "merged").iterdir())) <= 2


@pytest.mark.parametrize("killed", ["write", "_switch", "_delete"])
def test_a_killed_merge_loses_nothing(spark, tmp_path, monkeypatch, killed):
    table = MergedTable(spark, str(tmp_path / "t"), summed, every=1000)
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    for batch in range(3):
        table.append(facts, batch)
    table.compact()
    table.append(facts, 3)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if killed == "write":
            m.setattr(table, "merge", die)
        else:
            m.setattr(table, killed, die)
        with pytest.raises(RuntimeError):
            table.compact()
    total = lambda: {r.k: r.n for r in summed(table.read()).collect()}
    assert total() == {"a": 4, "b": 8}
    table.append(facts, 4)
    table.append(facts, 4)  # a batch that is written again
    table.compact()
    assert total() == {"a": 5, "b": 10}
    table.append(facts, 4)  # also after it was merged
    assert total() == {"a": 5, "b": 10}


def test_a_stopped_stream_goes_on(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder, path = str(tmp_path / "pages"), str(tmp_path / "job")

    def run():
        stream = jobs.read_stream(spark, folder, pages.schema)
        return as_rows(jobs.site_report_stream(crawl_of(spark, stream), path=path))

    pages.where("page_id % 3 <> 0").write.parquet(folder)
    run()
    pages.where("page_id % 3 = 0").write.mode("append").parquet(folder)
    whole = site.site_report(site.site_facts(site_pages(inputs.derive(spark, SF, inputs.CRAWL))))
    assert run() == as_rows(whole)
    facts = spark.read.parquet(f"{path}/table").where("strategy = 'page'").groupBy("batch").agg(F.sum("marks").alias("n"))
    by_batch = {r.batch: r.n for r in facts.collect()}
    assert by_batch == {0: pages.where("page_id % 3 <> 0").count(), 1: pages.where("page_id % 3 = 0").count()}


def test_a_repeated_batch_replaces_the_first_attempt(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "out"))
    for n, batch in ((5, 0), (3, 0), (2, 1)):
        table.append(spark.range(n), batch)
    assert table.read().groupBy("batch").count().orderBy("batch").collect() == [(0, 3), (1, 2)]


@pytest.mark.parametrize("name", ["site_report_stream", "language_report_stream", "quota_windows_stream"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    for table in ("pages", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    query, whole = entry.queries()[name], entry.queries()[name.removesuffix("_stream")]
    assert as_rows(query(spark, str(tmp_path))) == as_rows(query(spark, SF)) == as_rows(whole(spark, SF))
