"""Files as people and programs write them."""

import gzip
import json

from pyspark.sql import functions as F

from tonguemap.functions import urls
from tonguemap.sources import crawl, domains, reports, sitemaps


def test_domain_file_keeps_first_in_file_order(spark, tmp_path):
    (tmp_path / "d.csv").write_text("domain\n a.com, \ndomains.com\n\na.com\nb.org,x\n,c.net,\n")
    given = spark.createDataFrame([("z.org",), ("b.org",)], "value string").select(
        F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("split"), F.monotonically_increasing_id().alias("line")).alias("seq"), "value"
    )
    out = domains.domains_from_lines(domains.read_lines(spark, str(tmp_path)), given).orderBy("part", "seq").collect()
    assert [r.domain for r in out] == ["z.org", "b.org", "a.com", "c.net"]


def test_tokens_and_lines(spark):
    df = spark.createDataFrame([(1, "a.com,b.org Domain\n a.com\tc.net "), (2, "c.net\n\n d.io ")], "seq int, value string")
    assert [r.domain for r in domains.domains_from_tokens(df).orderBy("seq", "pos").collect()] == ["a.com", "b.org", "c.net", "d.io"]
    assert [r.line for r in domains.split_lines(df).orderBy("seq", "pos").collect()] == ["a.com,b.org Domain", "a.com\tc.net", "c.net", "d.io"]
    assert domains.split_tokens(df).count() == 7


def test_robots_and_candidates(spark):
    body = "User-agent: *\nSitemap: https://a.b/s.xml\r\nSITEMAP:/x\nsitemap:\nSitemap: https://a.b/s.xml\nsitemap: http://other.c/y.xml"
    df = spark.createDataFrame([("a.b", body), ("c.d", None)], "domain string, body string")
    assert [r.sitemap for r in sitemaps.robots_sitemaps(df).orderBy("pos").collect()] == ["https://a.b/s.xml", "/x", "http://other.c/y.xml"]


def test_candidates_of_start_urls(spark):
    """Defaults are those of the host that was asked for, also without a robots file."""
    body = "Sitemap: https://a.b/s.xml\nSitemap: /rel\nSitemap: https://other.c/y.xml\nSitemap: https://m.a.b//t.xml?x"
    starts = spark.createDataFrame([("a.b", "https://a.b/x"), ("a.b", "http://m.a.b/"), ("c.d", "https://c.d/"), ("e.f", "https://e.f/")], "domain string, url string")
    robots = spark.createDataFrame([
        ("https://a.b/robots.txt", body, 200, None), ("https://a.b/robots.txt", None, None, "timeout"),
        ("https://c.d/robots.txt", body, 404, None), ("https://e.f/robots.txt", None, None, "timeout"),
    ], "requested_url string, body string, status_code int, error string")
    begun = sitemaps.with_robots(starts, robots)
    assert {r.domain: r.error for r in begun.collect()} == {"a.b": None, "c.d": None, "e.f": "timeout"}
    out = [(r.start, r.url) for r in sitemaps.sitemap_candidates(begun).orderBy("start", "pos").collect()]
    defaults = lambda host: [f"{host}/sitemap.xml", f"{host}/sitemap_index.xml"]
    want = [("http://m.a.b/", u) for u in defaults("http://m.a.b")]
    want += [("https://a.b/x", u) for u in ["https://a.b/s.xml", "https://m.a.b/t.xml", *defaults("https://a.b")]]
    want += [("https://c.d/", u) for u in defaults("https://c.d")] + [("https://e.f/", u) for u in defaults("https://e.f")]
    assert out == want


def test_sitemap_documents(spark):
    docs = {
        "urlset": '<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> http://a/1?x=1&amp;y=2 </loc></url><url><loc>http://a/1?x=1&amp;y=2</loc></url></urlset>',
        "index": '<s:sitemapindex xmlns:s="http://x"><s:sitemap><s:loc><![CDATA[http://a/s?b&c]]></s:loc></s:sitemap></s:sitemapindex>',
        "broken": "<urlset><url><loc>http://a/1</loc></url>",
        "empty": "  ",
        "html": "<html><body><p>404</body></html>",
    }
    out = {r.name: r for r in sitemaps.parse_sitemaps(spark.createDataFrame(list(docs.items()), "name string, body string")).collect()}
    assert (out["urlset"].is_index, out["urlset"].locs) == (False, ["http://a/1?x=1&y=2"])
    assert (out["index"].is_index, out["index"].locs) == (True, ["http://a/s?b&c"])
    assert (out["broken"].parse_error, out["broken"].locs) == ("ParseError", [])
    assert (out["empty"].parse_error, out["empty"].locs) == (None, [])
    assert out["html"].parse_error == "ParseError"


def test_packed_sitemaps(spark, tmp_path):
    text = "<urlset>é</urlset>"
    packed = gzip.compress(text.encode())
    rows = [(1, packed), (2, text.encode()), (3, None), (4, b""), (5, packed[:12]), (6, b"\x1f\x8bnot packed"), (7, b"a\xffb"), (8, gzip.compress(b"a\xffb")), (9, b"\x1f")]
    out = {r.i: r.body for r in sitemaps.payload_text(spark.createDataFrame(rows, "i int, payload binary"), "payload").collect()}
    assert out == {1: text, 2: text, 3: None, 4: "", 5: None, 6: None, 7: "a\ufffdb", 8: "a\ufffdb", 9: "\x1f"}
    (tmp_path / "s.xml.gz").write_bytes(packed)
    assert spark.read.text(str(tmp_path), wholetext=True).first().value == text



def finding(name, percent=None, label=None):
    return {"name": name, "confidence_percent": percent, "confidence_label": label}


def test_summary_from_report_json(spark, tmp_path):
    # languages are counted again from what there is, whatever the report claims
    docs = [
        {"domain": "z1.test", "language_count": 9, "findings": [finding("Greek", 41, "Low")], "warning_count": 0},
        {"domain": "\tz2.test ", "findings": [finding("Thai"), finding("Czech", 55)], "warning_count": 7},
        {"domain": "z3.test", "findings": [], "languages": [" ", "Urdu", " Malay (High, 95%) "], "warnings": None},
        {"domain": "z4.test", "languages": ["Finnish"], "warnings": [{"code": "de"}, {"code": "fr"}]},
        {"domain": "z5.test"},
    ]
    (tmp_path / "r.json").write_text(json.dumps(docs))
    out = {r.domain_name: tuple(r)[1:] for r in reports.summary_from_reports(reports.read_reports(spark, str(tmp_path), multi_line=True)).collect()}
    assert out["z1.test"] == ("1", "Greek (Low, 41%)", "No")
    assert (out["z2.test"][0], out["z2.test"][2]) == ("2", "Yes")
    assert out["z3.test"] == ("2", "Urdu; Malay (High, 95%)", "No")
    assert out["z4.test"] == ("1", "Finnish", "Yes")
    assert out["z5.test"] == ("0", "", "Yes")


def test_summary_from_report_csv(spark, tmp_path):
    lines = ["domain,warnings,languages", 'z1.test,0," Thai ;; Urdu (Low, 40%);"', 'z2.test,3,"say ""Malay"""', "z3.test,[],", 'z4.test,,"Czech"', 'z5.test,"[{""a"": "";""}]",Greek']
    (tmp_path / "r.csv").write_text("\n".join(lines))
    out = {r.domain_name: tuple(r)[1:] for r in reports.summary_from_csv(reports.read_report_csv(spark, str(tmp_path))).collect()}
    assert out == {
        "z1.test": ("2", "Thai; Urdu (Low, 40%)", "No"), "z2.test": ("1", 'say "Malay"', "Yes"), "z3.test": ("0", "", "Yes"),
        "z4.test": ("1", "Czech", "No"), "z5.test": ("1", "Greek", "Yes"),
    }


def test_summary_spellings(spark, tmp_path):
    rows = [
        {"domain": "a", "languageCount": 1, "languages": "English", "reviewRecommended": "No"},
        {"DomainName": "b", "languageCount": 0, "LanguageCount": 2, "Languages": "X; Y", "ReviewRecommended": "Yes"},
        {"Domain Name": "c", "Language Count": "0", "languages": ""},
    ]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    out = [tuple(r) for r in reports.normalize_summary(reports.read_summary(spark, str(tmp_path), whole_files=True)).collect()]
    assert out == [("a", "1", "English", "No"), ("b", "2", "X; Y", "Yes"), ("c", "0", "", "No")]


def test_seeds_and_suffixes(spark):
    df = spark.createDataFrame([("A.com/x",), (" ",), ("mailto:x",)], "input_domain string")
    out = {r.input_domain: r for r in crawl.seeds(df).collect()}
    assert (out["A.com/x"].normalized_url, out["A.com/x"].registered_domain, out["A.com/x"].error) == ("https://a.com/x", "a.com", None)
    assert out[" "].error == "empty input"
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("q.unknown",), ("uk",), ("a.b.c.d.e.f.g.h",), (None,)], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",), ("c.d.e.f.g.h",), ("g.h",)], "rule string")
    got = {r.host: r.registered_domain for r in crawl.registered_domain_by_suffix(hosts, suffixes, "host").collect()}
    assert got == {"a.b.co.uk": "b.co.uk", "x.com": "x.com", "q.unknown": "q.unknown", "uk": "uk", "a.b.c.d.e.f.g.h": "b.c.d.e.f.g.h", None: None}


def test_suffix_rules_of_a_file(spark, tmp_path):
    """The join and the setting read the same rules the same way."""
    (tmp_path / "rules.dat").write_text("// ===BEGIN===\n\ncom\nco.uk  remark\n*.ck\n!www.ck\n*.kobe.jp\n!city.kobe.jp\njp\n  UK\n")
    rules = crawl.read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    setting = crawl.suffix_rules(rules)
    assert setting == ("!city.kobe.jp", "!www.ck", "*.ck", "*.kobe.jp", "co.uk", "com", "jp", "uk")
    names = ["a.b.co.uk", "co.uk", "ck", "shop.ck", "a.shop.ck", "b.a.shop.ck", "www.ck", "x.www.ck", "kobe.jp", "c.kobe.jp", "a.c.kobe.jp", "z.a.c.kobe.jp",
             "city.kobe.jp", "a.city.kobe.jp", "tokyo.jp", "x.tokyo.jp", "q.w.nowhere"]
    hosts = spark.createDataFrame([(n,) for n in names], "host string")
    joined = {r.host: r.registered_domain for r in crawl.registered_domain_by_suffix(hosts, rules, "host").collect()}
    inline = {r.host: r.d for r in hosts.select("host", urls.registered_domain(F.col("host"), setting).alias("d")).collect()}
    assert joined == inline
    assert (joined["a.shop.ck"], joined["x.www.ck"], joined["a.city.kobe.jp"], joined["z.a.c.kobe.jp"]) == ("a.shop.ck", "www.ck", "city.kobe.jp", "a.c.kobe.jp")
    assert (joined["shop.ck"], joined["c.kobe.jp"], joined["x.tokyo.jp"]) == ("shop.ck", "kobe.jp", "tokyo.jp")


def test_fetch_flags(spark):
    rows = [("http://a/", "http://a", 200, None), ("http://a", "http://b", 399, None), ("http://a", None, None, "timeout"), ("http://a", "http://a", 400, None)]
    df = spark.createDataFrame(rows, "requested_url string, final_url string, status_code int, error string")
    out = [(r.ok, r.moved, r.line) for r in df.select(
        crawl.fetch_ok().alias("ok"), crawl.fetch_redirected().alias("moved"), crawl.error_line("page").alias("line")).collect()]
    assert out == [(True, False, None), (True, True, None), (False, False, "page: http://a: timeout"), (False, False, None)]
