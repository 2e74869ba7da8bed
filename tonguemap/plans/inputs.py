"""Input tables of the registered queries, derived from the given tables.

The raw ``pages`` carry no statuses, hreflang links, redirects, robots or sitemap files. These SELECTs add
them from what each URL looks like, for every row, with whole texts. The text is plain SQL that reads the same
everywhere; ``{pages}`` and ``{events}`` are replaced by the relation to read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tonguemap.config import DEFAULT
from tonguemap.streaming.jobs import read_stream

# Some hosts move under suffixes of two labels: one that a rule names, one that a wildcard does, and an exception.
SUFFIXES = ("co.uk", "*.ck", "!www.ck")
CFG = replace(DEFAULT, suffixes=SUFFIXES)
URL = """CASE WHEN url LIKE '%//blog.%.example.net/%' THEN replace(url, '.example.net/', '.example.co.uk/')
  WHEN url LIKE '%//m.%.example.org/%' THEN replace(url, '.example.org/', '.example.ck/')
  WHEN url LIKE '%//www.%.example.org/%' THEN replace(url, '.example.org/', '.www.ck/') ELSE url END"""

_FAILED = "(url LIKE '%cheap-pills%' OR url LIKE '%casino-win%')"
_DOMAIN = """CASE WHEN url LIKE '%.co.uk/%' THEN regexp_extract(url, '^https?://(?:[^/]*[.])?([^./]+[.]co[.]uk)/', 1)
  WHEN url LIKE '%.www.ck/%' THEN 'www.ck'
  WHEN url LIKE '%.ck/%' THEN regexp_extract(url, '^https?://(?:[^/]*[.])?([^./]+[.][^./]+[.]ck)/', 1)
  ELSE regexp_extract(url, '^https?://(?:[^/]*[.])?([^./]+[.][^./]+)/', 1) END"""
_HOST = "regexp_extract(url, '^https?://([^/]+)/', 1)"

# A crawl snapshot. Covers failed fetches, error pages, redirects, pages that are HTML by type, by content or
# not at all, exact and loose rel, x-default, region codes, foreign hosts, app shells, language names and
# sub-domains, protocol-relative and dot-segment links.
CRAWL = f"""
SELECT page_id AS seq, url AS requested_url,
  CASE WHEN {_FAILED} THEN NULL
       WHEN url LIKE 'http://%/' THEN replace(url, 'http://', 'https://')
       WHEN url LIKE 'https://m.%#top' THEN replace(url, 'https://m.', 'https://es.')
       ELSE url END AS final_url,
  CAST(CASE WHEN {_FAILED} THEN NULL
       WHEN url LIKE '%//www.%.html' THEN 404
       WHEN url LIKE 'http://m.%' THEN 301 ELSE 200 END AS INT) AS status_code,
  CASE WHEN {_FAILED} THEN NULL
       WHEN url LIKE '%spam-farm%' THEN 'text/plain'
       WHEN url LIKE 'http://blog.%' THEN 'application/octet-stream'
       WHEN url LIKE '%/' THEN 'Application/XHTML+xml'
       ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN {_FAILED} THEN NULL
       WHEN url LIKE '%spam-farm%' THEN replace(html, '<html', '<div')
       ELSE replace(replace(replace(html,
         '<html lang="en">', CASE WHEN url LIKE '%.html' THEN '<html class="no-js" lang=" EN-us ">'
                                  WHEN url LIKE '%page=2%' THEN '<html lang="">'
                                  ELSE '<html lang="en">' END),
         '<head>', concat('<head>', CASE
           WHEN url LIKE '%utm_source=feed' THEN '<link rel="alternate" hreflang="es-MX" href="/es/a"><link rel="alternate" hreflang="x-default" href="/">'
           WHEN url LIKE '%page=2%' THEN '<link rel="Alternate nofollow" hreflang="pt-BR" href="/pt-br/b">'
           WHEN url LIKE '%#top' THEN '<link rel="canonical" href="/c"><link rel="alternate" hreflang="zh-Hans" href="https://other.test/zh/">'
           WHEN url LIKE '%/' THEN '<link rel="alternate" type="application/rss+xml" href="feed/">'
           ELSE '' END)),
         '<article>', concat(CASE
           WHEN url LIKE '%//blog.%' THEN '<div id="__next"></div>'
           WHEN url LIKE '%//www.%' THEN '<a href="/french/x">f</a><a href="https://es.example.com/inicio">e</a>'
           WHEN url LIKE '%//m.%' THEN '<a href="mailto:a@b.c">m</a><a href="../up?q=1&amp;r=2#z">u</a><a href="//www.example.org/it/p">i</a>'
           ELSE '' END, '<article>')) END AS body,
  CASE WHEN url LIKE '%cheap-pills%' THEN 'timeout'
       WHEN url LIKE '%casino-win%' THEN 'client_error: ClientConnectorError' END AS error
FROM {{pages}}
"""

# Failure classes of the fetches that did not answer, by URL shape.
FAILURES = f"""
SELECT page_id AS seq, url AS requested_url,
  CASE WHEN url LIKE '%.html' THEN 'asyncio:TimeoutError' WHEN url LIKE '%/' THEN 'client:TooManyRedirects'
       WHEN url LIKE '%#top' THEN 'client:ClientConnectorError' ELSE 'builtins:ValueError' END AS exception
FROM {{pages}}
"""

# Domain list lines as people write them.
DOMAIN_LINES = f"""
SELECT page_id AS seq,
  CASE WHEN url LIKE '%.html' THEN concat('  ', {_HOST}, ' ,a label,')
       WHEN url LIKE '%/' THEN concat('domains.', {_DOMAIN})
       WHEN url LIKE '%#top' THEN 'Domain'
       WHEN url LIKE '%page=2%' THEN concat(',', url, ',')
       WHEN url LIKE '%utm_source=feed' THEN '   '
       ELSE {_HOST} END AS value
FROM {{pages}}
"""

DOMAIN_CELLS = f"""
SELECT page_id AS seq, concat({_HOST}, ',', {_DOMAIN}, '  domain ', chr(10), ' Domain, ', url, ' ', chr(9)) AS value
FROM {{pages}}
"""

# One robots file per registered domain.
ROBOTS = f"""
SELECT domain, concat('User-agent: *', chr(10),
  'Sitemap: https://', domain, '/sm/', CAST(min(page_id) AS STRING), '.xml', chr(13), chr(10),
  '  SITEMAP:  https://', domain, '/sm/', CAST(max(page_id) AS STRING), '.xml ', chr(10),
  'sitemap:', chr(10), 'sitemap: /relative.xml', chr(10), 'Sitemap: https://other.test/x.xml', chr(10),
  'Sitemap: https://', domain, '/sm/', CAST(min(page_id) AS STRING), '.xml', chr(10), 'Disallow: /private') AS body
FROM (SELECT page_id, {_DOMAIN} AS domain FROM {{pages}}) AS p GROUP BY domain
"""

_SM = "concat('<sitemap><loc> https://', domain, '/sm/', CAST(6 * page_id + {k} AS STRING), '.xml </loc></sitemap>')"

# One sitemap document per page: indexes that form a tree, URL lists, and some broken files.
SITEMAPS = f"""
SELECT domain, page_id AS seq, concat('https://', domain, '/sm/', CAST(page_id AS STRING), '.xml') AS url,
  CASE WHEN url LIKE '%//blog.%#top' THEN concat('<urlset><url><loc>', url, '</loc></url>')
       WHEN url LIKE '%//m.%utm_source=feed' THEN ' '
       WHEN url LIKE '%.html' OR url LIKE '%/' OR url LIKE '%#top' OR url LIKE '%page=2%' THEN concat(
         '<?xml version="1.0" encoding="UTF-8"?><!-- tree --><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
         {", ".join(_SM.format(k=k) for k in range(1, 7))},
         '<sitemap><loc>https://other.test/sm.xml</loc></sitemap></sitemapindex>')
       ELSE concat('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>', replace(url, '&', '&amp;'),
         '</loc></url><!-- <loc>http://no.test/</loc> --><url><loc>', replace(url, '&', '&amp;'), '</loc></url><url><loc><![CDATA[https://', domain,
         '/it/c?a=1&b=2]]></loc></url><x:url xmlns:x="urn:x"><x:loc>https://', domain, '/sv/n</x:loc></x:url><url><loc> </loc></url></urlset>')
  END AS body
FROM (SELECT page_id, url, {_DOMAIN} AS domain FROM {{pages}}) AS p
"""

# Robots fetches of every host: those of the registered domains went well, others answer with an error page, or not.
ROBOTS_FETCHES = f"""
SELECT concat('https://', domain, '/robots.txt') AS requested_url, 200 AS status_code, body, NULL AS error
FROM ({ROBOTS.strip()}) AS r
UNION ALL
SELECT concat('https://', host, '/robots.txt'), CASE WHEN host LIKE 'm.%' THEN NULL ELSE 404 END,
  CASE WHEN host LIKE 'm.%' THEN NULL ELSE 'Sitemap: https://example.com/no.xml' END, CASE WHEN host LIKE 'm.%' THEN 'timeout' END
FROM (SELECT DISTINCT {_HOST} AS host FROM {{pages}}) AS h
"""

# Sitemap fetches, some of which never answered.
SITEMAP_FETCHES = f"""
SELECT url AS requested_url, CASE WHEN seq_url LIKE '%cheap-pills%' OR seq_url LIKE '%//m.%page=2%' THEN NULL ELSE body END AS body,
  CASE WHEN seq_url LIKE '%cheap-pills%' THEN 'timeout' WHEN seq_url LIKE '%//m.%page=2%' THEN 'too_many_redirects' END AS error
FROM ({SITEMAPS.strip()}) AS s JOIN (SELECT page_id AS id, url AS seq_url FROM {{pages}}) AS p ON p.id = s.seq
"""

# Link graph between landed pages: three children and one parent per page, plus entries at the start URLs.
EDGES = f"""
SELECT s.url AS src, e.pos, d.url AS dst
FROM (SELECT page_id AS id, 0 AS pos, 3 * page_id + 1 AS t FROM {{pages}}
  UNION ALL SELECT page_id, 1, 3 * page_id + 2 FROM {{pages}}
  UNION ALL SELECT page_id, 2, CAST(floor(page_id / 2) AS BIGINT) FROM {{pages}}
  UNION ALL SELECT page_id, 3, 3 * page_id + 3 FROM {{pages}}) AS e
JOIN {{pages}} AS s ON s.page_id = e.id JOIN {{pages}} AS d ON d.page_id = e.t
"""

START_EDGES = f"""
SELECT concat('https://', domain) AS src, 0 AS pos, min(url) AS dst FROM (SELECT url, {_DOMAIN} AS domain FROM {{pages}}) AS p GROUP BY domain
UNION ALL
SELECT concat('https://', domain), 1, max(url) FROM (SELECT url, {_DOMAIN} AS domain FROM {{pages}}) AS p GROUP BY domain
"""

# Start page fetches per host: over https they fail on mobile hosts, over http they always answer.
START_FETCHES = f"""
SELECT concat('https://', host) AS requested_url, seq, CASE WHEN host LIKE 'm.%' THEN NULL ELSE 200 END AS status_code,
  CASE WHEN host LIKE 'm.%' THEN 'timeout' END AS error
FROM (SELECT {_HOST} AS host, min(page_id) AS seq FROM {{pages}} GROUP BY {_HOST}) AS h
UNION ALL
SELECT concat('http://', host, '/'), seq, 301, NULL
FROM (SELECT {_HOST} AS host, min(page_id) AS seq FROM {{pages}} GROUP BY {_HOST}) AS h
"""

# Fetch log of language probes: some folders and names that answered on each host, or did not.
PROBE_LOG = f"""
SELECT concat('https://', {_HOST}, '/', CASE WHEN url LIKE '%.html' THEN 'spanish/' WHEN url LIKE '%#top' THEN 'it'
    ELSE regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) END) AS requested_url,
  CASE WHEN url LIKE 'http://%' THEN 404 WHEN url LIKE '%/' THEN 302 ELSE 200 END AS status_code
FROM {{pages}}
"""

JOBS = f"""
SELECT {_HOST} AS job_id, CASE WHEN url LIKE '%cheap-pills%' THEN NULL ELSE url END AS domain FROM {{pages}}
"""

STATUS_VALUES = f"""
SELECT page_id AS seq, CASE WHEN url LIKE '%//www.%' THEN 'Error' ELSE regexp_extract(url, '/([0-9]+)', 1) END AS status
FROM {{pages}}
"""

# Job submissions with the forwarding header a proxy adds, or none.
SUBMISSIONS = """
SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN NULL
  ELSE concat(' 10.0.0.', regexp_extract(props, '([0-9]+)', 1), ' , 10.1.1.1') END AS forwarded,
  concat(' user-', CAST(user_id AS STRING), ' ') AS fallback
FROM {events}
"""


def derive(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run one of the SELECTs above over the tables of a folder."""
    name = "events" if "{events}" in sql else "pages"
    given = table(spark, sf, name)
    if name == "pages":
        given = given.selectExpr("page_id", f"{URL} AS url", "html")
    return spark.sql(sql.format(**{name: "{given}"}), given=given)


# session setting that asks for :func:`spread`
SPREAD = "spark.tonguemap.spread"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if spark.conf.get(SPREAD, "false") == "true" else df


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    path = f"{sf}/{name}.parquet"
    schema, at = spark.read.parquet(path).schema, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return read_stream(spark, path, schema, "*") if folder else read_stream(spark, sf, schema, f"{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of fewer splits than cores, as of one small file: for the bench only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
