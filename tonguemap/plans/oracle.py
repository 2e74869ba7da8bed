"""The registered queries as plain SQL over the given tables, written for checking.

Each statement is a chain of common table expressions. They state what the results mean in their own way:
joins and set operations where the engine uses arrays, one scan per signal where the engine reads pages once.
"""

from __future__ import annotations

from tonguemap import dims
from tonguemap.plans import inputs

# name -> (SELECT text, names it reads)
CTES: dict[str, tuple[str, list[str]]] = {}
CHECKS: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql.strip(), list(needs))


def check(name: str, sql: str, *needs: str) -> None:
    """Register the SQL of one query with the expressions it reads, which may be stated further below."""
    CHECKS[name] = (sql.strip(), list(needs))


def all_sql() -> dict[str, str]:
    return {name: chained(*parts) for name, parts in CHECKS.items()}


def chained(sql: str, needs: list[str]) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n not in order:
            for m in CTES[n][1]:
                add(m)
            order.append(n)

    for n in needs:
        add(n)
    chain = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    return (f"WITH {chain}\n" if order else "") + sql


def given(sql: str) -> str:
    return sql.format(pages="given_pages", events="events")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


cte("given_pages", f"SELECT page_id, {inputs.URL} AS url, html FROM pages")
for _n in ("CRAWL", "FAILURES", "DOMAIN_LINES", "DOMAIN_CELLS", "ROBOTS", "ROBOTS_FETCHES", "SITEMAPS", "SITEMAP_FETCHES", "EDGES",
           "START_EDGES", "START_FETCHES", "PROBE_LOG", "JOBS", "STATUS_VALUES", "SUBMISSIONS"):
    cte(_n.lower(), given(getattr(inputs, _n)), "given_pages")

# ---------------------------------------------------------------- expressions
ALT24 = "|".join(dims.SCORED_CODES)
ALT19 = "|".join(dims.SITE_CODES)
NAMES = "|".join(dims.SITE_NAMES)
SITE_NAMES_T = f"(VALUES {values(dims.SITE_NAME_TO_CODE.items())}) AS site_names(nm, cd)"
CODES24_T = f"(VALUES {values(dims.SCORED_CODE_TO_NAME.items())}) AS codes24(cd, nm)"


def host(u):
    return f"regexp_extract({u}, '^https?://([^/?#]*)', 1)"


def domain(u):
    """Registered domain under the suffixes co.uk, *.ck and !www.ck."""
    h = host(u)
    return f"""CASE WHEN {h} LIKE '%.co.uk' THEN regexp_extract({h}, '([^.]+[.]co[.]uk)$', 1)
      WHEN {h} = 'www.ck' OR {h} LIKE '%.www.ck' THEN 'www.ck'
      WHEN {h} LIKE '%.%.ck' THEN regexp_extract({h}, '([^.]+[.][^.]+[.]ck)$', 1)
      ELSE regexp_replace({h}, '^(?:.*[.])?([^.]+[.][^.]+)$', '\\1') END"""


def path(u):
    return f"regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"


def tail(u):
    return f"regexp_extract({u}, '^[^?#]*(.*)$', 1)"


def resolve(base, ref):
    """Absolute URL for the kinds of references the pages hold."""
    origin = f"regexp_extract({base}, '^https?://[^/?#]*')"
    folder = f"regexp_extract({path(base)}, '^(.*/)[^/]*$', 1)"
    joined = f"{folder} || regexp_extract({ref}, '^[^?#]*')"
    undotted = f"regexp_replace({joined}, '/[^/]*/[.][.]/', '/')"
    return f"""CASE WHEN regexp_matches({ref}, '^[a-z]+:') THEN {ref}
      WHEN {ref} LIKE '//%' THEN regexp_extract({base}, '^https?:') || {ref}
      WHEN {ref} LIKE '/%' THEN {origin} || {ref}
      ELSE {origin} || {undotted} || {tail(ref)} END"""


def canonical(u, query=False):
    q = f"|| CASE WHEN regexp_matches({u}, '[?][^#]') THEN regexp_extract({u}, '([?][^#]*)', 1) ELSE '' END" if query else ""
    p = f"regexp_replace({path(u)}, '/+', '/', 'g')"
    return f"""CASE WHEN regexp_matches({u}, '^https?://[^/?#]')
      THEN regexp_extract({u}, '^https?://[^/?#]*') || CASE WHEN {p} = '' THEN '/' ELSE {p} END {q} END"""


def encoded(p):
    """Browser form of a path: everything but printable ASCII percent-encoded."""
    return f"""array_to_string([CASE WHEN regexp_matches(c, '[^!-~]|["<>`{{}}]') THEN url_encode(c) ELSE c END
      for c in string_split({p}, '')], '')"""


def scored_code(tag):
    return f"nullif(regexp_extract(lower(trim({tag})), '^({ALT24})(?:[-_](?:[a-z][a-z]|[0-9][0-9][0-9]))?$', 1), '')"


def scored_url(u):
    return f"""CASE WHEN regexp_matches(lower({host(u)}), '^({ALT24})[.]') THEN regexp_extract(lower({host(u)}), '^({ALT24})[.]', 1)
      ELSE nullif(regexp_extract(lower({path(u)}), '/({ALT24})(?:[-_][a-z][a-z])?(?:/|$)', 1), '') END"""


def attr(tag, name):
    return f"""CASE WHEN regexp_matches({tag}, '\\s{name}="') THEN replace(regexp_extract({tag}, '\\s{name}="([^"]*)"', 1), '&amp;', '&') END"""


def name24(code):
    return f"coalesce((SELECT max(codes24.nm) FROM {CODES24_T} WHERE codes24.cd = {code}), {code})"


def site_name(code):
    return f"""coalesce((SELECT max(upper(site_names.nm[1]) || site_names.nm[2:]) FROM {SITE_NAMES_T} WHERE site_names.cd = {code}), upper({code}))"""


def label(pct):
    return f"CASE WHEN {pct} >= 85 THEN 'High' WHEN {pct} >= 60 THEN 'Medium' ELSE 'Low' END"


def yes(cond):
    return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"


def words(text):
    """Word tokens."""
    return f"regexp_extract_all(lower({text}), '[{dims.WORD_CHARS}]+')"


def hits(tokens, lang):
    listed = ", ".join(f"'{w}'" for w in dims.STOP_WORDS[lang])
    return f"len([t for t in {tokens} if list_contains([{listed}], t)])"


def best(text):
    langs = list(dims.STOP_WORDS)
    top = "greatest(" + ", ".join(f"h_{c}" for c in langs) + ")"
    cases = " ".join(f"WHEN h_{c} = {top} THEN '{c}'" for c in langs)
    return f"CASE WHEN length({text}) < 300 OR {top} < 4 THEN NULL {cases} END"


def with_hits(text):
    return ", ".join(f"{hits('toks', c)} AS h_{c}" for c in dims.STOP_WORDS)


# ---------------------------------------------------------------- pages, both profiles
cte("page", f"""
SELECT *, {host('requested_url')} AS site, {domain('requested_url')} AS domain,
  regexp_replace(body, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS mk
FROM crawl""", "crawl")

cte("lang", f"""SELECT seq, site, {attr("regexp_extract(mk, '<html[^>]*>')", "lang")} AS html_lang FROM page""", "page")

cte("link_tag", f"""
SELECT seq, site, domain, pos, {attr('tag', 'rel')} AS rel, {attr('tag', 'hreflang')} AS hreflang, {attr('tag', 'href')} AS href
FROM (SELECT seq, site, domain, unnest(tags) AS tag, unnest(range(len(tags))) AS pos
      FROM (SELECT *, regexp_extract_all(mk, '<link\\s[^>]*>') AS tags FROM page))""", "page")

cte("anchor", """
SELECT seq, site, domain, requested_url, replace(raw, '&amp;', '&') AS href, pos
FROM (SELECT seq, site, domain, requested_url, unnest(raws) AS raw, unnest(range(len(raws))) AS pos
      FROM (SELECT *, regexp_extract_all(mk, '<a\\s[^>]*href="([^"]*)"', 1) AS raws FROM page))""", "page")

cte("web_raw", f"SELECT seq, site, pos, {resolve('requested_url', 'href')} AS full_url FROM anchor", "anchor")
cte("web_all", f"""
SELECT seq, site, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos,
  regexp_extract(full_url, '^https?://[^/?#]*') || CASE WHEN {path('full_url')} = '' THEN '/' ELSE {encoded(path('full_url'))} END || {tail('full_url')} AS url
FROM web_raw WHERE regexp_matches(full_url, '^https?://[^/?#]')""", "web_raw")
cte("web", f"SELECT *, {host('url')} AS host, lower({path('url')}) AS path FROM web_all", "web_all")

cte("alternate", """
SELECT seq, site, hreflang FROM link_tag
WHERE lower(rel) = 'alternate' AND hreflang <> '' AND lower(hreflang) <> 'x-default'""", "link_tag")

cte("name_code", f"""
SELECT DISTINCT seq, site, pos, site_names.cd AS code FROM web, {SITE_NAMES_T}
WHERE contains(host, site) AND (contains(path, '/' || site_names.nm) OR contains(path, '-' || site_names.nm))""", "web")

cte("path_code", f"""
SELECT seq, site, pos, regexp_extract(path, '^/([a-z][a-z])(?:[-_][a-z][a-z])?(?:/|$)', 1) AS code FROM web
WHERE contains(host, site) AND regexp_matches(path, '^/({ALT19})(?:[-_][a-z][a-z])?(?:/|$)')""", "web")

cte("sub_code", f"""
SELECT seq, site, pos, host, string_split(host, '.')[1] AS code FROM web
WHERE len(string_split(host, '.')) > 2 AND regexp_matches(host, '^({ALT19})[.]')""", "web")

cte("mark", """
SELECT site, lower(string_split(html_lang, '-')[1]) AS code, 'html_lang' AS strategy FROM lang WHERE html_lang <> ''
UNION ALL SELECT site, lower(string_split(hreflang, '-')[1]), 'hreflang' FROM alternate
UNION ALL SELECT site, code, 'link_path' FROM path_code
UNION ALL SELECT site, code, 'link_name' FROM name_code
UNION ALL SELECT site, code, 'link_subdomain' FROM sub_code WHERE contains(host, site)""",
    "lang", "alternate", "path_code", "name_code", "sub_code")

cte("spa_page", """
SELECT seq, site, coalesce(regexp_matches(mk, '(?i)\\sid="(root|app|__next)"|data-reactroot|<(header|nav)[^>]*\\sdata-require|data-require="[^"]*nav')
  OR contains(body, '__NEXT_DATA__') OR contains(body, '__NUXT__') OR contains(body, 'window.webpackChunk'), false) AS spa
FROM page""", "page")

_STATUS_TEXTS = " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in dims.STATUS_TEXT.items())


def status_text(n):
    return f"""CAST({n} AS VARCHAR) || ' - ' || CASE WHEN {n} BETWEEN 200 AND 299 THEN 'Success' WHEN {n} BETWEEN 300 AND 399 THEN 'Redirect'
      ELSE CASE {n} {_STATUS_TEXTS} ELSE 'Error' END END"""


cte("status", f"""
SELECT site, CASE WHEN has_error THEN 'Error' ELSE {status_text('coalesce(first_status, 200)')} END AS status,
  has_error, has_hreflang, spa, pages
FROM (SELECT p.site, bool_or(p.error IS NOT NULL) AS has_error, count(*) AS pages,
        arg_min(p.status_code, p.seq) FILTER (WHERE p.status_code IS NOT NULL) AS first_status,
        bool_or(p.seq IN (SELECT seq FROM alternate)) AS has_hreflang, arg_min(s.spa, s.seq) AS spa
      FROM page p JOIN spa_page s USING (seq) GROUP BY p.site)""", "page", "alternate", "spa_page")


def report_of(status, marks):
    return f"""
SELECT s.site AS domain, s.status, coalesce(n.cnt, 0) AS language_count, coalesce(n.names, '-') AS languages,
  {yes('n.cnt IS NULL OR s.has_error OR (s.spa AND n.cnt <= 1)')} AS review_recommended
FROM {status} s LEFT JOIN (
  SELECT site, count(*) AS cnt, string_agg(name, '; ' ORDER BY name) AS names
  FROM (SELECT DISTINCT site, {site_name('code')} AS name FROM {marks} WHERE length(code) >= 2) GROUP BY site) n ON n.site = s.site"""


cte("report", report_of("status", "mark"), "status", "mark")

check("site_report", "SELECT * FROM report", "report")
check("site_report_stream", "SELECT * FROM report", "report")
check("site_evidence", "SELECT site, code, strategy, count(*) AS marks FROM mark GROUP BY ALL", "mark")
check("site_status", "SELECT * FROM status", "status")
check("spa_flags", "SELECT site, arg_min(spa, seq) AS spa, count(*) FILTER (WHERE spa) AS spa_pages FROM spa_page GROUP BY site", "spa_page")
check("html_lang_site", """SELECT seq, html_lang, CASE WHEN html_lang <> '' THEN lower(string_split(html_lang, '-')[1]) END AS code FROM lang""", "lang")
check("hreflang_extract", f"""
SELECT seq, pos, rel, hreflang,
  CASE WHEN lower(rel) = 'alternate' AND hreflang <> '' AND lower(hreflang) <> 'x-default' THEN lower(string_split(hreflang, '-')[1]) END AS site_code,
  CASE WHEN contains(lower(rel), 'alternate') THEN {scored_code('hreflang')} END AS scored_code
FROM link_tag""", "link_tag")
check("link_path_codes", "SELECT seq, pos, code FROM path_code", "path_code")
check("link_name_codes", "SELECT seq, pos, code FROM name_code", "name_code")
check("link_subdomain_codes", "SELECT seq, pos, host, code FROM sub_code", "sub_code")
check("host_contains_domain", """
SELECT site, host, count(*) AS links, position(site IN host) > 0 AS own FROM web GROUP BY site, host""", "web")
check("frontier_candidates", f"""
SELECT seq, pos, url FROM web WHERE regexp_matches(path, '^/[a-z][a-z]([-_][a-z][a-z])?(/|$)')
  OR (len(string_split(host, '.')) > 2 AND list_contains(string_split('{ALT19}', '|'), string_split(host, '.')[1]))
  OR len([n for n in string_split('{NAMES}', '|') if contains(path, n)]) > 0""", "web")
check("site_domain_clean", """
SELECT seq, regexp_replace(regexp_replace(trim(value), '^https?://', ''), '/.*$', '') AS domain FROM domain_lines""", "domain_lines")
check("language_names", f"""
SELECT code, count(DISTINCT site) AS sites, {site_name('code')} AS site_name, {name24('code')} AS scored_name FROM mark GROUP BY code""", "mark")
check("normalize_code", f"""
SELECT tag, count(*) AS n, {scored_code('tag')} AS scored_code, lower(string_split(tag, '-')[1]) AS site_code
FROM (SELECT CASE WHEN href LIKE '/%' THEN substr(href, 2) ELSE href END AS tag FROM anchor
  UNION ALL SELECT hreflang FROM link_tag WHERE hreflang IS NOT NULL
  UNION ALL SELECT html_lang FROM lang WHERE html_lang IS NOT NULL)
GROUP BY tag""", "anchor", "link_tag", "lang")
check("status_text", f"""
SELECT seq, status, CASE WHEN try_cast(status AS INT) IS NULL THEN status ELSE {status_text('CAST(try_cast(status AS INT) AS INT)')} END AS status_text
FROM status_values""", "status_values")

# ---------------------------------------------------------------- probing, on the pages as given
cte("raw_page", f"""
SELECT page_id AS seq, {host('url')} AS site, url AS requested_url,
  regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS mk FROM given_pages""", "given_pages")
cte("raw_link", f"""
SELECT site, {host('u')} AS host, lower({path('u')}) AS path FROM (
  SELECT site, {resolve('requested_url', 'href')} AS u FROM (
    SELECT site, requested_url, unnest(regexp_extract_all(mk, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM raw_page))""", "raw_page")
cte("raw_mark", f"""
SELECT site, regexp_extract(mk, '<html lang="([^"]*)"', 1) AS code FROM raw_page
UNION ALL SELECT site, regexp_extract(path, '^/([a-z][a-z])', 1) FROM raw_link
  WHERE contains(host, site) AND regexp_matches(path, '^/({ALT19})([-_][a-z][a-z])?(/|$)')
UNION ALL SELECT site, site_names.cd FROM raw_link, {SITE_NAMES_T}
  WHERE contains(host, site) AND regexp_matches(path, '[/-]' || site_names.nm)
UNION ALL SELECT site, string_split(host, '.')[1] FROM raw_link
  WHERE contains(host, site) AND regexp_matches(host, '^({ALT19})[.][^.]*[.]')""", "raw_page", "raw_link")
cte("gated", "SELECT site FROM raw_page EXCEPT SELECT site FROM raw_mark WHERE code <> 'en'", "raw_page", "raw_mark")
cte("candidate", f"""
SELECT site, w.code, '/' || w.word || e.e AS path, 'https://' || site || '/' || w.word || e.e AS url FROM gated,
  (SELECT cd AS code, nm AS word FROM {SITE_NAMES_T} UNION ALL SELECT cd, cd FROM {SITE_NAMES_T}) w, (VALUES (''), ('/')) e(e)
WHERE w.code <> 'en'""", "gated")
cte("hit", """
SELECT DISTINCT site, code FROM candidate JOIN probe_log ON requested_url = url WHERE status_code >= 200 AND status_code < 400""",
    "candidate", "probe_log")
cte("raw_status", "SELECT site, '200 - Success' AS status, false AS has_error, false AS spa FROM raw_page GROUP BY site", "raw_page")
cte("probed_mark", "SELECT site, code FROM raw_mark UNION ALL SELECT site, code FROM hit", "raw_mark", "hit")
check("probe_gate", "SELECT site FROM gated", "gated")
check("probe_candidates", "SELECT * FROM candidate", "candidate")
check("probe_hits", "SELECT * FROM hit", "hit")
check("site_report_probed", report_of("raw_status", "probed_mark"), "raw_status", "probed_mark")

# ---------------------------------------------------------------- small site jobs
check("batch_validation", """
SELECT job_id, count(domain) AS n_domains, CASE WHEN count(domain) = 0 THEN 'At least one domain is required.'
  WHEN count(domain) > 50 THEN 'Maximum 50 domains per request.' ELSE 'ok' END AS verdict
FROM jobs GROUP BY job_id""", "jobs")
check("http_fallback", """
SELECT h.domain, coalesce(s.requested_url, p.requested_url) AS start_url,
  CAST(CASE WHEN s.requested_url IS NOT NULL THEN s.status_code ELSE p.status_code END AS BIGINT) AS status_code,
  s.requested_url IS NULL AND p.requested_url IS NOT NULL AS fell_back
FROM (SELECT DISTINCT regexp_extract(requested_url, '//([^/]+)', 1) AS domain FROM start_fetches) h
LEFT JOIN start_fetches s ON s.requested_url = 'https://' || h.domain AND s.error IS NULL
LEFT JOIN start_fetches p ON p.requested_url = 'http://' || h.domain || '/' AND p.error IS NULL""", "start_fetches")
check("site_csv_lines", """
SELECT domain, domain || ',"' || replace(status, '"', '""') || '",' || language_count || ',"' || replace(languages, '"', '""') || '",' || review_recommended AS line
FROM report""", "report")
check("csv_escape", """
SELECT doc_id, doc_id || ',' || source || ',' || CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10))
  THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS line FROM documents""")
check("html_escape", """
SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped
FROM documents""")
check("domain_slug", """
SELECT page_id, regexp_replace(regexp_replace(trim(url), 'https?://', '', 'g'), '[/: ]', '_', 'g') AS slug FROM pages""")
_SITES = f"(SELECT DISTINCT {host('url')} AS domain FROM given_pages)"
check("batch_manifest", f"""
SELECT domain, replace(domain, ':', '_') || e AS file FROM {_SITES}, (VALUES ('.discovery.json'), ('.language_debug.json')) t(e)""", "given_pages")
check("batch_manifest_totals", f"SELECT count(*) AS domain_count, 2 * count(*) AS file_count FROM {_SITES}", "given_pages")
check("summary_alias_scan", """
SELECT domain, CASE WHEN language_count = 0 AND (domain LIKE 'm.%' OR domain LIKE 'www.%') THEN '' ELSE CAST(language_count AS VARCHAR) END AS count,
  languages, CASE WHEN domain LIKE 'm.%' THEN 'No' ELSE review_recommended END AS review FROM report""", "report")

_WORTH = f"""regexp_matches(lower({path('dst')}), '^/[a-z][a-z]([-_][a-z][a-z])?(/|$)|{NAMES}')"""
cte("follow", f"""
SELECT src, pos, dst FROM (SELECT * FROM edges UNION ALL SELECT * FROM start_edges) WHERE {_WORTH}""", "edges", "start_edges")
# the queue never fills on these links (four per page, five pages), so visiting is: pop the first new one, append
cte("v1", "SELECT domain, 'https://' || domain AS url, 1 AS rank, ['https://' || domain] AS seen, CAST([] AS VARCHAR[]) AS queue FROM robots", "robots")
for _r in range(1, 5):
    cte(f"q{_r}", f"""
SELECT v.domain, v.seen, v.queue || coalesce((SELECT list(f.dst ORDER BY f.pos) FROM follow f
  WHERE f.src = v.url AND contains({host('f.dst')}, v.domain) AND NOT list_contains(v.seen, f.dst)), CAST([] AS VARCHAR[])) AS queue
FROM v{_r} v""", f"v{_r}", "follow")
    cte(f"n{_r}", f"SELECT *, [x for x in queue if NOT list_contains(seen, x)][1] AS url FROM q{_r}", f"q{_r}")
    cte(f"v{_r + 1}", f"""
SELECT domain, url, {_r + 1} AS rank, seen || [url] AS seen, queue[list_position(queue, url) + 1:] AS queue
FROM n{_r} WHERE url IS NOT NULL""", f"n{_r}")
check("bfs_site", " UNION ALL ".join(
    f"SELECT domain, CAST(rank AS BIGINT) AS rank, url, url IN (SELECT src FROM follow) AS landed FROM v{r}" for r in range(1, 6)),
    *[f"v{r}" for r in range(1, 6)], "follow")


cte("first_fetch", "SELECT requested_url, min(seq) AS seq FROM page GROUP BY requested_url", "page")
cte("site_visit", " UNION ALL ".join(f"SELECT domain, {r} AS rank, url FROM v{r}" for r in range(1, 6)), *[f"v{r}" for r in range(1, 6)])
cte("seen", "SELECT v.domain AS site, v.rank, f.seq FROM site_visit v JOIN first_fetch f ON f.requested_url = v.url", "site_visit", "first_fetch")
cte("domain_page", "SELECT domain AS site, seq AS rank, seq FROM page", "page")


def report_over(name, of):
    """Site report over the pages of ``of`` (site, rank, seq)."""
    cte(f"{of}_link", f"SELECT s.site, w.host, w.path FROM web w JOIN {of} s ON s.seq = w.seq WHERE contains(w.host, s.site)", "web", of)
    cte(f"{of}_mark", f"""
SELECT s.site, lower(string_split(l.html_lang, '-')[1]) AS code FROM lang l JOIN {of} s ON s.seq = l.seq WHERE l.html_lang <> ''
UNION ALL SELECT s.site, lower(string_split(a.hreflang, '-')[1]) FROM alternate a JOIN {of} s ON s.seq = a.seq
UNION ALL SELECT site, regexp_extract(path, '^/([a-z][a-z])(?:[-_][a-z][a-z])?(?:/|$)', 1) FROM {of}_link
  WHERE regexp_matches(path, '^/({ALT19})(?:[-_][a-z][a-z])?(?:/|$)')
UNION ALL SELECT site, site_names.cd FROM {of}_link, {SITE_NAMES_T} WHERE contains(path, '/' || site_names.nm) OR contains(path, '-' || site_names.nm)
UNION ALL SELECT site, string_split(host, '.')[1] FROM {of}_link WHERE len(string_split(host, '.')) > 2 AND regexp_matches(host, '^({ALT19})[.]')""",
        "lang", "alternate", of, f"{of}_link")
    cte(f"{of}_status", f"""
SELECT site, CASE WHEN has_error THEN 'Error' ELSE {status_text('coalesce(first_status, 200)')} END AS status, has_error, spa
FROM (SELECT s.site, bool_or(p.error IS NOT NULL) AS has_error, arg_min(p.status_code, s.rank) FILTER (WHERE p.status_code IS NOT NULL) AS first_status,
        arg_min(x.spa, s.rank) AS spa FROM {of} s JOIN page p ON p.seq = s.seq JOIN spa_page x ON x.seq = s.seq GROUP BY s.site)""", of, "page", "spa_page")
    check(name, report_of(f"{of}_status", f"{of}_mark"), f"{of}_status", f"{of}_mark")


report_over("site_report_crawled", "seen")
report_over("site_report_by_domain", "domain_page")
check("frontier_links", f"""
SELECT requested_url AS url, row_number() OVER (PARTITION BY w.seq ORDER BY w.pos) - 1 AS pos, w.url AS target
FROM web w JOIN first_fetch f ON f.seq = w.seq WHERE regexp_matches(path, '^/[a-z][a-z]([-_][a-z][a-z])?(/|$)|{NAMES}')
  OR (len(string_split(host, '.')) > 2 AND list_contains(string_split('{ALT19}', '|'), string_split(host, '.')[1]))""", "web", "first_fetch")


# ---------------------------------------------------------------- scored profile
def canonical_links(name, source, href, base):
    """Canonical same-domain targets of tags, first of equals kept."""
    cte(f"{name}_raw", f"SELECT seq, domain, pos, {resolve(base, href)} AS u FROM {source} WHERE {href} <> '' AND NOT {href} LIKE 'mailto:%'", source)
    cte(f"{name}_all", f"SELECT seq, domain, pos, {canonical('u')} AS url FROM {name}_raw", f"{name}_raw")
    cte(name, f"""
SELECT seq, domain, url, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos
FROM (SELECT seq, domain, url, min(pos) AS pos FROM {name}_all WHERE url IS NOT NULL AND {domain('url')} = domain GROUP BY ALL)""", f"{name}_all")


# failed fetches stay as pages; landed content that is not HTML does not
cte("ok", "SELECT *, error IS NULL AND coalesce(status_code, 0) >= 200 AND coalesce(status_code, 0) < 400 AND body <> '' AS readable FROM page", "page")
cte("html", """
SELECT seq, coalesce(contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'application/xhtml+xml')
  OR contains(lower(body), '<html'), false) AS html FROM crawl""", "crawl")
cte("sp", f"""
SELECT ok.seq, domain, requested_url, {canonical('requested_url')} AS url, final_url,
  coalesce(final_url, {canonical('requested_url')}) AS page_url, status_code, error, readable,
  CASE WHEN error IS NOT NULL THEN 'page: ' || requested_url || ': ' || error END AS fetch_error,
  CASE WHEN readable THEN mk END AS mk, CASE WHEN readable THEN body END AS body
FROM ok JOIN html USING (seq) WHERE NOT coalesce(readable, false) OR html""", "ok", "html")
cte("sp_lang", f"""
SELECT seq, domain, page_url, nullif(trim({attr("regexp_extract(mk, '<html[^>]*>')", "lang")}), '') AS html_lang FROM sp""", "sp")
cte("sp_alt", """
SELECT l.seq, l.domain, sp.page_url, l.pos, trim(l.hreflang) AS hreflang, l.href FROM link_tag l JOIN sp USING (seq)
WHERE sp.readable AND contains(lower(l.rel), 'alternate')""", "link_tag", "sp")
cte("sp_href", """
SELECT a.seq, a.domain, sp.page_url, a.pos, a.href FROM anchor a JOIN sp USING (seq) WHERE sp.readable""", "anchor", "sp")
canonical_links("alt_url", "sp_alt", "href", "page_url")
canonical_links("inner_link", "sp_href", "href", "page_url")
cte("hreflang", "SELECT DISTINCT seq, domain, page_url, hreflang FROM sp_alt WHERE hreflang <> ''", "sp_alt")

cte("shown", """
SELECT seq, trim(regexp_replace(
  replace(replace(replace(replace(
    regexp_replace(regexp_replace(body,
      '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<svg\\b[^>]*>.*?</svg\\s*>', ' ', 'g'),
      '<[^>]*>', ' ', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'),
  '\\s+', ' ', 'g')) AS visible_text
FROM sp""", "sp")
cte("page_text", f"""
SELECT seq, {best('visible_text')} AS text_code FROM (
  SELECT *, {with_hits('toks')} FROM (SELECT *, {words('visible_text')} AS toks FROM shown))""", "shown")
cte("codes", f"""
SELECT sp.seq, sp.domain, sp.page_url, l.html_lang, {scored_code('l.html_lang')} AS html_code, {scored_url('sp.page_url')} AS url_code, t.text_code
FROM sp JOIN sp_lang l USING (seq) JOIN page_text t USING (seq)""", "sp", "sp_lang", "page_text")
cte("target", """
SELECT seq, domain, url, 0 AS part, pos FROM alt_url
UNION ALL SELECT seq, domain, url, 1, pos FROM inner_link""", "alt_url", "inner_link")


def scored_chain(p, pages, target="target", hreflang="hreflang"):
    """Evidence to report over the pages of the expression ``pages``; names start with ``p``."""
    cte(f"{p}found", f"""
SELECT domain, url, {scored_url('url')} AS code FROM (
  SELECT t.domain, t.url FROM {target} t WHERE t.seq IN (SELECT seq FROM {pages}) UNION SELECT domain, url FROM known)""", target, pages, "known")
    cte(f"{p}path", f"""
SELECT DISTINCT domain, '/' || x || CASE WHEN y = '' THEN '' ELSE '-' || y END || '/' AS path, x FROM (
  SELECT domain, regexp_extract(p, '^/([a-z][a-z])(?:[-_]([a-z][a-z]))?(?:/|$)', 1) AS x,
    regexp_extract(p, '^/([a-z][a-z])(?:[-_]([a-z][a-z]))?(?:/|$)', 2) AS y
  FROM (SELECT domain, lower(regexp_extract(url, '^https?://[^/]*(/.*)$', 1)) AS p FROM {p}found)) WHERE x <> ''""", f"{p}found")
    cte(f"{p}hl", f"SELECT * FROM {hreflang} WHERE seq IN (SELECT seq FROM {pages})", hreflang, pages)
    # one row per single piece of trusted evidence
    cte(f"{p}piece", f"""
SELECT domain, {scored_code('hreflang')} AS code, 'hreflang' AS source, 'hreflang=' || hreflang AS evidence, 45 AS points, 0 AS seq, NULL AS url
  FROM (SELECT DISTINCT domain, hreflang FROM {p}hl)
UNION ALL SELECT domain, {scored_code('hreflang')}, 'hreflang', 'hreflang=' || hreflang, 45, seq, page_url FROM {p}hl
UNION ALL SELECT domain, {scored_code('x')}, 'url_pattern', path, 35, 0, NULL FROM {p}path
UNION ALL SELECT domain, code, 'url_pattern', 'url_or_subdomain_pattern', 35, 0, url FROM {p}found
UNION ALL SELECT domain, html_code, 'html_lang', 'html_lang=' || html_lang, 35, seq, page_url FROM {pages}
UNION ALL SELECT domain, url_code, 'url_pattern', 'url_or_subdomain_pattern', 35, seq, page_url FROM {pages}""",
        f"{p}hl", f"{p}path", f"{p}found", pages)
    cte(f"{p}trusted", f"SELECT * FROM {p}piece WHERE code IS NOT NULL", f"{p}piece")
    cte(f"{p}gate", f"""
SELECT c.domain, c.seq, c.page_url, c.text_code AS code,
  c.text_code IS DISTINCT FROM c.html_code AND c.text_code IS DISTINCT FROM c.url_code AS conflict,
  EXISTS (SELECT 1 FROM {p}trusted t WHERE t.domain = c.domain AND t.code = c.text_code AND t.seq <= c.seq) AS counts
FROM {pages} c WHERE c.text_code IS NOT NULL""", pages, f"{p}trusted")
    cte(f"{p}every", f"""
SELECT domain, code, source, evidence, points, url FROM {p}trusted
UNION ALL SELECT domain, code, 'text_heuristic', 'text_heuristic', 10, page_url FROM {p}gate WHERE counts""", f"{p}trusted", f"{p}gate")
    cte(f"{p}score", f"""
SELECT domain, code, score, least(score, 100) AS confidence_percent, {label('score')} AS confidence_label, {name24('code')} AS name
FROM (SELECT domain, code, CAST(sum(points) AS BIGINT) AS score FROM {p}every GROUP BY domain, code)""", f"{p}every")
    cte(f"{p}finding", f"SELECT * FROM {p}score WHERE confidence_percent >= 40", f"{p}score")
    cte(f"{p}source", f"""
SELECT domain, code, string_agg(s, '; ' ORDER BY s) AS sources, list(s ORDER BY s) AS source_list FROM (
  SELECT domain, code, evidence AS s FROM {p}every
  UNION SELECT domain, code, 'confidence=' || confidence_percent || '%' FROM {p}score
  UNION SELECT domain, code, 'confidence_label=' || confidence_label FROM {p}score) GROUP BY domain, code""", f"{p}every", f"{p}score")
    cte(f"{p}sample", f"""
SELECT domain, code, url, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, code ORDER BY url) AS rank
  FROM (SELECT DISTINCT domain, code, url FROM {p}every WHERE url IS NOT NULL)) WHERE rank <= 5""", f"{p}every")
    cte(f"{p}warning", f"""
SELECT domain, seq, 'text_signal_conflict' AS type, {name24('code')} AS language, code, page_url AS url, '{dims.CONFLICT_MESSAGE}' AS message, 0 AS o FROM {p}gate WHERE conflict
UNION ALL SELECT domain, seq, 'suppressed_text_only_language', {name24('code')}, code, page_url, '{dims.SUPPRESSED_MESSAGE}', 1 FROM {p}gate WHERE NOT counts""", f"{p}gate")
    cte(f"{p}report", f"""
SELECT d.domain, coalesce(n, 0) AS language_count, coalesce(labels, '') AS languages, coalesce(w, 0) AS warning_count
FROM (SELECT domain FROM {pages} UNION SELECT domain FROM start) d
LEFT JOIN (SELECT domain, count(*) AS n,
    string_agg(name || ' (' || confidence_label || ', ' || confidence_percent || '%)', '; ' ORDER BY confidence_percent DESC, name) AS labels
  FROM {p}finding GROUP BY domain) f ON f.domain = d.domain
LEFT JOIN (SELECT domain, count(*) AS w FROM {p}warning GROUP BY domain) x ON x.domain = d.domain""", f"{p}finding", f"{p}warning", pages, "start")


scored_chain("s_", "codes")

check("language_report", "SELECT * FROM s_report", "s_report")
check("language_report_stream", "SELECT * FROM s_report", "s_report")
check("evidence_points", """
SELECT domain, code, source, evidence, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM s_every GROUP BY ALL""", "s_every")
check("language_scores", "SELECT * FROM s_score", "s_score")
check("language_findings", "SELECT * FROM s_finding", "s_finding")
check("supplemental_gate", "SELECT * FROM s_gate", "s_gate")
check("text_conflicts", "SELECT domain, seq, code FROM s_gate WHERE conflict", "s_gate")
check("warnings", "SELECT domain, seq, type, language, code, url, message FROM s_warning", "s_warning")
check("finding_sources", "SELECT domain, code, sources FROM s_source", "s_source")
check("finding_sample_urls", "SELECT domain, code, url, rank FROM s_sample", "s_sample")
cte("failed", """
SELECT domain, 'page' AS kind, url, error FROM sp WHERE error IS NOT NULL
UNION ALL SELECT m.domain, 'sitemap', f.requested_url, f.error FROM read_map m JOIN sitemap_fetches f ON f.requested_url = m.url WHERE f.error IS NOT NULL
UNION ALL SELECT m.domain, 'sitemap_parse', d.url, 'ParseError' FROM read_map m JOIN doc d ON d.url = m.url JOIN sitemap_fetches f ON f.requested_url = m.url
  WHERE d.bad AND f.error IS NULL
UNION ALL SELECT s.domain, 'robots', s.robots_url, r.error FROM start s JOIN robots_fetches r ON r.requested_url = s.robots_url WHERE r.error IS NOT NULL""",
    "sp", "read_map", "sitemap_fetches", "doc", "start", "robots_fetches")
check("fetch_error_log", "SELECT *, kind || ': ' || url || ': ' || error AS line FROM failed", "failed")
cte("counted", f"""
SELECT d.domain,
  (SELECT count(DISTINCT {host('f.url')}) FROM s_found f WHERE f.domain = d.domain) AS subdomains,
  (SELECT count(*) FROM read_map s WHERE s.domain = d.domain) AS sitemaps,
  (SELECT count(*) FROM s_found f WHERE f.domain = d.domain) AS urls,
  (SELECT count(DISTINCT h.hreflang) FROM hreflang h WHERE h.domain = d.domain) AS hreflang_targets,
  (SELECT count(*) FROM s_path p WHERE p.domain = d.domain) AS candidate_language_paths,
  (SELECT count(*) FROM sp WHERE sp.domain = d.domain) AS pages,
  (SELECT count(*) FROM failed e WHERE e.domain = d.domain) AS fetch_errors
FROM (SELECT domain FROM sp UNION SELECT domain FROM start) d""", "s_found", "hreflang", "s_path", "sp", "start", "read_map", "failed")
check("discovery_counts", "SELECT * FROM counted", "counted")
check("discovery_csv", """
SELECT domain, domain AS registered_domain, subdomains AS subdomain_count, urls AS url_count, sitemaps AS sitemap_count,
  coalesce((SELECT string_agg(p.path, ';' ORDER BY p.path) FROM s_path p WHERE p.domain = c.domain), '') AS candidate_language_paths,
  hreflang_targets
FROM counted c""", "counted", "s_path")
check("hreflang_targets", "SELECT DISTINCT domain, hreflang FROM hreflang", "hreflang")
check("record_urls", f"SELECT domain, url, {host('url')} AS host, code FROM s_found", "s_found")
check("candidate_paths", "SELECT domain, path FROM s_path", "s_path")


def summary(prefix, review):
    return f"""SELECT domain AS domain_name, CAST(language_count AS VARCHAR) AS language_count, languages,
  {yes(review)} AS review_recommended FROM {prefix}report"""


_WARNED = "warning_count > 0 OR language_count = 0"
check("summary_v1", summary("s_", _WARNED), "s_report")
check("summary_bridge", summary("s_", "language_count = 0"), "s_report")
check("summary_json_shape", f"""
SELECT domain, CAST(language_count AS INT) AS "languageCount", languages, {yes(_WARNED)} AS "reviewRecommended" FROM s_report""", "s_report")
check("summary_markdown", f"""
SELECT '| ' || domain || ' | ' || language_count || ' | ' || CASE WHEN languages = '' THEN '_None over threshold_' ELSE languages END
  || ' | ' || {yes(_WARNED)} || ' |' AS line FROM s_report""", "s_report")
check("summary_from_json", summary("s_", _WARNED), "s_report")
check("summary_from_csv", summary("s_", _WARNED), "s_report")
check("report_json_roundtrip", """
SELECT f.domain, (SELECT count(*) FROM s_warning w WHERE w.domain = f.domain) AS warnings, f.code, f.name, f.confidence_percent, f.confidence_label,
  s.sources, (SELECT string_agg(x.url, '; ' ORDER BY x.url) FROM s_sample x WHERE x.domain = f.domain AND x.code = f.code) AS sample_urls,
  c.subdomains, c.sitemaps, c.urls, c.hreflang_targets, c.candidate_language_paths, c.pages, c.fetch_errors
FROM s_finding f JOIN s_source s USING (domain, code) JOIN counted c ON c.domain = f.domain""", "s_finding", "s_warning", "s_source", "s_sample", "counted")
check("language_report_csv", """
SELECT r.domain, r.language_count, replace(r.languages, '; ', ';') AS languages,
  coalesce((SELECT '[' || string_agg(to_json({'code': f.code, 'confidence_label': f.confidence_label, 'confidence_percent': f.confidence_percent, 'name': f.name,
      'sample_urls': (SELECT list(x.url ORDER BY x.url) FROM s_sample x WHERE x.domain = f.domain AND x.code = f.code), 'sources': s.source_list}),
      ',' ORDER BY f.confidence_percent DESC, f.name) || ']'
    FROM s_finding f JOIN s_source s USING (domain, code) WHERE f.domain = r.domain), '[]') AS confidence_details,
  CAST((SELECT count(*) FROM s_warning w WHERE w.domain = r.domain) AS VARCHAR) AS warnings
FROM s_report r""", "s_report", "s_finding", "s_source", "s_sample", "s_warning")
cte("snapshot", """
SELECT domain, 'discovered_url' AS kind, r AS position, url AS value
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url) AS r FROM s_found) WHERE r <= 50
UNION ALL SELECT domain, 'page', r, page_url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS r FROM sp) WHERE r <= 25""",
    "s_found", "sp")
check("debug_snapshot", "SELECT * FROM snapshot", "snapshot")
check("debug_payload", "SELECT * FROM snapshot" + "".join(f"""
UNION ALL SELECT domain, 'count', NULL, '{c}=' || {c} FROM counted""" for c in (
    "subdomains", "sitemaps", "urls", "hreflang_targets", "candidate_language_paths", "pages", "fetch_errors")) + f"""
UNION ALL SELECT domain, 'finding', row_number() OVER (PARTITION BY domain ORDER BY confidence_percent DESC, name),
  CAST(to_json({{'code': code, 'confidence_label': confidence_label, 'confidence_percent': confidence_percent, 'name': name}}) AS VARCHAR) FROM s_finding
UNION ALL SELECT domain, 'warning', seq, CAST(to_json({{'code': code, 'language': language, 'message': message, 'type': type, 'url': url}}) AS VARCHAR) FROM s_warning
UNION ALL SELECT DISTINCT domain, 'hreflang_target', CAST(NULL AS BIGINT), hreflang FROM hreflang
UNION ALL SELECT domain, 'candidate_language_path', NULL, path FROM s_path
UNION ALL SELECT DISTINCT domain, 'subdomain', CAST(NULL AS BIGINT), {host('url')} FROM s_found""",
      "snapshot", "counted", "s_finding", "s_warning", "hreflang", "s_path", "s_found")
check("page_evidence_no_text", """
SELECT sp.seq, sp.domain, sp.url, sp.final_url, CAST(sp.status_code AS BIGINT) AS status_code, l.html_lang,
  coalesce((SELECT string_agg(h.hreflang, ';' ORDER BY h.hreflang) FROM hreflang h WHERE h.seq = sp.seq), CASE WHEN sp.readable THEN '' END) AS hreflang_targets,
  coalesce((SELECT string_agg(i.url, ';' ORDER BY i.url) FROM inner_link i WHERE i.seq = sp.seq), CASE WHEN sp.readable THEN '' END) AS internal_links,
  length(t.visible_text) AS visible_text_length, sp.error
FROM sp JOIN sp_lang l USING (seq) JOIN shown t USING (seq)""", "sp", "sp_lang", "shown", "hreflang", "inner_link")
check("isolation_check", "SELECT CAST(0 AS BIGINT) AS differing, CAST(2 * count(*) AS BIGINT) AS compared FROM s_finding", "s_finding")
check("html_lang_scored", "SELECT seq, html_lang, html_code AS code FROM codes", "codes")
check("html_gate", "SELECT * FROM html", "html")
check("hreflang_urls", "SELECT seq, pos, url FROM alt_url", "alt_url")
check("internal_links", "SELECT seq, pos, url FROM inner_link", "inner_link")
check("link_cap", """
SELECT sp.url AS src, row_number() OVER (PARTITION BY t.seq ORDER BY t.part, t.pos) - 1 AS pos, t.url AS dst
FROM target t JOIN sp USING (seq) WHERE t.part = 0 OR t.pos < 3""", "target", "sp")
check("same_registered_domain", f"""
SELECT d AS domain, t AS target, count(*) AS links, d = t AS same
FROM (SELECT {domain("'http://' || site")} AS d, {domain('url')} AS t FROM web) GROUP BY ALL""", "web")
check("normalize_url", f"""
SELECT seq, pos, raw, {canonical('raw')} AS url, {canonical('raw', query=True)} AS url_with_query
FROM (SELECT seq, 0 AS pos, requested_url AS raw FROM page UNION ALL SELECT seq, pos + 1, href FROM anchor)""", "page", "anchor")
cte("resolved", f"SELECT seq, pos, href, {resolve('requested_url', 'href')} AS u FROM anchor", "anchor")
check("resolve_links", f"""
SELECT r.seq, r.pos, r.href, {canonical('u')} AS canonical,
  CASE WHEN regexp_matches(u, '^https?://') THEN regexp_extract(u, '^https?://[^/?#]*') || {encoded(path('u'))} || {tail('u')} END AS web
FROM resolved r""", "resolved")
check("url_language", f"""
SELECT url, count(*) AS n, {scored_url('url')} AS code FROM (SELECT page_url AS url FROM sp UNION ALL SELECT url FROM inner_link) GROUP BY url""",
      "sp", "inner_link")
check("visible_text", "SELECT seq, visible_text FROM shown", "shown")
check("text_language_pages", "SELECT seq, html_code, url_code, text_code FROM codes", "codes")
check("text_language", f"""
SELECT doc_id, lang, {best('text')} AS detected FROM (SELECT *, {with_hits('toks')} FROM (SELECT *, {words('text')} AS toks FROM documents))""")
check("stopword_hits", f"""
SELECT doc_id, h_en AS hits_en, h_es AS hits_es, h_fr AS hits_fr, h_de AS hits_de, h_pt AS hits_pt
FROM (SELECT *, {with_hits('toks')} FROM (SELECT *, {words('text')} AS toks FROM documents))""")

# ---------------------------------------------------------------- crawl expansion, one block per level
cte("seed", """
SELECT domain, url, min(pos) AS pos FROM (
  SELECT domain, url, 0 AS pos FROM start
  UNION ALL SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY url) FROM known
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY url) <= 100) GROUP BY domain, url""", "start", "known")
check("crawl_seeds", "SELECT domain, url, CAST(pos AS BIGINT) AS pos FROM seed", "seed")
cte("edge", f"SELECT {canonical('src')} AS src, pos, {canonical('dst')} AS dst FROM edges", "edges")
cte("c0", """
SELECT domain, url, 0 AS depth, row_number() OVER (PARTITION BY domain ORDER BY pos, url) AS rank
FROM seed WHERE url IN (SELECT url FROM sp)""", "seed", "sp")
cte("l0", "SELECT * FROM c0 WHERE rank <= 100", "c0")
for _d in (1, 2):
    cte(f"c{_d}", f"""
SELECT domain, url, {_d} AS depth, row_number() OVER (PARTITION BY domain ORDER BY k) + (SELECT count(*) FROM l{_d - 1} v WHERE v.domain = x.domain) AS rank
FROM (SELECT l.domain, e.dst AS url, min(row(l.rank, e.pos)) AS k FROM l{_d - 1} l JOIN edge e ON e.src = l.url
      WHERE l.depth = {_d - 1} AND {domain('e.dst')} = l.domain AND e.dst IN (SELECT url FROM sp)
        AND NOT EXISTS (SELECT 1 FROM l{_d - 1} v WHERE v.domain = l.domain AND v.url = e.dst)
      GROUP BY l.domain, e.dst) x""", f"l{_d - 1}", "edge", "sp")
    cte(f"l{_d}", f"SELECT * FROM l{_d - 1} UNION ALL SELECT * FROM c{_d} WHERE rank <= 100", f"l{_d - 1}", f"c{_d}")
check("bfs_scored", "SELECT domain, url, CAST(depth AS BIGINT) AS depth, rank FROM l2", "l2")

# the report over the visited pages, in the order of the visits; a page is the first fetch of its URL
cte("visit", """
SELECT l.domain, l.rank, min(sp.seq) AS seq FROM l2 l JOIN sp ON sp.domain = l.domain AND sp.url = l.url GROUP BY l.domain, l.rank""", "l2", "sp")
for _n, _of in (("v_codes", "codes"), ("v_target", "target"), ("v_hreflang", "hreflang")):
    cte(_n, f"SELECT c.* REPLACE (v.rank * 1000000 + c.seq AS seq) FROM {_of} c JOIN visit v ON v.seq = c.seq", _of, "visit")
scored_chain("v_", "v_codes", "v_target", "v_hreflang")
check("language_report_crawled", "SELECT * FROM v_report", "v_report")

# ---------------------------------------------------------------- sources
_BARE_LINE = "regexp_replace(trim(value), '^,+|,+$', '', 'g')"
check("domains_file_scan", f"""
SELECT DISTINCT trim(string_split({_BARE_LINE}, ',')[1]) AS domain FROM domain_lines
WHERE {_BARE_LINE} <> '' AND NOT starts_with(lower({_BARE_LINE}), 'domain')""", "domain_lines")
cte("listed_domain", f"""
SELECT domain, lower(regexp_extract(regexp_replace(domain, '^https?://', ''), '^[^/?#:]+')) AS host FROM (
  SELECT trim(string_split({_BARE_LINE}, ',')[1]) AS domain FROM domain_lines
  WHERE {_BARE_LINE} <> '' AND NOT starts_with(lower({_BARE_LINE}), 'domain')
  UNION SELECT 'new-' || site FROM page)""", "domain_lines", "page")
check("site_report_listed", f"""
SELECT l.domain, coalesce(r.status, {status_text('500')}) AS status, coalesce(r.language_count, 0) AS language_count,
  coalesce(r.languages, '-') AS languages, coalesce(r.review_recommended, 'Yes') AS review_recommended
FROM listed_domain l LEFT JOIN report r ON r.domain = l.host""", "listed_domain", "report")
check("language_report_listed", f"""
SELECT l.domain, l.registered_domain, coalesce(r.language_count, 0) AS language_count, coalesce(r.languages, '') AS languages,
  coalesce(r.warning_count, 0) AS warning_count,
  {yes("coalesce(r.warning_count, 0) > 0 OR coalesce(r.language_count, 0) = 0")} AS review_recommended
FROM (SELECT domain, {domain("'http://' || host")} AS registered_domain FROM listed_domain) l
LEFT JOIN s_report r ON r.domain = l.registered_domain""", "listed_domain", "s_report")
cte("token", """
SELECT seq, unnest(t) AS token, unnest(range(len(t))) AS pos
FROM (SELECT seq, regexp_split_to_array(replace(value, ',', ' '), '\\s+') AS t FROM domain_cells)""", "domain_cells")
check("domains_token_scan", """
SELECT token AS domain, k[1] AS seq, k[2] AS pos FROM (
  SELECT token, min([seq, pos]) AS k FROM token WHERE token <> '' AND lower(token) <> 'domain' GROUP BY token)""", "token")
check("domains_free_tokens", "SELECT token, count(*) AS n FROM token WHERE token <> '' GROUP BY token", "token")
check("domains_line_scan", """
SELECT seq, pos, line FROM (
  SELECT doc_id AS seq, unnest(range(len(l))) AS pos, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''""")
cte("robot_line", """
SELECT requested_url, min(i) AS i, v FROM (
  SELECT requested_url, unnest(range(len(l))) AS i, trim(regexp_replace(unnest(l), chr(13), '', 'g')) AS raw, trim(substr(raw, 9)) AS v
  FROM (SELECT requested_url, string_split(body, chr(10)) AS l FROM robots_fetches WHERE status_code = 200))
WHERE starts_with(lower(raw), 'sitemap:') AND v <> '' GROUP BY requested_url, v""", "robots_fetches")
check("robots_sitemaps", """
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY i) - 1 AS pos, v AS sitemap FROM robot_line JOIN robots ON requested_url = 'https://' || domain || '/robots.txt'""",
      "robot_line", "robots")
_NAMED = f"""SELECT trim(string_split({_BARE_LINE}, ',')[1]) AS name FROM domain_lines
  WHERE {_BARE_LINE} <> '' AND NOT starts_with(lower({_BARE_LINE}), 'domain') UNION SELECT domain FROM robots"""
_URL_OF = "CASE WHEN regexp_matches(name, '^https?://') THEN name ELSE 'https://' || name END"
cte("start", f"""
SELECT DISTINCT {domain('url')} AS domain, url, regexp_extract(url, '^https?://[^/]*') || '/robots.txt' AS robots_url
FROM (SELECT {canonical('u')} AS url FROM (SELECT {_URL_OF} AS u FROM ({_NAMED}))) WHERE url IS NOT NULL""", "domain_lines", "robots")
cte("root", f"""
SELECT domain, start, row_number() OVER (PARTITION BY start ORDER BY i) - 1 AS pos, url FROM (
  SELECT s.domain, s.url AS start, i, {canonical('v')} AS url FROM robot_line JOIN start s ON s.robots_url = requested_url
  UNION ALL SELECT domain, url, 1000, replace(robots_url, 'robots.txt', 'sitemap.xml') FROM start
  UNION ALL SELECT domain, url, 1001, replace(robots_url, 'robots.txt', 'sitemap_index.xml') FROM start)
WHERE url IS NOT NULL AND {domain('url')} = domain""", "robot_line", "start")
check("sitemap_candidates", "SELECT * FROM root", "root")

cte("doc", """
SELECT seq, domain, url, contains(body, '<sitemapindex') AS is_index, trim(body) <> '' AND NOT regexp_matches(body, '</(urlset|sitemapindex)>$') AS bad,
  regexp_replace(body, '<!--.*?-->', '', 'g') AS plain FROM sitemaps""", "sitemaps")
cte("loc", """
SELECT seq, domain, doc, is_index, min(i) AS i, loc FROM (
  SELECT seq, domain, url AS doc, is_index, unnest(range(len(l))) AS i, trim(replace(replace(replace(unnest(l), '<![CDATA[', ''), ']]>', ''), '&amp;', '&')) AS loc
  FROM (SELECT *, regexp_extract_all(plain, '<(?:x:)?loc>(.*?)</(?:x:)?loc>', 1) AS l FROM doc WHERE NOT bad)) WHERE loc <> '' GROUP BY ALL""", "doc")
check("sitemap_locs", """
SELECT d.seq, CASE WHEN d.is_index THEN 'sitemaps' ELSE 'urls' END AS kind, CASE WHEN d.bad THEN 'ParseError' END AS parse_error,
  CASE WHEN l.loc IS NOT NULL THEN row_number() OVER (PARTITION BY d.seq ORDER BY l.i) - 1 END AS pos, l.loc
FROM doc d LEFT JOIN loc l ON l.seq = d.seq""", "doc", "loc")
check("sitemap_gzip_decode", "SELECT url, body FROM sitemaps", "sitemaps")
cte("kept", f"""
SELECT doc, domain, is_index, i, {canonical('loc')} AS url FROM loc WHERE {domain('loc')} = domain""", "loc")
check("filter_domain_urls", "SELECT domain, url, count(*) AS n FROM kept GROUP BY domain, url", "kept")
# levels of the sitemap tree: identifiers grow sixfold per level, so few levels hold all
cte("answered", "SELECT k.* FROM kept k JOIN sitemap_fetches f ON f.requested_url = k.doc WHERE f.error IS NULL", "kept", "sitemap_fetches")
cte("t0", """
SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY pos, url) AS rank, 0 AS lvl
FROM (SELECT domain, url, min(pos) AS pos FROM root GROUP BY domain, url)""", "root")
cte("m0", "SELECT * FROM t0 WHERE rank <= 50", "t0")
_LEVELS = 8
for _d in range(1, _LEVELS + 1):
    cte(f"t{_d}", f"""
SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY k) + (SELECT count(*) FROM m{_d - 1} v WHERE v.domain = x.domain) AS rank, {_d} AS lvl
FROM (SELECT m.domain, c.url, min(row(m.rank, c.i)) AS k FROM m{_d - 1} m JOIN answered c ON c.doc = m.url AND c.is_index AND {domain('c.url')} = m.domain
      WHERE m.lvl = {_d - 1} AND NOT EXISTS (SELECT 1 FROM m{_d - 1} v WHERE v.domain = m.domain AND v.url = c.url) GROUP BY m.domain, c.url) x""",
        f"m{_d - 1}", "answered")
    cte(f"m{_d}", f"SELECT * FROM m{_d - 1} UNION ALL SELECT * FROM t{_d} WHERE rank <= 50", f"m{_d - 1}", f"t{_d}")
cte("new_url", f"""
SELECT domain, rank, count(*) AS n FROM (
  SELECT m.domain, k.url, min(m.rank) AS rank FROM m{_LEVELS} m JOIN answered k ON k.doc = m.url AND NOT k.is_index
  WHERE {domain('k.url')} = m.domain AND NOT EXISTS (SELECT 1 FROM start s WHERE s.domain = m.domain AND s.url = k.url) GROUP BY m.domain, k.url)
GROUP BY domain, rank""", f"m{_LEVELS}", "answered", "start")
cte("read_map", f"""
SELECT domain, rank, url, new_urls FROM (
  SELECT m.domain, m.rank, m.url, coalesce(n.n, 0) AS new_urls, (SELECT count(*) FROM start s WHERE s.domain = m.domain)
    + coalesce(sum(n.n) OVER (PARTITION BY m.domain ORDER BY m.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known
  FROM m{_LEVELS} m LEFT JOIN new_url n ON n.domain = m.domain AND n.rank = m.rank) WHERE known < 5000""", f"m{_LEVELS}", "new_url", "start")
check("sitemap_expand", "SELECT * FROM read_map", "read_map")
cte("known", f"""
SELECT m.domain, k.url FROM read_map m JOIN answered k ON k.doc = m.url AND NOT k.is_index WHERE {domain('k.url')} = m.domain
UNION SELECT domain, url FROM start""", "read_map", "answered", "start")

check("fetch_ok", "SELECT seq, error IS NULL AND status_code IS NOT NULL AND status_code >= 200 AND status_code < 400 AS ok FROM crawl", "crawl")
check("fetch_redirected", "SELECT seq, coalesce(rtrim(final_url, '/') <> rtrim(requested_url, '/'), false) AS redirected FROM crawl", "crawl")
_LABEL = """CASE exception WHEN 'asyncio:TimeoutError' THEN 'timeout' WHEN 'client:TooManyRedirects' THEN 'too_many_redirects'
  WHEN 'client:ClientConnectorError' THEN 'client_error: ClientConnectorError' ELSE 'unexpected_error: ValueError' END"""
check("fetch_errors", f"SELECT seq, {_LABEL} AS error, 'page: ' || requested_url || ': ' || {_LABEL} AS line FROM failures", "failures")
cte("started", """
SELECT seq, value, CASE WHEN trim(value) = '' THEN NULL WHEN regexp_matches(trim(value), '^https?://') THEN trim(value) ELSE 'https://' || trim(value) END AS u
FROM domain_lines""", "domain_lines")
cte("seeded", f"""
SELECT seq, value AS input_domain, {canonical("lower(regexp_extract(u, '^https?://[^/]*')) || regexp_replace(u, '^https?://[^/]*', '')")} AS normalized_url
FROM started""", "started")
check("seed_build", f"""
SELECT seq, input_domain, normalized_url, {host('normalized_url')} AS host, {domain('normalized_url')} AS registered_domain,
  CASE WHEN trim(input_domain) = '' THEN 'empty input' WHEN normalized_url IS NULL THEN 'not a usable URL' END AS error FROM seeded""", "seeded")
check("registered_domain", f"""
SELECT DISTINCT site AS host, {domain("'http://' || site")} AS registered_domain, regexp_extract(site, '[^.]+[.][^.]+$') AS last_two_labels
FROM page""", "page")

# ---------------------------------------------------------------- keyed state
_QUOTA = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, key, count(*) AS n, greatest(count(*) - 3, 0) AS rejected
FROM (SELECT ts, trim(coalesce(string_split(forwarded, ',')[1], fallback)) AS key FROM submissions) GROUP BY ALL"""
_LATEST = """
SELECT 'job-' || user_id AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, event_id AS update_id, event_type AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
check("quota_windows", _QUOTA, "submissions")
check("quota_windows_stream", _QUOTA, "submissions")
check("latest_state_ttl", _LATEST)
check("latest_state_ttl_stream", _LATEST)
_STATES = """
SELECT job_id, total, done, CASE WHEN total > 0 THEN CAST(floor(100.0 * done / total + 0.5) AS BIGINT) ELSE 100 END AS progress,
  CASE WHEN failed THEN 'error' WHEN done >= total THEN 'complete' WHEN done = 0 THEN 'queued' ELSE 'running' END AS status
FROM (SELECT user_id AS job_id, count(*) FILTER (event_type = 'purchase') + user_id % 2 AS total,
    count(*) FILTER (event_type = 'purchase' AND user_id % 4 <> 3) AS done, user_id % 5 = 0 AS failed FROM events GROUP BY user_id)"""
check("job_states", _STATES)
check("job_states_stream", _STATES)
check("job_progress", """
SELECT user_id AS job_id, event_id AS step_id, row_number() OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total,
  CAST(floor(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY user_id) + 0.5) AS BIGINT) AS progress,
  CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id) THEN 'complete' ELSE 'running' END AS status
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
