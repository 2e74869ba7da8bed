"""URL columns: splitting, resolving, normalising and reading language marks.

Everything is a built-in expression, so it runs inside the JVM next to the scan. The split
follows RFC 3986 by regular expression: ``parse_url`` raises under ANSI mode on odd input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonguemap import dims

# fixed values: patterns
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_TAIL = r"(?s)^[^?#]*(.*)$"
_DOTS = r"(?:^|/)\.{1,2}(?:/|$)"
_CANDIDATE_PATH = r"^/([a-z]{2})(?:[-_]([a-z]{2}))?(?:/|$)"
_SCORED_ALT = "|".join(dims.SCORED_CODES)
_SCORED_PATH = rf"/({_SCORED_ALT})(?:[-_][a-z]{{2}})?(?:/|$)"
_SCORED_SUBDOMAIN = rf"^({_SCORED_ALT})\."
_SITE_PREFIX = r"^/([a-z]{2})(?:[-_][a-z]{2})?(?:/|$)"
_SCORED_TAG = rf"^({_SCORED_ALT})(?:[-_](?:[a-z]{{2}}|[0-9]{{3}}))?$"
_SITE_ALT = "|".join(dims.SITE_CODES)
_SITE_CODE_PREFIX = rf"^/({_SITE_ALT})(?:[-_][a-z]{{2}})?(?:/|$)"
_SITE_SUBDOMAIN = rf"^({_SITE_ALT})\.[^.]*\."
_NAMES_ALT = "|".join(dims.SITE_NAMES)

# fixed values: blanks other than the space, as text and as a character class with it
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[ {BLANKS}]"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup_table(table: dict[str, str]) -> Column:
    """Map of fixed values as one literal, which costs less to plan than an expression per entry."""
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def strip(c: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def unbroken(c: Column) -> Column:
    """Without the tabs and line breaks that URLs lose wherever they are read."""
    return F.regexp_replace(c, r"[\t\r\n]", "")


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _SCHEME, 1))


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, _NETLOC, 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, _PATH, 1)


def hostname(c: Column) -> Column:
    """Host without user info and port, in lower case."""
    return F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def strip_default_port(c: Column) -> Column:
    return F.regexp_replace(c, r":(?:443|80)$", "")


def ensure_scheme(c: Column) -> Column:
    """Trimmed input with ``https://`` in front unless it has a scheme; NULL when empty."""
    s = strip(c)
    return F.when(s == "", None).when(s.rlike(r"^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def host(url: Column) -> Column:
    """Host of an absolute URL, with its port unless that is a default one."""
    return strip_default_port(F.lower(netloc(url)))


def _drop_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.slice(F.split(p, "/"), 2, F.size(F.split(p, "/")))

    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.when(p.rlike(r"/\.{1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(_DOTS), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(p)


def base_parts(base: Column) -> Column:
    """What resolving needs from a base URL, computed once per page instead of once per link."""
    p = path(base)
    return F.struct(
        scheme(base).alias("scheme"),
        F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0).alias("origin"),
        p.alias("path"),
        F.when(p == "", F.lit("/")).otherwise(F.regexp_extract(p, r"^(.*/)[^/]*$", 1)).alias("folder"),
        base.alias("url"),
    )


def resolve(parts: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` as seen from a :func:`base_parts` base; query and fragment are kept."""
    origin = parts["origin"]
    ref_path, tail = path(ref), F.regexp_extract(ref, _TAIL, 1)
    return (
        F.when(ref == "", parts["url"])
        .when(ref.rlike(_SCHEME), ref)
        .when(ref.startswith("//"), F.concat(parts["scheme"], F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _drop_dots(ref_path), tail))
        .when(ref.startswith("?"), F.concat(origin, parts["path"], ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(parts["url"], r"^[^#]*", 0), ref))
        .otherwise(F.concat(origin, _drop_dots(F.concat(parts["folder"], ref_path)), tail))
    )


_SKIPPED_TARGETS = r"^(?:mailto:|tel:|javascript:|#)"
_HTTP_WITH_HOST = r"^[hH][tT][tT][pP][sS]?://[^/?#]"


def canonical(full: Column, keep_query: bool = False) -> Column:
    """Canonical form of an absolute URL; NULL unless it is http(s) with a host."""
    p = F.regexp_replace(path(full), r";[^/]*$", "")
    p = F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, "/{2,}", "/"))
    out = F.concat(scheme(full), F.lit("://"), strip_default_port(F.lower(netloc(full))), p)
    if keep_query:
        q = F.regexp_extract(full, r"\?([^#]*)", 1)
        out = F.when(q == "", out).otherwise(F.concat(out, F.lit("?"), q))
    return F.when(full.rlike(_HTTP_WITH_HOST), out)


def normalize(url: Column, parts: Column | None = None, keep_query: bool = False) -> Column:
    """Canonical http(s) URL, or NULL for other targets (mail, phone, script, fragment only)."""
    raw = unbroken(strip(url))
    full = raw if parts is None else resolve(parts, raw)
    return F.when((url != "") & ~raw.rlike(_SKIPPED_TARGETS), canonical(full, keep_query))


def normalize_all(urls: Column, parts: Column) -> Column:
    """:func:`normalize` over an array in order, unusable entries left out, first of equals kept.

    Each ``transform`` binds its result to a lambda variable, so no step is computed twice.
    """
    raw = F.filter(F.transform(F.filter(urls, lambda u: u != ""), lambda u: unbroken(strip(u))), lambda u: ~u.rlike(_SKIPPED_TARGETS))
    full = F.transform(raw, lambda u: resolve(parts, u))
    return F.array_distinct(F.array_compact(F.transform(full, lambda u: canonical(u))))


def start_url(value: Column) -> Column:
    """Canonical start URL of what a domain list says; each step binds its result, so no step is worked out twice."""
    full = F.transform(F.transform(F.array(value), ensure_scheme), unbroken)
    return F.get(F.transform(full, lambda u: F.when(~u.rlike(_SKIPPED_TARGETS), canonical(u))), F.lit(0))


def _percent_encode(c: Column, also: str) -> Column:
    """Percent-encode control, non-ASCII and the listed characters, byte by byte in UTF-8."""
    unsafe = rf"[\x00-\x20\x7F-\x{{10FFFF}}{also}]"
    # url_encode writes a blank as "+", which a URL path must not hold
    enc = F.transform(
        F.split(c, ""),
        lambda ch: F.when(ch == " ", F.lit("%20")).when(ch.rlike(unsafe), F.url_encode(ch)).otherwise(ch),
    )
    return F.when(c.rlike(unsafe), F.array_join(enc, "")).otherwise(c)


def web_reference(href: Column) -> Column:
    """What a browser keeps of an href before resolving it: blanks around it and line breaks go, and backslashes in front of
    the query are slashes, unless the href names another scheme than that of web pages."""
    bare = unbroken(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    turned = F.concat(F.replace(F.regexp_extract(bare, r"^[^?#]*", 0), F.lit("\\"), F.lit("/")), F.regexp_extract(bare, _TAIL, 1))
    other = bare.rlike(_SCHEME) & ~bare.rlike("^(?i:https?):")
    return F.when(bare.contains("\\") & ~F.coalesce(other, F.lit(False)), turned).otherwise(bare)


def web_host(netloc_: Column, scheme_: Column) -> Column:
    """Host and port as a browser writes them: no user, no default port, numbers without zeros in front, and letters beyond
    ASCII in their ASCII form; NULL if there is no such form."""
    given = F.transform(F.array(F.regexp_replace(netloc_, "^.*@", "")), lambda h: F.named_struct(
        F.lit("name"), F.lower(F.regexp_replace(h, ":[0-9]*$", "")), F.lit("port"), F.regexp_replace(F.regexp_extract(h, ":([0-9]*)$", 1), "^0+(?=[0-9])", "")))
    own_port = F.when(scheme_ == "https", F.lit("443")).otherwise(F.lit("80"))

    def shown(h: Column) -> Column:
        name = F.when(h["name"].rlike("[^\\x00-\\x7F]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h["name"]))).otherwise(h["name"])
        port = F.when((h["port"] == "") | (h["port"] == own_port), F.lit("")).otherwise(F.concat(F.lit(":"), h["port"]))
        return F.concat(name, port)

    return F.get(F.transform(given, shown), F.lit(0))


def web_url(full: Column) -> Column:
    """Browser-style serialisation (WHATWG) of an absolute URL; NULL unless it is http(s) with a usable host."""
    s, p = scheme(full), _drop_dots(path(full))
    return F.when(
        full.rlike(_HTTP_WITH_HOST),
        F.concat(
            s, F.lit("://"), web_host(netloc(full), s),
            F.when(p == "", F.lit("/")).otherwise(_percent_encode(p, '"<>`{}')),
            _percent_encode(F.regexp_extract(full, _TAIL, 1), '"<>'),
        ),
    )


_LAST_TWO = r"^(?:.*\.)?([^.]+)\.+([^.]+)\.*$"


def registered_domain(host_col: Column, rules: tuple[str, ...] = ()) -> Column:
    """Last two labels of the host, or the host itself when it has fewer; ``rules`` as for :func:`domain_of`."""
    return _by_rules(F.lower(strip(host_col)), rules)


def domain_of(url: Column, rules: tuple[str, ...] = ()) -> Column:
    """Registered domain of an absolute URL: the last two labels of its host.

    With public-suffix ``rules`` it is the longest suffix that a rule names, and one label more. A rule ``*.ck``
    names every label under ``ck``, and ``!www.ck`` takes one of them out again. A host that is a suffix
    itself, or that no rule fits, keeps its last two labels.
    """
    return _by_rules(strip_default_port(F.lower(netloc(url))), rules)


def split_rules(rules: tuple[str, ...]) -> tuple[dict[int, list[str]], dict[int, list[str]], dict[int, list[str]]]:
    """Suffixes, suffixes of which any label more is one too, and exceptions, each by their number of labels."""
    plain, wild, exceptions = {}, {}, {}
    for rule in rules:
        kind = exceptions if rule.startswith("!") else wild if rule.startswith("*.") else plain
        name = rule.lower().removeprefix("!").removeprefix("*.").strip(".")
        kind.setdefault(name.count(".") + 1, []).append(name)
    return plain, wild, exceptions


def _by_rules(host_col: Column, rules: tuple[str, ...]) -> Column:
    if not rules:
        return F.regexp_replace(host_col, _LAST_TWO, "$1.$2")
    plain, wild, exceptions = split_rules(rules)

    def of(host: Column) -> Column:
        two = F.regexp_replace(host["given"], _LAST_TWO, "$1.$2")
        ending = lambda n: F.substring_index(host["bare"], ".", -n)
        cases = [(ending(n).isin(names), ending(n)) for n, names in sorted(exceptions.items(), reverse=True)]
        # a list of rules of one length is a hash set in the plan
        for n in range(max([1, *plain, *(n + 1 for n in wild)]), 0, -1):
            known = [ending(k).isin(names) for k, names in ((n, plain.get(n)), (n - 1, wild.get(n - 1))) if names]
            if known:
                hit = known[0] if len(known) == 1 else known[0] | known[1]
                cases.append((hit, F.when(host["bare"] != ending(n), ending(n + 1)).otherwise(two)))
        out = two
        for hit, domain in reversed(cases):
            out = F.when(hit, domain).otherwise(out)
        return out

    # bound to lambda variables, so that the host is worked out once
    bare = lambda h: F.regexp_replace(h, r"^.*@|^\.+|[.:]+[0-9]*$", "")
    both = F.transform(F.array(host_col), lambda h: F.named_struct(F.lit("given"), h, F.lit("bare"), bare(h)))
    return F.get(F.transform(both, of), F.lit(0))


def candidate_path(url: Column) -> Column:
    """``/xx/`` or ``/xx-yy/`` when the URL path starts like a language folder."""
    p = F.lower(path(url))
    lang, region = F.regexp_extract(p, _CANDIDATE_PATH, 1), F.regexp_extract(p, _CANDIDATE_PATH, 2)
    return F.when(lang == "", None).when(region == "", F.concat(F.lit("/"), lang, F.lit("/"))).otherwise(
        F.concat(F.lit("/"), lang, F.lit("-"), region, F.lit("/"))
    )


def scored_code(tag: Column) -> Column:
    """Language code of a tag such as ``pt-BR``; NULL unless it is one of the 24 known codes."""
    return none_if_empty(F.regexp_extract(F.lower(strip(tag)), _SCORED_TAG, 1))


def scored_url_code(url: Column) -> Column:
    """Language of a URL: sub-domain first, else a language folder anywhere in the path."""
    return F.coalesce(
        none_if_empty(F.regexp_extract(F.lower(netloc(url)), _SCORED_SUBDOMAIN, 1)),
        none_if_empty(F.regexp_extract(F.lower(path(url)), _SCORED_PATH, 1)),
    )


def clean_site_domain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), "^https?://", ""), "/.*$", "")


def site_code(tag: Column) -> Column:
    """Site profile: everything before the first hyphen, lower case, unchecked."""
    return F.lower(F.substring_index(tag, "-", 1))


def site_path_code(p: Column) -> Column:
    return none_if_empty(F.regexp_extract(p, _SITE_CODE_PREFIX, 1))


def site_name_codes(p: Column) -> Column:
    """Codes of all language names that follow a slash or hyphen in the path."""
    names = F.array_distinct(F.regexp_extract_all(p, F.lit(f"[/-]({_NAMES_ALT})"), F.lit(1)))
    return F.transform(names, lambda n: F.element_at(lookup_table(dims.SITE_NAME_TO_CODE), n))


def site_subdomain_code(host_col: Column) -> Column:
    return none_if_empty(F.regexp_extract(host_col, _SITE_SUBDOMAIN, 1))


def site_frontier(p: Column, host_col: Column) -> Column:
    """Does the link look worth following for languages?"""
    return p.rlike(rf"{_SITE_PREFIX}|{_NAMES_ALT}") | host_col.rlike(_SITE_SUBDOMAIN)
