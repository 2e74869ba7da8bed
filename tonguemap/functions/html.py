"""Signals read from page markup with built-in regular expressions, in one scan of the body."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap.functions.once import once
from tonguemap.functions.urls import BLANKS, lookup_table

# fixed values: patterns. Possessive quantifiers keep matching linear, and without recursion, on any markup.
# Inside a tag a quote opens a value only after an equals sign; elsewhere it is an ordinary character. A tag
# ends at the next bracket of either kind, and a block that is never closed runs to the end of the page, so
# that no start is tried twice over the rest of it.
_INSIDE = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""


def _block(name: str) -> str:
    return rf"{name}\b{_INSIDE}>(?:.*?</{name}\s*+>|.*+)"


_NOT_MARKUP = rf"!--(?:.*?-->|.*+)|{_block('script')}|{_block('style')}"
_INVISIBLE = rf"{_NOT_MARKUP}|{_block('noscript')}|{_block('svg')}"
_APP_ROOT = r"""id\s*+=\s*+(?:"(?:root|app|__next)"|'(?:root|app|__next)'|(?:root|app|__next)(?=[\s/>]|$))"""
_APP_MARK = rf"\s(?:{_APP_ROOT}|data-reactroot(?=[\s=/>]|$)|data-require(?=[\s=/>]|$))"
_SIGNAL_TAG = rf"(?:html|link|a|header|nav)(?=[\s/>]){_INSIDE}|[a-z](?=[^<>]*?{_APP_MARK}){_INSIDE}"
_TAGS = rf"(?is)<(?:{_NOT_MARKUP}|({_SIGNAL_TAG})>|[!?/a-z]{_INSIDE}>)"
_NOT_TEXT = rf"(?is)<(?:{_INVISIBLE}|[!?/a-z]{_INSIDE}>)"
_PLAIN_BLANKS = r"[ \t\n\x0B\f\r]{2,}+|[\t\n\x0B\f\r]"
_OTHER_BLANKS = f"[{BLANKS[5:]}]"
_OTHER_ATTR = r"""\s++(?!{name}[\s=])[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_ATTR = rf"""(?i)^[a-z]++(?:{_OTHER_ATTR})*+\s++{{name}}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_NUMERIC = "#(?:[0-9]+|[xX][0-9A-Fa-f]+)"
_NAMED = "[A-Za-z][A-Za-z0-9]*;"


def page_tags(body: Column) -> Column:
    """Start tags that can carry signals, without their brackets, in document order.

    One pass over the body, one match per tag. Comments, scripts and styles match as a whole, so nothing
    inside them counts; they and all other tags give empty entries, which are left out.
    """
    return F.filter(F.regexp_extract_all(body, F.lit(_TAGS), F.lit(1)), lambda t: t != "")


def _named(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: F.lower(F.regexp_extract(t, "^[A-Za-z]+", 0)) == name)


def _quoted_attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, _ATTR.format(name=name), 1)


def _unquote(raw: Column) -> Column:
    bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(raw != "", bare)


# names that pages may write without a semicolon come first, as the common ones are among them
HTML_NAMES = {name: value for name, value in sorted(html5.items(), key=lambda e: (e[0].rstrip(";") not in html5, e)) if name.endswith(";")}
XML_NAMES = {f"{name};": HTML_NAMES[f"{name};"] for name in ("amp", "lt", "gt", "quot", "apos")}
_BARE_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_BARE = "|".join(_BARE_NAMES)
# references to the numbers 128 to 159 mean the signs that Windows has there, where it has any
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
_REPLACEMENT = "\ufffd"


def decode_entities(c: Column) -> Column:
    """Decode the character references of HTML text: named, numeric, and old names without their semicolon."""
    return _references_decoded(c, HTML_NAMES, rf"{_NUMERIC};?|{_NAMED}", f"(?:{_BARE})")


def decode_attribute(c: Column) -> Column:
    """As in text, but a name without its semicolon stays if it goes on like a word or an address."""
    return _references_decoded(c, HTML_NAMES, rf"{_NUMERIC};?|{_NAMED}", f"(?:{_BARE})(?![=A-Za-z0-9])")


def decode_xml(c: Column) -> Column:
    """Decode the five named references of XML, and numeric ones."""
    return _references_decoded(c, XML_NAMES, rf"{_NUMERIC};|{_NAMED}", None)


def _references_decoded(c: Column, names: dict[str, str], pattern: str, bare: str | None) -> Column:
    """Each ampersand begins one piece of the text, whose reference is replaced; what it gives is not read again."""
    table = lookup_table(names)

    def numeric(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
        base = F.when(ref.rlike("^#[xX]"), 16).otherwise(10)
        code = F.when(F.length(digits) > 7, F.lit(0)).when(digits == "", F.lit(0)).otherwise(
            F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).cast("int"))
        bound = F.transform(F.array(code), lambda n: F.when(
            (n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(_REPLACEMENT)).when(
            n.between(128, 159) & F.lit(bare is not None), F.substring(F.lit(_WINDOWS), n - 127, F.lit(1))).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        return F.get(bound, F.lit(0))

    def found(piece: Column) -> Column:
        """The piece, how many letters its reference has, and what that means."""
        ref = F.regexp_extract(piece, f"^(?:{pattern})", 0)
        known = F.when(ref.startswith("#"), numeric(ref)).when(ref != "", F.try_element_at(table, ref))
        return F.named_struct(F.lit("piece"), piece, F.lit("ref"), ref, F.lit("value"), known)

    def shorter(x: Column) -> Column:
        """The longest old name that the piece begins with, if it has no reference with a semicolon."""
        if bare is None:
            return x
        name = F.regexp_extract(x["piece"], f"^{bare}", 0)
        other = F.transform(F.array(name), lambda n: F.named_struct(
            F.lit("piece"), x["piece"], F.lit("ref"), n, F.lit("value"), F.when(n != "", F.try_element_at(table, F.concat(n, F.lit(";"))))))
        return F.when(x["value"].isNotNull(), x).otherwise(F.get(other, F.lit(0)))

    def replaced(x: Column) -> Column:
        rest = F.substring(x["piece"], F.length(x["ref"]) + 1, F.length(x["piece"]))
        return F.when(x["value"].isNull(), F.concat(F.lit("&"), x["piece"])).otherwise(F.concat(x["value"], rest))

    pieces = F.split(c, "&")
    after = F.slice(pieces, F.lit(2), F.size(pieces))
    said = F.transform(F.transform(F.transform(after, found), shorter), replaced)
    return F.when(c.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(said, ""))).otherwise(c)


def _attrs(tags: Column, names: list[str]) -> Column:
    """Struct of attribute values per tag, NULL where absent; each step binds its result for the next."""
    raw = F.transform(tags, lambda t: F.array(*[_quoted_attr(t, n) for n in names]))
    decoded = F.transform(raw, lambda t: F.transform(F.transform(t, _unquote), decode_attribute))
    return F.transform(decoded, lambda t: F.struct(*[F.get(t, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def html_lang(tags: Column) -> Column:
    """``lang`` of the html element as written; NULL when missing."""
    return F.get(_attrs(F.slice(_named(tags, "html"), 1, 1), ["lang"]), F.lit(0))["lang"]


def link_tags(tags: Column) -> Column:
    """``array<struct<rel, hreflang, href>>`` of the link elements."""
    return _attrs(_named(tags, "link"), ["rel", "hreflang", "href"])


def anchor_hrefs(tags: Column) -> Column:
    """``href`` values of the anchors in document order, anchors without one left out."""
    raw = F.filter(F.transform(_named(tags, "a"), lambda t: _quoted_attr(t, "href")), lambda v: v != "")
    return F.transform(F.transform(raw, _unquote), decode_attribute)


@once
def _decoded(name: str) -> Column:
    return decode_entities(F.col(name))


def with_visible_text(df: DataFrame, body: str, out: str) -> DataFrame:
    """Add the text a reader sees: no tags or unseen blocks, entities decoded, blanks of any kind collapsed.

    One column per step: an expression with a lambda in it is never shared, so inlined steps would run twice.
    """
    return (
        df.withColumn("_untagged", F.regexp_replace(body, _NOT_TEXT, " "))
        .withColumn("_decoded", _decoded("_untagged"))
        # kinds of blanks that few texts hold are replaced only where there are any
        .withColumn(
            "_even",
            F.when(F.col("_decoded").rlike(_OTHER_BLANKS), F.translate("_decoded", BLANKS, " " * len(BLANKS))).otherwise(
                F.col("_decoded")
            ),
        )
        .withColumn(out, F.trim(F.regexp_replace("_even", _PLAIN_BLANKS, " ")))
        .drop("_untagged", "_decoded", "_even")
    )


def is_html(content_type: Column, body: Column) -> Column:
    ctype = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        ctype.contains("text/html")
        | ctype.contains("application/xhtml+xml")
        | body.rlike("(?i)<html")
    )


def is_spa(body: Column, tags: Column) -> Column:
    """Marks of pages that build themselves in the browser, or load their navigation late."""
    root = rf"(?i)\s(?:{_APP_ROOT}|data-reactroot(?=[\s=/>]|$))"
    lazy = r"""(?i)^(?:header|nav)\s(?:.*\s)?data-require(?=[\s=/>]|$)|\sdata-require\s*=\s*(?:"[^"]*nav|'[^']*nav|[^\s"'>]*nav)"""
    return (
        body.contains("__NEXT_DATA__")
        | body.contains("__NUXT__")
        | body.contains("window.webpackChunk")
        | F.exists(tags, lambda t: t.rlike(root) | t.rlike(lazy))
    )
