"""Display columns: names, status texts, labels, escaping, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonguemap import dims
from tonguemap.functions.urls import lookup_table, none_if_empty, strip


def site_language_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup_table(dims.SITE_CODE_TO_NAME), code), F.upper(code))


def scored_language_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup_table(dims.SCORED_CODE_TO_NAME), code), code)


def status_text(status: Column) -> Column:
    """``404 - Not Found`` style text; a value that is no number passes through."""
    code = status.try_cast("int")
    names = lookup_table({str(k): v for k, v in dims.STATUS_TEXT.items()})
    text = (
        F.when(code.between(200, 299), F.lit("Success"))
        .when(code.between(300, 399), F.lit("Redirect"))
        .otherwise(F.coalesce(F.try_element_at(names, code.cast("string")), F.lit("Error")))
    )
    return F.when(code.isNull(), status.cast("string")).otherwise(F.concat(status.cast("string"), F.lit(" - "), text))


def confidence_percent(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def confidence_label(percent: Column) -> Column:
    return F.when(percent >= 85, "High").when(percent >= 60, "Medium").otherwise("Low")


def language_label(name: Column, label: Column, percent: Column) -> Column:
    """``Name (Label, 90%)``; the plain name when label or percent is missing; NULL without a name."""
    name, label = none_if_empty(strip(name)), none_if_empty(strip(label))
    full = F.concat(name, F.lit(" ("), label, F.lit(", "), percent.cast("string"), F.lit("%)"))
    return F.coalesce(full, name)


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def html_escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def csv_quote(c: Column) -> Column:
    """Always quoted, inner quotes doubled."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_escape(c: Column) -> Column:
    """Quoted only when the value holds a quote, comma or newline."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), csv_quote(s)).otherwise(s)


def domain_slug(c: Column) -> Column:
    s = strip(c)
    for raw, sub in (("https://", ""), ("http://", ""), ("/", "_"), (":", "_"), (" ", "_")):
        s = F.replace(s, F.lit(raw), F.lit(sub))
    return F.when(s == "", "unknown_domain").otherwise(s)


def markdown_row(domain: Column, count: Column, languages: Column, review: Column) -> Column:
    def cell(c: Column, default: str) -> Column:
        return F.replace(F.coalesce(none_if_empty(c.cast("string")), F.lit(default)), F.lit("|"), F.lit("\\|"))

    return F.concat(
        F.lit("| "), cell(domain, "_Unknown domain_"),
        F.lit(" | "), cell(count, "0"),
        F.lit(" | "), cell(languages, "_None over threshold_"),
        F.lit(" | "), cell(review, "No"),
        F.lit(" |"),
    )


def progress_percent(done: Column, total: Column) -> Column:
    """Share in percent, halves rounded up."""
    return F.floor(done * 100 / total + 0.5).cast("long")
