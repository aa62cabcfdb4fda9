"""Expressions over raw review fields, links and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing field.
MISSING = ["NaN", "None"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(text: Column | str) -> Column:
    text = _col(text)
    return text.isNotNull() & ~text.isin(MISSING)


def binary_label(rating: Column | str, bad: int = 1, good: int = 5) -> Column:
    """0 for the worst rating, 1 for the best, NULL for those between."""
    number = _col(rating).try_cast("int")
    return F.when(number == bad, F.lit(0)).when(number == good, F.lit(1))


def clean_field(text: Column | str) -> Column:
    """Drop tabs and quotes, turn newlines into blanks, empty into NULL."""
    return F.nullif(F.translate(_col(text), "\n\t\"", " "), F.lit(""))


def for_tsv(text: Column | str) -> Column:
    """A cleaned field as it stands in a TSV file, where NULL is NaN.

    Carriage returns become blanks too: readers may end a row at them.
    """
    return F.coalesce(clean_field(F.translate(_col(text), "\r", " ")), F.lit("NaN"))


def author_id(url: Column | str) -> Column:
    """What follows the first `/id` of an author link, NULL without one."""
    return F.get(F.split(_col(url), "/id"), F.lit(1))


def link_id(link: Column | str, pattern: str = "/id([0-9]+)") -> Column:
    """Numeric id of a store link, NULL without one."""
    return F.nullif(F.regexp_extract(_col(link), pattern, 1), F.lit(""))


def rank_feed_url(country: Column, rank_list: Column, genre: Column, limit: int = 300) -> Column:
    """Address of a ranking feed; a NULL genre leaves its part out."""
    return F.concat_ws(
        "/", F.lit("https://itunes.apple.com"), country, F.lit("rss"), rank_list,
        F.lit(f"limit={limit}"), F.concat(F.lit("genre="), genre), F.lit("json"))


def review_feed_url(country: Column, app_id: Column, page: Column) -> Column:
    """Address of one page of the JSON review feed of an app."""
    return F.concat_ws(
        "/", F.lit("https://itunes.apple.com"), country, F.lit("rss/customerreviews"),
        F.concat(F.lit("id="), app_id), F.concat(F.lit("page="), page.cast("string")),
        F.lit("sortby=mostrecent"), F.lit("json"))


def review_xml_url(country: Column, app_id: Column, sort_by: Column) -> Column:
    """Address of the XML review feed of an app."""
    return F.concat_ws(
        "/", F.lit("https://itunes.apple.com"), country, F.lit("rss/customerreviews"),
        F.concat(F.lit("id="), app_id), F.concat(F.lit("sortBy="), sort_by), F.lit("xml"))


def first_match(html: Column | str, pattern: str) -> Column:
    """Group 1 of the first match, NULL when the page has none."""
    return F.get(F.regexp_extract_all(_col(html), F.lit(pattern), F.lit(1)), F.lit(0))


def page_title(html: Column | str) -> Column:
    return first_match(html, "<title>([^<]*)</title>")


def page_heading(html: Column | str) -> Column:
    return first_match(html, "<h1>([^<]*)</h1>")


def page_lang(html: Column | str) -> Column:
    return first_match(html, "<html lang=\"([^\"]*)\"")


def page_links(html: Column | str) -> Column:
    """All link targets of a page, in order."""
    return F.regexp_extract_all(_col(html), F.lit("href=\"([^\"]+)\""), F.lit(1))


def after_prefix(text: Column | str, width: int) -> Column:
    """Text after a prefix of fixed width."""
    text = _col(text)
    return text.substr(F.lit(width + 1), F.length(text))


def rating_parts(label: Column | str) -> Column:
    """Stars and number of ratings of a label such as `4 stars, 120 Ratings`."""
    parts = F.split(_col(label), ",")
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("stars"),
                    F.trim(F.get(parts, F.lit(1))).alias("ratings"))
