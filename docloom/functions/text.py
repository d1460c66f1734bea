"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop list of the sparse index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

#: Words of two or more letters, digits or underscores, in any script.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"


def words(text: Column) -> Column:
    """Lower-case words, repeats kept; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(1))


def index_terms(text: Column) -> Column:
    """Words without the stop list, repeats kept."""
    return F.filter(words(text), lambda w: ~w.isin(STOP_WORDS))


def strip(text: Column) -> Column:
    """Without white space at either end, all of Unicode's."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def preview(text: Column, size: int = 150) -> Column:
    """Stripped, line breaks as spaces, cut to ``size`` characters."""
    return F.substring(F.replace(strip(text), F.lit("\n"), F.lit(" ")), 1, size)


def capitalised(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def title_from_key(key: Column) -> Column:
    """``chapter_title`` as ``Chapter Title``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def page_numbers(text: Column) -> Column:
    """Distinct page numbers of the tags in a text, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"@@PAGE_(\d+)@@"), F.lit(1)), lambda x: x.cast("int"))))


def without_tags(text: Column) -> Column:
    """Without page and heading tags, stripped."""
    return strip(F.regexp_replace(text, r"\s*@@(?:PAGE_|H)\d+@@\s*", " "))


def file_suffixes(name: Column) -> Column:
    """Suffixes of a file name; a leading dot starts no suffix."""
    return F.regexp_extract_all(F.regexp_replace(name, r"^\.+", ""), F.lit(r"(\.[^.]+)"), F.lit(1))


def stem(path: Column, suffix: str = "pdf") -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def without_fences(raw: Column) -> Column:
    """Model output without its code fences, trimmed."""
    return F.trim(F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def clean_title(raw: Column) -> Column:
    return F.replace(F.trim(raw), F.lit('"'), F.lit(""))


def utc_date(ts: Column) -> Column:
    """Date in UTC, whatever the session's time zone; a timestamp without a zone is UTC already."""
    since_epoch = F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400).cast("int")
    return F.when(F.typeof(ts) == "timestamp_ntz", F.to_date(ts)).otherwise(F.date_from_unix_date(since_epoch))


def day_key(ts: Column) -> Column:
    return F.date_format(utc_date(ts), "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(utc_date(ts), "yyyy-MM")


def tag_or_null(raw: Column, tag: str, any_case: bool = False) -> Column:
    """Stripped content of ``<tag>...</tag>``, null where the tag is missing (empty where it is empty)."""
    pattern = rf"(?s{'i' if any_case else ''})<{tag}>\s*(.*?)\s*</{tag}>"
    return F.when(raw.rlike(pattern), strip(F.regexp_extract(raw, pattern, 1)))


def html_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and tags removed, the five basic entities and a few named ones decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


#: Entities that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
