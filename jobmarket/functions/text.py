"""String cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: everything a Unicode-aware strip removes; SQL ``trim`` would leave tabs and the like
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    """``''`` becomes null; other text stays as it is."""
    return F.nullif(col(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def label(c: Column | str, default: str) -> Column:
    """Reporting label: blank (spaces only) or null becomes ``default``."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))


def is_filled(c: Column | str) -> Column:
    return col(c).isNotNull() & (F.trim(col(c)) != "")


def clean_placeholder(c: Column | str) -> Column:
    """Blank text and "... not specified" wordings become null."""
    text = strip(c)
    return F.when((text != "") & ~text.rlike(r"(?iU)not\s+specified"), text)


def first_employer(*names: Column | str) -> Column:
    """First non-empty name, then stripped; a name of spaces wins and yields null."""
    return blank_to_null(strip(F.coalesce(*[blank_to_null(n) for n in names])))


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))),
        "",
    )


def normalize_key(c: Column | str) -> Column:
    """Lookup key: lower case, folded vowels and ñ, single spaces."""
    return strip(squeeze(F.translate(F.lower(col(c)), "ñáéíóú", "naeiou")))


def normalize_url(c: Column | str) -> Column:
    """Lower-case URL without query, fragment and trailing slashes."""
    url = F.lower(strip(c))
    url = F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return F.rtrim(url, F.lit("/"))


def absolute_url(href: Column | str, base: str) -> Column:
    h = col(href)
    return (
        F.when(h.startswith("http"), h)
        .when(h.startswith("/"), F.concat(F.lit(base), h))
        .otherwise(F.concat(F.lit(base + "/"), h))
    )


def dedup_key(
    url: Column | str, category: Column | str, company: Column | str, location: Column | str
) -> Column:
    """md5 of the normalized URL, or of category, company and location without one."""

    def part(c):
        return strip(F.lower(F.coalesce(col(c), F.lit(""))))

    by_url = F.concat(F.lit("url|"), normalize_url(url))
    fallback = F.concat_ws("|", F.lit("fallback"), part(category), part(company), part(location))
    return F.md5(F.when(strip(url) != "", by_url).otherwise(fallback))


ROW_FIELDS = (
    "job_title", "salary_text", "employer", "location", "education_requirement",
    "employment_type",
)


def parse_row_text(c: Column | str) -> Column:
    """Split ``title | salary | employer | ... | Posted on date`` into a struct.

    Empty parts vanish, so a missing field shifts the following ones left.
    """
    parts = F.filter(F.transform(F.split(col(c), r"\|"), strip), lambda p: p != "")
    last = F.get(parts, F.size(parts) - 1)
    dated = F.coalesce(F.lower(last).startswith("posted on"), F.lit(False))
    count = F.size(parts) - F.when(dated, 1).otherwise(0)
    fields = [
        F.when(F.lit(i) < count, F.get(parts, F.lit(i))).alias(name)
        for i, name in enumerate(ROW_FIELDS)
    ]
    date = F.when(dated, strip(last.substr(F.lit(len("posted on") + 1), F.length(last))))
    return F.struct(*fields, date.alias("date_posted"))


def parse_date(c: Column | str) -> Column:
    """``M/d/yyyy`` or ISO date; anything else is null."""
    return F.coalesce(F.try_to_date(col(c), "M/d/yyyy"), F.try_to_date(col(c), "yyyy-MM-dd"))


def parse_timestamp(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c))
