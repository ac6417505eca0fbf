"""Derived industry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.rules.industry import INDUSTRY_KEYWORDS, OTHER_INDUSTRY

DERIVED = "industry_derived"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _searched(title: Column | str, description: Column | str) -> Column:
    texts = [F.coalesce(_column(x), F.lit("")) for x in (title, description)]
    return F.lower(F.concat_ws(" ", *texts))


def _found(industry: Column | str, text: Column, rules) -> Column:
    # plain substring searches scan long descriptions faster than a regular expression
    groups = [
        F.when(reduce(Column.__or__, [text.contains(k) for k in keywords]), F.lit(name))
        for name, keywords in rules
    ]
    return F.coalesce(F.nullif(F.trim(_column(industry)), F.lit("")), *groups, F.lit(OTHER_INDUSTRY))


def derived_industry(
    industry: Column | str = "industry",
    title: Column | str = "job_title",
    description: Column | str = "description",
    rules=INDUSTRY_KEYWORDS,
) -> Column:
    """Stated industry, else the first keyword group found in title and description."""
    return _found(industry, _searched(title, description), rules)


def with_industry(jobs: DataFrame, rules=INDUSTRY_KEYWORDS) -> DataFrame:
    """Add ``industry_derived`` unless the snapshot already stores it."""
    if DERIVED in jobs.columns:
        return jobs
    # a column of its own, as the text would be put together again for every keyword
    searched = jobs.withColumn("_searched", _searched("job_title", "description"))
    return searched.withColumn(DERIVED, _found("industry", F.col("_searched"), rules)).drop("_searched")
