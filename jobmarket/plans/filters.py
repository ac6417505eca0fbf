"""Filter arguments of the analytics and listing queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.industry import DERIVED, with_industry


@dataclass(frozen=True)
class Filters:
    """Exact-match filters; an empty or missing value filters nothing."""

    category: str | None = None
    region: str | None = None
    industry: str | None = None
    employment_type: str | None = None

    def apply(self, jobs: DataFrame) -> DataFrame:
        wanted = {
            "career_category": self.category,
            "region": self.region,
            "employment_type": self.employment_type,
        }
        for column, value in wanted.items():
            if value:
                jobs = jobs.where(F.col(column) == value)
        if self.industry:
            jobs = with_industry(jobs).where(F.col(DERIVED) == self.industry)
        return jobs


NO_FILTERS = Filters()


@dataclass(frozen=True)
class JobFilters:
    """Case-insensitive substring filters and free-text search.

    ``%``, ``_`` and ``\\`` in a value act as wildcards unless ``literal`` is set.
    """

    career_category: str | None = None
    location: str | None = None
    region: str | None = None
    industry: str | None = None
    employment_type: str | None = None
    search: str | None = None
    literal: bool = False

    SEARCHED = ("job_title", "company", "career_category", "location", "region")

    def _like(self, column: str, value: str) -> Column:
        if self.literal:
            for ch in ("\\", "%", "_"):
                value = value.replace(ch, "\\" + ch)
        return F.col(column).ilike(f"%{value}%")

    def apply(self, jobs: DataFrame) -> DataFrame:
        for column in ("career_category", "location", "region", "employment_type"):
            value = getattr(self, column)
            if value:
                jobs = jobs.where(self._like(column, value))
        if self.industry:
            jobs = with_industry(jobs).where(self._like(DERIVED, self.industry))
        if self.search:
            jobs = jobs.where(
                reduce(Column.__or__, [self._like(c, self.search) for c in self.SEARCHED])
            )
        return jobs


def has_salary() -> Column:
    """Postings that enter salary figures."""
    return F.col("salary_disclosed") & (F.col("salary_amount_monthly") > 0)


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    return limit
