"""Raw postings to clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.functions import salary as S
from jobmarket.functions import text as X
from jobmarket.functions.titles import standardize_titles
from jobmarket.operators.locations import standardize_locations
from jobmarket.rules.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from jobmarket.schemas import CLEAN


def clean_records(
    raw: DataFrame,
    lookup: DataFrame | None = None,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    location_dim: DataFrame | None = None,
) -> DataFrame:
    """Standardize every raw posting; adds ``dedup_key``, keeps any extra columns.

    Titles, salaries and keys are computed in place; only the location lookup joins.
    Dates and times stay text here, see :func:`prepare`.
    """
    # the join comes first, while rows are at their narrowest
    df = standardize_locations(raw, lookup, "location", location_dim)
    df = df.withColumn(
        "company", X.first_employer("company", "employer", "organization", "employer_name")
    ).withColumns(
        {
            "employment_type": X.clean_placeholder("employment_type"),
            "education_requirement": X.clean_placeholder("education_requirement"),
        }
    )
    df = S.normalize_salary(S.parse_salary(df, S.salary_source(df)))
    df = standardize_titles(df, "job_title", taxonomy)
    df = df.drop(
        "salary_text", "salary", "employer", "organization", "employer_name", "raw_row_text",
        "source_url",
    )
    return df.withColumn(
        "dedup_key", X.dedup_key("job_url", "career_category", "company", "location")
    )


def prepare(clean: DataFrame) -> DataFrame:
    """Types of the clean table; unreadable dates and times become null."""
    typed = clean
    if dict(clean.dtypes)["date_posted"] == "string":
        typed = typed.withColumn("date_posted", X.parse_date("date_posted"))
    if dict(clean.dtypes)["collected_at"] == "string":
        typed = typed.withColumn("collected_at", X.parse_timestamp("collected_at"))
    return typed.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CLEAN])
