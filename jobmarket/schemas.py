"""Declared schemas; no source is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; works before any session exists."""
    schema = T.StructType()
    for pair in spec.replace("decimal(28,2)", "money").split(","):
        name, kind = pair.split()
        schema.add(name, T.DecimalType(28, 2) if kind == "money" else kind)
    return schema


RAW_COLUMNS = (
    "job_title", "salary_text", "salary", "employer", "company", "organization",
    "employer_name", "location", "education_requirement", "employment_type", "date_posted",
    "industry", "description", "job_url", "raw_row_text", "source", "source_url",
    "collected_at",
)
RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

#: sums of it still fit a decimal of 38 digits
MONEY = "decimal(28,2)"

CLEAN = _struct(
    f"""
    job_title string, career_category string, title_match_method string, company string,
    location string, region string, salary_period string, salary_disclosed boolean,
    currency string, date_posted date, employment_type string, education_requirement string,
    industry string, description string, source string, job_url string,
    collected_at timestamp, salary_amount {MONEY}, salary_period_inferred string,
    salary_outlier boolean, salary_period_used string, salary_period_estimated boolean,
    salary_amount_monthly {MONEY}
    """
)

#: columns of one upsert batch, in table order
JOB_COLUMNS = (
    "job_title", "career_category", "company", "location", "region", "salary_amount",
    "salary_period", "salary_disclosed", "salary_period_inferred", "salary_amount_monthly",
    "salary_period_used", "salary_period_estimated", "currency", "date_posted",
    "employment_type", "education_requirement", "industry", "description", "source",
    "job_url", "collected_at", "title_match_method",
)
#: the unique key of the jobs table
JOB_KEY = ("job_title", "career_category", "company", "location")

JOBS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [CLEAN[c] for c in JOB_COLUMNS]
    + [T.StructField("created_at", T.TimestampType())]
)

#: columns of the job listing, in output order
LISTING_COLUMNS = (
    "id", "job_title", "career_category", "title_match_method", "company", "location",
    "region", "salary_amount", "salary_period", "salary_period_inferred",
    "salary_amount_monthly", "salary_period_used", "salary_period_estimated",
    "salary_disclosed", "currency", "date_posted", "employment_type",
    "education_requirement", "industry", "description", "source", "job_url", "collected_at",
)

LOCATION_LOOKUP = _struct("kind string, key string, location string, region string")
PSGC = _struct("code string, description string")
SEEN = _struct("job_url string")
LISTING = _struct(
    "page long, pos integer, job_title string, salary_text string, employer string,"
    " location string, education_requirement string, employment_type string,"
    " date_posted string, job_url string, raw_row_text string"
)
