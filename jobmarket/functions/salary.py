"""Free-text salaries: parsing, period inference and monthly equivalents.

Everything is a built-in expression, staged so that each text search runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.text import blank_to_null, strip
from jobmarket.rules import salary as R
from jobmarket.schemas import MONEY

PARSED = ("salary_min", "salary_max", "salary_period", "salary_disclosed", "currency")


def salary_source(df: DataFrame) -> Column:
    """First non-empty of the two raw salary fields, else an empty text."""
    return F.coalesce(blank_to_null("salary_text"), blank_to_null("salary"), F.lit(""))


def pay_period(text: Column) -> Column:
    """Stated pay period; one cheap test spares bare figures the word searches."""
    lowered = F.lower(text)
    branches = []
    for period, words, parts in R.PERIOD_WORDS:
        pattern = r"(?U)\b(?:" + "|".join(words) + r")\b|" + "|".join(parts)
        branches.append(F.when(lowered.rlike(pattern), F.lit(period)))
    return F.when(lowered.rlike(R.PERIOD_HINT), F.coalesce(*branches))


def currency_mark(text: Column) -> Column:
    upper = F.upper(text)
    return F.coalesce(
        *[F.when(upper.rlike("(?U)" + p), F.lit(code)) for code, p in R.CURRENCY_MARKS]
    )


def _figure(token: Column, thousands: Column) -> Column:
    digits = F.regexp_replace(token, "[,kK]", "")
    return digits.try_cast("double") * F.when(thousands, 1000.0).otherwise(1.0)


def parse_salary(
    df: DataFrame, text: Column, default_currency: str = R.DEFAULT_CURRENCY
) -> DataFrame:
    """Add salary_min, salary_max, salary_period, salary_disclosed and currency."""
    span = rf"(?U){R.NUMBER}\s*(?:{R.RANGE_SEPARATOR})\s*{R.NUMBER}(?:\s*[kK])?"
    df = df.withColumn("_text", strip(text))
    # a text without digits states no salary, whatever its wording
    stated = F.col("_text").rlike("[0-9]") & ~F.col("_text").rlike("(?iU)" + R.NOT_DISCLOSED)
    without_bonus = F.when(
        F.lower("_text").contains("month"),
        F.regexp_replace("_text", "(?iU)" + R.BONUS_MENTION, " "),
    ).otherwise(F.col("_text"))
    df = df.withColumn("_body", F.when(stated, without_bonus))
    df = df.withColumns(
        {
            "_found": F.when(
                F.col("_body").rlike(R.RANGE_SEPARATOR), F.regexp_extract("_body", span, 0)
            ),
            "_tokens": F.regexp_extract_all("_body", F.lit(R.NUMBER_TOKEN), F.lit(0)),
        }
    )
    df = df.withColumn("_span", blank_to_null("_found"))
    ends = F.split(F.regexp_replace("_span", r"(?U)[\s,kK]", ""), R.RANGE_SEPARATOR)
    shared_k = F.col("_span").rlike("[kK]$")
    first, second = F.get("_tokens", F.lit(0)), F.get("_tokens", F.lit(1))
    a = _figure(first, first.rlike("[kK]$"))
    b = _figure(second, second.rlike("[kK]$"))
    df = df.withColumns(
        {
            "_a": F.when(F.col("_span").isNotNull(), _figure(F.get(ends, F.lit(0)), shared_k)).otherwise(a),
            "_b": F.when(F.col("_span").isNotNull(), _figure(F.get(ends, F.lit(1)), shared_k)).otherwise(b),
        }
    )
    df = df.withColumns(
        {"_low": F.least("_a", "_b"), "_high": F.greatest("_a", "_b")}  # both skip nulls
    )
    shown = F.coalesce(F.col("_low") > 0, F.lit(False))
    return df.withColumns(
        {
            "salary_min": F.when(shown, F.round("_low", 2)),
            "salary_max": F.when(shown, F.round("_high", 2)),
            "salary_period": F.when(shown, pay_period(F.col("_body"))),
            "salary_disclosed": shown,
            "currency": F.when(
                shown, F.coalesce(currency_mark(F.col("_text")), F.lit(default_currency))
            ),
        }
    ).drop("_text", "_body", "_found", "_span", "_tokens", "_a", "_b", "_low", "_high")


def midpoint(low: Column, high: Column) -> Column:
    """Representative amount: the middle of the two, or whichever is present."""
    return F.round((F.coalesce(low, high) + F.coalesce(high, low)) / 2, 2)


def inferred_period(disclosed: Column, stated: Column, amount: Column) -> Column:
    return F.when(
        disclosed,
        F.coalesce(
            blank_to_null(stated),
            F.when(amount <= R.DAILY_CEILING, "daily")
            .when(amount <= R.WEEKLY_CEILING, "weekly")
            .when(amount >= R.MONTHLY_FLOOR, "monthly")
            .when(amount.isNotNull(), "ambiguous"),
        ),
    )


def monthly_equivalent(amount: Column, period: Column) -> Column:
    return F.round(
        F.when(period == "daily", amount * R.DAYS_PER_MONTH)
        .when(period == "weekly", amount * R.WEEKS_PER_YEAR / 12)
        .when(period == "hourly", amount * R.HOURS_PER_DAY * R.DAYS_PER_MONTH)
        .when(period == "monthly", amount)
        .when(period == "annual", amount / 12),
        2,
    )


def normalize_salary(df: DataFrame) -> DataFrame:
    """Add amount, inferred and used period, estimate and outlier flags, monthly amount.

    Money columns are decimals.  A figure of 1e26 or more doesn't fit and is null while
    ``salary_disclosed`` stays set; imports put such rows into the rejected table.
    """
    stated = blank_to_null("salary_period")
    df = df.withColumn("_amount", midpoint(F.col("salary_min"), F.col("salary_max")))
    df = df.withColumns(
        {
            "salary_period_inferred": inferred_period(
                F.col("salary_disclosed"), F.col("salary_period"), F.col("_amount")
            ),
            "salary_outlier": F.coalesce(F.col("_amount") > R.OUTLIER_CEILING, F.lit(False)),
        }
    )
    guess = F.when(F.col("salary_period_inferred") != "ambiguous", F.col("salary_period_inferred"))
    df = df.withColumns(
        {
            "salary_period_used": F.coalesce(stated, guess),
            "salary_period_estimated": stated.isNull() & guess.isNotNull(),
        }
    )
    return df.withColumns(
        {
            "salary_amount": F.col("_amount").try_cast(MONEY),
            "salary_amount_monthly": monthly_equivalent(
                F.col("_amount"), F.col("salary_period_used")
            ).try_cast(MONEY),
        }
    ).drop("_amount")


def bucket_number(amount: Column) -> Column:
    """Histogram bucket, counted from 1."""
    expr = F.lit(len(R.SALARY_BUCKETS))
    for number, (upper, _) in reversed(list(enumerate(R.SALARY_BUCKETS[:-1], 1))):
        expr = F.when(amount < upper, number).otherwise(expr)
    return expr


def bucket_label(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for _, name in R.SALARY_BUCKETS]), number)
