"""Constants and patterns for salary parsing and normalization."""

from __future__ import annotations

# Wordings that mean the salary is not stated.
NOT_DISCLOSED = (
    r"\b(?:competitive|negotiable|undisclosed|not\s+disclosed|not\s+specified"
    r"|depends?\s+on\s+experience|doe|to\s+be\s+discussed|tbd)\b"
)

# Bonus mentions such as "13th month" are no salary figures.
BONUS_MENTION = r"\b[0-9]+\s*(?:st|nd|rd|th)\s+month\b"

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
NUMBER_TOKEN = NUMBER + "[kK]?"
RANGE_SEPARATOR = "-|–|to"

# Period words in the order in which they are tried.
PERIOD_WORDS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    # (period, whole words, substrings)
    (
        "annual",
        ("year", "years", "yr", "yrs", "annum", "annual", "annually", "yearly"),
        ("/yr", "/year", "per annum"),
    ),
    ("hourly", ("hour", "hours", "hr", "hrs", "hourly"), ("/hr", "/hour", "per hour")),
    ("daily", ("day", "days", "daily"), ("/day", "per day")),
    ("weekly", ("week", "weeks", "weekly"), ("/week", "per week")),
    ("monthly", ("month", "months", "mo", "monthly"), ("/mo", "/month", "per month")),
)

#: beginnings that every period wording above contains
PERIOD_HINT = "y(?:ea)?r|ann|h(?:ou)?r|da|week|mo"

# Currency marks in the order in which they are tried (text is upper case).
CURRENCY_MARKS: tuple[tuple[str, str], ...] = (
    ("PHP", r"₱|PHP|\bP\s*[0-9,]"),
    ("USD", r"USD|\$"),
    ("EUR", r"EUR|€"),
    ("GBP", r"GBP|£"),
    ("JPY", r"JPY|¥"),
)
DEFAULT_CURRENCY = "PHP"

# Bands for guessing the pay period of a bare figure.
DAILY_CEILING = 1000
WEEKLY_CEILING = 5000
MONTHLY_FLOOR = 8000
OUTLIER_CEILING = 1_000_000

# Working time used for monthly equivalents.
DAYS_PER_MONTH = 22
HOURS_PER_DAY = 8
WEEKS_PER_YEAR = 52

# Salary histogram; upper bounds are exclusive.
SALARY_BUCKETS: tuple[tuple[int | None, str], ...] = (
    (10_000, "Below ₱10K"),
    (20_000, "₱10K–₱19K"),
    (30_000, "₱20K–₱29K"),
    (40_000, "₱30K–₱39K"),
    (50_000, "₱40K–₱49K"),
    (75_000, "₱50K–₱74K"),
    (100_000, "₱75K–₱99K"),
    (None, "₱100K+"),
)

PERIOD_LABELS: dict[str, str] = {
    "daily": "/day",
    "weekly": "/week",
    "monthly": "/month",
    "annual": "/year",
    "hourly": "/hour",
}
