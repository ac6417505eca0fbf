from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmarket.functions import salary as S

NONE = (None, None, None, False, None)
PARSED = [
    ("P30,000/month", (30000, 30000, "monthly", True, "PHP")),
    ("30K monthly", (30000, 30000, "monthly", True, "PHP")),
    ("P360,000/year", (360000, 360000, "annual", True, "PHP")),
    ("P15,000 - P20,000/month", (15000, 20000, "monthly", True, "PHP")),
    ("Competitive salary", NONE),
    ("600", (600, 600, None, True, "PHP")),
    ("15-20k", (15000, 20000, None, True, "PHP")),
    ("15k-20k", (15000, 20000, None, True, "PHP")),
    ("P20,000/month + 13th month pay", (20000, 20000, "monthly", True, "PHP")),
    ("P18,000 + 14th month bonus", (18000, 18000, None, True, "PHP")),
    ("P25,000", (25000, 25000, None, True, "PHP")),
    ("0", NONE),
    ("P0/month", NONE),
    ("₱577.50", (577.5, 577.5, None, True, "PHP")),
    ("15,000-20K", (20000, 15000000, None, True, "PHP")),
    ("USD 500 per week", (500, 500, "weekly", True, "USD")),
    ("$12/hr", (12, 12, "hourly", True, "USD")),
    ("€9 hourly", (9, 9, "hourly", True, "EUR")),
    ("20000 monthly, 5 days", (5, 20000, "daily", True, "PHP")),
    ("8000 to 9000", (8000, 9000, None, True, "PHP")),
    ("8000 – 9000 per annum", (8000, 9000, "annual", True, "PHP")),
    ("Salary not specified", NONE),
    ("to  be discussed 5000", NONE),
    ("no figure", NONE),
    ("\t", NONE),
    (None, NONE),
]


def parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return S.parse_salary(df, F.coalesce("t", F.lit("")))


def test_parse(spark):
    rows = parse(spark, [t for t, _ in PARSED]).orderBy("i").collect()
    for row, (text, want) in zip(rows, PARSED):
        assert tuple(row[c] for c in S.PARSED) == want, text


def test_bands_and_monthly(spark):
    cases = [
        (600.0, None, "daily", "daily", True, "13200.00", False),
        (1000.0, None, "daily", "daily", True, "22000.00", False),
        (1000.01, None, "weekly", "weekly", True, "4333.38", False),
        (3000.0, "", "weekly", "weekly", True, "13000.00", False),
        (5000.0, None, "weekly", "weekly", True, "21666.67", False),
        (5000.01, None, "ambiguous", None, False, None, False),
        (7999.99, None, "ambiguous", None, False, None, False),
        (8000.0, None, "monthly", "monthly", True, "8000.00", False),
        (100.0, "hourly", "hourly", "hourly", False, "17600.00", False),
        (360000.0, "annual", "annual", "annual", False, "30000.00", False),
        (1000000.0, None, "monthly", "monthly", True, "1000000.00", False),
        (1000000.01, None, "monthly", "monthly", True, "1000000.01", True),
        (None, None, None, None, False, None, False),
    ]
    df = spark.createDataFrame(
        [(i, c[0], c[0], c[1], c[0] is not None) for i, c in enumerate(cases)],
        "i int, salary_min double, salary_max double, salary_period string, salary_disclosed boolean",
    )
    for row, case in zip(S.normalize_salary(df).orderBy("i").collect(), cases):
        assert (
            row.salary_period_inferred, row.salary_period_used, row.salary_period_estimated,
            row.salary_amount_monthly, row.salary_outlier,
        ) == (case[2], case[3], case[4], case[5] and Decimal(case[5]), case[6]), case


def test_one_sided_midpoint(spark):
    df = spark.createDataFrame([(10.0, None), (None, 20.0), (10.0, 20.0), (None, None)], "a double, b double")
    rows = df.select(S.midpoint(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [10, 20, 15, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("0123456789,.kKP-to $/moyrhdaw\n", max_size=20), min_size=20, max_size=60))
def test_invariants(spark, texts):
    rows = S.normalize_salary(parse(spark, texts)).collect()
    for r in rows:
        assert r.salary_disclosed == (r.salary_min is not None) == (r.currency is not None)
        if r.salary_disclosed and r.salary_amount is not None:
            assert 0 < r.salary_min <= r.salary_max
            assert r.salary_min - 0.01 <= float(r.salary_amount) <= r.salary_max + 0.01
            assert (r.salary_period_used is None) == (r.salary_period_inferred == "ambiguous")


def test_stays_in_the_jvm(spark):
    plan = S.normalize_salary(parse(spark, ["1"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
