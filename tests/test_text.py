import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmarket.functions import text as X
from jobmarket.functions.industry import derived_industry


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_covers_all_whitespace(spark):
    values = ["\t a b \n", " x　", "   ", "", None]
    assert column(spark, values, X.strip("c")) == [v and v.strip() for v in values]


def test_placeholder(spark):
    values = ["Job type not specified", "Educ level NOT  specified", "4-NOT SPECIFIED", " ", None, " Permanent "]
    assert column(spark, values, X.clean_placeholder("c")) == [None] * 5 + ["Permanent"]


def test_first_employer(spark):
    rows = [(None, "", "org", None), ("  ", "emp", None, None), (None, " emp ", "org", None), (None,) * 4]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert [r[0] for r in df.select(X.first_employer("a", "b", "c", "d")).collect()] == ["org", None, "emp", None]


def test_title_case(spark):
    values = ["taiwan, r.o.c.", "o'brien ñandú", "CEBU CITY 2nd", ""]
    assert column(spark, values, X.title_case("c")) == [v.title() for v in values[:2]] + ["Cebu City 2Nd", ""]


def test_urls_share_a_key(spark):
    urls = ["https://x/a/?utm=1#t", "https://X/a", " https://x/a/ ", "https://x/a#q?z"]
    key = X.dedup_key("c", F.lit("A"), F.lit("B"), F.lit("C"))
    want = hashlib.md5(b"url|https://x/a").hexdigest()
    assert column(spark, urls, key) == [want] * 4
    fallback = hashlib.md5("fallback|a|b|c".encode()).hexdigest()
    assert column(spark, ["", None, "  "], key) == [fallback] * 3
    assert column(spark, ["?x"], key) == [hashlib.md5(b"url|").hexdigest()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abAB:/?#. ", max_size=15), min_size=20, max_size=40))
def test_normalized_url(spark, urls):
    def plain(u):
        return u.strip().lower().split("?")[0].split("#")[0].rstrip("/")

    once = column(spark, urls, X.normalize_url("c"))
    assert once == [plain(u) for u in urls]
    assert column(spark, once, X.normalize_url("c")) == [plain(u) for u in once]


def test_row_text(spark):
    values = ["T | S | E | L | ED | ET | Posted on 8/29/2026", "T|E||L|posted on  1/2/2025", "Posted on 3/4/2025", "", None,
              "a|b|c|d|e|f|g|h"]
    got = [tuple(r) for r in column(spark, values, X.parse_row_text("c"))]
    assert got == [
        ("T", "S", "E", "L", "ED", "ET", "8/29/2026"),
        ("T", "E", "L", None, None, None, "1/2/2025"),
        (None,) * 6 + ("3/4/2025",),
        (None,) * 7,
        (None,) * 7,
        ("a", "b", "c", "d", "e", "f", None),
    ]


def test_absolute_url_and_dates(spark):
    assert column(spark, ["http://y/z", "/p", "p"], X.absolute_url("c", "https://b")) == ["http://y/z", "https://b/p", "https://b/p"]
    got = column(spark, ["8/29/2026", "2026-08-29", "nope", None, "13/45/2026"], X.parse_date("c").cast("string"))
    assert got == ["2026-08-29", "2026-08-29", None, None, None]
    got = column(spark, ["2026-08-29T16:51:25.313737+00:00", "x"], X.parse_timestamp("c").cast("string"))
    assert got == ["2026-08-29 16:51:25.313737", None]


def test_industry(spark):
    rows = [
        (" Mining ", "nurse", None, " Mining "), (None, "Bank teller", None, None), ("", "x", "on the embankment", None),
        (None, "Sales Associate", None, None), (None, None, None, None), ("  ", "store help", "", None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, industry string, job_title string, description string")
    got = [r[0] for r in df.orderBy("i").select(derived_industry()).collect()]
    assert got == ["Mining", "Banking & Finance", "Banking & Finance", "Sales & Marketing", "Other", "Retail"]
