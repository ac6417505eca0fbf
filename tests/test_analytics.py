from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import jobmarket as jm
from jobmarket.functions.industry import DERIVED, with_industry
from jobmarket.plans import explorer
from jobmarket.plans.explorer import safe_limit, safe_page
from jobmarket.registry.tables import jobs_view
from jobmarket.schemas import JOBS, LISTING_COLUMNS

SF = "/root/testdata/sf0.001"


def table(spark, *rows):
    data = []
    for i, row in enumerate(rows, 1):
        row = {"id": i, "salary_disclosed": row.get("salary_amount_monthly") is not None, **row}
        data.append(tuple(row.get(f.name) for f in JOBS))
    return spark.createDataFrame(data, JOBS)


def values(df):
    return [tuple(r) for r in df.collect()]


def paid(category, amount, **more):
    return {"career_category": category, "salary_amount_monthly": Decimal(amount), **more}


def test_blank_labels_stay_apart(spark):
    jobs = table(spark, *[{"career_category": c} for c in (None, "", " ", "x")])
    assert values(jm.get_categories(jobs)) == [("Uncategorized", 1)] * 3 + [("x", 1)]
    assert values(jm.analytics_summary(jobs)) == [(4, 0, 1, 0, 0, 0)]


def test_ties_and_limits(spark):
    jobs = table(spark, *[{"company": c} for c in ("b", "b", "a", "a", "c", " ", None)])
    assert values(jm.get_companies(jobs, 2)) == [("a", 2), ("b", 2)]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            jm.get_companies(jobs, bad)
    plan = jm.get_companies(jobs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan


def test_average_rounds_half_up(spark):
    jobs = table(spark, paid("a", "2.00"), paid("a", "3.00"), paid("b", "2.00"), paid("b", "2.99"), paid("z", "0.00"))
    assert values(jm.get_salary_by_category(jobs)) == [("a", Decimal(3), 2), ("b", Decimal(2), 2)]
    empty = values(jm.get_salary_summary(jobs.where("false")))
    assert empty == [(None, None, None, 0)]


def test_distribution_edges(spark):
    jobs = table(spark, *[paid("a", a) for a in ("9999.99", "10000.00", "99999.99", "100000.00", "74999.00")])
    assert values(jm.get_salary_distribution(jobs)) == [
        ("Below ₱10K", 1), ("₱10K–₱19K", 1), ("₱50K–₱74K", 1), ("₱75K–₱99K", 1), ("₱100K+", 1),
    ]


def test_filters(spark):
    jobs = table(
        spark,
        {"career_category": "Dev", "region": "NCR", "job_title": "web developer", "employment_type": "Permanent"},
        {"career_category": "Dev 100%", "region": "ncr", "job_title": "cook", "industry": "Food"},
    )
    assert jm.Filters(region="NCR", category="").apply(jobs).count() == 1
    assert jm.Filters(industry="Information Technology").apply(jobs).count() == 1
    assert jm.JobFilters(region="cr").apply(jobs).count() == 2
    assert jm.JobFilters(search="DEV_100").apply(jobs).count() == 1
    assert jm.JobFilters(search="DEV_100", literal=True).apply(jobs).count() == 0
    assert jm.JobFilters(career_category="100%", literal=True).apply(jobs).count() == 1
    assert jm.JobFilters(industry="foo").apply(jobs).count() == 1


def test_stored_industry_is_pushed_down(spark, tmp_path):
    jobs = table(spark, {"job_title": "nurse"}, {"job_title": "bank clerk"})
    with_industry(jobs).write.parquet(str(tmp_path / "jobs"))
    stored = spark.read.parquet(str(tmp_path / "jobs"))
    found = jm.Filters(industry="Healthcare").apply(stored).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo({DERIVED},Healthcare)" in plan and "ReadSchema: struct<id:bigint,industry_derived:string>" in plan
    assert values(found) == [(1,)]


def test_rates_shares_and_labels(spark):
    jobs = table(spark, *[{"salary_disclosed": i < 1} for i in range(8)])
    assert jm.disclosure_rate(jm.analytics_summary(jobs)).first().disclosure_rate == 13  # 12.5
    assert jm.disclosure_rate(jm.analytics_summary(jobs.where("false"))).first().disclosure_rate == 0
    df = spark.createDataFrame([(0.0,), (None,), (-1.0,), (1234.5,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(jm.currency_label("v")).collect()] == ["N/A", "N/A", "N/A", "₱1,235", "N/A"]
    types = table(spark, *[{"employment_type": t} for t in ("a", "a", None, "b")])
    assert [(r.employment_type, r.total, r.share) for r in jm.employment_share(jm.get_employment_types(types)).collect()] == [
        ("a", 4, 0.5), ("Not specified", 4, 0.25), ("b", 4, 0.25),
    ]


def test_salary_labels(spark):
    def row(amount, used, stated=None, estimated=False, disclosed=True):
        return {
            "salary_amount": amount and Decimal(amount), "salary_period_used": used, "salary_period": stated,
            "salary_period_estimated": estimated, "salary_disclosed": disclosed,
        }

    jobs = table(spark, row("1234.50", "daily", estimated=True), row("30000.00", "monthly"), row("6000.00", None),
                 row("99.00", "", "hourly"), row(None, "daily"), row("5.00", "daily", disclosed=False))
    got = [r.salary for r in jm.display_rows(jm.list_jobs(jobs)).orderBy("id").collect()]
    assert got == ["₱1,234.5/day (est.)", "₱30,000/month", "₱6,000", "₱99/hour", "Not disclosed", "Not disclosed"]


def test_listing_pages(spark):
    jobs = table(spark, *[{"job_title": str(i)} for i in range(45)])
    assert [r.id for r in jm.list_jobs(jobs, page=3).collect()] == [5, 4, 3, 2, 1]
    assert [r.id for r in jm.list_jobs(jobs, page=3, limit=2, offset=1).collect()] == [44, 43]
    assert tuple(jm.list_jobs(jobs).columns) == LISTING_COLUMNS
    assert values(jm.page_window(jm.get_job_count(jobs), 3)) == [(45, 41, 45, 3)]
    assert values(jm.page_window(jm.get_job_count(jobs.where("false")))) == [(0, 0, 0, 1)]
    assert [safe_page(p) for p in (None, "x", float("nan"), 0, 2.9, "3")] == [1, 1, 1, 1, 2, 3]
    assert [safe_limit(p) for p in (None, float("inf"), -1, 500, 7.5)] == [20, 20, 20, 100, 7]
    assert "TakeOrderedAndProject" in jm.list_jobs(jobs, page=2)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("filters", [jm.Filters(), jm.Filters(region="ASIA"), jm.Filters(category="none such")])
def test_dashboard_equals_single_queries(spark, filters):
    jobs = jobs_view(spark, SF)
    panels = jm.dashboard(jobs, filters)
    single = {
        "summary": jm.analytics_summary(jobs, filters),
        "categories": jm.get_categories(jobs, 10, filters),
        "locations": jm.get_locations(jobs, 10, filters),
        "regions": jm.get_regions(jobs, filters),
        "companies": jm.get_companies(jobs, 10, filters),
        "job_titles": jm.get_job_titles(jobs, 10, filters),
        "industries": jm.get_industries(jobs, 10, filters),
        "employment_types": jm.get_employment_types(jobs, filters),
        "salary_summary": jm.get_salary_summary(jobs, filters),
        "salary_by_category": jm.get_salary_by_category(jobs, 10, filters),
        "salary_distribution": jm.get_salary_distribution(jobs, filters),
        "salary_range_by_category": jm.get_salary_range_by_category(jobs, 10, filters),
        "filter_options": jm.get_filter_options(jobs),
    }
    assert panels.keys() == single.keys()

    def rounded(df):
        return [tuple(round(v, 4) if isinstance(v, Decimal) else v for v in row) for row in values(df)]

    for name, df in single.items():
        assert panels[name].columns == df.columns, name
        assert rounded(panels[name]) == rounded(df), name


def test_chart_shapes(spark):
    jobs = jobs_view(spark, SF)
    assert jm.chart_data(jm.get_salary_by_category(jobs)).columns == ["name", "average", "jobs"]
    assert jm.chart_data(jm.get_salary_range_by_category(jobs)).columns == ["name", "minimum", "maximum", "average"]
    assert jm.chart_data(jm.get_salary_distribution(jobs)).columns == ["name", "jobs"]
    assert jm.chart_data(jm.get_employment_types(jobs)).columns == ["name", "value"]
    assert values(jm.filter_list(jobs, "regions").select(F.min("value")))[0][0] == "AFRICA"


@pytest.mark.parametrize("in_range", [7, 64, 1 << 16])
def test_deep_pages(spark, monkeypatch, in_range):
    """Pages from counted ranges of ids hold the rows that sorting everything gives."""
    monkeypatch.setattr(explorer, "ID_RANGE", in_range)
    jobs = jobs_view(spark, SF).where("id % 3 <> 1")
    wanted = jm.JobFilters(region="asi")
    ids = [r.id for r in wanted.apply(jobs).select("id").orderBy(F.desc("id")).collect()]
    pages = {start: jm.list_jobs(jobs, wanted, offset=start, limit=30) for start in (0, 29, 100, len(ids) - 10, len(ids) + 5)}
    monkeypatch.setattr(explorer, "DEEP", 0)
    for start, plain in pages.items():
        deep = jm.list_jobs(jobs, wanted, offset=start, limit=30)
        assert deep.columns == plain.columns
        assert [r.id for r in deep.collect()] == [r.id for r in plain.collect()] == ids[start : start + 30]
    assert jm.list_jobs(jobs.limit(0), offset=5000).count() == 0


def test_deep_page_of_a_stored_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(explorer, "ID_RANGE", 50)
    path = str(tmp_path / "jobs")
    jobs_view(spark, SF).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    jobs = spark.read.parquet(path)
    page = jm.list_jobs(jobs, page=13, limit=100)
    assert [r.id for r in page.collect()] == [r.id for r in jobs.select("id").orderBy(F.desc("id")).offset(1200).limit(100).collect()]
