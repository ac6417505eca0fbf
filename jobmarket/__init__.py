"""Job-posting analytics on Spark DataFrames."""

from jobmarket.operators.collect import (
    collect_new, crawl_stop, merge_details, only_unseen, page_statistics, union_seen,
    with_provenance,
)
from jobmarket.operators.dedup import keep_first, keep_latest
from jobmarket.operators.locations import (
    build_location_lookup, location_dimension, lookup_statistics, standardize_locations,
)
from jobmarket.operators.quality import merged_report, partial_report, quality_report
from jobmarket.operators.standardize import clean_records, prepare
from jobmarket.operators.upsert import evolve, import_statistics, split_valid, upsert_jobs
from jobmarket.plans.analytics import (
    analytics_summary, chart_data, currency_label, disclosure_rate, employment_share,
    filter_list, get_categories, get_companies, get_employment_types, get_filter_options,
    get_industries, get_job_titles, get_locations, get_regions, get_salary_by_category,
    get_salary_distribution, get_salary_range_by_category, get_salary_statistics,
    get_salary_summary,
)
from jobmarket.plans.dashboard import dashboard, panel_cube
from jobmarket.plans.explorer import (
    display_rows, explorer_options, get_job_count, list_jobs, page_window,
)
from jobmarket.plans.filters import Filters, JobFilters
from jobmarket.plans.run import (
    State, clean_table, import_landing, report_table, run_clean, run_collection, run_import, run_landing, uncategorized_table,
)
from jobmarket.rules.taxonomy import build_taxonomy
from jobmarket import schemas
from jobmarket.session import build_session
