"""Every registered query against its SQL counterpart on the smallest data set."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from jobmarket.registry.stored import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = check.rows(df.columns, df.collect())
    assert got
    sql = entry.oracle_sql()[name]
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == check.rows(columns, cursor.fetchall())


def test_fuzzy_query_equals_plain_scoring(spark):
    from jobmarket.functions.titles import token_set_score
    from jobmarket.rules.taxonomy import DEFAULT_TAXONOMY

    for row in entry.queries()["title_fuzzy"](spark, SF).collect():
        if row.title_match_method and row.title_match_method.startswith("fuzzy"):
            words = frozenset("".join(c if c.isalnum() else " " for c in row.job_title.lower()).split())
            scored = [(token_set_score(words, frozenset(p.split())), -i, r) for i, (p, r) in enumerate(DEFAULT_TAXONOMY.fuzzy)]
            score, _, rank = max(scored)
            assert row.title_match_method == f"fuzzy({int(score)})"
            assert row.career_category == DEFAULT_TAXONOMY.categories[rank]


def test_entry(spark):
    assert entry.entry(spark).columns == ["career_category", "average_salary", "job_count"]
