import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmarket.functions.titles import (
    SCORE_CUTOFF, Vocabulary, common_subsequence, standardize_titles, token_set_score,
    uncategorized_titles,
)
from jobmarket.rules.taxonomy import CATEGORIES, DEFAULT_TAXONOMY, build_taxonomy

TITLES = [
    ("BUSINESS DEVELOPMENT/MARKETING SPECIALIST", "Business Development", "exact"),
    ("THIRD MARINE ENGINEER", "Engineering", "exact"),
    ("SHIP ELECTRICIAN", "Skilled Trades", "exact"),
    ("ASSISTANT FOOD AND BEVERAGE MANAGER", "Management", "exact"),
    ("COMPUTER AIDED DESIGN (CAD) OPERATOR", "Architecture & Design", "exact"),
    ("DOMESTIC HELPER", "General Labor", "exact"),
    ("HOUSEKEEPER (PRIVATE)", "Food & Hospitality", "exact"),
    ("SECURITY GUARD", "Cybersecurity", "exact"),
    ("Senior Sales & Marketing Staff", "Marketing Specialist", "exact"),
    ("QUALITY CONTROL/ASSURANCE OFFICER", "QA / Tester", "exact"),
    ("Jr. Full-Stack Developer", "Full Stack Developer", "exact"),
    ("helpdesk", "IT Support", "exact"),
    ("Call Centre Agent", "Customer Service", "exact"),
    ("Agriculturist", "Agriculture", "exact"),
    ("HYDRAULIC BACKHOE EXCAVATOR OPERATOR", "Manufacturing / Production", "exact"),
    ("EXPORT/IMPORT OFFICER", "Administrative", "fuzzy(100)"),
    ("CREDIT/COLLECTION SPECIALIST", "Finance", "fuzzy(89)"),
    ("TAX SPECIALIST I (GOV)", "IT Support", "fuzzy(86)"),
    ("OPERATOR", "Systems / IT", "fuzzy(100)"),
    ("Accountnt", "Accountant", "fuzzy(94)"),
    ("Senior", "Uncategorized", None),
    ("SHIP FITTER", "Uncategorized", None),
    ("TRAVEL CONSULTANT", "Uncategorized", None),
    ("PRODUCTION/PLANNING CLERK", "Uncategorized", None),
    ("FRONT DESK OFFICER", "Uncategorized", None),
    ("HAIR STYLIST", "Uncategorized", None),
]


def test_taxonomy_size():
    assert len(DEFAULT_TAXONOMY.categories) == len(CATEGORIES) == 53
    assert len(DEFAULT_TAXONOMY.exact) == 567
    assert len(DEFAULT_TAXONOMY.fuzzy) == 551
    assert DEFAULT_TAXONOMY.longest == 5


def test_own_tables():
    t = build_taxonomy(
        ("A", "B"),
        (("B", "cat dog"), ("A", "cats dog"), ("A", "cat dog"), ("B", "help desk")),
        (("A", "pre"),),
        (("B", "cat dog"), ("A", "odd - s")),
    )
    assert t.exact == {"cats dog": 0, "cat dog": 0, "help desk": 1} and t.prefixes == (("pre", 0),)
    assert t.fuzzy == (("odd - s", 0), ("cat dog", 1))


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in TITLES], "job_title string")
    got = {r.job_title: (r.career_category, r.title_match_method) for r in standardize_titles(df).collect()}
    assert got == {t: (c, m) for t, c, m in TITLES}


def test_blank_titles(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t ",), (" Nurse ",)], "job_title string")
    rows = [tuple(r) for r in standardize_titles(df).collect()]
    assert rows == [("", "Uncategorized", None)] * 3 + [("Nurse", "Healthcare", "exact")]


def test_filter_on_category_after_join(spark):
    left = spark.createDataFrame([(1, "nurse"), (2, "xyz")], "id int, t string")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    df = left.join(right, "id").selectExpr("id", "t || ' ' || s AS job_title")
    rows = uncategorized_titles(standardize_titles(df)).collect()
    assert [tuple(r) for r in rows] == [("xyz b", 1)]


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], (previous + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == slow_subsequence(a, b)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abcde", min_size=1, max_size=6), max_size=5), st.sets(st.text("abcde", min_size=1, max_size=6), max_size=5))
def test_score_is_symmetric_and_cutoff_only_hides(a, b):
    a, b = frozenset(a), frozenset(b)
    score = token_set_score(a, b)
    assert score == pytest.approx(token_set_score(b, a)) and 0 <= score <= 100
    assert token_set_score(a, b, 84) == (score if score >= 84 else 0)


def test_vocabulary_equals_scoring_everything():
    vocabulary = Vocabulary(DEFAULT_TAXONOMY)

    def everything(title):
        found, top = None, SCORE_CUTOFF
        for phrase, rank in DEFAULT_TAXONOMY.fuzzy:
            score = token_set_score(frozenset(title.split()), frozenset(phrase.split()))
            if score >= top and (found is None or score > top):
                found, top = rank, score
        return (None, None) if found is None else (DEFAULT_TAXONOMY.categories[found], int(top))

    rng = random.Random(7)
    phrases = [p for p, _ in DEFAULT_TAXONOMY.fuzzy]
    for _ in range(250):
        letters = list(rng.choice(phrases))
        for _ in range(rng.randint(0, 3)):
            spot = rng.randrange(len(letters))
            if rng.random() < 0.5 and len(letters) > 1:
                letters.pop(spot)
            else:
                letters.insert(spot, rng.choice("abcdefg "))
        title = " ".join("".join(letters).split() + rng.choice(phrases).split()[: rng.randint(0, 1)])
        assert vocabulary.best(title) == everything(title), title
