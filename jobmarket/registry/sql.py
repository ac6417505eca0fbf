"""SQL counterparts of the registered queries (DuckDB dialect)."""

from __future__ import annotations

from jobmarket.rules.industry import INDUSTRY_KEYWORDS, OTHER_INDUSTRY
from jobmarket.rules.places import OVERSEAS_CONTINENTS, OVERSEAS_COUNTRIES
from jobmarket.rules.taxonomy import DEFAULT_TAXONOMY

ORDERS = """
o AS MATERIALIZED (
  SELECT *, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS whole,
         'Town ' || (o_orderkey % 60) AS town
  FROM orders
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
)"""

TITLE = """CASE k % 16
  WHEN 0 THEN p_name WHEN 1 THEN 'Senior Data Analyst' WHEN 2 THEN 'SALES ASSOCIATE - ' || p_name
  WHEN 3 THEN 'Software Engineer (' || p_name || ')' WHEN 4 THEN 'Jr. Accountant'
  WHEN 5 THEN 'Help Desk / ' || p_name WHEN 6 THEN 'Store Manager & Cashier' WHEN 7 THEN 'nurse ' || p_name
  WHEN 8 THEN ' Warehouse helper ' WHEN 9 THEN ' ' WHEN 11 THEN 'Agriculturist ' || p_name
  WHEN 12 THEN 'Production Machine Operator' WHEN 13 THEN 'Teacher, ' || p_name
  WHEN 14 THEN 'principal' WHEN 15 THEN upper(p_name) END"""

POSTINGS = ORDERS + f""",
postings AS (
  SELECT k AS posting_id, {TITLE} AS job_title,
  CASE k % 12
    WHEN 0 THEN 'Salary not specified' WHEN 1 THEN 'P' || (whole // 500) WHEN 2 THEN '' || (whole // 100)
    WHEN 3 THEN 'P' || (whole // 1000) || ',' || lpad('' || (whole % 1000), 3, '0') || '/year'
    WHEN 4 THEN (whole // 10000 + 1) || 'k monthly' WHEN 5 THEN 'P' || (whole // 20) || ' - P' || (whole // 10)
    WHEN 6 THEN (whole // 5000 + 1) || '-' || (whole // 2500 + 2) || 'k' WHEN 7 THEN '0'
    WHEN 8 THEN 'USD ' || (whole // 1000 + 1) || ' per week'
    WHEN 9 THEN (whole // 100) || ' to ' || (whole // 50) || ' + 13th month pay'
    WHEN 10 THEN 'Competitive salary' END AS salary_text,
  CASE WHEN k % 12 = 11 THEN '900' END AS salary,
  CASE WHEN k % 23 = 0 THEN '  ' WHEN k % 23 = 1 THEN '' END AS company,
  CASE WHEN k % 29 <> 0 THEN c_name ELSE '' END AS employer,
  CASE WHEN k % 31 <> 0 THEN c_name || ' Group' END AS organization,
  CASE k % 12
    WHEN 0 THEN 'City Of ' || town || ', ' || n_name WHEN 1 THEN town WHEN 2 THEN n_name
    WHEN 3 THEN 'Barangay 5, ' || town || ' City, ' || n_name
    WHEN 4 THEN 'City Of ' || n_name || ', Ncr, Fourth District' WHEN 5 THEN 'Work from home'
    WHEN 6 THEN 'EUROPE' WHEN 7 THEN 'taiwan, r.o.c.' WHEN 8 THEN 'Nowhere ' || (k % 7) WHEN 9 THEN ''
    WHEN 11 THEN upper(town || ' (capital), ' || n_name) END AS location,
  o_orderpriority AS employment_type,
  CASE WHEN k % 9 = 0 THEN 'Educ level not specified' ELSE p_type END AS education_requirement,
  strftime(o_orderdate, '%-m/%-d/%Y') AS date_posted,
  CASE WHEN k % 10 = 0 THEN ''
    ELSE 'https://jobs.example.com/' || (k // 3) || CASE WHEN k % 3 = 0 THEN '/?utm=1#t' ELSE '' END END AS job_url,
  'orders' AS source, o_orderdate
  FROM o
)"""

JOBS = ORDERS + f""",
jobs AS (
  SELECT k + 1 AS id, {TITLE} AS job_title,
  CASE k % 37 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE c_mktsegment END AS career_category,
  'exact' AS title_match_method,
  CASE k % 41 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS company,
  CASE k % 43 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE n_name END AS location,
  CASE k % 47 WHEN 0 THEN NULL ELSE r_name END AS region,
  CASE WHEN k % 4 <> 0 THEN floor(o_totalprice * 4) / 4 END AS salary_amount,
  CASE k % 6 WHEN 0 THEN 'monthly' WHEN 1 THEN '' END AS salary_period,
  CAST(NULL AS VARCHAR) AS salary_period_inferred,
  CASE WHEN k % 4 <> 0 AND k % 11 <> 0
    THEN floor(o_totalprice / 9) * CASE WHEN k % 7 = 0 THEN 3 ELSE 1 END END AS salary_amount_monthly,
  CASE WHEN k % 11 <> 0 THEN CASE k % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'hourly'
    WHEN 3 THEN 'monthly' WHEN 4 THEN 'annual' END END AS salary_period_used,
  k % 3 = 0 AS salary_period_estimated, k % 4 <> 0 AS salary_disclosed,
  CASE WHEN k % 4 <> 0 THEN 'PHP' END AS currency, CAST(o_orderdate AS DATE) AS date_posted,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS employment_type,
  p_type AS education_requirement,
  CASE k % 5 WHEN 0 THEN 'Trade ' || c_mktsegment WHEN 1 THEN '' END AS industry,
  CASE k % 3 WHEN 0 THEN 'We need a driver for ' || p_name WHEN 1 THEN p_type END AS description,
  'orders' AS source, 'https://jobs.example.com/' || k AS job_url, o_orderdate AS collected_at,
  o_orderstatus
  FROM o
)"""

_TEXT = "lower(concat_ws(' ', coalesce(job_title, ''), coalesce(description, '')))"
INDUSTRY = (
    "coalesce(nullif(trim(industry), ''), CASE "
    + " ".join(
        f"WHEN regexp_matches({_TEXT}, '{'|'.join(words)}') THEN '{name}'" for name, words in INDUSTRY_KEYWORDS
    )
    + f" ELSE '{OTHER_INDUSTRY}' END)"
)
JOBS_INDUSTRY = JOBS + f""",
ji AS (SELECT *, {INDUSTRY} AS derived FROM jobs)"""

PAID = "salary_disclosed AND salary_amount_monthly > 0"
BUCKET = """CASE WHEN salary_amount_monthly < 10000 THEN 'Below ₱10K' WHEN salary_amount_monthly < 20000 THEN '₱10K–₱19K'
  WHEN salary_amount_monthly < 30000 THEN '₱20K–₱29K' WHEN salary_amount_monthly < 40000 THEN '₱30K–₱39K'
  WHEN salary_amount_monthly < 50000 THEN '₱40K–₱49K' WHEN salary_amount_monthly < 75000 THEN '₱50K–₱74K'
  WHEN salary_amount_monthly < 100000 THEN '₱75K–₱99K' ELSE '₱100K+' END"""
LABELS = {"career_category": "Uncategorized", "location": "Unknown", "region": "Unknown", "employment_type": "Not specified"}
SOME = "region = 'ASIA' AND employment_type = '1-URGENT'"


def _panel(column: str, limit: int | None = None, where: str = "true") -> str:
    shown = f"coalesce(nullif(trim({column}), ''), '{LABELS[column]}')" if column in LABELS else column
    filled = "" if column in LABELS else f" AND {column} IS NOT NULL AND trim({column}) <> ''"
    tail = f" ORDER BY job_count DESC, {column} LIMIT {limit}" if limit else ""
    return (
        f"SELECT {column}, job_count FROM (SELECT {shown} AS {column}, job_count FROM "
        f"(SELECT {column}, count(*) AS job_count FROM jobs WHERE {where}{filled} GROUP BY {column})){tail}"
    )


def _salaries(limit: int = 10, where: str = "true") -> str:
    return (
        "SELECT * FROM (SELECT coalesce(nullif(trim(v), ''), 'Uncategorized') AS career_category, salary_min, "
        "salary_max, average_salary, job_count FROM (SELECT career_category AS v, min(salary_amount_monthly) AS "
        "salary_min, max(salary_amount_monthly) AS salary_max, round(sum(salary_amount_monthly) / count(*)) AS "
        f"average_salary, count(*) AS job_count FROM jobs WHERE {where} AND {PAID} GROUP BY career_category)) "
        f"ORDER BY job_count DESC, career_category LIMIT {limit}"
    )


SUMMARY = """SELECT count(*) AS total_jobs, count(DISTINCT nullif(trim(company), '')) AS total_companies,
  count(DISTINCT nullif(trim(career_category), '')) AS total_categories,
  count(DISTINCT nullif(trim(location), '')) AS total_locations,
  count(DISTINCT nullif(trim(region), '')) AS total_regions,
  count(*) FILTER (WHERE salary_disclosed) AS jobs_with_salary FROM """

INDUSTRIES = "SELECT derived AS industry, count(*) AS job_count FROM ji GROUP BY derived"
OPTIONS = """SELECT DISTINCT facet, value FROM (
  SELECT 'categories' AS facet, career_category AS value FROM ji UNION ALL SELECT 'regions', region FROM ji
  UNION ALL SELECT 'industries', derived FROM ji UNION ALL SELECT 'employment_types', employment_type FROM ji)
  WHERE value IS NOT NULL AND trim(value) <> ''"""

LABEL = """CASE WHEN salary_amount IS NULL OR NOT salary_disclosed THEN 'Not disclosed' ELSE
  '₱' || format('{:,}', CAST(floor(salary_amount) AS BIGINT)) ||
  CASE CAST((salary_amount - floor(salary_amount)) * 4 AS INT) WHEN 1 THEN '.25' WHEN 2 THEN '.5' WHEN 3 THEN '.75' ELSE '' END ||
  coalesce(CASE coalesce(nullif(salary_period_used, ''), salary_period) WHEN 'daily' THEN '/day' WHEN 'weekly' THEN '/week'
    WHEN 'monthly' THEN '/month' WHEN 'annual' THEN '/year' WHEN 'hourly' THEN '/hour' END
    || CASE WHEN salary_period_estimated THEN ' (est.)' ELSE '' END, '') END"""
DISPLAY = f"""SELECT id, job_title, job_url, coalesce(nullif(career_category, ''), 'Uncategorized') AS career_category,
  coalesce(nullif(company, ''), 'Unknown') AS company, coalesce(nullif(location, ''), 'Unknown') AS location,
  {LABEL} AS salary, coalesce(nullif(employment_type, ''), 'Not specified') AS employment_type FROM """


def _search(word: str) -> str:
    fields = ("job_title", "company", "career_category", "location", "region")
    return "(" + " OR ".join(f"{f} ILIKE '%{word}%'" for f in fields) + ")"


# ------------------------------------------------------------------ salary parsing

SALARY = POSTINGS + r""",
s1 AS (SELECT *, trim(coalesce(nullif(salary_text, ''), nullif(salary, ''), '')) AS t FROM postings),
s2 AS (SELECT *, CASE WHEN NOT regexp_matches(t, '(?i)\b(competitive|negotiable|undisclosed|not\s+disclosed|not\s+specified|depends?\s+on\s+experience|doe|to\s+be\s+discussed|tbd)\b')
         THEN regexp_replace(t, '(?i)\b\d+\s*(st|nd|rd|th)\s+month\b', ' ', 'g') END AS body FROM s1),
s3 AS (SELECT *, nullif(regexp_extract(body, '\d[\d,]*(?:\.\d+)?\s*(?:-|–|to)\s*\d[\d,]*(?:\.\d+)?(?:\s*[kK])?'), '') AS span,
         regexp_extract_all(body, '\d[\d,]*(?:\.\d+)?[kK]?') AS nums FROM s2),
s4 AS (SELECT *,
  CASE WHEN span IS NOT NULL
    THEN CAST(replace(regexp_extract(span, '^([\d,.]+)', 1), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(span, '[kK]$') THEN 1000 ELSE 1 END
    ELSE CAST(regexp_replace(nums[1], '[,kK]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(nums[1], '[kK]$') THEN 1000 ELSE 1 END END AS a,
  CASE WHEN span IS NOT NULL
    THEN CAST(replace(regexp_extract(span, '([\d,.]+)\s*[kK]?$', 1), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(span, '[kK]$') THEN 1000 ELSE 1 END
    ELSE CAST(regexp_replace(coalesce(nums[2], nums[1]), '[,kK]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(coalesce(nums[2], nums[1]), '[kK]$') THEN 1000 ELSE 1 END END AS b
  FROM s3),
s5 AS (SELECT *, coalesce(least(a, b) > 0, false) AS salary_disclosed FROM s4),
parsed AS (SELECT * EXCLUDE (salary),
  CASE WHEN salary_disclosed THEN round(least(a, b), 2) END AS salary_min,
  CASE WHEN salary_disclosed THEN round(greatest(a, b), 2) END AS salary_max,
  CASE WHEN salary_disclosed THEN CASE
    WHEN regexp_matches(lower(body), '\b(year|years|yr|yrs|annum|annual|annually|yearly)\b|/yr|/year|per annum') THEN 'annual'
    WHEN regexp_matches(lower(body), '\b(hour|hours|hr|hrs|hourly)\b|/hr|/hour|per hour') THEN 'hourly'
    WHEN regexp_matches(lower(body), '\b(day|days|daily)\b|/day|per day') THEN 'daily'
    WHEN regexp_matches(lower(body), '\b(week|weeks|weekly)\b|/week|per week') THEN 'weekly'
    WHEN regexp_matches(lower(body), '\b(month|months|mo|monthly)\b|/mo|/month|per month') THEN 'monthly' END END AS salary_period,
  CASE WHEN salary_disclosed THEN CASE
    WHEN regexp_matches(upper(t), '₱|PHP|\bP\s*[\d,]') THEN 'PHP' WHEN regexp_matches(upper(t), 'USD|\$') THEN 'USD'
    WHEN regexp_matches(upper(t), 'EUR|€') THEN 'EUR' WHEN regexp_matches(upper(t), 'GBP|£') THEN 'GBP'
    WHEN regexp_matches(upper(t), 'JPY|¥') THEN 'JPY' ELSE 'PHP' END END AS currency
  FROM s5),
n1 AS (SELECT *, round((salary_min + salary_max) / 2, 2) AS salary_amount FROM parsed),
n2 AS (SELECT *, salary_amount IS NOT NULL AND salary_amount > 1000000 AS salary_outlier,
  CASE WHEN salary_disclosed THEN coalesce(salary_period, CASE WHEN salary_amount <= 1000 THEN 'daily'
    WHEN salary_amount <= 5000 THEN 'weekly' WHEN salary_amount >= 8000 THEN 'monthly' ELSE 'ambiguous' END) END AS salary_period_inferred
  FROM n1),
n3 AS (SELECT *, coalesce(salary_period, nullif(salary_period_inferred, 'ambiguous')) AS salary_period_used,
  salary_period IS NULL AND coalesce(salary_period_inferred <> 'ambiguous', false) AS salary_period_estimated FROM n2),
paid AS (SELECT *, round(CASE salary_period_used WHEN 'daily' THEN salary_amount * 22 WHEN 'weekly' THEN salary_amount * 52 / 12
  WHEN 'hourly' THEN salary_amount * 176 WHEN 'monthly' THEN salary_amount WHEN 'annual' THEN salary_amount / 12 END, 2) AS salary_amount_monthly
  FROM n3)"""

# ------------------------------------------------------------------------- titles


def _category_case(column: str) -> str:
    phrases: dict[int, list[str]] = {}
    for phrase, rank in DEFAULT_TAXONOMY.exact.items():
        phrases.setdefault(rank, []).append(phrase)
    for prefix, rank in DEFAULT_TAXONOMY.prefixes:
        phrases.setdefault(rank, []).append(prefix + "[a-z0-9]*")
    return (
        "CASE "
        + " ".join(
            rf"WHEN regexp_matches({column}, '\b({'|'.join(phrases[r])})\b') THEN '{DEFAULT_TAXONOMY.categories[r]}'"
            for r in sorted(phrases)
        )
        + " END"
    )


def _words(column: str) -> str:
    plain = (
        rf"regexp_replace(lower(trim(coalesce({column}, ''))), "
        r"'\b(jr\.?|junior|sr\.?|senior|lead|principal|entry[-\s]?level)\b', ' ', 'g')"
    )
    return f"trim(regexp_replace(replace({plain}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


# the derived titles are written so that nothing unmatched comes near a fuzzy match
def _titled(source: str) -> str:
    return (
        f"titled AS (SELECT * EXCLUDE (job_title), trim(coalesce(job_title, '')) AS job_title, "
        f"coalesce(cat, 'Uncategorized') AS career_category, CASE WHEN cat IS NOT NULL THEN 'exact' END AS "
        f"title_match_method FROM (SELECT *, {_category_case('words')} AS cat FROM "
        f"(SELECT *, {_words('job_title')} AS words FROM {source})))"
    )


def _fuzzy() -> str:
    """Titles without a phrase, each held against the whole fuzzy vocabulary.

    The score is stated on its own: word sets from string_split, and the longest common
    subsequence by the textbook table, one row per letter.
    """
    vocabulary = ", ".join(
        f"({i}, '{phrase}', '{DEFAULT_TAXONOMY.categories[rank]}')" for i, (phrase, rank) in enumerate(DEFAULT_TAXONOMY.fuzzy)
    )
    return f"""
open_titles AS (SELECT DISTINCT words, list_distinct(string_split(words, ' ')) AS a FROM titled WHERE cat IS NULL AND words <> ''),
vocabulary AS (SELECT i, category, list_distinct(string_split(phrase, ' ')) AS b FROM (VALUES {vocabulary}) AS v(i, phrase, category)),
compared AS (SELECT words, i, category, list_filter(a, lambda x: list_contains(b, x)) AS shared,
    array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS left_over,
    array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS right_over
  FROM open_titles CROSS JOIN vocabulary),
measured AS (SELECT *, length(left_over) AS la, length(right_over) AS lb, (len(shared) > 0)::BIGINT AS gap,
    coalesce(list_sum(list_transform(shared, lambda x: length(x))), 0)::BIGINT + greatest(len(shared) - 1, 0) AS width FROM compared),
subset AS (SELECT *, 2 * (width + gap) + la + lb AS total, CASE WHEN gap = 1 AND least(la, lb) = 0 THEN 100::DOUBLE
    WHEN gap = 1 THEN 100::DOUBLE - 100::DOUBLE * (1 + least(la, lb)) / (2 * width + 1 + least(la, lb)) ELSE 0 END AS part FROM measured),
tabled AS (SELECT *, CASE WHEN part < 100 AND 100::DOUBLE - 100::DOUBLE * abs(la - lb) / total >= 83 THEN list_reduce(
    list_transform(range(1, la + 1), lambda p: list_transform(range(1, lb + 1), lambda q: (left_over[p] = right_over[q])::BIGINT)),
    lambda above, equal: list_transform(range(1, lb + 1), lambda q: list_max(list_transform(range(1, q + 1),
      lambda k: greatest(above[k], coalesce(above[k - 1], 0) + equal[k]))::BIGINT[])::BIGINT),
    list_transform(range(1, lb + 1), lambda q: 0::BIGINT))[lb] END AS common FROM subset),
scored AS (SELECT words, i, category, greatest(part, coalesce(100::DOUBLE - 100::DOUBLE * (la + lb - 2 * common) / total, 0)) AS score FROM tabled),
fuzzy AS (SELECT words, arg_min(category, i) AS category, any_value(score) AS score FROM (
    SELECT *, max(score) OVER (PARTITION BY words) AS top FROM scored WHERE score >= 84) WHERE score = top GROUP BY words)"""


# ----------------------------------------------------------------------- locations


def _name(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({column}, '(?i)^city of ', ''), '(?i)\s*\(capital\)', '', 'g'))"


PLACES = f"""
m AS (SELECT CASE WHEN s_suppkey % 17 = 0 THEN '9999' ELSE (10 + n_regionkey) || lpad('' || n_nationkey, 2, '0') END AS pcode,
  CASE WHEN s_suppkey % 13 = 5 THEN 'NATION_' || (s_suppkey % 25) ELSE CASE s_suppkey % 4
    WHEN 0 THEN 'City Of Town ' || (s_suppkey % 50) WHEN 1 THEN 'Town ' || (s_suppkey % 50) || ' (Capital)'
    WHEN 2 THEN 'Town ' || (s_suppkey % 50) || ' City' ELSE 'Town ' || (s_suppkey % 50) END END AS description, s_suppkey AS ord
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT (10 + n_regionkey) || lpad('' || n_nationkey, 2, '0') AS pcode, n_regionkey,
  CASE WHEN n_regionkey = 3 THEN 'City of ' || n_name ELSE n_name END AS description, r_name AS region, n_nationkey AS ord
  FROM nation JOIN region ON r_regionkey = n_regionkey),
capital AS (SELECT {_name('description')} AS city, ord FROM p WHERE n_regionkey = 3),
towns AS (SELECT {_name('m.description')} AS city, p.description AS province, p.region, m.ord FROM m JOIN p USING (pcode)),
entries AS (SELECT city, NULL AS province, 'NCR' AS region, 0 AS part, ord FROM capital
  UNION ALL SELECT city, province, region, 1, ord FROM towns
  WHERE lower(city) NOT IN (SELECT lower(city) FROM capital)),
precise AS (SELECT 'city_province' AS kind, lower(city) || '|' || lower(province) AS key, arg_max(city, ord) AS location,
  arg_max(region, ord) AS region FROM entries WHERE province IS NOT NULL GROUP BY 2),
named AS (SELECT lower(city) AS key, count(DISTINCT region) AS n, arg_max(city, part * 1000000000 + ord) AS city,
  max(region) AS region FROM entries GROUP BY 1),
lookup AS (SELECT * FROM precise
  UNION ALL SELECT CASE WHEN n = 1 THEN 'city' ELSE 'ambiguous' END, key, CASE WHEN n = 1 THEN city END,
    CASE WHEN n = 1 THEN region END FROM named
  UNION ALL SELECT 'province', lower({_name('description')}), {_name('description')}, region FROM p)"""


def _quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def _proper(column: str) -> str:
    return (
        rf"list_aggregate(list_transform(regexp_extract_all(lower({column}), '[a-z]+|[^a-z]+'), "
        "lambda w: upper(w[1]) || w[2:]), 'string_agg', '')"
    )


def _location_cleaned(column: str) -> str:
    text = rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"
    for pattern in (
        r",?\s*philippines\s*$", r",?\s*metro manila\s*$", r",?\s*ncr\s*$", r"^\s*city\s+of\s+",
        r",?\s*(first|second|third|fourth|fifth|sixth|seventh)\s+district\s*$", r"\s*\(capital\)",
    ):
        text = f"regexp_replace({text}, '(?i){pattern}', '', 'g')"
    text = rf"regexp_replace({text}, '\s*,\s*', ', ', 'g')"
    return rf"trim(regexp_replace({text}, '[,\s]+$', ''))"


LOCATED = f"""
texts AS (SELECT raw, {_location_cleaned('raw')} AS cleaned FROM (SELECT DISTINCT trim(location) AS raw FROM postings WHERE trim(location) <> '')),
parts AS (SELECT raw, cleaned, list_filter(list_transform(string_split(lower(cleaned), ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM texts),
names AS (SELECT raw, ps, i, ps[i] AS name FROM (SELECT raw, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
forms AS (SELECT raw, ps, i, 0 AS v, name AS form FROM names
  UNION ALL SELECT raw, ps, i, 1, regexp_replace(name, '\\s+city$', '') FROM names WHERE regexp_matches(name, '\\s+city$')
  UNION ALL SELECT raw, ps, i, 2, name || ' city' FROM names WHERE NOT name LIKE '% city'),
tries AS (SELECT raw, v AS rank, 'city_province' AS kind, form || '|' || ps[2] AS key, NULL AS shown FROM forms WHERE i = 1 AND len(ps) >= 2
  UNION ALL SELECT raw, i * 100 + v * 2, 'city', form, NULL FROM forms
  UNION ALL SELECT raw, i * 100 + v * 2 + 1, 'ambiguous', form, form FROM forms
  UNION ALL SELECT raw, 1000000 + i, 'province', name, NULL FROM names),
hits AS (SELECT raw, arg_min(coalesce({_proper('shown')}, l.location), rank) AS location,
  arg_min(CASE WHEN kind = 'ambiguous' THEN 'Ambiguous' ELSE coalesce(l.region, '?') END, rank) AS region
  FROM tries JOIN lookup l USING (kind, key) GROUP BY raw),
located AS (SELECT parts.raw,
  CASE WHEN regexp_matches(parts.raw, '(?i)\\b(remote|work from home|wfh|home[- ]based)\\b') THEN 'Remote'
    WHEN lower(parts.raw) IN ({_quoted(OVERSEAS_COUNTRIES)}) THEN {_proper('parts.raw')}
    WHEN lower(parts.raw) IN ({_quoted(OVERSEAS_CONTINENTS)}) THEN 'Overseas (Unspecified)'
    WHEN cleaned = '' THEN 'Unknown' WHEN hits.raw IS NOT NULL THEN hits.location ELSE {_proper('cleaned')} END AS location,
  CASE WHEN regexp_matches(parts.raw, '(?i)\\b(remote|work from home|wfh|home[- ]based)\\b') THEN NULL
    WHEN lower(parts.raw) IN ({_quoted(OVERSEAS_COUNTRIES + OVERSEAS_CONTINENTS)}) THEN 'Overseas'
    WHEN hits.raw IS NOT NULL THEN nullif(hits.region, '?') END AS region
  FROM parts LEFT JOIN hits USING (raw))"""

# ---------------------------------------------------------------------- whole rows

_URL = "rtrim(split_part(split_part(lower(trim({0})), '?', 1), '#', 1), '/')"


def _key(url: str, category: str, company: str, location: str) -> str:
    def part(c):
        return f"trim(lower(coalesce({c}, '')))"

    return (
        f"md5(CASE WHEN trim({url}) <> '' THEN 'url|' || {_URL.format(url)} ELSE 'fallback|' || {part(category)} "
        f"|| '|' || {part(company)} || '|' || {part(location)} END)"
    )


COMPANY = "nullif(trim(coalesce(nullif(company, ''), nullif(employer, ''), nullif(organization, ''))), '')"
PLACEHOLDER = "CASE WHEN regexp_matches({0}, '(?i)not\\s+specified') THEN NULL ELSE nullif(trim({0}), '') END AS {0}"

CLEAN = (
    SALARY + "," + PLACES + "," + LOCATED + "," + _titled("paid") + f""",
joined AS (SELECT titled.* EXCLUDE (company, location, employment_type, education_requirement), {COMPANY} AS company,
  coalesce(located.location, 'Unknown') AS location, located.region,
  {PLACEHOLDER.format('employment_type')}, {PLACEHOLDER.format('education_requirement')}
  FROM titled LEFT JOIN located ON trim(titled.location) = located.raw),
clean AS (SELECT *, {_key('job_url', 'career_category', 'company', 'location')} AS dedup_key FROM joined),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY posting_id) AS rn FROM clean)"""
)

REPEATS = JOBS + """,
repeats AS (SELECT * EXCLUDE (job_title, career_category, id), o_orderstatus AS job_title,
  coalesce(employment_type, 'Uncategorized') AS career_category FROM jobs)"""
KEYS = "job_title, career_category, company, location"


def _latest(where: str) -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY collected_at DESC NULLS LAST, "
        f"job_url DESC NULLS LAST) AS rn FROM repeats WHERE {where}) WHERE rn = 1)"
    )


_ORDER = "collected_at NULLS FIRST, job_title NULLS FIRST, career_category NULLS FIRST, company NULLS FIRST, location NULLS FIRST"
_SAME = " AND ".join(f"{{0}}.{c} IS NOT DISTINCT FROM {{1}}.{c}" for c in KEYS.split(", "))
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

EVENTS = """
listings AS (SELECT event_id // 50 AS page, CAST(event_id % 50 AS INT) AS pos,
  'https://jobs.example.com/' || user_id || '/' || event_type AS job_url, event_type FROM events),
seen AS (SELECT DISTINCT job_url FROM listings WHERE event_type = 'error')"""
STOP = EVENTS + """,
firsts AS (SELECT job_url, min(page) AS first_page FROM listings GROUP BY 1),
marked AS (SELECT l.*, f.first_page, s.job_url IS NOT NULL AS known FROM listings l JOIN firsts f USING (job_url) LEFT JOIN seen s USING (job_url)),
stop AS (SELECT min(page) AS stop_page FROM (SELECT page FROM marked GROUP BY page HAVING bool_and(first_page < page) OR bool_and(known)))"""

_UNESCAPE = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def oracle_sql() -> dict[str, str]:
    j, ji = JOBS, JOBS_INDUSTRY
    building = "career_category = 'BUILDING' AND derived = 'Trade BUILDING'"
    one_row = {
        "summary": SUMMARY + "jobs",
        "salary_summary": "SELECT round(sum(salary_amount_monthly) / count(*), 2) AS average_salary, min(salary_amount_monthly) AS lowest_salary, "
        f"max(salary_amount_monthly) AS highest_salary, count(*) AS salary_job_count FROM jobs WHERE {PAID}",
    }
    measures = {
        "summary": ("total_jobs", "total_companies", "total_categories", "total_locations", "total_regions", "jobs_with_salary"),
        "salary_summary": ("average_salary", "lowest_salary", "highest_salary", "salary_job_count"),
    }
    panels = " UNION ALL ".join(
        [
            f"SELECT '{name}' AS panel, {label} AS label, CAST({n} AS BIGINT) AS job_count, CAST({average} AS DOUBLE) AS average_salary, "
            f"CAST({low} AS DOUBLE) AS salary_min, CAST({high} AS DOUBLE) AS salary_max FROM ({sql})"
            for name, label, n, average, low, high, sql in (
                ("categories", "career_category", "job_count", "NULL", "NULL", "NULL", _panel("career_category", 10)),
                ("locations", "location", "job_count", "NULL", "NULL", "NULL", _panel("location", 10)),
                ("regions", "region", "job_count", "NULL", "NULL", "NULL", _panel("region")),
                ("companies", "company", "job_count", "NULL", "NULL", "NULL", _panel("company", 10)),
                ("job_titles", "job_title", "job_count", "NULL", "NULL", "NULL", _panel("job_title", 10)),
                ("industries", "industry", "job_count", "NULL", "NULL", "NULL", INDUSTRIES + " ORDER BY job_count DESC, industry LIMIT 10"),
                ("employment_types", "employment_type", "job_count", "NULL", "NULL", "NULL", _panel("employment_type")),
                ("salary_by_category", "career_category", "job_count", "average_salary", "NULL", "NULL", _salaries()),
                ("salary_distribution", "salary_range", "job_count", "NULL", "NULL", "NULL",
                 f"SELECT {BUCKET} AS salary_range, count(*) AS job_count FROM jobs WHERE {PAID} GROUP BY 1"),
                ("salary_range_by_category", "career_category", "job_count", "average_salary", "salary_min", "salary_max", _salaries()),
                ("filter_options", "facet || '|' || value", "NULL", "NULL", "NULL", "NULL", OPTIONS),
            )
        ]
        + [
            f"SELECT '{name}', '{m}', NULL, CAST({m} AS DOUBLE), NULL, NULL FROM ({sql})" for name, sql in one_row.items() for m in measures[name]
        ]
    )
    first_import = (
        f"first AS (SELECT * , row_number() OVER (ORDER BY {_ORDER}) AS id FROM "
        + _latest("date_posted < DATE '1998-01-01' AND company IS NOT NULL AND job_title IS NOT NULL")
        + "), batch AS (SELECT * FROM "
        + _latest("date_posted >= DATE '1997-01-01' AND company IS NOT NULL AND job_title IS NOT NULL")
        + ")"
    )
    kept_columns = "region, salary_amount, job_url, collected_at"
    updated = ", ".join(
        f"CASE WHEN b.job_url IS NOT NULL THEN b.{c} ELSE f.{c} END AS {c}" for c in kept_columns.split(", ")
    )
    upsert = f"""SELECT id, {KEYS}, region, CAST(salary_amount AS DOUBLE) AS salary_amount, job_url,
      {_STAMP.format('collected_at')} AS collected_at, created_at FROM (
      SELECT f.id, {', '.join('f.' + c for c in KEYS.split(', '))}, {updated}, '2026-01-01 00:00:00' AS created_at
      FROM first f LEFT JOIN batch b ON {_SAME.format('f', 'b')}
      UNION ALL
      SELECT (SELECT max(id) FROM first) + row_number() OVER (ORDER BY {_ORDER}), {KEYS}, {kept_columns}, '2026-02-02 00:00:00'
      FROM batch b WHERE NOT EXISTS (SELECT 1 FROM first f WHERE {_SAME.format('f', 'b')}))"""
    row_text = (
        "SELECT posting_id, concat_ws(' | ', job_title, salary_text, employer, location, education_requirement, "
        "employment_type, CASE WHEN posting_id % 5 <> 0 THEN 'POSTED ON ' || date_posted END) AS t FROM postings"
    )

    def row_fields(keys: str, source: str) -> str:
        names = ("job_title", "salary_text", "employer", "location", "education_requirement", "employment_type")
        picks = ", ".join(f"fs[{i}] AS {n}" for i, n in enumerate(names, 1))
        return (
            f"SELECT {keys}, {picks}, CASE WHEN dated THEN trim(ps[-1][10:]) END AS date_posted FROM (SELECT *, "
            f"CASE WHEN dated THEN ps[:-2] ELSE ps END AS fs FROM (SELECT *, coalesce(lower(ps[-1]) LIKE 'posted on%', false) AS dated "
            f"FROM (SELECT {keys}, list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM ({source}))))"
        )

    listed = (
        "SELECT id, job_title, career_category, title_match_method, company, location, region, salary_amount, salary_period, "
        "salary_period_inferred, salary_amount_monthly, salary_period_used, salary_period_estimated, salary_disclosed, currency, "
        "strftime(date_posted, '%Y-%m-%d') AS date_posted, employment_type, education_requirement, industry, description, source, "
        f"job_url, {_STAMP.format('collected_at')} AS collected_at FROM jobs"
    )
    older_table = f"""SELECT f.id, {', '.join('f.' + c for c in KEYS.split(', '))}, CASE WHEN b.job_url IS NOT NULL THEN b.region ELSE f.region END AS region,
      f.id * 10 AS salary_min, b.job_url, NULL AS created_at FROM first f LEFT JOIN batch b ON {_SAME.format('f', 'b')}
      UNION ALL
      SELECT (SELECT max(id) FROM first) + row_number() OVER (ORDER BY {_ORDER}), {KEYS}, region, NULL, job_url, '2026-02-02 00:00:00'
      FROM batch b WHERE NOT EXISTS (SELECT 1 FROM first f WHERE {_SAME.format('f', 'b')})"""
    clean_rows = _with(
        CLEAN,
        "SELECT job_title, career_category, title_match_method, company, location, region, salary_period, salary_disclosed, currency, "
        "strftime(o_orderdate, '%Y-%m-%d') AS date_posted, employment_type, education_requirement, source, job_url, "
        f"{_STAMP.format('o_orderdate')} AS collected_at, salary_amount, salary_period_inferred, salary_outlier, salary_period_used, "
        "salary_period_estimated, salary_amount_monthly FROM numbered WHERE rn = 1",
    )
    quality = _with(
        CLEAN,
        """SELECT count(*) AS total_records, count(*) FILTER (WHERE rn > 1) AS duplicate_records,
        count(*) FILTER (WHERE NOT salary_disclosed) AS missing_salaries, count(*) FILTER (WHERE company IS NULL) AS missing_company,
        count(*) FILTER (WHERE location = 'Unknown') AS missing_locations,
        count(*) FILTER (WHERE region IS NULL AND location NOT IN ('Unknown', 'Remote')) AS unmapped_locations,
        count(*) FILTER (WHERE region = 'Ambiguous') AS ambiguous_locations, count(*) FILTER (WHERE region = 'Overseas') AS overseas_postings,
        count(*) FILTER (WHERE job_title = '') AS missing_titles, count(*) FILTER (WHERE career_category = 'Uncategorized') AS uncategorized_titles,
        count(*) FILTER (WHERE title_match_method LIKE 'fuzzy%') AS fuzzy_matched_titles,
        count(*) FILTER (WHERE salary_period_inferred = 'daily') AS salary_period_inferred_daily,
        count(*) FILTER (WHERE salary_period_inferred = 'weekly') AS salary_period_inferred_weekly,
        count(*) FILTER (WHERE salary_period_inferred = 'monthly') AS salary_period_inferred_monthly,
        count(*) FILTER (WHERE salary_period_inferred = 'ambiguous') AS salary_period_ambiguous,
        count(*) FILTER (WHERE salary_outlier) AS salary_outliers_flagged,
        count(*) FILTER (WHERE salary_amount_monthly IS NOT NULL) AS salary_records_monthly_normalized,
        count(*) FILTER (WHERE salary_period_estimated) AS salary_records_period_estimated,
        count(*) FILTER (WHERE rn = 1 AND job_title <> '' AND company IS NOT NULL AND location <> 'Unknown') AS valid_records
        FROM numbered""",
    )
    uncategorized = _with(
        POSTINGS + "," + _titled("postings"),
        "SELECT job_title, count(*) AS count FROM titled WHERE career_category = 'Uncategorized' GROUP BY 1",
    )
    return {
        "summary": _with(j, SUMMARY + "jobs"),
        "summary_filtered": _with(ji, SUMMARY + f"ji WHERE {building}"),
        "top_categories": _with(j, _panel("career_category", 10)),
        "top_locations": _with(j, _panel("location", 10, SOME)),
        "regions": _with(j, _panel("region")),
        "top_companies": _with(j, _panel("company", 10)),
        "top_titles": _with(j, _panel("job_title", 20)),
        "industries": _with(ji, INDUSTRIES + " ORDER BY job_count DESC, industry LIMIT 20"),
        "document_industries": """SELECT CASE WHEN regexp_matches(t, 'eaux|oui|elle ') THEN 'French'
            WHEN regexp_matches(t, 'sch|und ') THEN 'German' WHEN regexp_matches(t, 'the |tion') THEN 'English'
            ELSE 'Other' END AS industry, count(*) AS job_count
            FROM (SELECT lower(source || ' ' || text) AS t FROM documents) GROUP BY 1""",
        "employment_types": _with(j, _panel("employment_type")),
        "salary_summary": _with(
            j,
            f"SELECT round(sum(salary_amount_monthly) / count(*), 2) AS average_salary, min(salary_amount_monthly) AS "
            f"lowest_salary, max(salary_amount_monthly) AS highest_salary, count(*) AS salary_job_count FROM jobs WHERE {PAID}",
        ),
        "salary_by_category": _with(j, f"SELECT career_category, average_salary, job_count FROM ({_salaries()})"),
        "salary_by_category_filtered": _with(
            j, f"SELECT career_category, average_salary, job_count FROM ({_salaries(5, SOME)})"
        ),
        "salary_distribution": _with(
            j, f"SELECT {BUCKET} AS salary_range, count(*) AS job_count FROM jobs WHERE {PAID} GROUP BY 1"
        ),
        "salary_range_by_category": _with(j, _salaries()),
        "filter_options": _with(ji, OPTIONS),
        "filter_list_regions": _with(j, "SELECT DISTINCT region AS value FROM jobs WHERE trim(region) <> ''"),
        "disclosure_rate": _with(
            j,
            "SELECT CASE WHEN count(*) > 0 THEN CAST(floor(count(*) FILTER (WHERE salary_disclosed) * 100.0 / count(*) + 0.5) AS BIGINT) "
            "ELSE 0 END AS disclosure_rate FROM jobs",
        ),
        "employment_share": _with(
            j,
            "SELECT employment_type, job_count, CAST(sum(job_count) OVER () AS BIGINT) AS total, "
            f"round(job_count / sum(job_count) OVER (), 6) AS share FROM ({_panel('employment_type')})",
        ),
        "currency_labels": """SELECT c_custkey, CASE WHEN c_acctbal > 0
            THEN '₱' || format('{:,}', CAST(floor(c_acctbal + 0.5) AS BIGINT)) ELSE 'N/A' END AS label FROM customer""",
        "chart_salary_range": _with(
            j,
            "SELECT career_category AS name, salary_min AS minimum, salary_max AS maximum, average_salary AS average "
            f"FROM ({_salaries()})",
        ),
        "chart_employment": _with(
            j, f"SELECT employment_type AS name, job_count AS value FROM ({_panel('employment_type')})"
        ),
        "chart_top_categories": _with(
            j, f"SELECT career_category AS name, job_count AS jobs FROM ({_panel('career_category', 8)})"
        ),
        "dashboard_panels": _with(ji, panels),
        "dashboard_summary": _with(j, SUMMARY + "jobs WHERE region = 'ASIA'"),
        "jobs_page": _with(j, f"{listed} WHERE region ILIKE '%asi%' ORDER BY id DESC LIMIT 25 OFFSET 50"),
        "jobs_deep_page": _with(j, f"{listed} ORDER BY id DESC LIMIT 100 OFFSET 1000"),
        "jobs_after": _with(j, f"{listed} WHERE region ILIKE '%asi%' AND id < (SELECT max(o_orderkey) // 2 FROM orders) ORDER BY id DESC LIMIT 25"),
        "jobs_offset": _with(
            j, DISPLAY + f"(SELECT * FROM jobs WHERE {_search('WIDGET')} ORDER BY id DESC LIMIT 30 OFFSET 15)"
        ),
        "salary_labels": _with(j, DISPLAY + "jobs"),
        "jobs_count": _with(
            ji,
            "SELECT count(*) AS count FROM ji WHERE career_category ILIKE '%build%' AND location ILIKE '%nation_1%' "
            "AND employment_type ILIKE '%_-h%' AND derived ILIKE '%other%'",
        ),
        "jobs_search": _with(j, f"SELECT id, job_title, company FROM jobs WHERE {_search('customer#%7')}"),
        "page_numbers": _with(
            j,
            "SELECT count(*) AS count, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 21 END AS BIGINT) AS first_row, least(40, count(*)) AS last_row, "
            f"CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS total_pages FROM jobs WHERE {_search('bolt')}",
        ),
        "explorer_options": _with(
            j,
            f"SELECT 'category' AS kind, career_category AS label, job_count FROM ({_panel('career_category', 10)}) UNION ALL "
            f"SELECT 'location', location, job_count FROM ({_panel('location', 100)})",
        ),
        "salary_parse": _with(
            SALARY, "SELECT posting_id, salary_min, salary_max, salary_period, salary_disclosed, currency FROM parsed"
        ),
        "salary_normalize": _with(
            SALARY,
            "SELECT posting_id, salary_amount, salary_period_inferred, salary_outlier, salary_period_used, "
            "salary_period_estimated, salary_amount_monthly FROM paid",
        ),
        "salary_statistics": _with(
            SALARY,
            "SELECT count(*) AS jobs_with_salary, round(avg(salary_min), 2) AS average_salary_min, round(avg(salary_max), 2) AS "
            "average_salary_max, min(salary_min) AS lowest_salary_min, max(salary_max) AS highest_salary_max FROM parsed WHERE salary_disclosed",
        ),
        "placeholder_null": _with(
            POSTINGS,
            f"SELECT posting_id, {PLACEHOLDER.format('employment_type')}, {PLACEHOLDER.format('education_requirement')} FROM postings",
        ),
        "employer_coalesce": _with(POSTINGS, f"SELECT posting_id, {COMPANY} AS company FROM postings"),
        "type_preparation": _with(
            POSTINGS,
            f"SELECT posting_id, strftime(o_orderdate, '%Y-%m-%d') AS date_posted, {_STAMP.format('o_orderdate')} AS collected_at, "
            "CAST(NULL AS VARCHAR) AS no_date FROM postings",
        ),
        "url_normalize": f"SELECT page_id, {_URL.format('url')} AS url, {_key('url', 'NULL', 'NULL', 'NULL')} AS dedup_key FROM pages",
        "url_dedup_first": _with(
            POSTINGS,
            f"SELECT min(posting_id) AS posting_id, {_key('job_url', 'job_title', 'employer', 'location')} AS dedup_key FROM postings GROUP BY 2",
        ),
        "dedup_latest": _with(
            REPEATS, f"SELECT {KEYS}, job_url, {_STAMP.format('collected_at')} AS collected_at FROM {_latest('true')}"
        ),
        "text_dedup": f"SELECT min(doc_id) AS doc_id, {_key('NULL', 'lang', 'NULL', 'text')} AS dedup_key FROM documents GROUP BY 2".replace(
            "trim(NULL)", "trim(CAST(NULL AS VARCHAR))"
        ).replace("lower(coalesce(NULL, ''))", "''").replace("trim(lower(coalesce(text, '')))", "trim(lower(text), chr(9) || chr(10) || chr(13) || ' ')"),
        "row_text_parse": _with(POSTINGS, row_fields("posting_id", row_text)),
        "conversation_rows": row_fields(
            "conv_id, turn", r"SELECT conv_id, turn, regexp_replace(text, '[.\n]', '|', 'g') AS t FROM conversations"
        ),
        "link_extract": """SELECT page_id, CAST(i - 1 AS INT) AS pos, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN 'https://jobs.example.com' || h
            ELSE 'https://jobs.example.com/' || h END AS job_url FROM (SELECT page_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM (
            SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''>]*)["'']', 1), lambda x: contains(x, '/')) AS hs FROM pages)) WHERE h <> ''""",
        "listing_extract": "SELECT page, pos, raw_row_text AS job_title, 'https://jobs.example.com' || " + _UNESCAPE.format("h") + """ AS job_url, raw_row_text FROM (
            SELECT page_id AS page, CAST(i - 1 AS INT) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS h, trim(""" + _UNESCAPE.format("regexp_extract(a, '>([^<]*)</a>', 1)") + """) AS raw_row_text FROM (
            SELECT page_id, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS l FROM pages))) WHERE raw_row_text <> ''""",
        "card_extract": "SELECT page_id, url, CAST(0 AS INT) AS pos, trim(" + _UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + ") AS job_title, CAST(NULL AS VARCHAR) AS salary FROM pages",
        "detail_extract": "SELECT page_id, nullif(trim(" + _UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + "), '') AS job_title, nullif(trim(replace(replace("
            + _UNESCAPE.format("regexp_extract(html, '<footer>([^<]*)</footer>', 1)") + ", '&copy;', '©'), '&middot;', '·')), '') AS employer, CAST(NULL AS VARCHAR) AS salary_text FROM pages",
        "anti_join_new": _with(EVENTS, "SELECT page, pos, job_url FROM listings WHERE job_url NOT IN (SELECT job_url FROM seen)"),
        "crawl_cutoff": _with(
            STOP,
            "SELECT page, pos, job_url FROM marked WHERE page = first_page AND NOT known AND "
            "page < coalesce((SELECT stop_page FROM stop), 9223372036854775807)",
        ),
        "crawl_stop_page": _with(STOP, "SELECT stop_page FROM stop"),
        "page_statistics": _with(
            STOP,
            "SELECT page, count(*) AS listings, count(*) FILTER (WHERE page = first_page AND NOT known) AS new_listings FROM marked GROUP BY page",
        ),
        "seen_union": _with(
            EVENTS, "SELECT DISTINCT job_url FROM listings"
        ),
        "detail_merge": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS job_url, o_orderstatus AS job_title,
            CASE WHEN c_acctbal < 0 OR c_mktsegment IS NULL THEN 'none' ELSE c_mktsegment END AS salary_text, c_name AS employer
            FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
        "title_clean": _with(POSTINGS, f"SELECT posting_id, {_words('job_title')} AS words FROM postings"),
        "title_taxonomy": _with(
            POSTINGS + "," + _titled("postings"),
            "SELECT posting_id, job_title, career_category, title_match_method FROM titled",
        ),
        "title_fuzzy": _with(
            """misspelt AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN m ELSE m || ' ' || p_name END AS job_title
              FROM (SELECT *, ['Accountnt', 'Export/Import Officer', 'Credit/Collection Specialist', 'Operator', 'Tax Specialist',
                'Softwre Enginer', 'Salesladdy'][p_size % 7 + 1] AS m FROM part)),"""
            + _titled("misspelt") + "," + _fuzzy(),
            """SELECT p_partkey, job_title, coalesce(cat, f.category, 'Uncategorized') AS career_category,
              CASE WHEN cat IS NOT NULL THEN 'exact' WHEN f.words IS NOT NULL THEN 'fuzzy(' || floor(score)::INTEGER || ')' END
                AS title_match_method FROM titled LEFT JOIN fuzzy f ON titled.words = f.words""",
        ),
        "title_rules": r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\bcold\b|\bblue\b') THEN 'Cold'
            WHEN regexp_matches(p_name, '\bring\b|rod') THEN 'Round' ELSE 'Uncategorized' END AS category FROM part""",
        "uncategorized_rank": uncategorized,
        "lookup_build": _with(PLACES, "SELECT kind, key, location, region FROM lookup"),
        "lookup_statistics": _with(
            PLACES,
            "SELECT (SELECT count(*) FROM m WHERE pcode NOT IN (SELECT pcode FROM p)) AS unresolved, "
            "(SELECT count(*) FROM towns WHERE lower(city) IN (SELECT lower(city) FROM capital)) AS capital_duplicates",
        ),
        "location_resolve": _with(
            POSTINGS + "," + PLACES + "," + LOCATED,
            "SELECT posting_id, coalesce(located.location, 'Unknown') AS location, located.region FROM postings "
            "LEFT JOIN located ON trim(postings.location) = located.raw",
        ),
        "clean_rows": clean_rows,
        "quality_report": quality,
        "upsert_snapshot": _with(REPEATS + ", " + first_import, upsert),
        "upsert_buckets": _with(REPEATS + ", " + first_import, upsert),
        "upsert_older_table": _with(REPEATS + ", " + first_import, older_table),
        "import_rejects": "SELECT 'https://jobs.example.com/' || o_orderkey AS job_url, o_orderstatus AS job_title, CAST(NULL AS VARCHAR) AS company "
        "FROM orders WHERE o_orderkey % 41 = 1",
        "raw_arrays": _with(
            POSTINGS,
            "SELECT CAST(row_number() OVER (PARTITION BY posting_id // 2000 ORDER BY posting_id) - 1 AS INT) AS ord, job_title, salary_text, salary, "
            "company, employer, organization, location, education_requirement, date_posted, job_url FROM postings",
        ),
        "landing_round_trip": _with(
            POSTINGS,
            "SELECT CASE WHEN posting_id // 50 % 2 = 0 THEN '20260101T000000Z' ELSE '20260102T000000Z' END AS run_ts, 'orders' AS landed_from, "
            "posting_id // 50 AS page, CAST(posting_id % 50 AS INT) AS pos, job_title, salary_text, company, location, job_url FROM postings",
        ),
        # a CSV file doesn't tell an empty text from none
        "clean_csv": f"SELECT * REPLACE (nullif(job_title, '') AS job_title, nullif(job_url, '') AS job_url) FROM ({clean_rows})",
        "landings_report": quality,
        "landings_jobs": _with(
            CLEAN + f""",
            kept AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY o_orderdate DESC, job_url DESC NULLS LAST) AS latest
              FROM numbered WHERE rn = 1 AND company IS NOT NULL AND job_title IS NOT NULL)""",
            f"SELECT {KEYS}, region, salary_amount, salary_amount_monthly, job_url, {_STAMP.format('o_orderdate')} AS collected_at FROM kept WHERE latest = 1",
        ),
        "uncategorized_csv": f"SELECT nullif(job_title, '') AS job_title, count FROM ({uncategorized})",
        "seen_commits": _with(EVENTS, "SELECT DISTINCT job_url FROM listings"),
        "lookup_from_csv": _with(PLACES, "SELECT kind, key, location, region FROM lookup"),
        "lookup_renamed": _with(PLACES, "SELECT kind, key, location, CASE WHEN region = 'ASIA' THEN 'BARMM' ELSE region END AS region FROM lookup"),
        "jobs_sanitized": _with(j, f"{listed} ORDER BY id DESC LIMIT 100"),
        "import_counts": _with(
            REPEATS,
            f"SELECT b AS before, a AS after, a - b AS inserted FROM (SELECT (SELECT count(*) FROM {_latest('true')}) AS a, "
            "(SELECT count(*) FROM " + _latest("date_posted < DATE '1998-01-01'") + ") AS b)",
        ),
    }
