from jobmarket import build_location_lookup, lookup_statistics, standardize_locations
from jobmarket.operators.locations import location_dimension

PLACED = [
    (None, "Unknown", None),
    ("", "Unknown", None),
    (" \t", "Unknown", None),
    ("Philippines", "Unknown", None),
    ("Work from home", "Remote", None),
    ("Home-based (Cebu)", "Remote", None),
    ("EUROPE", "Overseas (Unspecified)", "Overseas"),
    ("taiwan, r.o.c.", "Taiwan, R.O.C.", "Overseas"),
    ("City Of Makati, Ncr, Fourth District", "Makati", "NCR"),
    ("Makati City, Metro Manila", "Makati", "NCR"),
    ("City Of Santa Rosa, Laguna", "Santa Rosa", "CALABARZON"),
    ("Santa Rosa, Ilocos Norte", "Santa Rosa", "Ilocos Region"),
    ("Santa Rosa", "Santa Rosa", "Ambiguous"),
    ("Santa Rosa City", "Santa Rosa", "Ambiguous"),
    ("Cebu City (Capital), Cebu", "Cebu City", "Central Visayas"),
    ("CEBU CITY, CEBU, PHILIPPINES", "Cebu City", "Central Visayas"),
    ("Barangay 5, Mandaue, Cebu", "Mandaue City", "Central Visayas"),
    ("Penablanca , Pampanga", "Peñablanca", "Central Luzon"),
    ("Pampanga", "Pampanga", "Central Luzon"),
    ("Somewhere, Laguna", "Laguna", "CALABARZON"),
    ("Nowhere Town", "Nowhere Town", None),
    ("Cotabato, Maguindanao", "Maguindanao", "ARMM"),
]


def test_lookup(lookup):
    rows = {(r.kind, r.key): (r.location, r.region) for r in lookup.collect()}
    assert rows[("city", "makati")] == ("Makati", "NCR")
    assert rows[("ambiguous", "santa rosa")] == (None, None)
    assert rows[("city_province", "cebu city|cebu")] == ("Cebu City", "Central Visayas")
    assert rows[("city", "penablanca")] == ("Peñablanca", "Central Luzon")
    assert rows[("province", "manila")] == ("Manila", "NCR")
    assert rows[("city", "san juan")] == ("San Juan", "NCR")
    assert ("city_province", "san juan|ilocos norte") not in rows
    assert not any("lost" in key for _, key in rows)


def test_lookup_options(places):
    free = {(r.kind, r.key): r.region for r in build_location_lookup(*places, reference_compat=False).collect()}
    assert ("city_province", "san juan|ilocos norte") in free and ("ambiguous", "san juan") in free
    fixed = build_location_lookup(*places, fix_regions=True).where("key = 'maguindanao'").first()
    assert fixed.region == "BARMM"
    assert tuple(lookup_statistics(*places).first()) == (1, 1)


def test_locations(spark, lookup):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLACED)], "i int, location string")
    rows = standardize_locations(df, lookup).orderBy("i").collect()
    assert [(p[0], r.location, r.region) for p, r in zip(PLACED, rows)] == PLACED


def test_dimension_has_one_row_per_text(spark, lookup):
    df = spark.createDataFrame([("Cebu",)] * 50 + [(" Cebu ",), (None,)], "location string")
    assert [tuple(r) for r in location_dimension(df, lookup).collect()] == [("Cebu", "Cebu City", "Central Visayas", 51)]


def test_join_is_broadcast_and_python_free(spark, lookup):
    df = spark.createDataFrame([("Cebu",)], "location string")
    plan = standardize_locations(df, lookup)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan
