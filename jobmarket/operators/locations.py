"""Location lookup building and location standardization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.text import normalize_key, squeeze, strip, title_case
from jobmarket.operators.skew import hot_keys, lookup_join
from jobmarket.rules import places as P
from jobmarket.sources.staging import staged

REMOTE_WORDING = r"(?iU)\b(?:remote|work from home|wfh|home[- ]based)\b"


# ------------------------------------------------------------- lookup building


def official_name(c: Column | str) -> Column:
    """'City of Makati' -> 'Makati', 'Cebu City (Capital)' -> 'Cebu City'."""
    text = F.col(c) if isinstance(c, str) else c
    bare = F.when(F.lower(text).startswith("city of "), F.substr(text, F.lit(9))).otherwise(text)
    return strip(F.regexp_replace(strip(bare), r"(?iU)\s*\(capital\)", ""))


def _name_key(c: Column | str) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return F.translate(strip(F.lower(text)), "ñáéíóú", "naeiou")


def _last(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def _entries(
    regions: DataFrame, provinces: DataFrame, municipalities: DataFrame, order: str, compat: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    short = F.create_map(*[F.lit(x) for kv in P.REGION_SHORT_NAMES.items() for x in kv])
    region_of = (
        regions.select(
            F.substring("code", 1, 2).alias("region_code"),
            F.coalesce(F.try_element_at(short, F.col("description")), F.col("description")).alias("region"),
            F.col(order).alias("ord"),
        )
        .groupBy("region_code")
        .agg(_last(F.col("region"), F.col("ord")).alias("region"))
    )
    named = (
        provinces.select(
            "code",
            "description",
            F.col(order).alias("ord"),
            F.substring("code", 1, 2).alias("region_code"),
        )
        .join(region_of, "region_code", "left")
        .select("code", "description", "ord", "region_code", "region")
    )
    capital = named.where(F.col("region_code") == P.CAPITAL_REGION_PREFIX).select(
        official_name("description").alias("city"),
        F.lit(None).cast("string").alias("province"),
        F.lit(P.CAPITAL_REGION).alias("region"),
        F.struct(F.lit(0).alias("part"), F.col("ord")).alias("ord"),
    )
    province_of = named.groupBy(F.substring("code", 1, 4).alias("province_code")).agg(
        _last(F.struct(strip("description").alias("province"), "region"), F.col("ord")).alias("p")
    )
    towns = (
        municipalities.select(
            F.substring("code", 1, 4).alias("province_code"),
            official_name("description").alias("city"),
            F.struct(F.lit(1).alias("part"), F.col(order).alias("ord")).alias("ord"),
        )
        .join(province_of, "province_code", "left")
        .select("city", F.col("p.province").alias("province"), F.col("p.region").alias("region"), "ord", "p")
    )
    resolved = towns.where("p is not null").drop("p")
    if compat:  # a municipality sharing its name with a capital-region city is left out
        taken = capital.select(_name_key("city").alias("_name")).distinct()
        resolved = resolved.join(taken, _name_key(resolved["city"]) == taken["_name"], "left_anti")
    return named, towns, capital.unionByName(resolved)


def build_location_lookup(
    regions: DataFrame,
    provinces: DataFrame,
    municipalities: DataFrame,
    order: str = "code",
    reference_compat: bool = True,
    fix_regions: bool = False,
) -> DataFrame:
    """``(kind, key, location, region)`` with kinds city_province, city, ambiguous, province.

    Regions and provinces follow from the code prefixes.  ``order`` decides which of
    several equal names is kept (the last).  City names known in more than one region
    are ambiguous.
    """
    named, _, entries = _entries(regions, provinces, municipalities, order, reference_compat)
    precise = (
        entries.where("province is not null")
        .groupBy(F.concat(_name_key("city"), F.lit("|"), _name_key("province")).alias("key"))
        .agg(_last(F.struct("city", "region"), F.col("ord")).alias("v"))
        .select(F.lit("city_province").alias("kind"), "key", "v.city", "v.region")
    )
    by_name = entries.groupBy(_name_key("city").alias("key")).agg(
        F.count_distinct(F.coalesce("region", F.lit("\0"))).alias("n"),
        _last(F.col("city"), F.col("ord")).alias("city"),
        F.max("region").alias("region"),
    )
    unique = F.col("n") == 1
    cities = by_name.select(
        F.when(unique, "city").otherwise("ambiguous").alias("kind"),
        "key",
        F.when(unique, F.col("city")).alias("city"),
        F.when(unique, F.col("region")).alias("region"),
    )
    province_name = official_name("description")
    only_province = (
        named.groupBy(_name_key(province_name).alias("key"))
        .agg(_last(F.struct(province_name.alias("city"), "region"), F.col("ord")).alias("v"))
        .select(F.lit("province").alias("kind"), "key", "v.city", "v.region")
    )
    lookup = precise.unionByName(cities).unionByName(only_province)
    if fix_regions:
        renamed = F.create_map(*[F.lit(x) for kv in P.RENAMED_REGIONS.items() for x in kv])
        fixed = F.coalesce(F.try_element_at(renamed, F.lower(strip("region"))), F.col("region"))
        lookup = lookup.withColumn("region", fixed)
    return lookup.withColumnRenamed("city", "location").select("kind", "key", "location", "region")


def lookup_statistics(
    regions: DataFrame,
    provinces: DataFrame,
    municipalities: DataFrame,
    order: str = "code",
) -> DataFrame:
    """Municipalities without a province, and those dropped for a capital-region name."""
    _, towns, _ = _entries(regions, provinces, municipalities, order, True)
    capital = (
        provinces.where(F.substring("code", 1, 2) == P.CAPITAL_REGION_PREFIX)
        .select(_name_key(official_name("description")).alias("_name"))
        .distinct()
    )
    marked = towns.join(
        capital.withColumn("_taken", F.lit(True)), _name_key("city") == capital["_name"], "left"
    )
    found = F.col("p").isNotNull()
    return marked.agg(
        F.count_if(~found).alias("unresolved"),
        F.count_if(found & F.col("_taken").isNotNull()).alias("capital_duplicates"),
    )


# -------------------------------------------------------------- standardization


def clean_location(c: Column | str) -> Column:
    """Drop country, capital-region, "city of", district and "(capital)" wording.

    The order matters: "ncr" is only removed from the end, before the district goes.
    """
    text = squeeze(strip(c))
    for pattern in (
        r",?\s*philippines\s*$",
        r",?\s*metro manila\s*$",
        r",?\s*ncr\s*$",
        r"^\s*city\s+of\s+",
        r",?\s*(?:first|second|third|fourth|fifth|sixth|seventh)\s+district\s*$",
        r"\s*\(capital\)",
    ):
        text = F.regexp_replace(text, "(?iU)" + pattern, "")
    text = F.regexp_replace(text, r"(?U)\s*,\s*", ", ")
    return strip(F.regexp_replace(text, r"(?U)[,\s]+$", ""))


def _variants(key: Column) -> Column:
    """The name, the name without " city" and the name with it."""
    bare = strip(F.regexp_replace(key, r"(?U)\s+city$", ""))
    forms = F.array(
        key,
        F.when(bare != key, bare),
        F.when(~key.endswith(" city"), F.concat(key, F.lit(" city"))),
    )
    return F.array_compact(forms)


def _probe(kind: str, key: Column, shown: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        key.alias("key"),
        (shown if shown is not None else F.lit(None).cast("string")).alias("shown"),
    )


def _probes(parts: Column, key: Column) -> Column:
    """Lookups to try, best first: city with province, city, then province."""
    head = F.coalesce(F.get(parts, F.lit(0)), key)
    second = F.get(parts, F.lit(1))

    def city_only(name: Column) -> Column:
        return F.flatten(
            F.transform(
                _variants(name), lambda v: F.array(_probe("city", v), _probe("ambiguous", v, v))
            )
        )

    with_province = F.when(
        second.isNotNull(),
        F.transform(
            _variants(head), lambda v: _probe("city_province", F.concat(v, F.lit("|"), second))
        ),
    ).otherwise(F.filter(F.array(_probe("city_province", head)), lambda _: F.lit(False)))
    rest = F.slice(parts, F.lit(2), F.size(parts))
    return F.concat(
        with_province,
        city_only(head),
        F.flatten(F.transform(rest, city_only)),
        F.array(_probe("province", head)),
        F.transform(rest, lambda p: _probe("province", p)),
    )


def _direct_location(raw: Column, key: Column, cleaned: Column) -> Column:
    """(location, region) of texts that need no lookup, else null."""

    def result(location: Column | str, region: str | None) -> Column:
        location = F.lit(location) if isinstance(location, str) else location
        return F.struct(location.alias("location"), F.lit(region).cast("string").alias("region"))

    return (
        F.when(F.coalesce(raw, F.lit("")) == "", result(P.UNKNOWN, None))
        .when(raw.rlike(REMOTE_WORDING), result(P.REMOTE, None))
        .when(key.isin(*P.OVERSEAS_COUNTRIES), result(title_case(raw), P.OVERSEAS))
        .when(key.isin(*P.OVERSEAS_CONTINENTS), result(P.OVERSEAS_UNSPECIFIED, P.OVERSEAS))
        .when(cleaned == "", result(P.UNKNOWN, None))
    )


def location_dimension(raw_locations: DataFrame, lookup: DataFrame, column: str = "location") -> DataFrame:
    """One row per distinct raw text: ``(raw_location, location, region, postings)``.

    Distinct values are formed before anything else, so popular places collapse in
    the map tasks and each text is resolved once.
    """
    filled = raw_locations.select(strip(column).alias("raw_location")).where("raw_location <> ''")
    texts = filled.groupBy("raw_location").agg(F.count("*").alias("postings"))
    texts = texts.withColumns(
        {"_key": normalize_key("raw_location"), "_cleaned": clean_location("raw_location")}
    )
    texts = texts.withColumn(
        "_direct", _direct_location(F.col("raw_location"), F.col("_key"), F.col("_cleaned"))
    )
    names = F.transform(F.split(normalize_key("_cleaned"), ","), strip)
    texts = texts.withColumn("_parts", F.filter(names, lambda p: p != ""))
    tries = F.when(F.col("_direct").isNull(), _probes(F.col("_parts"), normalize_key("_cleaned")))
    probed = texts.select(
        "raw_location", "postings", "_direct", "_cleaned",
        F.posexplode_outer(tries).alias("_rank", "_try"),
    ).select("raw_location", "postings", "_direct", "_cleaned", "_rank", "_try.*")
    # a town that very many texts name is looked up apart, so no task gets all of its probes
    probe = F.concat("kind", F.lit("|"), "key").alias("_probe_key")
    known = lookup.select(probe, F.col("location").alias("_name"), "region", F.lit(True).alias("_hit"))
    matched = lookup_join(probed.select("*", probe), known, "_probe_key")
    found = F.struct(
        F.coalesce(title_case("shown"), F.col("_name")).alias("location"),
        F.when(F.col("kind") == "ambiguous", P.AMBIGUOUS).otherwise(F.col("region")).alias("region"),
    )
    best = matched.groupBy("raw_location").agg(
        F.first("postings").alias("postings"),
        F.first("_direct").alias("_direct"),
        F.first("_cleaned").alias("_cleaned"),
        F.min_by(F.when(F.col("_hit"), found), F.when(F.col("_hit"), F.col("_rank"))).alias("_found"),
    )
    unmapped = F.struct(
        title_case("_cleaned").alias("location"), F.lit(None).cast("string").alias("region")
    )
    answer = F.coalesce("_direct", "_found", unmapped)
    return best.select("raw_location", "postings", answer.alias("_a")).select(
        "raw_location", "_a.location", "_a.region", "postings"
    )


def standardize_locations(
    df: DataFrame,
    lookup: DataFrame | None = None,
    column: str = "location",
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Replace ``column`` by the standard location and add ``region``.

    ``dimension`` is a stored result of :func:`location_dimension`; without one it is
    computed and stored first, so that its size is known when the join is planned.
    A small dimension is broadcast and the postings stay where they are; a large one
    is merged, with popular places split off first (see :func:`lookup_join`).
    """
    if dimension is None:
        dimension = staged(location_dimension(df, lookup, column), "locations")
    popular = hot_keys(dimension, "raw_location", "postings")
    names = dimension.select(
        "raw_location", F.col("location").alias("_location"), F.col("region").alias("_region")
    )
    keyed = df.withColumn("raw_location", F.nullif(strip(column), F.lit("")))
    joined = lookup_join(keyed, names, "raw_location", popular)
    return joined.withColumns(
        {column: F.coalesce("_location", F.lit(P.UNKNOWN)), "region": F.col("_region")}
    ).drop("raw_location", "_location", "_region")
