"""Incremental collection: which listed postings are new, and where a crawl stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.text import blank_to_null
from jobmarket.operators.skew import lookup_join
from jobmarket.schemas import RAW


def _nonblank(url: str) -> Column:
    return F.coalesce(F.col(url), F.lit("")) != ""


def only_unseen(listings: DataFrame, seen: DataFrame, url: str = "job_url") -> DataFrame:
    """Listings with an address that history does not hold; repeats survive.

    An address listed very often is looked up apart, so no task gets all of its rows.
    """
    history = seen.select(F.col("job_url").alias(url)).distinct().withColumn("_known", F.lit(True))
    return lookup_join(listings.where(_nonblank(url)), history, url).where("_known IS NULL").drop("_known")


def _pairs(listings: DataFrame, page: str, url: str) -> DataFrame:
    """(page, url, n) of all listings, blank addresses included, folded before the shuffle."""
    pairs = listings.select(F.col(page).alias("page"), F.col(url).alias("url"))
    return pairs.groupBy("page", "url").agg(F.count("*").alias("n"))


def _addresses(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, first, known): the first page of every address, and whether history holds it."""
    first = pairs.where(_nonblank("url")).groupBy("url").agg(F.min("page").alias("first"))
    history = seen.select(F.col("job_url").alias("url")).distinct().withColumn("_known", F.lit(True))
    return first.join(history, "url", "left").select("url", "first", F.coalesce("_known", F.lit(False)).alias("known"))


def _page_flags(pairs: DataFrame, addresses: DataFrame) -> DataFrame:
    """Per page: listings, new listings, and whether it has addresses, first ones, and ones unknown to history.

    Nothing stands between the shuffle of the pairs and this join, so adaptive execution can split an address on very many pages.
    """
    first = F.col("first") == F.col("page")
    return pairs.join(addresses, "url", "left").groupBy("page").agg(
        F.sum("n").alias("listings"),
        F.sum(F.when(first & ~F.col("known"), F.col("n")).otherwise(0)).alias("new_listings"),
        F.bool_or(F.col("first").isNotNull()).alias("has_urls"),
        F.bool_or(F.coalesce(first, F.lit(False))).alias("has_first"),
        F.bool_or(F.coalesce(~F.col("known"), F.lit(False))).alias("has_unknown"),
    )


def _stop(flags: DataFrame, history: DataFrame, page: str, pages: DataFrame | None) -> DataFrame:
    stalled = F.col("has_urls") & ~F.col("has_first")
    # with no history at all the second test is off
    stops = flags.where(stalled | (~F.col("has_unknown") & history.exists())).select("page")
    if pages is not None:
        fetched = pages.select(F.col(page).alias("page")).distinct()
        stops = stops.unionByName(fetched.join(flags, "page", "left_anti"))
    return stops.agg(F.min("page").alias("stop_page"))


def crawl_stop(
    listings: DataFrame, seen: DataFrame, page: str = "page", url: str = "job_url",
    pages: DataFrame | None = None,
) -> DataFrame:
    """One row: the first page that ends the crawl, null if none does.

    A page ends the crawl if it is empty (needs ``pages``, the list of fetched pages),
    if all its addresses were on earlier pages, or if history is not empty and holds
    all of them.  Listings are folded per (page, address) once; that table gives the
    first page of every address and, joined with it, the flags of every page.
    """
    pairs = _pairs(listings, page, url)
    return _stop(_page_flags(pairs, _addresses(pairs, seen)), seen, page, pages)


def collect_new(
    listings: DataFrame, seen: DataFrame, page: str = "page", url: str = "job_url",
    pages: DataFrame | None = None, max_pages: int | None = None, incremental: bool = True,
) -> DataFrame:
    """Listings a crawl keeps: before the stop page, on the address's first page, unseen.

    With ``max_pages`` the crawl ends after that page: later pages are left for the next run.
    Repeats of an address on its first page are all kept.  The join back runs on
    (address, page), so an address listed on very many pages is spread out.
    """
    if max_pages is not None:
        listings = listings.where(F.col(page) <= max_pages)
        pages = pages.where(F.col(page) <= max_pages) if pages is not None else None
    history = seen if incremental else seen.limit(0)
    pairs = _pairs(listings, page, url)
    addresses = _addresses(pairs, history)
    stop = _stop(_page_flags(pairs, addresses), history, page, pages).select(
        F.coalesce(F.col("stop_page").cast("long"), F.lit((1 << 63) - 1)).alias("stop_page")
    )
    wanted = addresses.where(~F.col("known")).select(F.col("url").alias("_url"), F.col("first").alias("_page"))
    here = (F.col(url) == F.col("_url")) & (F.col(page) == F.col("_page"))
    return listings.where(F.col(page) < stop.scalar()).join(wanted, here, "left_semi")


def page_statistics(
    listings: DataFrame, seen: DataFrame, page: str = "page", url: str = "job_url"
) -> DataFrame:
    """Per page: listings and how many of them are new (first page, not in history)."""
    pairs = _pairs(listings, page, url)
    return _page_flags(pairs, _addresses(pairs, seen)).select("page", "listings", "new_listings")


def merge_details(listings: DataFrame, details: DataFrame, url: str = "job_url") -> DataFrame:
    """Detail fields replace listing fields where they are non-empty.

    An address with several detail rows uses one of them as a whole: the greatest by its columns in order.
    """
    fields = [c for c in details.columns if c != url]
    # one row per address before the join, so repeated details multiply nothing
    one = details.groupBy(url).agg(F.max(F.struct(*fields)).alias("_d"))
    renamed = one.select(url, *[F.col(f"_d.{c}").alias(f"_d_{c}") for c in fields])
    joined = lookup_join(listings, renamed, url)
    merged = {
        c: F.coalesce(blank_to_null(f"_d_{c}"), F.col(c) if c in listings.columns else F.lit(None))
        for c in fields
    }
    return joined.withColumns(merged).drop(*[f"_d_{c}" for c in fields])


def with_provenance(
    listings: DataFrame, source: str, collected_at: str | Column, source_url: str | None = None
) -> DataFrame:
    """Raw postings of one run: source, its address and one collection time."""
    stamp = F.lit(collected_at) if isinstance(collected_at, str) else collected_at
    df = listings.withColumns(
        {"source": F.lit(source), "source_url": F.lit(source_url).cast("string"), "collected_at": stamp}
    )
    for field in RAW:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast("string"))
    return df


def union_seen(seen: DataFrame, new: DataFrame, url: str = "job_url") -> DataFrame:
    """History plus the addresses of this run."""
    fresh = new.select(F.col(url).alias("job_url")).where(F.coalesce("job_url", F.lit("")) != "")
    return seen.select("job_url").unionByName(fresh).distinct()
