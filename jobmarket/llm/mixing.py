"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k being Poisson distributed with the mean
``rate(s) = weight(s) / sum of weights * rows / rows(s)``.  The distribution is inverted at a
number drawn from a hash of seed and doc_id, so a run can be repeated exactly and needs no state.
Copies are then put into an order drawn from a hash of seed, doc_id and copy number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import by_bounded, staged, table

#: a larger mean is drawn as a sum of independent parts of at most this mean
PART = 16.0
#: terms of the distribution of one part; the tail beyond is below 1e-30
TERMS = 100
#: parts of a document that are drawn together; more are dealt out
PIECE = 64


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source_key, parts, cdf): for each source the number of parts of its rate and the distribution of one part.

    ``weights`` maps sources to target weights; sources not named get no row of the mix.
    Without it all sources weigh the same.  A null source is a source of its own.
    """
    counts = docs.groupBy(_source_key().alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(f"s:{name}"), F.lit(float(w)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source_key")), F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    whole = weighed.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    rate = F.col("weight") / F.lit(float(whole["weights"] or 1.0)) * F.lit(float(whole["rows"] or 0)) / F.col("n")
    rated = weighed.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    # running sums of rate^k / k!, scaled by exp(-rate)
    cdf = F.expr(
        f"""aggregate(sequence(1, {TERMS}),
            named_struct('term', exp(-rate / parts), 'sum', exp(-rate / parts), 'all', array(exp(-rate / parts))),
            (s, k) -> named_struct(
                'term', s.term * (rate / parts) / k,
                'sum', s.sum + s.term * (rate / parts) / k,
                'all', array_append(s.all, s.sum + s.term * (rate / parts) / k)),
            s -> s.all)"""
    )
    return rated.select("source_key", "rate", "parts", cdf.alias("cdf"))


def _source_key():
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("s:"), F.col("source")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """Documents repeated to the target weights, in a global random order.

    Adds ``copies`` (of this document), ``copy`` (from 1) and ``shuffle_key`` (hexadecimal; rows come
    range-partitioned and sorted by it); columns of these names in the input are replaced.
    Repeated rows of one doc_id get equal counts; a null doc_id counts as the text "null"; texts
    are not looked at.  An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    kept = docs.drop("copies", "copy", "shuffle_key")
    rates = staged(source_rates(docs, weights)).selectExpr("source_key AS __key", "parts AS __parts", "cdf AS __cdf")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rated = by_bounded(kept.withColumn("__key", _source_key()).withColumn("__name", name), rates, "__key")
    # a document with few parts is drawn in its row
    copies = rated.where(f"__parts <= {PIECE}").withColumn("copies", _drawn("1", "__parts", seed))
    copies = copies.withColumn("copy", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END")))
    mixed = copies.select(*kept.columns, "copies", "copy", "__name")
    if rates.where(f"__parts > {PIECE}").isEmpty():
        return _ordered(mixed, seed, spark).select(*kept.columns, "copies", "copy", "shuffle_key")
    # one of a rare source in pieces of PIECE parts, which are dealt out
    pieces = rated.where(f"__parts > {PIECE}").withColumn("__piece", F.explode(F.expr(f"sequence(0, (__parts - 1) div {PIECE})")))
    drawn = pieces.select("__key", "__name", "__piece", "__parts").distinct().join(F.broadcast(rates.select("__key", "__cdf")), "__key")
    drawn = drawn.withColumn("__n", _drawn(f"__piece * {PIECE} + 1", f"least(__parts, (__piece + 1) * {PIECE})", seed))
    doc = Window.partitionBy("__key", "__name")
    drawn = drawn.select(
        "__key", "__name", "__piece", "__n", F.sum("__n").over(doc).cast("int").alias("copies"),
        (F.sum("__n").over(doc.orderBy("__piece")) - F.col("__n")).cast("int").alias("__before"),
    )
    parts = pieces.join(drawn, ["__key", "__name", "__piece"]).where("__n > 0")
    parts = parts.withColumn("copy", F.explode(F.expr("sequence(__before + 1, __before + __n)")))
    return _ordered(mixed.unionAll(parts.select(*mixed.columns)), seed, spark).select(*kept.columns, "copies", "copy", "shuffle_key")


def _drawn(first: str, last: str, seed: str):
    """Sum of the draws of parts ``first`` to ``last``."""
    return F.expr(
        f"""aggregate(sequence({first}, {last}), 0, (total, i) -> total + size(filter(__cdf, c ->
            c <= cast(conv(substr(md5({seed!r} || ':' || __name || ':' || i), 1, 8), 16, 10) AS double) / 4294967296D)))"""
    )


def _ordered(copies: DataFrame, seed: str, spark: SparkSession) -> DataFrame:
    """Rows in the order of their shuffle key.  Keys are uniform, so their leading digits cut even ranges without a sample."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("__name"), F.col("copy").cast("string"))))
    place = F.expr(f"cast(conv(substr(shuffle_key, 1, 8), 16, 10) AS long) * {parts} div {1 << 32}").cast("int")
    return keyed.repartitionById(parts, place).sortWithinPartitions("shuffle_key", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH sources AS (
    SELECT source, count(*) AS n, sum(count(*)) OVER () * 1.0 AS total, count(*) OVER () AS sources
    FROM documents GROUP BY source
), rates AS (
    SELECT source, 1.0::DOUBLE / sources * total / n AS rate FROM sources
), parted AS (
    SELECT source, rate, greatest(1, ceil(rate / {PART}))::INTEGER AS parts FROM rates
), terms AS (
    SELECT source, parts, k, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1.0))
        OVER (PARTITION BY source ORDER BY k) AS c
    FROM parted, range(0, {TERMS + 1}) AS t(k)
), cdfs AS (
    SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM terms GROUP BY source
), drawn AS (
    SELECT d.*, coalesce(d.doc_id::VARCHAR, 'null') AS name,
        list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda c:
            c <= ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE
        ))))::INTEGER AS copies
    FROM documents d JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source
), unfolded AS (
    SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copies, copy, md5('mix:order:' || name || ':' || copy) AS shuffle_key
FROM unfolded
"""
