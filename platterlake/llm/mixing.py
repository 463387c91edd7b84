"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platterlake.llm.shared import written

#: Hex digits of the seeded hash that name a bucket: 4,096 buckets of a source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Targets of sources with (source, source_size, weight).

    The budget, `share` times all sizes, is dealt by weight; a source stops at `max_epochs` times its size and
    the excess goes to the others by weight, again and again until none is above. In order of cap / weight the
    stopped sources come first, so running sums find that fixed point at once. One row per source meets in
    one task; the documents never do.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("_cap") / F.col("weight"), "source")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rest = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.col("_cap") * F.col("_rest") <= F.col("weight") * (F.col("_budget") - F.col("_before"))
    level = (F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)) * F.col("weight")
    return (
        sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(rest))
        .withColumn("_full", full)
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(level / F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything)))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, repeats, taken).

    `weights` go to the sources in code-point order, null last, repeating. A document is taken as often as its
    source is taken whole; the rest of the target is filled in the order of a seeded hash of the id, up to the
    document that brings the words nearest to it. Prefix sums run over hash buckets within a source first and
    over documents within a bucket then, so a source with a third of all rows is spread over all tasks.

    Null or empty text: size 0, taken 0 words. Null source: a source of its own. Null id: hashed as the word
    null. Equal ids and repeated rows: one result each, ordered by size where the hash ties. Empty table: no
    rows. Other columns are ignored whatever their names.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("_hash"),
    )
    d = written(d).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))  # texts are read once
    buckets = d.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = (
        buckets.groupBy("source")
        .agg(F.sum("_words").alias("source_size"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", deal)
    )
    targets = water_fill(sources, share, max_epochs).withColumnRenamed("source", "_source")
    by_bucket = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.withColumn("_below", F.coalesce(F.sum("_words").over(by_bucket), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_below", "_whole", "source_size", "target")
    )
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_below") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    part = ahead + F.col("size") / 2 <= F.col("target") - F.col("_whole") * F.col("source_size")
    return (
        d.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("repeats", F.col("_whole") + F.when(part, 1).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM s),
f AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w
              / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target
  FROM f),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN ahead + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
