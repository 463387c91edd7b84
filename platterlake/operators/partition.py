"""Planning a file-server partition in the tail of a disc."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR


def plan_partition(discs: DataFrame, mode: Column, amount: Column) -> DataFrame:
    """discs (image_id, cylinders, sectors_per_cylinder, tail_free) with the partition's cylinders and start.

    Modes: `max`, `cylinders`, `sectors`, `bytes`, `ratio` (of the disc, 0 to 1) and `existing_free` (the free tail);
    sizes are rounded up to whole cylinders, `existing_free` down. One cylinder at least stays; where the plan
    doesn't fit, the code says why and the plan is null.
    """
    spc, total = F.col("sectors_per_cylinder"), F.col("cylinders")
    up = lambda sectors: F.ceil(sectors / spc)
    fitting = F.floor(F.col("tail_free") / spc)
    wanted = (
        F.when(mode == "max", fitting)
        .when(mode == "cylinders", amount)
        .when(mode == "sectors", up(amount))
        .when(mode == "bytes", up(F.ceil(amount / SECTOR)))
        .when(mode == "ratio", F.ceil(total * amount))
        .when(mode == "existing_free", fitting)
    ).cast("long")
    code = F.when(wanted.isNull(), "unknown-mode").when(wanted < 1, "empty").when(wanted > total - 1, "no-room").when(wanted > fitting, "not-compacted")
    out = discs.withColumn("code", code)
    ok = F.col("code").isNull()
    return out.withColumn("partition_cylinders", F.when(ok, wanted)).withColumn("start_cylinder", F.when(ok, total - wanted).cast("long")).withColumn("start_sector", F.when(ok, (total - wanted) * spc).cast("long"))


def clip_free(regions: DataFrame, plans: DataFrame, key: str = "image_id") -> DataFrame:
    """Free regions cut where the partition starts."""
    start = F.coalesce("_start", F.lit((1 << 62)))
    cut = regions.join(plans.select(key, F.col("start_sector").alias("_start")), key, "left")
    return cut.withColumn("length", F.least(F.col("length"), start - F.col("start_sector"))).where("length > 0").drop("_start")
