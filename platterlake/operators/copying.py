"""Copies between discs as plan relations: what to create, in which order, under which name and access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platterlake.functions.access import from_server, to_server
from platterlake.functions.numbers import SECTOR

#: Sectors of a directory block, and the first sector behind map and root.
DIRECTORY_SECTORS, FIRST_FREE = 5, 7


def scope(path: Column) -> Column:
    """struct<partition, path> of `afs:$.F`; partition is null without a prefix."""
    prefix = F.lower(F.regexp_extract(path, r"^([A-Za-z]+):", 1))
    return F.struct(F.when(prefix != "", prefix).alias("partition"), F.regexp_replace(path, r"^[A-Za-z]+:", "").alias("path"))


def rebased(path: Column, source_root: str, target_root: str) -> Column:
    """The path below the target that a path below the source goes to; null for others."""
    below = F.upper(path).startswith(source_root.upper() + ".") | (F.upper(path) == source_root.upper())
    return F.when(below, F.concat(F.lit(target_root), path.substr(F.lit(len(source_root) + 1), F.length(path))))


def copy_plan(placed: DataFrame, source_root: str, target_root: str, access: str = "keep", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(..., target, action, step): all below the source root, directories before what is in them.

    `access`: keep, `to-server` or `from-server` (the column `access` is mapped where there is one).
    """
    plan = placed.withColumn("target", rebased(F.col("path"), source_root, target_root)).where("target is not null and depth > 0")
    plan = plan.withColumn("action", F.when(F.col("is_dir"), "mkdir").otherwise("file"))
    if access != "keep" and "access" in plan.columns:
        mapped = to_server(F.col("access"), F.col("is_dir")) if access == "to-server" else from_server(F.col("access"))
        plan = plan.withColumn("access", mapped)
    return plan.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("place")))


def merge_pairs(source: DataFrame, target: DataFrame, source_root: str, target_root: str, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(path, target, is_dir, exists): each source node with the place it goes to, and whether something is there."""
    moved = source.withColumn("target", rebased(F.col("path"), source_root, target_root)).where("target is not null")
    there = target.select(*keys, F.upper("path").alias("_t")).distinct().withColumn("exists", F.lit(True))
    joined = moved.withColumn("_t", F.upper("target")).join(there, [*keys, "_t"], "left")
    return joined.select(*keys, "path", "target", "is_dir", F.coalesce("exists", F.lit(False)).alias("exists"))


def emplace(library: DataFrame, target: DataFrame, stem: str, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(path, replaced): the library's root files below `$.stem`; its directories are skipped."""
    files = library.where((F.col("depth") == 1) & ~F.col("is_dir")).withColumn("path", F.concat(F.lit(f"$.{stem}."), "name"))
    there = target.select(*keys, F.upper("path").alias("_t")).distinct().withColumn("_is", F.lit(True))
    joined = files.withColumn("_t", F.upper("path")).join(there, [*keys, "_t"], "left")
    return joined.select(*keys, "path", F.coalesce("_is", F.lit(False)).alias("replaced"))


def rebuild_layout(placed: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Start sectors after a hierarchical disc is rebuilt in pre-order; empty files have none, the root stays."""
    own = F.when(F.col("is_dir"), DIRECTORY_SECTORS).otherwise(F.ceil(F.col("length") / SECTOR)).cast("long")
    before = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = placed.where("depth > 0").withColumn("sectors", own)
    start = F.lit(FIRST_FREE) + F.coalesce(F.sum("sectors").over(before), F.lit(0))
    return sized.withColumn("new_start", F.when(F.col("sectors") > 0, start).otherwise(0).cast("long"))


def split_at_cylinders(ranges: DataFrame, sectors_per_cylinder: int) -> DataFrame:
    """(..., cylinder, first, count): ranges (start, length) cut where cylinders end, with first counted in the cylinder."""
    spc = sectors_per_cylinder
    end = F.col("start") + F.col("length")
    cut = ranges.where("length > 0").withColumn("cylinder", F.explode(F.sequence(F.floor(F.col("start") / spc), F.floor((end - 1) / spc))))
    low, high = F.greatest("start", F.col("cylinder") * spc), F.least(end, (F.col("cylinder") + 1) * spc)
    return cut.withColumn("first", (low - F.col("cylinder") * spc).cast("long")).withColumn("count", (high - low).cast("long"))


def first_fit_sequence(regions: DataFrame, requests: DataFrame, key: str = "image_id") -> DataFrame:
    """(image, seq, need, start): requests served one after another from the first region that holds them; null where none does.

    What a request gets depends on those before it: an image's regions come first, its requests follow in order, and only
    the regions that are left are held.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    free = regions.select(key, F.lit(0).alias("turn"), long("start_sector"), long("length"))
    asked = requests.select(key, F.lit(1).alias("turn"), F.col("seq").cast("long").alias("start_sector"), F.col("need").cast("long").alias("length"))
    rows = free.unionByName(asked).where(F.col(key).isNotNull())
    kind = rows.schema[key].dataType.simpleString()

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, left = object(), []
        for batch in batches:
            at, taken = [], []
            for i, (own, turn, first, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if own != image:
                    image, left = own, []
                if not turn:
                    left.append([first, n])
                    continue
                fits = next((r for r in left if r[1] >= n), None)
                at.append(i)
                taken.append(fits and fits[0])
                if fits:
                    fits[0], fits[1] = fits[0] + n, fits[1] - n
                    left = [r for r in left if r[1]]
            served = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([served.column(0), served.column(2), served.column(3), pa.array(taken, pa.int64())], [key, "seq", "need", "start"])

    in_order = rows.repartition(key).sortWithinPartitions(key, "turn", "start_sector", "length")
    return in_order.mapInArrow(serve, f"`{key}` {kind}, seq bigint, need bigint, start bigint")
