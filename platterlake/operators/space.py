"""Space on a disc: free maps, first fit, compaction, extents, usage bars. Keyed by image; scales with files, not sectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR


def free_map(entries: DataFrame, totals: DataFrame, reserved: int = 2, key: str = "image_id") -> DataFrame:
    """Maximal runs of sectors that neither the catalogue nor a file uses: (image, start_sector, length).

    `entries` has image, start_sector, sectors; `totals` has image, total_sectors. One sort per image: each used
    run is compared with the furthest end before it.
    """
    end = totals.select(key, F.col("total_sectors").cast("long").alias("start_sector"), F.lit(0).cast("long").alias("sectors"))
    used = entries.where("sectors > 0").select(key, F.col("start_sector").cast("long"), F.col("sectors").cast("long")).unionByName(end)
    used = used.join(totals.select(key, "total_sectors"), key).withColumn("start_sector", F.least("start_sector", F.col("total_sectors").cast("long")))
    before = Window.partitionBy(key).orderBy("start_sector", "sectors").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max(F.col("start_sector") + F.col("sectors")).over(before), F.lit(0)), F.lit(reserved))
    gaps = used.withColumn("reached", reached.cast("long")).where("start_sector > reached")
    return gaps.select(key, F.col("reached").alias("start_sector"), (F.col("start_sector") - F.col("reached")).alias("length")).distinct()


def free_summary(regions: DataFrame, key: str = "image_id") -> DataFrame:
    return regions.groupBy(key).agg(F.count("length").alias("regions"), F.sum("length").alias("free_sectors"), F.max("length").alias("largest"))


def free_sectors(entries: DataFrame, totals: DataFrame, reserved: int = 2, key: str = "image_id") -> DataFrame:
    """Sectors minus the catalogue's and each file's (where files overlap, both count)."""
    taken = entries.groupBy(key).agg(F.sum("sectors").alias("taken"))
    return totals.join(taken, key, "left").select(key, (F.col("total_sectors") - reserved - F.coalesce("taken", F.lit(0))).cast("long").alias("free_sectors"))


def first_fit(regions: DataFrame, need: Column, key: str = "image_id") -> DataFrame:
    """(image, start_sector): the lowest run that holds `need` sectors; images without one are left out."""
    return regions.where(F.col("length") >= need).groupBy(key).agg(F.min("start_sector").alias("start_sector"))


def first_fit_issues(regions: DataFrame, images: DataFrame, need: Column, key: str = "image_id") -> DataFrame:
    """(image, code, detail) of images without a run that holds `need` sectors."""
    largest = regions.groupBy(key).agg(F.max("length").alias("_most"))
    joined = images.select(key).distinct().join(largest, key, "left").where(F.coalesce("_most", F.lit(0)) < need)
    return joined.select(key, F.lit("no-space").alias("code"), F.coalesce("_most", F.lit(0)).cast("string").alias("detail"))


def merge_free(regions: DataFrame, freed: DataFrame, key: str = "image_id") -> DataFrame:
    """Free runs with newly freed ones, neighbours made one."""
    return coalesce_runs(regions.select(key, "start_sector", "length").unionByName(freed.select(key, "start_sector", "length")), key)


def coalesce_runs(runs: DataFrame, key: str = "image_id") -> DataFrame:
    """Runs that touch or overlap, by place, made one."""
    order = Window.partitionBy(key).orderBy("start_sector", "length")
    before = F.max(F.col("start_sector") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_sector") <= F.col("_before"), 0).otherwise(1)).over(order)
    numbered = runs.withColumn("_before", before).withColumn("_island", island)
    out = numbered.groupBy(key, "_island").agg(F.min("start_sector").alias("start_sector"), F.max(F.col("start_sector") + F.col("length")).alias("_end"))
    return out.select(key, "start_sector", (F.col("_end") - F.col("start_sector")).alias("length"))


def coalesce_extents(extents: DataFrame, key: str = "object_id") -> DataFrame:
    """Extents of an object in their own order; one that begins where the one before ends is joined to it."""
    order = Window.partitionBy(key).orderBy("ordinal")
    fresh = F.when(F.lag(F.col("start") + F.col("length")).over(order) == F.col("start"), 0).otherwise(1)
    numbered = extents.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(order))
    return numbered.groupBy(key, "run").agg(F.min_by("start", "ordinal").alias("start"), F.sum("length").alias("length"))


def map_blocks(extents: DataFrame, per_block: int = 48, key: str = "object_id") -> DataFrame:
    """The map block of each extent and its place in it; `is_last` marks the blocks that have no next one."""
    order = Window.partitionBy(key).orderBy("ordinal")
    numbered = extents.withColumn("_n", F.row_number().over(order) - 1)
    blocks = numbered.withColumn("block_no", F.floor(F.col("_n") / per_block).cast("long")).withColumn("slot", (F.col("_n") % per_block).cast("long"))
    return blocks.withColumn("is_last", F.col("block_no") == F.max("block_no").over(Window.partitionBy(key))).drop("_n")


def locate_offsets(extents: DataFrame, offsets: DataFrame, key: str = "object_id") -> DataFrame:
    """The sector that holds each byte offset of an object (offsets: object, offset); offsets beyond the end are left out.

    An extent starts where the ones before end, so the join is on the object alone and the range a filter on it.
    """
    before = F.coalesce(F.sum("length").over(Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = extents.withColumn("_low", before)
    sector = F.floor(F.col("offset") / SECTOR).cast("long")
    joined = offsets.join(placed, key).where((sector >= F.col("_low")) & (sector < F.col("_low") + F.col("length")))
    return joined.select(key, "offset", (F.col("start") + sector - F.col("_low")).alias("sector"))


def compaction_layout(entries: DataFrame, reserved: int = 2, key: str = "image_id") -> DataFrame:
    """Start sectors after compaction, in catalogue order; images with a locked file are left out."""
    locked = entries.where("locked").select(key).distinct()
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(reserved) + F.coalesce(F.sum("sectors").over(before), F.lit(0))
    return entries.join(locked, key, "left_anti").withColumn("new_start", start.cast("long"))


def usage_bar(regions: DataFrame, totals: DataFrame, columns: int = 64, key: str = "image_id") -> DataFrame:
    """(image, bar): a column is `.` if any of its sectors is free, else `#`."""
    cells = totals.select(key, F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"), F.col("total_sectors").alias("_total"))
    low = F.floor(F.col("c") * F.col("_total") / columns).cast("long")
    high = F.greatest(F.floor((F.col("c") + 1) * F.col("_total") / columns).cast("long"), low + 1)
    cells = cells.withColumn("low", low).withColumn("high", high)
    free = regions.groupBy(key).agg(F.collect_list(F.struct("start_sector", "length")).alias("free"))  # as many as an image has files
    any_free = F.coalesce(F.exists("free", lambda r: (r["start_sector"] < F.col("high")) & (r["start_sector"] + r["length"] > F.col("low"))), F.lit(False))
    drawn = cells.join(free, key, "left").withColumn("mark", F.when(any_free, ".").otherwise("#"))
    return drawn.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "mark"))), lambda x: x["mark"]), "").alias("bar"))


def bitmap_free(bitmaps: DataFrame) -> DataFrame:
    """Free sectors of each cylinder's bitmap (one bit a sector, 1: free; `sectors` of them count)."""
    byte = lambda k: F.conv(F.hex(F.col("bitmap").substr(k + F.lit(1), F.lit(1))), 16, 10).cast("int")
    whole = F.floor(F.col("sectors") / 8).cast("int")
    mask = F.pow(F.lit(2), F.col("sectors") % 8).cast("int") - 1
    full = F.aggregate(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda n, k: n + F.bit_count(byte(k)))
    rest = F.when(F.col("sectors") % 8 > 0, F.bit_count(byte(whole).bitwiseAND(mask))).otherwise(0)
    return bitmaps.withColumn("free", (full + rest).cast("long"))


def best_cylinder(cylinders: DataFrame, key: str = "image_id") -> DataFrame:
    """The cylinder with most free sectors, the lowest where several have; images without free sectors are left out."""
    return cylinders.where("free > 0").groupBy(key).agg(F.max_by("cylinder", F.struct("free", -F.col("cylinder"))).alias("cylinder"), F.max("free").alias("free"))


def allocate(runs: DataFrame, need: int | Column, key: str = "image_id") -> DataFrame:
    """Runs that serve one request: cylinders with most free sectors first, first fit inside, the last run cut.

    `runs` has image, cylinder, start, length. All or nothing: images with too little space give no rows.
    """
    need = F.lit(need) if isinstance(need, int) else need
    sized = runs.withColumn("_free", F.sum("length").over(Window.partitionBy(key, "cylinder"))).withColumn("_all", F.sum("length").over(Window.partitionBy(key)))
    order = Window.partitionBy(key).orderBy(F.col("_free").desc(), "cylinder", "start")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = sized.where(F.col("_all") >= need).withColumn("ordinal", F.row_number().over(order)).withColumn("_before", before).where(F.col("_before") < need)
    return taken.select(key, "ordinal", "cylinder", "start", F.least("length", need - F.col("_before")).cast("long").alias("length"))


def old_map_checksum(data: Column, length: int = 255) -> Column:
    """Checksum of a free-map sector: bytes from the last down, each added with the carry of the one before.

    Adding the carry back keeps a sum of 1 to 255, equal to the sum of the bytes modulo 255; the first byte comes last, and
    its carry is dropped. As 256 is 1 modulo 255, a number of 7 bytes stands for the sum of its bytes, and each byte is read once.
    """
    parts = -(-(length - 1) // 7)

    def add(done: Column, digits: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.conv(F.substring(digits, 14 * k + 1, 14), 16, 10).cast("long") for k in range(parts)], done)

    head = F.conv(F.hex(data.substr(F.lit(1), F.lit(1))), 16, 10).cast("long")
    rest = F.rpad(data.substr(F.lit(2), F.lit(length - 1)), 7 * parts, F.lit(b"\x00"))
    carried = F.aggregate(F.array(F.hex(rest)), F.lit(0).cast("long"), add, lambda c: F.when(c == 0, 0).otherwise((c - 1) % 255 + 1))
    return ((carried + head) % 256).cast("int")
