"""Disc images as rows (image_id, path, length, content), and the layout of their sectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR

#: Name, filing system, bytes, sides, tracks a side, sectors a track, and whether sides alternate by track.
FORMATS = [
    ("dfs-40", "dfs", 102400, 1, 40, 10, False),
    ("dfs-80", "dfs", 204800, 1, 80, 10, False),
    ("dfs-40-ds", "dfs", 204800, 2, 40, 10, True),
    ("dfs-80-ds", "dfs", 409600, 2, 80, 10, True),
    ("adfs-s", "adfs", 163840, 1, 40, 16, False),
    ("adfs-m", "adfs", 327680, 1, 80, 16, False),
    ("adfs-l", "adfs", 655360, 2, 80, 16, True),
]
TWO_SIDED_BYTES = 655360


def read_images(spark: SparkSession, path: str, pattern: str = "*.{ssd,dsd,adf,adl,dat,dsc}") -> DataFrame:
    """All images below a folder, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("image_id"), "path", "length", "content")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, fs string, bytes long, sides int, tracks int, spt int, interleaved boolean")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def filing_system(path: Column) -> Column:
    """By extension; null where it is unknown."""
    return F.when(extension(path).isin("ssd", "dsd"), "dfs").when(extension(path).isin("adf", "adl", "dat"), "adfs")


def prefix_issue(requested: Column, detected: Column) -> Column:
    """What forbids reading an image of one filing system as another; null where nothing does. Partitions lie on hierarchical discs."""
    return F.when(detected.isNull(), "unknown-extension").when((requested == "dfs") & (detected != "dfs"), "not-flat").when(requested.isin("adfs", "afs") & (detected == "dfs"), "flat-image")


def with_layout(images: DataFrame) -> DataFrame:
    """The images with fs, sides, tracks, spt and the bytes an untruncated image has; issues have a code.

    Flat single-sided images of other sizes that are whole sectors are one long track. Hierarchical images other
    than the three floppy sizes are flat hard discs of 33 sectors a track.
    """
    ext, size = extension(F.col("path")), F.col("length")
    fs = filing_system(F.col("path"))
    whole = size % SECTOR == 0
    floppy = size.isin(163840, 327680, 655360) & (ext != "dat")
    tracks = (
        F.when(ext == "ssd", F.when(size == 102400, 40).when(size == 204800, 80).when(whole, 1))
        .when(ext == "dsd", F.when(size <= 204800, 40).otherwise(80))
        .when(floppy, F.when(size == 163840, 40).otherwise(80))
        .when(fs == "adfs", F.ceil(size / (33 * SECTOR)))
    )
    spt = F.when((ext == "ssd") & (F.col("tracks") == 1), F.floor(size / SECTOR)).when(fs == "dfs", 10).when(floppy, 16).otherwise(33)
    sides = F.when((ext == "dsd") | (floppy & (size == 655360)), 2).otherwise(1)
    code = F.when(fs.isNull(), "unknown-extension").when(size == 0, "empty").when(~whole, "not-whole-sectors").when((fs == "adfs") & (size < 7 * SECTOR), "too-small")
    out = images.withColumn("fs", fs).withColumn("tracks", tracks.cast("int")).withColumn("spt", spt.cast("int")).withColumn("sides", sides)
    return out.withColumn("full_bytes", F.greatest(size, F.when(F.col("fs") == "dfs", F.col("tracks") * F.col("spt") * F.col("sides") * SECTOR).otherwise(size))).withColumn("code", code)


def expanded(images: DataFrame) -> DataFrame:
    """Short images padded with zeros to the size of their format, and how many bytes that added."""
    missing = F.greatest(F.col("full_bytes") - F.col("length"), F.lit(0))
    return images.withColumn("content", F.rpad("content", F.col("full_bytes").cast("int"), F.lit(b"\x00"))).withColumn("added", missing)


def in_linear_order(images: DataFrame) -> DataFrame:
    """Two-sided hierarchical floppies with side 1 behind side 0; their files hold a track of each in turn. Others stay.

    The readers of hierarchical discs and of partitions count sectors in this order.
    """
    return images.withColumn("content", F.when(_is_two_sided(), _tracks(lambda side, track: 2 * track + side)).otherwise(F.col("content")))


def in_file_order(images: DataFrame) -> DataFrame:
    """The reverse: images as their files hold them, from linear content."""
    return images.withColumn("content", F.when(_is_two_sided(), _tracks(lambda side, track: 80 * side + track, by_side=False)).otherwise(F.col("content")))


def _is_two_sided() -> Column:
    return (F.col("fs") == "adfs") & (F.col("sides") == 2) & (F.length("content") == TWO_SIDED_BYTES)


def _tracks(place: Callable[[int, int], int], by_side: bool = True) -> Column:
    size = 16 * SECTOR
    order = [(s, t) for s in range(2) for t in range(80)] if by_side else [(s, t) for t in range(80) for s in range(2)]
    def moved(content: Column) -> Column:  # as a lambda it stays out of the generated code, which 160 parts would make too long
        return F.concat(*[content.substr(F.lit(place(s, t) * size + 1), F.lit(size)) for s, t in order])

    return F.transform(F.array("content"), moved)[0]


def surfaces(images: DataFrame, sequential: bool = False) -> DataFrame:
    """A row for each side that has a catalogue of its own: (..., side, offset0, stride); only flat images have two.

    Sides alternate by track, or follow one another whole where `sequential`.
    """
    sides = F.when(F.col("fs") == "dfs", F.col("sides")).otherwise(1)
    out = images.withColumn("side", F.explode(F.sequence(F.lit(0), sides - 1)))
    track = F.col("spt") * SECTOR
    if sequential:
        return out.withColumn("offset0", F.col("side") * F.col("tracks") * track).withColumn("stride", track)
    return out.withColumn("offset0", F.col("side") * track).withColumn("stride", track * F.when(F.col("fs") == "dfs", F.col("sides")).otherwise(1))


def address(lba: Column) -> Column:
    """Byte offset of a sector of a surface."""
    return F.col("offset0") + F.floor(lba / F.col("spt")) * F.col("stride") + (lba % F.col("spt")) * SECTOR


def sector_bytes(lba: Column) -> Column:
    return F.col("content").substr((address(lba) + 1).cast("int"), F.lit(SECTOR))


def sectors(surface: DataFrame, start: Column, count: Column) -> DataFrame:
    """(image_id, side, lba, byte_offset, data) of a range of sectors of each surface; a count below 1 gives none."""
    lbas = F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<bigint>"))
    spread = surface.withColumn("lba", F.explode(lbas))
    return spread.select("image_id", "side", "lba", address(F.col("lba")).alias("byte_offset"), sector_bytes(F.col("lba")).alias("data"))


def range_bytes(start: Column, length: Column) -> Column:
    """Bytes of a file on a surface: track by track, cut to its length; empty for an empty one."""
    last = start + F.floor((length + SECTOR - 1) / SECTOR) - 1
    spt = F.col("spt")
    tracks = F.sequence(F.floor(start / spt).cast("int"), F.floor(last / spt).cast("int"))

    def add(done: Column, track: Column) -> Column:
        low, high = F.greatest(start, track * spt), F.least(last, track * spt + spt - 1)
        return F.concat(done, F.col("content").substr((address(low) + 1).cast("int"), ((high - low + 1) * SECTOR).cast("int")))

    return F.when(length > 0, F.aggregate(tracks, F.lit(b""), add).substr(F.lit(1), length.cast("int"))).otherwise(F.lit(b""))


def byte_slice(data: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """The bytes that a slice [start:stop:step] takes: places below 0 count from the end, a step below 0 goes back."""
    if not step:
        raise ValueError("the step can't be 0")
    n = F.length(data)
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def place(at: int | None, missing: Column) -> Column:
        return missing if at is None else F.least(F.greatest(F.lit(at) if at >= 0 else n + at, low), high)

    first, last = place(start, low if step > 0 else high), place(stop, high if step > 0 else low)
    count = F.greatest(F.ceil((last - first) / step), F.lit(0)).cast("int")
    none = F.when(data.isNull(), F.lit(None).cast("binary"))
    if step == 1:
        return none.when(count > 0, data.substr(first + 1, count)).otherwise(F.lit(b""))
    taken = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.hex(data.substr((first + k * step + 1).cast("int"), F.lit(1))))
    return none.when(count > 0, F.unhex(F.array_join(taken, ""))).otherwise(F.lit(b""))


def parse_geometry(content: Column) -> Column:
    """struct<cylinders, heads, spt, capacity> of a 22-byte geometry sidecar; null where it is shorter."""
    from platterlake.functions.numbers import byte_at, uint_be

    cylinders, heads = uint_be(content, 13, 2), byte_at(content, 15)
    return F.when(F.length(content) >= 22, F.struct(cylinders.alias("cylinders"), heads.alias("heads"), F.lit(33).cast("long").alias("spt"), (cylinders * heads * 33 * SECTOR).alias("capacity")))


def cylinders_for(capacity: Column, heads: Column, spt: int = 33) -> Column:
    return F.ceil(capacity / (heads * spt * SECTOR)).cast("long")
