"""Flat catalogues: 31 entries in sectors 0 and 1, or a second 31 in sectors 2 and 3. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.functions.numbers import byte_at, sectors_required, uint_le
from platterlake.functions.text import decode_text
from platterlake.sources.images import range_bytes, sector_bytes

#: Fixed values of the two-section catalogue: its marker, and sectors that the catalogues take.
MARKER = "AA" * 12
CATALOGUE_SECTORS = {"standard": 2, "double": 4}


def _title_ok(data: Column, offset: int, count: int) -> Column:
    return F.forall(F.array(*[byte_at(data, offset + k) for k in range(count)]), lambda b: (b == 0) | ((b > 31) & (b < 128)))


def identify(surface: DataFrame) -> DataFrame:
    """The surfaces with `catalogue`: standard, double or null. The header rules have to hold in either case."""
    s = [sector_bytes(F.lit(k)) for k in range(4)]
    out = surface
    for k in range(4):
        out = out.withColumn(f"_s{k}", s[k])
    s0, s1, s2, s3 = (F.col(f"_s{k}") for k in range(4))
    total = byte_at(s1, 6).bitwiseAND(F.lit(3)) * 256 + byte_at(s1, 7)
    header = _title_ok(s0, 1, 7) & _title_ok(s1, 0, 4) & (byte_at(s1, 5) % 8 == 0) & (byte_at(s1, 6).bitwiseAND(F.lit(0xCC)) == 0)
    header = header & (total >= 4) & (total % 10 == 0) & (total * 256 <= F.col("full_bytes"))
    same = (byte_at(s3, 6) == byte_at(s1, 6)) & (byte_at(s3, 7) == byte_at(s1, 7)) & (byte_at(s3, 5) % 8 == 0)
    double = (F.hex(F.substring(s2, 1, 12)) == MARKER) & same
    marked = F.hex(F.substring(s2, 1, 8)) == MARKER[:16]
    shadow = (F.hex(F.substring(s3, 1, 4)) == "00000000") & same
    kind = F.when(header & double, "double").when(header & ~marked & ~shadow, "standard")
    return out.withColumn("catalogue", kind).drop("_s0", "_s1", "_s2", "_s3")


def disc_info(catalogued: DataFrame) -> DataFrame:
    s0, s1, s3 = (sector_bytes(F.lit(k)) for k in (0, 1, 3))
    double = F.col("catalogue") == "double"
    tail = F.when(double, F.substring(s1, 1, 2)).otherwise(F.substring(s1, 1, 4))
    title = F.regexp_replace(decode_text(F.concat(F.substring(s0, 1, 8), tail)), r"\s+$", "")
    files = F.floor(byte_at(s1, 5) / 8) + F.when(double, F.floor(byte_at(s3, 5) / 8)).otherwise(0)
    return catalogued.where("catalogue is not null").select(
        "image_id",
        "side",
        "catalogue",
        title.alias("title"),
        byte_at(s1, 4).alias("cycle"),
        files.cast("long").alias("num_files"),
        (byte_at(s1, 6).bitwiseAND(F.lit(3)) * 256 + byte_at(s1, 7)).alias("total_sectors"),
        F.shiftright(byte_at(s1, 6), 4).bitwiseAND(F.lit(3)).alias("boot_option"),
    )


def _sections(catalogued: DataFrame) -> DataFrame:
    """Entries of the section in sectors 0 and 1, and of the one in sectors 2 and 3 where there is one; each image is read once."""

    def section(names: int, base: int) -> Column:
        s0, s1 = sector_bytes(F.lit(names)), sector_bytes(F.lit(names + 1))
        n = F.least(F.floor(byte_at(s1, 5) / 8), F.lit(31)).cast("int")
        return F.struct(s0.alias("a"), s1.alias("b"), F.lit(base).alias("base"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("at"))

    both = F.when(F.col("catalogue") == "double", F.array(section(0, 0), section(2, 31))).otherwise(F.array(section(0, 0)))
    rows = catalogued.withColumn("_s", F.explode(both)).withColumn("_i", F.explode("_s.at"))
    a, b, at, base = F.col("_s.a"), F.col("_s.b"), F.col("_i") * 8 + 8, F.col("_s.base")
    x = byte_at(b, at + 6)
    letter = byte_at(a, at + 7)
    high = lambda mask, shift: F.shiftleft(x.bitwiseAND(F.lit(mask)), shift)
    name = F.regexp_replace(decode_text(a.substr(at + 1, F.lit(7))), r"\s+$", "")
    directory = F.chr(letter.bitwiseAND(F.lit(0x7F)))
    return rows.select(
        *catalogued.columns,
        (F.col("_i") + base).alias("ordinal"),
        name.alias("name"),
        directory.alias("directory"),
        F.concat_ws(".", directory, name).alias("entry_path"),
        (letter >= 128).alias("locked"),
        (uint_le(b, at, 2) + high(0x0C, 14)).alias("load"),
        (uint_le(b, at + 2, 2) + high(0xC0, 10)).alias("exec"),
        (uint_le(b, at + 4, 2) + high(0x30, 12)).alias("file_length"),
        (byte_at(b, at + 7) + high(0x03, 8)).alias("start_sector"),
    )


def entries(catalogued: DataFrame, with_data: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, side, ordinal, path, name, directory, locked, load, exec, length, sectors, start_sector[, data]), and the columns of images to be kept."""
    both = _sections(catalogued.where("catalogue is not null"))
    data = [range_bytes(F.col("start_sector"), F.col("file_length")).alias("data")] if with_data else []
    return both.select(
        "image_id", "side", "ordinal", F.col("entry_path").alias("path"), "name", "directory", "locked", "load", "exec", F.col("file_length").alias("length"), sectors_required(F.col("file_length")).alias("sectors"), "start_sector", *data, *kept
    )


def marker_issues(catalogued: DataFrame) -> DataFrame:
    """What is wrong between the sections of double catalogues: cycle, boot option and size have to agree."""
    s1, s3 = sector_bytes(F.lit(1)), sector_bytes(F.lit(3))
    checks = F.array(
        F.when(byte_at(s1, 4) != byte_at(s3, 4), F.lit("cycle-differs")),
        F.when(byte_at(s1, 6).bitwiseAND(F.lit(0x30)) != byte_at(s3, 6).bitwiseAND(F.lit(0x30)), F.lit("boot-differs")),
        F.when((byte_at(s1, 6).bitwiseAND(F.lit(3)) != byte_at(s3, 6).bitwiseAND(F.lit(3))) | (byte_at(s1, 7) != byte_at(s3, 7)), F.lit("size-differs")),
    )
    return catalogued.where("catalogue = 'double'").select("image_id", "side", F.explode(F.array_compact(checks)).alias("code"))
