"""Numbers: hexadecimal text, little-endian fields of binary columns, sector arithmetic, capacities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTOR = 256

#: Capacity suffixes (any case) and their bytes.
CAPACITY_UNITS = {"": 1, "b": 1, "kb": 1000, "kib": 1024, "mb": 1000**2, "mib": 1024**2, "gb": 1000**3, "gib": 1024**3}


def hex_text(x: Column, digits: int = 8) -> Column:
    """Upper-case hexadecimal of at least `digits` digits; empty for null."""
    return F.coalesce(F.format_string(f"%0{digits}X", x.cast("long")), F.lit(""))


def hex_value(text: Column) -> Column:
    """The number a hexadecimal text stands for; null where it is none."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(text, 16, 10).cast("long"))


def byte_at(data: Column, offset: Column | int) -> Column:
    """The byte at a 0-based offset as a number; null beyond the end."""
    return uint_le(data, offset, 1)


def uint_le(data: Column, offset: Column | int, width: int) -> Column:
    """Little-endian unsigned number of `width` bytes at a 0-based offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.hex(data.substr(at + F.lit(1), F.lit(width)))
    ordered = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]) if width > 1 else digits
    return F.when(F.length(data) >= at + width, F.conv(ordered, 16, 10).cast("long"))


def uint_be(data: Column, offset: Column | int, width: int) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(F.length(data) >= at + width, F.conv(F.hex(data.substr(at + F.lit(1), F.lit(width))), 16, 10).cast("long"))


def bytes_le(x: Column, width: int) -> Column:
    """A number as `width` little-endian bytes."""
    digits = F.lpad(F.hex(x.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))


def sectors_required(length: Column) -> Column:
    """Sectors that hold `length` bytes."""
    return F.floor((length + (SECTOR - 1)) / SECTOR).cast("long")


def capacity_bytes(text: Column) -> Column:
    """Bytes of a text like `10MB`, `40 MiB` or `1024`: a whole number, then a unit or none; null where it is no capacity."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = F.regexp_substr(bare, F.lit("^[0-9]+"))
    unit = F.lower(F.regexp_replace(bare, r"^[0-9]+\s*", ""))
    times = F.coalesce(*[F.when(unit == name, F.lit(n)) for name, n in CAPACITY_UNITS.items()]).cast("long")
    return number.try_cast("long") * times


def object_bytes(sectors: Column, last_bytes: Column) -> Column:
    """Size of an object of whole extents, of whose last sector `last_bytes` count (0: all)."""
    return F.when(F.coalesce(sectors, F.lit(0)) == 0, 0).when(last_bytes == 0, sectors * SECTOR).otherwise((sectors - 1) * SECTOR + last_bytes).cast("long")
