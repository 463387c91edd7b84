"""The packed 16-bit date: day in bits 0-4, high year bits in 5-7, month in 8-11, low year bits in 12-15."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR = 1981


def unpack_date(packed: Column) -> Column:
    """DATE of a packed one; null where it names no day."""
    x = packed.cast("long")
    bits = lambda low, mask: F.shiftright(x, low).bitwiseAND(F.lit(mask))
    year = F.lit(FIRST_YEAR) + bits(12, 0xF) + bits(5, 0x7) * 16
    return F.format_string("%04d-%02d-%02d", year, bits(8, 0xF), bits(0, 0x1F)).try_cast("date")


def pack_date(day: Column) -> Column:
    """Packed form of a DATE of 1981 to 2108; null outside."""
    year = (F.year(day) - FIRST_YEAR).cast("long")
    packed = F.dayofmonth(day) + F.month(day) * 256 + (year % 16) * 4096 + F.floor(year / 16) * 32
    return F.when((year >= 0) & (year < 128), packed).cast("long")
