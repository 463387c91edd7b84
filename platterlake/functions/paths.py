"""Dotted paths from the root `$`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, r"\.")


def leaf(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def parent(path: Column) -> Column:
    """The path above; null for the root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), "."))


def depth(path: Column) -> Column:
    return F.size(parts(path)) - 1


def split_flat(name: Column) -> Column:
    """struct<directory, filename> of `D.NAME`; without a directory, `$`."""
    dotted = F.contains(name, F.lit("."))
    directory = F.when(dotted, F.upper(F.substring_index(name, ".", 1))).otherwise("$")
    return F.struct(directory.alias("directory"), F.when(dotted, F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)).otherwise(name).alias("filename"))


def to_flat(path: Column) -> Column:
    """`$.F` stays, `$.D.F` with a one-letter D becomes `D.F`; null where a flat catalogue has no place for it."""
    p = parts(path)
    letter = F.get(p, 1)
    return F.when(F.size(p) == 2, path).when((F.size(p) == 3) & (F.length(letter) == 1), F.concat_ws(".", letter, F.get(p, 2)))
