"""Exports: files with their metadata beside or in their names, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.functions.metadata import bridge_line, dash_suffix, name_suffix, sidecar_line

FORMATS = ("inf-trad", "inf-pieb", "filename-riscos", "filename-mos", "none")


def with_metadata(files: DataFrame, meta_format: str = "inf-trad") -> DataFrame:
    """(path, data) of the files (path, name, load, exec, length, attr, data) and of their sidecars, if the format has them."""
    if meta_format not in FORMATS:
        raise ValueError(f"unknown metadata format {meta_format!r}")
    has = F.col("load").isNotNull()
    if meta_format.startswith("filename"):
        suffix = (name_suffix if meta_format == "filename-riscos" else dash_suffix)(F.col("load"), F.coalesce("exec", F.lit(0)))
        named = F.when(has & ~F.endswith("path", suffix), F.concat("path", suffix)).otherwise(F.col("path"))
        return files.select(named.alias("path"), "data")
    plain = files.select("path", "data")
    if meta_format == "none":
        return plain
    if meta_format == "inf-trad":
        line = sidecar_line(F.col("name"), F.col("load"), F.coalesce("exec", F.lit(0)), F.col("length"), F.col("attr"))
    else:
        line = bridge_line(F.col("load"), F.coalesce("exec", F.lit(0)), F.col("attr"))
    sidecars = files.where(has).select(F.concat("path", F.lit(".inf")).alias("path"), F.encode(F.concat(line, F.lit("\n")), "UTF-8").alias("data"))
    return plain.unionByName(sidecars)


def write_report(rows: DataFrame, path: str, kind: str = "tsv") -> None:
    """A report as tab-separated text with a header, or as JSON lines."""
    if kind == "tsv":
        rows.select([F.col(c).cast("string") for c in rows.columns]).write.option("sep", "\t").option("header", True).csv(path)
    elif kind == "json":
        rows.write.json(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")
