"""Folders of host files as relations, with the rules by which their files go into an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, length, data) of all files below it, in any store that Spark reads.

    Spark's readers pass over names that begin with `.` or `_`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.regexp_replace(F.lit(folder.rstrip("/")), r"^[a-z]+:/*", "/")
    whole = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return files.select(whole.substr(F.length(base) + 2, F.length(whole)).alias("path"), "length", F.col("content").alias("data"))


def import_plan(files: DataFrame, flat: bool, key: str = "image_id") -> DataFrame:
    """(image, path, target, directory, step): where each host file goes, in sorted order of the host paths.

    Names that begin with a dot, below such folders too, and sidecars (`.inf`) are left out. A name ends at its first
    comma. Flat images have no folders: all files go to `$`; else `directory` has to be there first.
    """
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: F.startswith(x, F.lit(".")))
    leaf = F.substring_index(F.element_at(parts, -1), ",", 1)
    above = F.slice(parts, 1, F.size(parts) - 1)
    directory = F.lit("$") if flat else F.array_join(F.concat(F.array(F.lit("$")), above), ".")
    kept = files.where(~hidden & ~F.lower("path").endswith(".inf"))
    placed = kept.select(key, "path", directory.alias("directory"), F.concat_ws(".", directory, leaf).alias("target"))
    return placed.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(F.split("path", "/"))).cast("long"))
