"""Metadata from several sources: sidecar pairing, the cascade of sources, archive summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platterlake.functions.metadata import clean_name, name_meta, parse_sidecar


def pair_sidecars(members: DataFrame, key: str = "archive") -> DataFrame:
    """(archive, target, sidecar, source, meta): each readable `X.inf` with the member `X/` if there is one, else `X`."""
    sidecars = members.where(F.lower("filename").endswith(".inf")).withColumn("parsed", parse_sidecar(F.col("content"))).where("parsed is not null")
    sidecars = sidecars.select(key, F.col("filename").alias("sidecar"), F.regexp_replace("filename", r"(?i)\.inf$", "").alias("_stem"), "parsed.source", "parsed.meta")
    named = members.select(key, F.col("filename").alias("target"), F.regexp_replace("filename", "/$", "").alias("_stem"), F.endswith("filename", F.lit("/")).alias("_dir"))
    best = Window.partitionBy(key, "sidecar").orderBy(F.col("_dir").desc())
    paired = sidecars.join(named, [key, "_stem"]).where("target <> sidecar").withColumn("_n", F.row_number().over(best))
    return paired.where("_n = 1").select(key, "target", "sidecar", "source", "meta")


def resolve_members(members: DataFrame, key: str = "archive", decode_names: bool = True) -> DataFrame:
    """A row for each member that isn't a used sidecar: (archive, ordinal, filename, is_dir, file_size, source, meta).

    The archive's own extra field comes first (`extra_meta`), then the sidecar, then the suffix of the name; the
    suffix is cut off whichever of them gave the metadata.
    """
    pairs = pair_sidecars(members, key)
    used = pairs.select(key, F.col("sidecar").alias("filename")).distinct()
    first = Window.partitionBy(key, "target").orderBy("sidecar")
    pairs = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    side = pairs.select(key, F.col("target").alias("filename"), F.col("source").alias("_side"), F.col("meta").alias("_side_meta"))
    left = members.join(used, [key, "filename"], "left_anti").join(side, [key, "filename"], "left")
    is_dir = F.endswith("filename", F.lit("/"))
    own = F.when(~is_dir & F.lit(decode_names), name_meta(F.col("filename")))
    source = F.when(F.col("extra_meta").isNotNull(), "sparkfs").when(F.col("_side_meta").isNotNull(), F.col("_side")).when(own.isNotNull(), "filename")
    name = F.when(~is_dir, clean_name(F.col("filename"))).otherwise(F.col("filename")) if decode_names else F.col("filename")
    return left.select(key, "ordinal", name.alias("filename"), is_dir.alias("is_dir"), "file_size", source.alias("source"), F.coalesce("extra_meta", "_side_meta", own).alias("meta"))


def cascade(sources: DataFrame, key: str = "file_id") -> DataFrame:
    """Of the rows (file, priority, source, meta) the one of least priority that has metadata, for each file."""
    first = sources.where("meta is not null").groupBy(key).agg(F.min_by(F.struct("source", "meta"), "priority").alias("best"))
    return sources.select(key).distinct().join(first, key, "left").select(key, "best.source", "best.meta")


def summarise(entries: DataFrame, key: str = "archive") -> DataFrame:
    """Counts of members, directories and sources of each archive."""
    of = lambda name: F.count_if(F.coalesce(F.col("source"), F.lit("")) == name).alias(f"n_{name.replace('-', '_')}")
    return entries.groupBy(key).agg(
        F.count("filename").alias("n_entries"), F.count_if("is_dir").alias("n_dirs"), of("sparkfs"), of("inf-trad"), of("inf-pieb"), of("filename"), F.count_if(F.col("source").isNull() & ~F.col("is_dir")).alias("n_plain")
    )


def filetype_histogram(entries: DataFrame, key: str = "archive") -> DataFrame:
    return entries.where("meta.load is not null and meta.filetype is not null").groupBy(key, F.col("meta.filetype").alias("filetype")).agg(F.count("*").alias("n"))


def pair_geometry(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of `.dat` and `.dsc` by stem, issues for those without partner)."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    dat = images.where(F.lower("path").endswith(".dat")).select(stem.alias("stem"), F.col("path").alias("dat"), F.col("content").alias("data"))
    dsc = images.where(F.lower("path").endswith(".dsc")).select(stem.alias("stem"), F.col("path").alias("dsc"), F.col("content").alias("geometry"))
    both = dat.join(dsc, "stem", "full_outer")
    missing = F.when(F.col("dsc").isNull(), "no-geometry").when(F.col("dat").isNull(), "no-data")
    issues = both.where("dat is null or dsc is null").select(F.col("stem").alias("image_id"), missing.alias("code"), F.coalesce("dat", "dsc").alias("path"), F.lit(None).cast("string").alias("detail"))
    return both.where("dat is not null and dsc is not null"), issues
