"""Catalogue relations: lookups, mutations as relation to relation, merges, differences and checks.

Entries have (image_id, path, name, directory, locked, length, load, exec, ordinal, ...); mutations return the new
relation, and a refused one leaves the rows and shows in `issues`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platterlake.functions.globs import matches
from platterlake.functions.numbers import sectors_required

KEY = "image_id"


def lookup(entries: DataFrame, wanted: DataFrame, key: str = KEY) -> DataFrame:
    """The first entry, in catalogue order, of each wanted path (any case)."""
    first = Window.partitionBy(key, "_path").orderBy("ordinal")
    named = entries.withColumn("_path", F.upper("path")).join(wanted.select(key, F.upper("path").alias("_path")).distinct(), [key, "_path"])
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_path")


def states(nodes: DataFrame, wanted: DataFrame, key: str = KEY) -> DataFrame:
    """(image, path, found, is_dir, is_file) of each wanted path (any case)."""
    here = nodes.groupBy(key, F.upper("path").alias("_path")).agg(F.bool_or("is_dir").alias("_dir"))
    joined = wanted.select(key, "path").distinct().withColumn("_path", F.upper("path")).join(here, [key, "_path"], "left")
    found = F.col("_dir").isNotNull()
    return joined.select(key, "path", found.alias("found"), F.coalesce("_dir", F.lit(False)).alias("is_dir"), (found & ~F.coalesce("_dir", F.lit(True))).alias("is_file"))


def make_dirs(nodes: DataFrame, wanted: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(directories to add, issues): the wanted paths and all above them that aren't there; a file in the way is an issue."""
    parts = F.split("path", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    all_paths = wanted.select(key, F.explode(chain).alias("path")).withColumn("_path", F.upper("path")).dropDuplicates([key, "_path"])
    here = nodes.groupBy(key, F.upper("path").alias("_path")).agg(F.bool_or("is_dir").alias("_dir"))
    joined = all_paths.join(here, [key, "_path"], "left")
    issues = joined.where(~F.col("_dir")).select(key, F.lit("file-in-the-way").alias("code"), "path", F.lit(None).cast("string").alias("detail"))
    return joined.where("_dir is null").select(key, "path", F.lit(True).alias("is_dir")), issues


def duplicate_names(entries: DataFrame, key: str = KEY) -> DataFrame:
    return entries.groupBy(key, F.upper("path").alias("path")).agg(F.count("ordinal").alias("copies")).where("copies > 1")


def sector_collisions(entries: DataFrame, key: str = KEY) -> DataFrame:
    """(image, sector, first_path, path): each claim of a sector after the first, in catalogue order.

    Only entries that overlap another are spread into sectors: a window finds those whose start lies before the
    furthest end so far, or before whose end another starts.
    """
    end = F.col("start_sector") + F.col("sectors")
    order = Window.partitionBy(key).orderBy("start_sector", "ordinal")
    used = entries.where("sectors > 0").withColumn("_end", end)
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("start_sector").over(order.rowsBetween(1, Window.unboundedFollowing))
    overlapping = used.withColumn("_before", before).withColumn("_after", after).where("start_sector < _before or _end > _after")
    claims = overlapping.select(key, "ordinal", "path", F.explode(F.sequence(F.col("start_sector"), F.col("_end") - 1)).alias("sector"))
    claim = Window.partitionBy(key, "sector").orderBy("ordinal")
    numbered = claims.withColumn("first_path", F.first("path").over(claim)).withColumn("_n", F.row_number().over(claim))
    return numbered.where("_n > 1").select(key, "sector", "first_path", "path")


def beyond_end(entries: DataFrame, totals: DataFrame, key: str = KEY) -> DataFrame:
    out = entries.join(totals.select(key, "total_sectors"), key).withColumn("end_sector", F.col("start_sector") + F.col("sectors"))
    return out.where("end_sector > total_sectors").select(key, "path", "end_sector", "total_sectors")


def validate(entries: DataFrame, totals: DataFrame, max_files: int = 31, key: str = KEY) -> DataFrame:
    """(image, code, path, detail) of all that is wrong with the catalogues."""
    many = entries.groupBy(key).agg(F.count("path").alias("n")).where(F.col("n") > max_files)
    issue = lambda df, code, path, detail: df.select(key, F.lit(code).alias("code"), path.alias("path"), detail.alias("detail"))
    nothing = F.lit(None).cast("string")
    return (
        issue(many, "too-many-files", nothing, F.col("n").cast("string"))
        .unionByName(issue(sector_collisions(entries, key), "sector-collision", F.col("path"), F.concat_ws(" ", F.col("sector").cast("string"), "first_path")))
        .unionByName(issue(beyond_end(entries, totals, key), "beyond-end", F.col("path"), F.col("end_sector").cast("string")))
        .unionByName(issue(duplicate_names(entries, key), "duplicate-name", F.col("path"), F.col("copies").cast("string")))
    )


def track_overlaps(footprints: DataFrame, key: str = KEY) -> DataFrame:
    """Footprints (image, start, end) that reach into the next one."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start", "end"))
    return footprints.withColumn("next_start", following).where("next_start < end")


# --- merges of path sets -------------------------------------------------------------------------------------


def conflicts(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    return source.join(target.select(*on).distinct(), on, "left_semi")


def conflict_summary(found: DataFrame, label: Column, shown: int = 5) -> DataFrame:
    """(n, shown, more): how many conflicts there are, the first few, and how many more. Each task sends its first few."""
    first = found.select(label.alias("label")).orderBy("label").limit(shown).agg(F.array_sort(F.collect_list("label")).alias("shown"))
    n = found.agg(F.count("*").alias("n"))
    return n.crossJoin(first).select("n", "shown", (F.col("n") - F.size("shown")).alias("more"))  # one row with one row


def merge(source: DataFrame, target: DataFrame, on: list[str], policy: str = "skip") -> DataFrame:
    """The target with the source's rows; on a conflict the target's row stays (`skip`) or gives way (`overwrite`)."""
    if policy == "skip":
        return target.unionByName(source.join(target.select(*on).distinct(), on, "left_anti"))
    if policy == "overwrite":
        return target.join(source.select(*on).distinct(), on, "left_anti").unionByName(source)
    raise ValueError(f"unknown policy {policy!r}")


def diff(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """(keys, change): `added`, `removed` or `changed`, with null values equal."""
    a = left.select(*on, F.lit(True).alias("_l"), F.col(value).alias("_lv"))
    b = right.select(*on, F.lit(True).alias("_r"), F.col(value).alias("_rv"))
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_lv").eqNullSafe(F.col("_rv")), "changed")
    return a.join(b, on, "full_outer").withColumn("change", change).where("change is not null").select(*on, "change")


# --- mutations -----------------------------------------------------------------------------------------------


def upsert(entries: DataFrame, files: DataFrame, key: str = KEY) -> DataFrame:
    """The entries with new files (image, path, ...) put in; one of the same path (any case) gives way."""
    names = files.select(key, F.upper("path").alias("_path")).distinct()
    kept = entries.withColumn("_path", F.upper("path")).join(names, [key, "_path"], "left_anti").drop("_path")
    return kept.unionByName(files, allowMissingColumns=True)


def delete(entries: DataFrame, pattern: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries left, issues): locked entries are refused unless forced."""
    hit = matches(F.col("path"), pattern, hash_is_any=True)
    refused = hit & F.col("locked") & F.lit(not force)
    issues = entries.where(refused).select(KEY, F.lit("locked").alias("code"), "path", F.lit(None).cast("string").alias("detail"))
    return entries.where(~hit | refused), issues


def rename(entries: DataFrame, moves: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(entries, issues) after moves (image, path, new_path); a move onto an existing path is refused."""
    wanted = moves.select(key, F.upper("path").alias("_path"), "new_path")
    taken = entries.select(key, F.upper("path").alias("_new")).distinct()
    free = wanted.withColumn("_new", F.upper("new_path"))
    allowed = free.join(taken, [key, "_new"], "left_anti").unionByName(free.where("_new = _path"))
    moved = entries.withColumn("_path", F.upper("path")).join(allowed.drop("_new"), [key, "_path"], "left")
    moved = moved.withColumn("path", F.coalesce("new_path", "path")).drop("_path", "new_path")
    refused = free.where("_new <> _path").join(taken, [key, "_new"], "left_semi")
    return moved, refused.select(key, F.lit("exists").alias("code"), F.col("new_path").alias("path"), F.lit(None).cast("string").alias("detail"))


def _hit(pattern: str, recursive: bool) -> Column:
    """Paths that match, and where `recursive` all paths below one that does."""
    found = matches(F.col("path"), pattern, hash_is_any=True)
    return found | matches(F.col("path"), f"{pattern}.*", hash_is_any=True) if recursive else found


def set_locked(entries: DataFrame, pattern: str, locked: bool, recursive: bool = False) -> DataFrame:
    return entries.withColumn("locked", F.when(_hit(pattern, recursive), locked).otherwise(F.col("locked")))


def chmod(entries: DataFrame, pattern: str, access: Column, recursive: bool = False, column: str = "attr") -> DataFrame:
    """`access` (a canonical or a server's byte, as the column holds) for what matches, and for all below it where `recursive`."""
    return entries.withColumn(column, F.when(_hit(pattern, recursive), access.cast(entries.schema[column].dataType)).otherwise(F.col(column)))


def set_address(entries: DataFrame, pattern: str, column: str, value: int) -> DataFrame:
    """`column` (load or exec) of the matching files set; directories are left alone."""
    hit = matches(F.col("path"), pattern, hash_is_any=True)
    if "is_dir" in entries.columns:
        hit = hit & ~F.col("is_dir")
    return entries.withColumn(column, F.when(hit, F.lit(value).cast("long")).otherwise(F.col(column)))


def remove_empty_dirs(nodes: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = (KEY,)) -> tuple[DataFrame, DataFrame]:
    """(nodes left, issues): of the wanted directories (ids), those without children go."""
    full = nodes.select(*keys, F.col("parent_id").alias("id")).distinct()
    gone = wanted.select(*keys, "id").join(full, [*keys, "id"], "left_anti")
    refused = wanted.select(*keys, "id").join(full, [*keys, "id"], "left_semi")
    issues = refused.select(*keys, F.lit("not-empty").alias("code"), F.col("id").cast("string").alias("path"), F.lit(None).cast("string").alias("detail"))
    return nodes.join(gone, [*keys, "id"], "left_anti"), issues


def with_sectors(entries: DataFrame) -> DataFrame:
    return entries.withColumn("sectors", sectors_required(F.col("length")))


def stat(entries: DataFrame) -> DataFrame:
    """A row of metadata for each entry, and one for each directory letter that some entry uses (length 0)."""
    files = entries.select(KEY, "path", F.lit(False).alias("is_dir"), "length", "load", "exec", "locked")
    letters = entries.select(KEY, F.upper("directory").alias("path")).distinct()
    zero = F.lit(0).cast("long")
    return files.unionByName(letters.select(KEY, "path", F.lit(True).alias("is_dir"), zero.alias("length"), zero.alias("load"), zero.alias("exec"), F.lit(False).alias("locked")))
