"""Directory trees as relations (image_id, id, parent_id, name, ordinal, is_dir).

Paths are found by pointer doubling: each round replaces a node's ancestor by that ancestor's own, so k rounds reach the
root from depth 2 ** k with k joins. The number of directories of an image bounds its depth, and so the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.functions.globs import matches
from platterlake.functions.paths import leaf

def rounds_for(nodes: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> int:
    """Rounds of doubling that reach the root from the deepest node there can be: one below all of its image's parents."""
    parents = nodes.groupBy(*keys).agg(F.count_distinct("parent_id").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, int(parents).bit_length())


def tree_paths(nodes: DataFrame, rounds: int | None = None, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The nodes with `path`, `depth` (root: 0) and `place`, an array that sorts them in pre-order.

    Without `rounds`, any depth is reached. Nodes whose chain of parents doesn't end in a root (cycles) get a null path.
    """
    rounds = rounds_for(nodes, keys) if rounds is None else rounds
    up = nodes.select(*keys, "id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.array(F.struct("ordinal", "name")).alias("place"), F.lit(0).alias("depth"))
    for _ in range(rounds):
        above = up.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("place").alias("_place"), F.col("depth").alias("_depth"))
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        joined = up.join(above, [*same, F.col("up") == F.col("_id")], "left")
        met = F.col("_id").isNotNull()
        up = joined.select(
            *keys,
            "id",
            F.when(met, F.col("_up")).otherwise(F.col("up")).alias("up"),
            F.when(met, F.concat_ws(".", "_path", "path")).otherwise(F.col("path")).alias("path"),
            F.when(met, F.concat("_place", "place")).otherwise(F.col("place")).alias("place"),
            F.when(met, F.col("_depth") + F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
        )
    found = up.select(*keys, "id", F.when(F.col("up").isNull(), F.col("path")).alias("path"), "depth", "place")
    return nodes.join(found, [*keys, "id"])


def children(nodes: DataFrame, directory: Column) -> DataFrame:
    """Entries of a directory in stored order."""
    return nodes.where(F.col("parent_id") == directory).orderBy("ordinal")


def walk(nodes: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A row for each directory: its path and the sorted names of its directories and files."""
    placed = tree_paths(nodes, keys=keys)
    inside = nodes.groupBy(*keys, F.col("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_dir"), F.col("name")))).alias("dirnames"),
        F.array_sort(F.collect_list(F.when(~F.col("is_dir"), F.col("name")))).alias("filenames"),
    )
    none = F.array().cast("array<string>")
    return placed.where("is_dir").join(inside, [*keys, "id"], "left").select(
        *keys, "path", "depth", F.coalesce("dirnames", none).alias("dirnames"), F.coalesce("filenames", none).alias("filenames"), "place"
    )


def find(placed: DataFrame, pattern: str) -> DataFrame:
    """Nodes below the root whose name or whole path matches; `#` is an ordinary character."""
    return placed.where((F.col("depth") > 0) & (matches(F.col("name"), pattern) | matches(F.col("path"), pattern)))


def bulk_targets(placed: DataFrame, directory: str, pattern: str) -> DataFrame:
    """Entries right below a directory whose name matches; `#` is any character."""
    above = F.upper(F.regexp_replace("path", r"\.[^.]*$", ""))
    return placed.where((F.col("depth") > 0) & (above == directory.upper()) & matches(leaf(F.col("path")), pattern, hash_is_any=True))


def post_order(placed: DataFrame) -> DataFrame:
    """The nodes with `step`: all that is below a node has a smaller one."""
    return placed.withColumn("step", -F.col("depth"))


def without_subtrees(placed: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Nodes that neither are named in `names` (column name, any case) nor lie below such a node."""
    banned = names.select(F.upper("name").alias("_part")).distinct()
    gone = placed.select(*keys, "id", F.explode(F.split(F.upper("path"), r"\.")).alias("_part")).join(banned, "_part", "left_semi")
    return placed.join(gone.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")


def glyph_lines(nodes: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(path, line): a drawn tree, each name behind the branches of its ancestors."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*keys, "parent_id").orderBy("ordinal", "name")
    lasts = nodes.withColumn("is_last", F.lead("id").over(ordered).isNull())
    drawn = lasts.withColumn("bar", F.when(F.col("parent_id").isNull(), "").when(F.col("is_last"), "    ").otherwise("│   "))
    bars = tree_paths(drawn.withColumn("label", F.col("name")).withColumn("name", F.col("bar")), keys=keys)
    above = F.array_join(F.transform(F.slice("place", 1, F.greatest(F.size("place") - 1, F.lit(0))), lambda x: x["name"]), "")
    branch = F.when(F.col("parent_id").isNull(), "").when(F.col("is_last"), "└── ").otherwise("├── ")
    return bars.select(*keys, "id", F.concat(above, branch, F.col("label")).alias("line"))
