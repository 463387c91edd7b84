"""Relations of disc shape made from the driver's tables, and the same as DuckDB text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platterlake.functions.numbers import sectors_required

DISC_SECTORS = 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """25 files an image, a gap of three sectors after every fifth; `dealt` beforehand where images will be built of them."""
    part = table(spark, sf_dir, "part").withColumn("image_id", F.floor(F.col("p_partkey") / 25).cast("long"))
    part = _dealt(part) if dealt else part
    order = Window.partitionBy("image_id").orderBy("p_partkey")
    even = (F.col("p_partkey") * 2654435761) % 1048576 + 4293918720
    files = part.select(
        "image_id",
        "p_partkey",
        F.row_number().over(order).cast("long").alias("ordinal"),
        F.substring(F.lit("$ABCDEFG"), F.col("p_size") % 8 + 1, F.lit(1)).alias("directory"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"),
        (F.col("p_size").cast("long") * 137).alias("length"),
        (F.col("p_partkey") % 7 == 0).alias("locked"),
        F.when(F.col("p_partkey") % 2 == 0, even).otherwise((F.col("p_partkey") * 40503) % 262144).alias("load"),
    )
    files = files.withColumn("sectors", sectors_required(F.col("length"))).withColumn("path", F.concat_ws(".", "directory", "name"))
    before = F.coalesce(F.sum("sectors").over(Window.partitionBy("image_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("start_sector", (before + 2 + F.floor((F.col("ordinal") - 1) / 5) * 3).cast("long"))


def _dealt(files: DataFrame) -> DataFrame:
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "image_id")


def by_image(files: DataFrame) -> DataFrame:
    """The files with those of an image side by side, before they are given their bytes.

    So only their keys are shuffled and sorted, and images are built one after another as rows stream by. The number of
    partitions stands, since these few bytes tell nothing of what the images will hold.
    """
    return _dealt(files).sortWithinPartitions("image_id")


def bad_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries with some starts two sectors early and some names repeated."""
    twin = F.col("p_partkey") % 13 == 0
    name = F.when(twin, F.concat(F.lit("P"), (F.col("p_partkey") - 1).cast("string"))).otherwise(F.col("name"))
    directory = F.when(twin | ((F.col("p_partkey") + 1) % 13 == 0), "$").otherwise(F.col("directory"))
    start = F.when(F.col("p_partkey") % 11 == 0, F.col("start_sector") - 2).otherwise(F.col("start_sector"))
    bad = entries(spark, sf_dir).withColumn("start_sector", start).withColumn("name", name).withColumn("directory", directory)
    return bad.withColumn("path", F.concat_ws(".", "directory", "name"))


def totals(files: DataFrame, sectors: int = DISC_SECTORS) -> DataFrame:
    return files.select("image_id").distinct().withColumn("total_sectors", F.lit(sectors).cast("long"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, regions, nations and suppliers as directories and files of one image."""
    node = lambda df, id_, parent, name, ordinal, is_dir: df.select(F.lit(0).cast("long").alias("image_id"), id_.alias("id"), parent.cast("string").alias("parent_id"), name.alias("name"), ordinal.cast("long").alias("ordinal"), F.lit(is_dir).alias("is_dir"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    root = node(spark.range(1), F.lit("$"), F.lit(None), F.lit("$"), F.lit(0), True)
    return (
        root.unionByName(node(region, key("R", "r_regionkey"), F.lit("$"), F.col("r_name"), F.col("r_regionkey"), True))
        .unionByName(node(nation, key("N", "n_nationkey"), key("R", "n_regionkey"), F.col("n_name"), F.col("n_nationkey"), True))
        .unionByName(node(supplier, key("S", "s_suppkey"), key("N", "s_nationkey"), F.regexp_replace("s_name", "[#. ]", "_"), F.col("s_suppkey"), False))
    )


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    one = lines.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    one = one.select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_suppkey") % 2).alias("odd"))
    before = Window.partitionBy("object_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(1) + F.coalesce(F.sum("length").over(before), F.lit(0)) + F.coalesce(F.sum("odd").over(before), F.lit(0)) * 5
    return one.withColumn("start", start.cast("long")).drop("odd")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.lit(0).cast("long").alias("image_id"),
        F.col("c_custkey").alias("slot"),
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("name"),
        F.floor(F.abs("c_acctbal")).cast("long").alias("free_space"),
        (F.col("c_custkey") % 5 != 0).alias("in_use"),
    )


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("user"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").cast("long").alias("bytes"))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both dialects, locked ones, and some that can't be read."""
    k = F.col("o_orderkey")
    load, exec_ = (k * 2654435761) % 4294967296, (k * 40503) % 65536
    hex8 = lambda x: F.format_string("%08X", x)
    named = F.concat(F.lit("$.F"), k.cast("string"), F.lit("  "), hex8(load), F.lit(" "), hex8(exec_), F.lit(" "), hex8(k % 65536))
    bridge = F.concat_ws(" ", F.lit("0"), F.lower(F.hex(load)), F.lower(F.hex(exec_)), F.lower(F.hex(k % 64)))
    line = F.when(k % 4 == 0, named).when(k % 4 == 1, F.concat(named, F.lit(" L"))).when(k % 4 == 2, bridge).otherwise(F.concat(F.lit("$.F"), k.cast("string"), F.lit(" 1900 8023")))
    return table(spark, sf_dir, "orders").select(k.alias("file_id"), line.alias("line"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of 40 files with names of all encodings; every fifth file has a sidecar instead."""
    k = F.col("p_partkey")
    archive = F.floor(k / 40).cast("long")
    base = F.concat(F.lit("d/F"), k.cast("string"))
    three, eight = F.format_string("%03x", k % 4096), F.format_string("%08x", (k * 2654435761) % 4294967296)
    name = F.when(k % 5 == 0, F.concat(base, F.lit(","), three)).when(k % 5 == 1, F.concat(base, F.lit(","), eight, F.lit(","), eight)).when(k % 5 == 2, F.concat(base, F.lit(","), F.lower(F.hex(k)), F.lit("-"), F.lower(F.hex(k * 3)))).otherwise(base)
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    files = part.select(archive.alias("archive"), (k * 2).alias("ordinal"), name.alias("filename"), (F.col("p_size").cast("long") * 137).alias("file_size"), none.alias("content"))
    line = F.concat(F.lit("F"), k.cast("string"), F.lit(" FFFFFB00 00008000 00000010 33"))
    side = part.where(k % 5 == 4).select(archive.alias("archive"), (k * 2 + 1).alias("ordinal"), F.concat(base, F.lit(".inf")).alias("filename"), F.length(line).cast("long").alias("file_size"), line.alias("content"))
    return files.unionByName(side)


#: The same relations as DuckDB text; each is a list of common table expressions.
SQL_ENTRIES = """
p AS (
  SELECT CAST(floor(p_partkey / 25.0) AS BIGINT) AS image_id, p_partkey,
         row_number() OVER (PARTITION BY CAST(floor(p_partkey / 25.0) AS BIGINT) ORDER BY p_partkey) AS ordinal,
         substr('$ABCDEFG', CAST(1 + p_size % 8 AS INT), 1) AS directory, 'P' || CAST(p_partkey AS VARCHAR) AS name,
         CAST(p_size AS BIGINT) * 137 AS length, p_partkey % 7 = 0 AS locked,
         CASE WHEN p_partkey % 2 = 0 THEN 4293918720 + (p_partkey * 2654435761) % 1048576 ELSE (p_partkey * 40503) % 262144 END AS load
  FROM part),
s AS (SELECT *, CAST(floor((length + 255) / 256.0) AS BIGINT) AS sectors, directory || '.' || name AS path FROM p),
e AS (
  SELECT *, CAST(2 + coalesce(sum(sectors) OVER (PARTITION BY image_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + 3 * floor((ordinal - 1) / 5.0) AS BIGINT) AS start_sector FROM s)"""
SQL_BAD = (
    SQL_ENTRIES
    + """,
b AS (
  SELECT * REPLACE (CASE WHEN p_partkey % 11 = 0 THEN start_sector - 2 ELSE start_sector END AS start_sector,
                    CASE WHEN p_partkey % 13 = 0 THEN 'P' || CAST(p_partkey - 1 AS VARCHAR) ELSE name END AS name,
                    CASE WHEN p_partkey % 13 = 0 OR (p_partkey + 1) % 13 = 0 THEN '$' ELSE directory END AS directory) FROM e),
x AS (SELECT * REPLACE (directory || '.' || name AS path) FROM b)"""
)
SQL_FREE = (
    SQL_ENTRIES
    + """,
used AS (SELECT image_id, ordinal, start_sector, sectors FROM e UNION ALL SELECT DISTINCT image_id, 1000000, 800, 0 FROM e),
g AS (SELECT image_id, start_sector, coalesce(max(start_sector + sectors) OVER (PARTITION BY image_id ORDER BY start_sector, ordinal
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS prev_end FROM used),
f AS (SELECT image_id, CAST(prev_end AS BIGINT) AS start_sector, CAST(start_sector - prev_end AS BIGINT) AS length FROM g WHERE start_sector > prev_end)"""
)
SQL_TREE = """
n AS (
  SELECT '$' AS id, CAST(NULL AS VARCHAR) AS parent_id, '$' AS name, CAST(0 AS BIGINT) AS ordinal, true AS is_dir
  UNION ALL SELECT 'R' || r_regionkey, '$', r_name, r_regionkey, true FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, n_nationkey, true FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, regexp_replace(s_name, '[#. ]', '_', 'g'), s_suppkey, false FROM supplier),
t AS (
  SELECT *, name AS path, CAST(0 AS BIGINT) AS depth FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.*, t.path || '.' || n.name, t.depth + 1 FROM n JOIN t ON n.parent_id = t.id)"""
SQL_EXTENTS = """
l AS (
  SELECT l_orderkey AS object_id, CAST(l_linenumber AS BIGINT) AS ordinal, CAST(l_quantity AS BIGINT) AS length, l_suppkey % 2 AS odd
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1),
x AS (
  SELECT object_id, ordinal, length, CAST(1 + coalesce(sum(length) OVER w, 0) + 5 * coalesce(sum(odd) OVER w, 0) AS BIGINT) AS start
  FROM l WINDOW w AS (PARTITION BY object_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SQL_USERS = """
u AS (SELECT c_custkey AS slot, 'U' || c_custkey AS name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS free_space, c_custkey % 5 <> 0 AS in_use FROM customer)"""
SQL_WRITES = """
w AS (SELECT 'U' || o_custkey AS "user", o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders),
c AS (SELECT *, (CAST(ceil(bytes / 256.0) AS BIGINT) + CAST(ceil(ceil(bytes / 256.0) / 48.0) AS BIGINT)) * 256 AS cost FROM w)"""
