"""Further registered queries: copies and merges as plans, layouts, bitmaps, names and sector differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions import paths, text
from platterlake.operators import catalogue, copying, space, tree, users
from platterlake.plans import bridge
from platterlake.plans.bridge import table
from platterlake.plans.catalogue import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_ORDERED = bridge.SQL_TREE.replace("name AS path, CAST(0 AS BIGINT) AS depth", "name AS path, CAST(0 AS BIGINT) AS depth, [lpad(CAST(ordinal AS VARCHAR), 9, '0') || name] AS place").replace(
    "t.depth + 1 FROM", "t.depth + 1, list_append(t.place, lpad(CAST(n.ordinal AS VARCHAR), 9, '0') || n.name) FROM"
)


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_paths(bridge.tree(spark, d).withColumn("length", F.when(F.col("is_dir"), 0).otherwise(F.col("ordinal") * 100)))


@query(f"WITH RECURSIVE {_ORDERED} SELECT id, '$.COPY' || substr(path, 7) AS target, CASE WHEN is_dir THEN 'mkdir' ELSE 'file' END AS action, row_number() OVER (ORDER BY place) AS step FROM t WHERE path LIKE '$.ASIA%'")
def q49_copy_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = copying.copy_plan(_placed(spark, d), "$.asia", "$.COPY")
    return plan.select("id", "target", "action", F.col("step").cast("long").alias("step"))


@query(f"WITH RECURSIVE {_ORDERED} SELECT path, '$.EUROPE' || substr(path, 7) AS target, is_dir, '$.EUROPE' || substr(path, 7) IN (SELECT path FROM t) AS \"exists\" FROM t WHERE path LIKE '$.ASIA%'")
def q50_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    placed = _placed(spark, d)
    return copying.merge_pairs(placed, placed, "$.ASIA", "$.EUROPE").select("path", "target", "is_dir", "exists")


@query(
    f"""WITH RECURSIVE {_ORDERED}, s AS (SELECT id, place, CAST(CASE WHEN is_dir THEN 5 ELSE ceil(ordinal * 100 / 256.0) END AS BIGINT) AS sectors FROM t WHERE depth > 0)
  SELECT id, CAST(CASE WHEN sectors > 0 THEN 7 + coalesce(sum(sectors) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS new_start FROM s"""
)
def q51_rebuild_layout(spark: SparkSession, d: str) -> DataFrame:
    return copying.rebuild_layout(_placed(spark, d)).select("id", "new_start")


@query(
    f"""WITH {bridge.SQL_EXTENTS}, c AS (SELECT *, unnest(range(CAST(floor(start / 16.0) AS BIGINT), CAST(floor((start + length - 1) / 16.0) AS BIGINT) + 1)) AS cylinder FROM x WHERE length > 0)
  SELECT object_id, ordinal, cylinder, greatest(start, cylinder * 16) - cylinder * 16 AS first, least(start + length, (cylinder + 1) * 16) - greatest(start, cylinder * 16) AS count FROM c"""
)
def q52_cylinder_ranges(spark: SparkSession, d: str) -> DataFrame:
    return copying.split_at_cylinders(bridge.extents(spark, d), 16).select("object_id", "ordinal", "cylinder", "first", "count")


@query(
    """WITH b AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m, o_orderkey % 121 AS sectors FROM orders)
  SELECT o_orderkey, CAST(coalesce((SELECT sum(bit_count(CAST('0x' || substr(m, CAST(2 * i + 1 AS INT), 2) AS INT) & CASE WHEN i < sectors // 8 THEN 255 ELSE (1 << CAST(sectors % 8 AS INT)) - 1 END))
    FROM range(16) r(i) WHERE i * 8 < sectors), 0) AS BIGINT) AS free FROM b"""
)
def q53_bitmap_free(spark: SparkSession, d: str) -> DataFrame:
    data = F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    maps = table(spark, d, "orders").select("o_orderkey", data.alias("bitmap"), (F.col("o_orderkey") % 121).alias("sectors"))
    return space.bitmap_free(maps).select("o_orderkey", "free")


@query(
    """SELECT c_custkey, 'U' || c_custkey AS name, c_custkey % 3 = 0 AS is_system, CAST(CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 50) * 1024 END AS BIGINT) AS quota FROM customer"""
)
def q54_user_specs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    quota = F.when(k % 2 == 0, F.concat(F.lit(":"), (k % 50).cast("string"), F.lit("KiB"))).otherwise("")
    spec = F.concat(F.lit("U"), k.cast("string"), F.when(k % 6 == 0, F.concat(F.lit(":s"), quota)).when(k % 3 == 0, F.concat(quota, F.lit(":S"))).otherwise(quota))
    specs = table(spark, d, "customer").select(k, spec.alias("spec"))
    parsed = users.parse_specs(specs)
    return parsed.select(F.substring("name", 2, 20).cast("long").alias("c_custkey"), "name", "is_system", "quota")


@query(
    r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A' ELSE '$' END AS directory, CASE p_partkey % 3 WHEN 2 THEN 'P' || (p_partkey * 977) ELSE 'P' || p_partkey END AS filename,
  CASE WHEN p_partkey % 3 = 2 THEN length('P' || (p_partkey * 977)) <= 7 ELSE length('P' || p_partkey) <= 7 END AS valid FROM part"""
)
def q55_flat_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "a.").when(k % 3 == 1, "$.").otherwise(""), F.lit("P"), F.when(k % 3 == 2, k * 977).otherwise(k).cast("string"))
    split = table(spark, d, "part").select("p_partkey", paths.split_flat(name).alias("s")).select("p_partkey", "s.directory", "s.filename")
    return split.withColumn("valid", text.is_flat_name(F.col("filename")))


@query(
    f"""WITH {bridge.SQL_ENTRIES}, a AS (SELECT image_id, unnest(range(start_sector, start_sector + sectors)) AS lba, p_partkey AS v FROM e),
  b AS (SELECT image_id, unnest(range(start_sector, start_sector + sectors)) AS lba, p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS v FROM e WHERE p_partkey % 7 <> 0)
  SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.lba, b.lba) AS lba, CASE WHEN a.lba IS NULL THEN 'added' WHEN b.lba IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.image_id = b.image_id AND a.lba = b.lba WHERE a.lba IS NULL OR b.lba IS NULL OR a.v <> b.v"""
)
def q56_sector_diff(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.entries(spark, d)
    spread = lambda df, v: df.select("image_id", F.explode(F.sequence(F.col("start_sector"), F.col("start_sector") + F.col("sectors") - 1)).alias("lba"), v.alias("v"))
    k = F.col("p_partkey")
    changed = k + F.when(k % 10 == 0, 1).otherwise(0)
    return catalogue.diff(spread(files, k), spread(files.where(k % 7 != 0), changed), ["image_id", "lba"], "v")


@query(
    f"""WITH {bridge.SQL_BAD}, z AS (SELECT image_id, 'sector-collision' AS code, count(*) AS n FROM (
      SELECT image_id, row_number() OVER (PARTITION BY image_id, sector ORDER BY ordinal) AS r FROM (SELECT image_id, ordinal, unnest(range(start_sector, start_sector + sectors)) AS sector FROM x)) WHERE r > 1 GROUP BY image_id
    UNION ALL SELECT image_id, 'beyond-end', count(*) FROM x WHERE start_sector + sectors > 300 GROUP BY image_id
    UNION ALL SELECT image_id, 'too-many-files', 1 FROM x GROUP BY image_id HAVING count(*) > 20
    UNION ALL SELECT image_id, 'duplicate-name', count(*) FROM (SELECT image_id, upper(path) AS p FROM x GROUP BY ALL HAVING count(*) > 1) GROUP BY image_id)
  SELECT image_id, code, CAST(n AS BIGINT) AS n FROM z"""
)
def q57_validate(spark: SparkSession, d: str) -> DataFrame:
    bad = bridge.bad_entries(spark, d)
    return catalogue.validate(bad, bridge.totals(bad, 300), max_files=20).groupBy("image_id", "code").agg(F.count("*").alias("n"))
