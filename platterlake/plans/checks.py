"""Registered queries of plans, guards, layouts and exports that the other modules of queries don't reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR, bytes_le
from platterlake.operators import catalogue, copying, metadata, space, tree, users
from platterlake.plans import bridge
from platterlake.plans.bridge import table
from platterlake.plans.catalogue import Query
from platterlake.plans.fixtures import server_images
from platterlake.plans.images import _images, _read
from platterlake.plans.more import _ORDERED, _placed
from platterlake.sinks.export import with_metadata
from platterlake.sinks.images import patched, write_files
from platterlake.sources import afs, dfs
from platterlake.sources.archives import safe_path
from platterlake.sources.images import expanded, read_images, surfaces, with_layout

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {bridge.SQL_ENTRIES}, t AS (SELECT image_id, max(start_sector + sectors) AS used FROM e GROUP BY image_id)
  SELECT image_id, CAST(204800 - greatest(used * 256, 512) AS BIGINT) AS added, CAST(204800 AS BIGINT) AS bytes, (SELECT count(*) FROM e WHERE e.image_id = t.image_id) AS files FROM t""")
def q85_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Images cut off behind their last file, padded again and read."""
    cut = _images(spark, d, "used").withColumn("content", F.col("content").substr(F.lit(1), F.greatest(F.col("used") * SECTOR, F.lit(512)).cast("int")))
    named = cut.select("image_id", "path", F.length("content").cast("long").alias("length"), "content")
    full = expanded(with_layout(named).withColumn("tracks", F.lit(80)).withColumn("spt", F.lit(10)).withColumn("full_bytes", F.lit(204800).cast("long")))
    found = dfs.entries(dfs.identify(surfaces(full.withColumn("bytes", F.length("content").cast("long")))), kept=("added", "bytes"))
    return found.groupBy("image_id", "added", "bytes").agg(F.count("path").alias("files"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Double catalogues of two files, one in each section; the second section's cycle differs for every third."""
    k = F.col("n_nationkey")
    pad = lambda b: F.rpad(b, SECTOR, F.lit(b"\x00"))
    entry = lambda letter: F.concat(F.lit(letter), F.lpad(k.cast("string"), 6, "0"), F.lit("$")).cast("binary")
    place = lambda start: F.concat(F.lit(bytes(4)), bytes_le(k * 10, 2), F.lit(b"\x00"), bytes_le(F.lit(start), 1))
    head = lambda cycle: F.concat(F.lit(b"\x00" * 4), bytes_le(cycle, 1), F.lit(b"\x08\x21\x90"))
    one = F.concat(pad(F.concat(F.lit(b"DOUBLE\x00\x00"), entry("A"))), pad(F.concat(head(k), place(4))))
    two = F.concat(pad(F.concat(F.lit(b"\xaa" * 8), entry("B"))), pad(F.concat(head(k + F.when(k % 3 == 0, 1).otherwise(0)), place(9))))
    marked = F.concat(one, F.lit(b"\xaa" * 12), two.substr(F.lit(13), F.lit(500)))
    image = F.rpad(marked, 102400, F.lit(b"\x00"))
    return table(spark, d, "nation").select(k.cast("long").alias("image_id"), F.concat(k.cast("string"), F.lit(".ssd")).alias("path"), F.lit(102400).cast("long").alias("length"), image.alias("content"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS image_id, 'cycle-differs' AS code FROM nation WHERE n_nationkey % 3 = 0""")
def q86_section_issues(spark: SparkSession, d: str) -> DataFrame:
    """Double catalogues whose sections disagree."""
    return dfs.marker_issues(_read(_sections(spark, d))).select("image_id", "code")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS image_id, 'double' AS catalogue, CAST(2 AS BIGINT) AS num_files FROM nation""")
def q87_double_catalogues(spark: SparkSession, d: str) -> DataFrame:
    return dfs.disc_info(_read(_sections(spark, d))).select("image_id", "catalogue", "num_files")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT DISTINCT image_id, md5(repeat(chr(65 + CAST(image_id % 26 AS INT)), 256)) AS sector_md5 FROM e""")
def q88_patched(spark: SparkSession, d: str) -> DataFrame:
    """Sector 700 of each image put over, and read back."""
    images = _images(spark, d)
    letter = F.chr(F.lit(65) + F.col("image_id") % 26)
    patches = images.select("image_id", F.lit(700).cast("long").alias("lba"), F.encode(F.repeat(letter, SECTOR), "UTF-8").alias("data"))
    return patched(images, patches).select("image_id", F.md5(F.col("content").substr(F.lit(700 * SECTOR + 1), F.lit(SECTOR))).alias("sector_md5"))


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id || '/' || name AS path, CAST(length AS BIGINT) AS bytes FROM e
  UNION ALL SELECT image_id || '/' || name || '.inf', CAST(greatest(length(name), 11) + 1 + 30 AS BIGINT) FROM e""")
def q89_export(spark: SparkSession, d: str) -> DataFrame:
    """Files with their sidecars, and how long each is."""
    e = bridge.entries(spark, d)
    files = e.select(F.concat_ws("/", "image_id", "name").alias("path"), "name", "load", (F.col("p_partkey") % 65536).alias("exec"), "length", F.lit(3).cast("long").alias("attr"), F.encode(F.repeat(F.lit("x"), F.col("length").cast("int")), "UTF-8").alias("data"))
    return with_metadata(files).select("path", F.length("data").cast("long").alias("bytes"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'etc/P' || p_partkey WHEN 1 THEN 'a/P' || p_partkey WHEN 2 THEN '_' ELSE 'a/b' END AS safe FROM part""")
def q90_safe_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    told = F.element_at(F.array(F.concat(F.lit("../../etc/"), k), F.concat(F.lit("/a/./"), k), F.lit("../.."), F.lit("a\\b")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", safe_path(told).alias("safe"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'afs' WHEN 1 THEN 'adfs' END AS partition, '$.' || s_suppkey AS path FROM supplier""")
def q91_scopes(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat(F.lit("$."), F.col("s_suppkey").cast("string"))
    told = F.concat(F.element_at(F.array(F.lit("afs:"), F.lit("ADFS:"), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int")), k)
    return table(spark, d, "supplier").select("s_suppkey", copying.scope(told).alias("s")).select("s_suppkey", "s.*")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, 'locked' AS code, path FROM e WHERE directory = 'D' AND locked""")
def q92_locked_guard(spark: SparkSession, d: str) -> DataFrame:
    """Locked files that a delete by wildcard is refused for."""
    return catalogue.delete(bridge.entries(spark, d), "d.*")[1].select("image_id", "code", "path")


@query(f"""WITH RECURSIVE {bridge.SQL_TREE}, l AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ordinal DESC, name DESC) = 1 AS is_last FROM n),
  g AS (SELECT id, '' AS bars, name AS line FROM l WHERE parent_id IS NULL
    UNION ALL SELECT l.id, CASE WHEN l.is_last THEN g.bars || '    ' ELSE g.bars || '│   ' END, g.bars || CASE WHEN l.is_last THEN '└── ' ELSE '├── ' END || l.name FROM l JOIN g ON l.parent_id = g.id)
  SELECT id, line FROM g""")
def q93_glyph_lines(spark: SparkSession, d: str) -> DataFrame:
    return tree.glyph_lines(bridge.tree(spark, d)).select("id", "line")


@query("""SELECT 'd' || n_nationkey AS stem, CASE n_nationkey % 3 WHEN 0 THEN 'paired' WHEN 1 THEN 'no-geometry' ELSE 'no-data' END AS code FROM nation""")
def q94_geometry_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Hard discs with their geometry files, and either without the other."""
    k = F.col("n_nationkey")
    named = lambda suffix: F.concat(F.lit("d"), k.cast("string"), F.lit(suffix))
    nation = table(spark, d, "nation")
    files = nation.where(k % 3 != 2).select(named(".dat").alias("path"), F.lit(b"x").alias("content")).unionByName(nation.where(k % 3 != 1).select(named(".DSC").alias("path"), F.lit(b"y").alias("content")))
    pairs, issues = metadata.pair_geometry(files)
    return pairs.select("stem", F.lit("paired").alias("code")).unionByName(issues.select(F.col("image_id").alias("stem"), "code"))


@query(f"""WITH RECURSIVE {bridge.SQL_TREE} SELECT '$.ASIA.' || name AS path, '$.ASIA.' || name IN (SELECT upper(path) FROM t) AS replaced FROM n WHERE parent_id = 'R2' AND false
  UNION ALL SELECT '$.LIB.F' || s_suppkey, s_suppkey % 3 = 0 FROM supplier""")
def q95_emplace(spark: SparkSession, d: str) -> DataFrame:
    """A library's files below a directory, and which of them are there already."""
    s = table(spark, d, "supplier").select(F.lit(1).alias("image_id"), F.lit(1).alias("depth"), F.lit(False).alias("is_dir"), F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("name"), "s_suppkey")
    there = s.where("s_suppkey % 3 = 0").select("image_id", F.lower(F.concat(F.lit("$.lib."), "name")).alias("path"))
    return copying.emplace(s.drop("s_suppkey"), there, "LIB").select("path", "replaced")


@query(f"""WITH {bridge.SQL_BAD}, n AS (SELECT image_id, start_sector AS start, start_sector + sectors AS "end", lead(start_sector) OVER (PARTITION BY image_id ORDER BY start_sector, start_sector + sectors) AS next_start FROM x)
  SELECT * FROM n WHERE next_start < "end" """)
def q96_track_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Footprints that reach into the next one."""
    bad = bridge.bad_entries(spark, d).select("image_id", F.col("start_sector").alias("start"), (F.col("start_sector") + F.col("sectors")).alias("end"))
    return catalogue.track_overlaps(bad).select("image_id", "start", "end", "next_start")


@query("""SELECT 'U' || c_custkey AS name, c_custkey % 2 = 0 AS is_system, CAST(c_custkey * 1024 AS BIGINT) AS quota FROM customer
  UNION ALL SELECT 'SYST', true, CAST(NULL AS BIGINT) UNION ALL SELECT 'Boot', false, NULL""")
def q97_built_in_users(spark: SparkSession, d: str) -> DataFrame:
    """Specs over the built-in users."""
    k = F.col("c_custkey")
    told = F.concat(F.lit("U"), k.cast("string"), F.when(k % 2 == 0, ":S").otherwise(""), F.lit(":"), k.cast("string"), F.lit("KiB"))
    specs = table(spark, d, "customer").select(told.alias("spec")).unionByName(spark.createDataFrame([("SYST:s",)], "spec string"))
    return users.with_built_ins(spark, users.parse_specs(specs), omit=("Welcome",))[0].select("name", "is_system", "quota")


@query(f"""WITH RECURSIVE {_ORDERED} SELECT CASE WHEN is_dir THEN 'mkdir' ELSE 'file' END AS action, count(*) AS n FROM t WHERE depth > 0 AND path LIKE '$.ASIA%' GROUP BY 1""")
def q98_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    return copying.copy_plan(_placed(spark, d), "$.ASIA", "$.TO").groupBy("action").agg(F.count("id").alias("n"))


@query(f"""WITH {bridge.SQL_FREE}, r AS (SELECT image_id, start_sector // 100 AS cylinder, start_sector AS start, length FROM f),
  z AS (SELECT *, sum(length) OVER (PARTITION BY image_id, cylinder) AS c, sum(length) OVER (PARTITION BY image_id) AS a FROM r),
  o AS (SELECT *, row_number() OVER w AS ordinal, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM z WHERE a >= 20 WINDOW w AS (PARTITION BY image_id ORDER BY c DESC, cylinder, start))
  SELECT image_id, ordinal, CAST(cylinder AS BIGINT) AS cylinder, start, CAST(least(length, 20 - b) AS BIGINT) AS length FROM o WHERE b < 20""")
def q99_allocate(spark: SparkSession, d: str) -> DataFrame:
    """Runs for 20 sectors, from the cylinders with most free ones."""
    e = bridge.entries(spark, d)
    runs = space.free_map(e, bridge.totals(e)).select("image_id", F.floor(F.col("start_sector") / 100).alias("cylinder"), F.col("start_sector").alias("start"), "length")
    return space.allocate(runs, 20).select("image_id", F.col("ordinal").cast("long").alias("ordinal"), "cylinder", "start", "length")


@query(f"""WITH {bridge.SQL_ENTRIES}, c AS (SELECT image_id || ':' || path AS label FROM e WHERE p_partkey % 2 = 0), f AS (SELECT label FROM c ORDER BY label LIMIT 5)
  SELECT (SELECT count(*) FROM c) AS n, (SELECT string_agg(label, ' ' ORDER BY label) FROM f) AS shown, (SELECT count(*) FROM c) - (SELECT count(*) FROM f) AS more""")
def q100_conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many conflicts there are, and the first five."""
    e = bridge.entries(spark, d)
    found = catalogue.conflicts(e, e.where("p_partkey % 2 = 0"), ["image_id", "path"])
    told = catalogue.conflict_summary(found, F.concat(F.col("image_id").cast("string"), F.lit(":"), "path"))
    return told.select("n", F.array_join("shown", " ").alias("shown"), F.col("more").cast("long").alias("more"))


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, path, CAST(CASE WHEN directory = 'E' THEN 6400 ELSE load END AS BIGINT) AS load FROM e""")
def q101_set_address(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.set_address(bridge.entries(spark, d), "e.*", "load", 6400).select("image_id", "path", "load")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT DISTINCT image_id, '$' AS path, 'broken-map' AS issue FROM e WHERE image_id % 2 = 0""")
def q102_partition_issues(spark: SparkSession, d: str) -> DataFrame:
    """Partitions whose root can't be read, as every second image is cut off before it."""
    zero = F.lit(0).cast("long")
    files = bridge.by_image(bridge.entries(spark, d)).select("image_id", "name", "load", zero.alias("exec"), F.lit(12).alias("access"), F.lit(0xD828).alias("packed_date"), F.lit(b"x").alias("data"))
    images = server_images(files)
    cut = F.when(F.col("image_id").cast("long") % 2 == 0, F.col("content").substr(F.lit(1), (F.col("root_sin") * SECTOR).cast("int"))).otherwise(F.col("content"))
    return afs.objects(images.withColumn("content", cut)).where("issue is not null").select(F.col("image_id").cast("long").alias("image_id"), "path", "issue")


@query("""SELECT 'double/' || n_nationkey || '.ssd' AS name, CAST(102400 AS BIGINT) AS length, CAST(2 AS BIGINT) AS num_files FROM nation""")
def q103_folder_of_images(spark: SparkSession, d: str) -> DataFrame:
    """Images written as files below the shared folder, and all of them read again in one batch."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="images-")
    folder = f"{shared.rstrip('/')}/images-{uuid.uuid4().hex}"
    write_files(_sections(spark, d).select(F.concat(F.lit("double/"), "path").alias("path"), F.col("content").alias("data")), folder)
    images = read_images(spark, folder)
    info = dfs.disc_info(_read(images)).select("image_id", "num_files")
    name = F.regexp_extract("image_id", r"(double/[^/]*)$", 1)
    return images.select("image_id", "length").join(info, "image_id").select(name.alias("name"), "length", "num_files")
