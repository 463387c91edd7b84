"""Registered queries of structures, mutations and checks that no other query covers; inputs are bytes made by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR, bytes_le
from platterlake.functions.text import is_flat_name, is_server_name, padded
from platterlake.operators import catalogue, copying, space, tree, users
from platterlake.plans import bridge
from platterlake.plans.bridge import table
from platterlake.plans.catalogue import Query
from platterlake.plans.images import _hierarchical, _images, _read
from platterlake.sinks.images import too_many_files, with_map_boot, with_title
from platterlake.sources import adfs, afs, dfs, hosts
from platterlake.sources.images import cylinders_for, filing_system, formats, parse_geometry, prefix_issue, sectors, surfaces, with_layout

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _field(x: Column, width: int) -> Column:
    return bytes_le(x.cast("long"), width)


def _partitions(spark: SparkSession, d: str) -> DataFrame:
    """Discs of 8 cylinders of 4 sectors with pointers to two info sectors (the second differs for every fifth), bitmaps at each cylinder's start."""
    k = F.col("n_nationkey")
    zeros = lambda n: F.lit(bytes(n))
    info = lambda cylinders: F.rpad(F.concat(F.lit(b"AFS0"), padded(F.col("n_name"), 16), _field(cylinders, 2), _field(F.lit(32), 3), _field(F.lit(1), 1), _field(F.lit(4), 2), _field(F.lit(1), 1), zeros(2), _field(k + 9, 3), _field(F.lit(0xD828), 2), _field(F.lit(4), 2), _field(F.lit(0), 1)), SECTOR, F.lit(b"\x00"))
    pointer = lambda at: F.concat(zeros(0xF6), _field(F.lit(at), 4), zeros(2), _field(F.lit(32), 3), zeros(1))
    bitmap = lambda c: F.rpad(_field((k * 7 + c) % 16, 1), SECTOR, F.lit(b"\x00"))
    bitmaps = [x for c in range(4, 8) for x in (bitmap(c), zeros(3 * SECTOR))]
    content = F.concat(pointer(2), pointer(3), info(F.lit(8)), info(F.when(k % 5 == 0, 9).otherwise(8)), zeros(12 * SECTOR), *bitmaps)
    return table(spark, d, "nation").select(k.cast("long").alias("image_id"), content.alias("content"))


def _info(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    images = _partitions(spark, d)
    located = images.join(adfs.disc_info(images).select("image_id", "info_sector_1", "info_sector_2"), "image_id")
    return images, afs.info_sectors(located)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS image_id, c AS "copy", n_name AS title, CAST(CASE WHEN c = 2 AND n_nationkey % 5 = 0 THEN 9 ELSE 8 END AS BIGINT) AS cylinders,
  CAST(n_nationkey + 9 AS BIGINT) AS root_sin FROM nation, (VALUES (1), (2)) v(c)""")
def q60_info_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Both info sectors of each disc, found by the pointers in its free map."""
    return _info(spark, d)[1].where("valid").select("image_id", "copy", "title", "cylinders", "root_sin")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS image_id, CASE WHEN n_nationkey % 5 = 0 THEN 'copies-differ' ELSE 'agreed' END AS code FROM nation""")
def q61_info_copies(spark: SparkSession, d: str) -> DataFrame:
    """Discs whose info sectors agree, and those that are issues."""
    good, issues = afs.agreed_info(_info(spark, d)[1])
    return good.select("image_id", F.lit("agreed").alias("code")).unionByName(issues.select("image_id", "code"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(c AS BIGINT) AS cylinder, CAST(bit_count(CAST((n_nationkey * 7 + c) % 16 AS INT)) AS BIGINT) AS free
  FROM nation, range(4, 8) r(c) WHERE n_nationkey % 5 <> 0""")
def q62_cylinder_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Free sectors by the bitmap of each cylinder of a partition."""
    images, info = _info(spark, d)
    good = afs.agreed_info(info)[0].select("image_id", "start_cylinder", "cylinders", "sectors_per_cylinder")
    maps = afs.cylinder_bitmaps(images.join(good, "image_id"))
    return space.bitmap_free(maps).select("image_id", F.col("cylinder").cast("long").alias("cylinder"), "free")


@query("""SELECT c_custkey AS id, 'G' || c_nationkey AS grp, 'U' || c_custkey AS name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS free_space, c_custkey % 5 <> 0 AS in_use,
  c_custkey % 7 = 0 AS is_system, CAST(c_custkey % 4 AS BIGINT) AS boot_option FROM customer""")
def q63_user_table(spark: SparkSession, d: str) -> DataFrame:
    """Users from the bytes of their tables, one table a customer."""
    k = F.col("c_custkey")
    status = F.when(k % 5 != 0, 0x80).otherwise(0) + F.when(k % 7 == 0, 0x40).otherwise(0) + k % 4
    name = F.concat(F.lit("G"), F.col("c_nationkey").cast("string"), F.lit(".U"), k.cast("string"), F.lit("\r"))
    row = F.concat(padded(name, 20, "\0"), padded(F.lit("PW\r"), 6, "\0"), _field(F.floor(F.abs("c_acctbal")), 4), _field(status, 1))
    found = afs.users(table(spark, d, "customer").select(k.alias("image_id"), row.alias("data")))
    return found.select(F.col("image_id").alias("id"), "grp", "name", "free_space", "in_use", "is_system", F.col("boot_option").cast("long").alias("boot_option"))


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, 'T' || image_id AS title, CAST(image_id % 4 AS BIGINT) AS boot_option, count(*) AS num_files, CAST(800 AS BIGINT) AS total_sectors FROM e GROUP BY image_id""")
def q64_set_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles and boot options put into the headers of images and read back, with the rest of the header as it was."""
    changed = with_title(_images(spark, d), F.concat(F.lit("T"), F.col("image_id").cast("string")), F.col("image_id") % 4)
    return dfs.disc_info(_read(changed)).select("image_id", "title", "boot_option", "num_files", "total_sectors")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, path, CAST(CASE WHEN path LIKE 'A.P1%' OR directory = 'B' THEN 51 WHEN locked THEN 11 ELSE 3 END AS BIGINT) AS attr FROM e""")
def q65_chmod(spark: SparkSession, d: str) -> DataFrame:
    """Access by wildcard, and for all below a directory."""
    e = bridge.entries(spark, d).withColumn("attr", F.when(F.col("locked"), 11).otherwise(3).cast("long"))
    e = catalogue.chmod(catalogue.chmod(e, "a.p1*", F.lit(51)), "b", F.lit(51), recursive=True)
    return e.select("image_id", "path", "attr")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, path FROM e WHERE path NOT LIKE 'C.%' OR locked""")
def q66_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left when a directory's unlocked files go."""
    return catalogue.delete(bridge.entries(spark, d), "c.*")[0].select("image_id", "path")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, CASE WHEN p_partkey % 3 = 0 THEN directory || '.R' || p_partkey ELSE path END AS path, length FROM e""")
def q67_rename(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.entries(spark, d)
    moves = e.where("p_partkey % 3 = 0").select("image_id", F.lower("path").alias("path"), F.concat("directory", F.lit(".R"), F.col("p_partkey").cast("string")).alias("new_path"))
    return catalogue.rename(e, moves)[0].select("image_id", "path", "length")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, path, is_dir, max(length) AS length FROM (SELECT image_id, path, false AS is_dir, length FROM e UNION ALL SELECT DISTINCT image_id, directory, true, 0 FROM e) GROUP BY ALL""")
def q68_stat(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.stat(bridge.entries(spark, d).withColumn("exec", F.lit(0).cast("long"))).select("image_id", "path", "is_dir", "length")


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, ordinal, path FROM e WHERE p_partkey % 4 = 0""")
def q69_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries by name in any case."""
    e = bridge.entries(spark, d)
    wanted = e.where("p_partkey % 4 = 0").select("image_id", F.lower("path").alias("path")).unionByName(e.select("image_id", F.lit("Z.NONE").alias("path")))
    return catalogue.lookup(e, wanted).select("image_id", "ordinal", "path")


@query(f"""WITH {bridge.SQL_FREE}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY start_sector) AS n FROM f)
  SELECT image_id, CAST(1 AS BIGINT) AS seq, min(start_sector) AS start FROM f GROUP BY image_id
  UNION ALL SELECT image_id, 2, coalesce(min(CASE WHEN length - CASE WHEN n = 1 THEN 1 ELSE 0 END >= 3 THEN start_sector + CASE WHEN n = 1 THEN 1 ELSE 0 END END)) FROM r GROUP BY image_id
  UNION ALL SELECT image_id, 3, NULL FROM f GROUP BY image_id""")
def q70_first_fit_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Three requests one after another: of 1 sector, of 3, and of more than there are."""
    e = bridge.entries(spark, d)
    free = space.free_map(e, bridge.totals(e))
    asked = e.select("image_id").distinct().select("image_id", F.inline(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(n).alias("need")) for k, n in ((1, 1), (2, 3), (3, 100_000))])))
    return copying.first_fit_sequence(free, asked).select("image_id", "seq", "start")


@query("""SELECT p_partkey, CAST(1 + p_partkey % 700 AS BIGINT) AS cylinders, CAST(1 + p_partkey % 8 AS BIGINT) AS heads, CAST((1 + p_partkey % 700) * (1 + p_partkey % 8) * 33 * 256 AS BIGINT) AS capacity,
  CAST(1 + p_partkey % 700 AS BIGINT) AS again FROM part""")
def q71_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Geometry sidecars, and the cylinders that their capacity needs."""
    k = F.col("p_partkey")
    sidecar = F.concat(F.lit(bytes(13)), bytes_le(F.floor((1 + k % 700) / 256), 1), bytes_le((1 + k % 700) % 256, 1), bytes_le(1 + k % 8, 1), F.lit(bytes(6)))
    g = table(spark, d, "part").select("p_partkey", parse_geometry(sidecar).alias("g")).select("p_partkey", "g.cylinders", "g.heads", "g.capacity")
    return g.withColumn("again", cylinders_for(F.col("capacity"), F.col("heads")))


@query("""SELECT s_suppkey, regexp_full_match(s_name, '[ -~]{1,7}') AND NOT regexp_matches(s_name, '[#*:.]') AS flat, regexp_full_match(regexp_replace(s_name, '#0*', ''), '[^. :]{1,10}') AS server FROM supplier""")
def q72_name_validity(spark: SparkSession, d: str) -> DataFrame:
    short = F.regexp_replace("s_name", "#0*", "")
    return table(spark, d, "supplier").select("s_suppkey", is_flat_name(F.col("s_name")).alias("flat"), is_server_name(short).alias("server"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'G' || c_nationkey || '.' ELSE '' END || 'U' || c_custkey AS full_id FROM customer""")
def q73_user_identity(spark: SparkSession, d: str) -> DataFrame:
    grp = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("G"), F.col("c_nationkey").cast("string"))).otherwise("")
    return table(spark, d, "customer").select("c_custkey", users.full_id(grp, F.concat(F.lit("U"), F.col("c_custkey").cast("string"))).alias("full_id"))


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, 'too-many-files' AS code, CAST(count(*) AS VARCHAR) AS detail FROM e GROUP BY image_id HAVING count(*) > 24""")
def q74_too_many_files(spark: SparkSession, d: str) -> DataFrame:
    return too_many_files(bridge.entries(spark, d), 24)


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT DISTINCT image_id, CAST(k AS BIGINT) AS lba, CAST(k * 256 AS BIGINT) AS byte_offset, CAST(256 AS BIGINT) AS bytes FROM e, range(3, 8) r(k)""")
def q75_sector_range(spark: SparkSession, d: str) -> DataFrame:
    """Sectors 3 to 7 of each image."""
    found = sectors(surfaces(with_layout(_images(spark, d))), F.lit(3).cast("long"), F.lit(5))
    return found.select("image_id", "lba", F.col("byte_offset").cast("long").alias("byte_offset"), F.length("data").cast("long").alias("bytes"))


@query(f"""WITH {bridge.SQL_FREE}, m AS (SELECT image_id, start_sector, length FROM f UNION ALL SELECT image_id, start_sector, sectors FROM e WHERE p_partkey % 2 = 0 AND sectors > 0),
  a AS (SELECT *, max(start_sector + length) OVER (PARTITION BY image_id ORDER BY start_sector, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m),
  i AS (SELECT *, sum(CASE WHEN start_sector <= b THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY start_sector, length ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM a)
  SELECT image_id, min(start_sector) AS start_sector, CAST(max(start_sector + length) - min(start_sector) AS BIGINT) AS length FROM i GROUP BY image_id, g""")
def q76_merge_free(spark: SparkSession, d: str) -> DataFrame:
    """Free runs after every second file is deleted."""
    e = bridge.entries(spark, d)
    freed = e.where("p_partkey % 2 = 0 and sectors > 0").select("image_id", "start_sector", F.col("sectors").alias("length"))
    return space.merge_free(space.free_map(e, bridge.totals(e)), freed).select("image_id", "start_sector", "length")


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, path FROM t WHERE path <> '$' AND NOT regexp_matches(upper(path), '(^|\\.)(ASIA|FRANCE)(\\.|$)')")
def q77_without_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """The tree without two named directories and all below them."""
    named = spark.createDataFrame([("asia",), ("France",)], "name string")
    return tree.without_subtrees(tree.tree_paths(bridge.tree(spark, d)), named).where("depth > 0").select("id", "path")


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dfs' WHEN 1 THEN 'adfs' WHEN 2 THEN 'adfs' END AS fs, CASE (p_partkey // 4) % 3 WHEN 0 THEN 'dfs' WHEN 1 THEN 'adfs' ELSE 'afs' END AS wanted FROM part)
  SELECT p_partkey, wanted, CASE WHEN fs IS NULL THEN 'unknown-extension' WHEN wanted = 'dfs' AND fs <> 'dfs' THEN 'not-flat' WHEN wanted <> 'dfs' AND fs = 'dfs' THEN 'flat-image' END AS issue FROM i""")
def q78_prefix_compatibility(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ("DSD", "adl", "dat", "txt"))), (k % 4 + 1).cast("int")))
    wanted = F.element_at(F.array(*map(F.lit, ("dfs", "adfs", "afs"))), (F.floor(k / 4) % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", wanted.alias("wanted"), prefix_issue(wanted, filing_system(path)).alias("issue"))


@query("""WITH f AS (SELECT CAST(p_size AS BIGINT) AS image_id, p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'a/F' || p_partkey || ',fff' WHEN 1 THEN 'b/c/F' || p_partkey WHEN 2 THEN 'F' || p_partkey || '.INF' WHEN 3 THEN 'a/.x/F' ELSE 'F' || p_partkey END AS path FROM part),
  p AS (SELECT image_id, path, CASE k % 5 WHEN 0 THEN '$.a' WHEN 1 THEN '$.b.c' ELSE '$' END AS directory, CASE k % 5 WHEN 0 THEN '$.a.F' || k WHEN 1 THEN '$.b.c.F' || k ELSE '$.F' || k END AS target FROM f WHERE k % 5 NOT IN (2, 3))
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY string_split(path, '/')) AS step FROM p""")
def q79_import_plan(spark: SparkSession, d: str) -> DataFrame:
    """Where the files of host folders go, without hidden ones and sidecars."""
    k = F.col("p_partkey").cast("string")
    named = F.element_at(F.array(F.concat(F.lit("a/F"), k, F.lit(",fff")), F.concat(F.lit("b/c/F"), k), F.concat(F.lit("F"), k, F.lit(".INF")), F.lit("a/.x/F"), F.concat(F.lit("F"), k)), (F.col("p_partkey") % 5 + 1).cast("int"))
    files = table(spark, d, "part").select(F.col("p_size").cast("long").alias("image_id"), named.alias("path"))
    return hosts.import_plan(files, flat=False)


@query(f"""WITH RECURSIVE {bridge.SQL_TREE}, w AS (SELECT lower(path) AS path FROM t UNION SELECT '$.none' UNION SELECT '$.asia.x')
  SELECT CAST(0 AS BIGINT) AS image_id, w.path, t.id IS NOT NULL AS found, coalesce(t.is_dir, false) AS is_dir, coalesce(NOT t.is_dir, false) AS is_file FROM w LEFT JOIN t ON upper(t.path) = upper(w.path)""")
def q80_path_states(spark: SparkSession, d: str) -> DataFrame:
    placed = tree.tree_paths(bridge.tree(spark, d))
    wanted = placed.select("image_id", F.lower("path").alias("path")).unionByName(spark.createDataFrame([(0, "$.none"), (0, "$.asia.x")], "image_id long, path string"))
    return catalogue.states(placed, wanted)


@query(f"""WITH RECURSIVE {bridge.SQL_TREE}, w AS (SELECT path || '.NEW' AS path FROM t WHERE depth = 1 UNION ALL SELECT path || '.NEW.DEEP' FROM t WHERE depth = 1)
  SELECT CAST(0 AS BIGINT) AS image_id, path, true AS is_dir FROM w""")
def q81_make_directories(spark: SparkSession, d: str) -> DataFrame:
    """Directories two levels below each region, with those above them."""
    placed = tree.tree_paths(bridge.tree(spark, d))
    return catalogue.make_dirs(placed, placed.where("depth = 1").select("image_id", F.concat("path", F.lit(".NEW.DEEP")).alias("path")))[0]


@query(f"""WITH {bridge.SQL_FREE}, m AS (SELECT e.image_id, coalesce(max(f.length), 0) AS most FROM (SELECT DISTINCT image_id FROM e) e LEFT JOIN f USING (image_id) GROUP BY e.image_id)
  SELECT image_id, 'no-space' AS code, CAST(most AS VARCHAR) AS detail FROM m WHERE most < 500""")
def q82_first_fit_issues(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.entries(spark, d)
    return space.first_fit_issues(space.free_map(e, bridge.totals(e)), e, F.lit(500))


@query(f"""WITH {bridge.SQL_ENTRIES} SELECT image_id, CAST(image_id % 4 AS BIGINT) AS boot_option, CAST(0 AS BIGINT) AS issues FROM e GROUP BY image_id""")
def q83_set_map_boot(spark: SparkSession, d: str) -> DataFrame:
    """Boot options put into free maps, whose checksums hold."""
    changed = with_map_boot(_hierarchical(spark, d, 1280), F.col("image_id") % 4)
    return adfs.disc_info(changed, adfs.map_codes().alias("codes")).select("image_id", "boot_option", F.size("codes").cast("long").alias("issues"))


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 102400 WHEN 1 THEN 204800 WHEN 2 THEN 327680 ELSE 655360 END AS bytes, CASE WHEN p_partkey % 4 < 2 THEN 'dfs' ELSE 'adfs' END AS fs FROM part),
  f AS (SELECT * FROM (VALUES ('dfs-40', 'dfs', 102400, 1, 40, 10), ('dfs-80', 'dfs', 204800, 1, 80, 10), ('adfs-m', 'adfs', 327680, 1, 80, 16), ('adfs-l', 'adfs', 655360, 2, 80, 16)) v(format, fs, bytes, sides, tracks, spt))
  SELECT p_partkey, format, sides, tracks, spt FROM i JOIN f USING (fs, bytes)""")
def q84_formats(spark: SparkSession, d: str) -> DataFrame:
    """The layout of each image, and the one format of its size and sides."""
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % 4 + 1).cast("int"))
    images = table(spark, d, "part").select(k.alias("image_id"), pick("a.ssd", "a.ssd", "a.adf", "a.adl").alias("path"), pick(102400, 204800, 327680, 655360).cast("long").alias("length"), F.lit(b"").alias("content"))
    laid = with_layout(images).select("image_id", "fs", F.col("length").alias("bytes"), "sides", "tracks", "spt")
    found = laid.join(F.broadcast(formats(spark)), ["fs", "bytes", "sides", "tracks", "spt"])
    return found.select(F.col("image_id").alias("p_partkey"), "format", "sides", "tracks", "spt")
