"""The registered queries of the disc operators, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions import access, dates, globs, metadata, numbers, paths, text
from platterlake.operators import catalogue, partition, space, tree, users
from platterlake.operators import metadata as sources
from platterlake.plans import bridge
from platterlake.plans.bridge import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _bits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 64).alias("bits"))


_CANONICAL_TEXT = """(CASE WHEN bits & 8 <> 0 THEN 'L' ELSE '' END) || (CASE WHEN bits & 2 <> 0 THEN 'W' ELSE '' END) || (CASE WHEN bits & 1 <> 0 THEN 'R' ELSE '' END)
  || '/' || (CASE WHEN bits & 32 <> 0 THEN 'W' ELSE '' END) || (CASE WHEN bits & 16 <> 0 THEN 'R' ELSE '' END)"""
_BITS = "b AS (SELECT o_orderkey, o_orderkey % 64 AS bits FROM orders)"


@query(f"WITH {bridge.SQL_FREE} SELECT * FROM f")
def q21_free_map(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.entries(spark, d)
    return space.free_map(files, bridge.totals(files))


@query("SELECT o_orderkey, printf('%08X', (o_orderkey * 2654435761) % 4294967296) AS address, printf('%02X', o_orderkey % 64) AS attr FROM orders")
def q01_hex_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", numbers.hex_text((k * 2654435761) % 4294967296).alias("address"), numbers.hex_text(k % 64, 2).alias("attr"))


@query(
    f"""WITH {_BITS} SELECT o_orderkey, {_CANONICAL_TEXT} AS canonical,
  CASE WHEN bits & 32 <> 0 THEN (CASE WHEN bits & 16 <> 0 THEN 'DL/' ELSE 'D/' END) ELSE
    (CASE WHEN bits & 16 <> 0 THEN 'L' ELSE '' END) || (CASE WHEN bits & 8 <> 0 THEN 'W' ELSE '' END) || (CASE WHEN bits & 4 <> 0 THEN 'R' ELSE '' END)
    || '/' || (CASE WHEN bits & 2 <> 0 THEN 'W' ELSE '' END) || (CASE WHEN bits & 1 <> 0 THEN 'R' ELSE '' END) END AS server FROM b"""
)
def q02_access_text(spark: SparkSession, d: str) -> DataFrame:
    return _bits(spark, d).select("o_orderkey", access.access_text(F.col("bits")).alias("canonical"), access.server_access_text(F.col("bits")).alias("server"))


@query(
    f"""WITH {_BITS}, m AS (SELECT o_orderkey, ((bits >> 4) & 1) + ((bits >> 5) & 1) * 2 + (bits & 1) * 4 + ((bits >> 1) & 1) * 8 + ((bits >> 3) & 1) * 16 AS server FROM b)
  SELECT o_orderkey, CAST(server AS BIGINT) AS server, CAST((server & 1) * 16 + ((server >> 1) & 1) * 32 + ((server >> 2) & 1) + ((server >> 3) & 1) * 2 + ((server >> 4) & 1) * 8 AS BIGINT) AS back FROM m"""
)
def q03_access_remap(spark: SparkSession, d: str) -> DataFrame:
    mapped = _bits(spark, d).withColumn("server", access.to_server(F.col("bits")).cast("long"))
    return mapped.select("o_orderkey", "server", access.from_server(F.col("server")).cast("long").alias("back"))


@query(f"WITH {_BITS} SELECT o_orderkey, {_CANONICAL_TEXT} AS txt, CAST(bits & 59 AS BIGINT) AS from_text, CAST(bits AS BIGINT) AS from_hex FROM b")
def q04_access_parse(spark: SparkSession, d: str) -> DataFrame:
    told = _bits(spark, d).withColumn("txt", access.access_text(F.col("bits"))).withColumn("hex", F.concat(F.lit("0x"), numbers.hex_text(F.col("bits"), 2)))
    return told.select("o_orderkey", "txt", access.parse_access(F.col("txt")).cast("long").alias("from_text"), access.parse_access(F.col("hex")).cast("long").alias("from_hex"))


@query(f"WITH {bridge.SQL_ENTRIES} SELECT CAST((load >> 8) & 4095 AS BIGINT) AS filetype, count(*) AS n FROM e WHERE load & 4293918720 = 4293918720 GROUP BY 1")
def q05_filetype_histogram(spark: SparkSession, d: str) -> DataFrame:
    typed = bridge.entries(spark, d).select(metadata.infer_filetype(F.col("load")).alias("filetype")).where("filetype is not null")
    return typed.groupBy("filetype").agg(F.count("*").alias("n"))


_MEMBERS = """
m AS (
  SELECT p_partkey AS k, CAST(floor(p_partkey / 40.0) AS BIGINT) AS archive, p_partkey % 5 AS r, (p_partkey * 2654435761) % 4294967296 AS a, CAST(p_size AS BIGINT) * 137 AS file_size FROM part)"""


@query(
    f"""WITH {_MEMBERS} SELECT k, 'd/F' || k AS name, CAST(CASE r WHEN 0 THEN 4293918720 + (k % 4096) * 256 WHEN 1 THEN a WHEN 2 THEN k END AS BIGINT) AS load,
  CAST(CASE r WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN k * 3 END AS BIGINT) AS exec FROM m"""
)
def q06_filename_suffix_parse(spark: SparkSession, d: str) -> DataFrame:
    named = bridge.members(spark, d).where("content is null").withColumn("m", metadata.name_meta(F.col("filename")))
    return named.select((F.col("ordinal") / 2).cast("long").alias("k"), metadata.clean_name(F.col("filename")).alias("name"), "m.load", "m.exec")


@query(
    f"""WITH {bridge.SQL_ENTRIES} SELECT p_partkey, CASE WHEN load & 4293918720 = 4293918720 THEN ',' || printf('%03x', (load >> 8) & 4095)
  ELSE ',' || printf('%08x', load) || ',' || printf('%08x', length) END AS suffix, ',' || printf('%x', load) || '-' || printf('%x', length) AS dashed FROM e"""
)
def q07_filename_suffix_build(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.entries(spark, d)
    return e.select("p_partkey", metadata.name_suffix(F.col("load"), F.col("length")).alias("suffix"), metadata.dash_suffix(F.col("load"), F.col("length")).alias("dashed"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS r, (o_orderkey * 2654435761) % 4294967296 AS a, (o_orderkey * 40503) % 65536 AS x FROM orders)
  SELECT k AS file_id, CASE WHEN r < 2 THEN 'inf-trad' WHEN r = 2 THEN 'inf-pieb' END AS source, CAST(CASE WHEN r < 3 THEN a END AS BIGINT) AS load,
         CAST(CASE WHEN r < 3 THEN x END AS BIGINT) AS exec, CAST(CASE r WHEN 1 THEN 11 WHEN 2 THEN k % 64 END AS BIGINT) AS attr,
         CAST(CASE WHEN r < 3 AND a & 4293918720 = 4293918720 THEN (a >> 8) & 4095 END AS BIGINT) AS filetype FROM o"""
)
def q08_inf_parse(spark: SparkSession, d: str) -> DataFrame:
    read = bridge.sidecars(spark, d).withColumn("p", metadata.parse_sidecar(F.col("line")))
    return read.select("file_id", "p.source", "p.meta.load", "p.meta.exec", "p.meta.attr", "p.meta.filetype")


@query(
    f"""WITH {bridge.SQL_ENTRIES} SELECT p_partkey, rpad(path, greatest(11, length(path))::INT, ' ') || ' ' || printf('%08X', load) || ' ' || printf('%08X', start_sector) || ' ' || printf('%08X', "length")
    || CASE WHEN locked THEN ' 0B' ELSE '' END AS line, '0 ' || printf('%x', load) || ' ' || printf('%x', start_sector) || ' ' || CASE WHEN locked THEN 'b' ELSE '17' END AS bridge FROM e"""
)
def q09_inf_format(spark: SparkSession, d: str) -> DataFrame:
    e = bridge.entries(spark, d).withColumn("attr", F.when(F.col("locked"), 11))
    columns = [F.col(c) for c in ("path", "load", "start_sector", "length", "attr")]
    return e.select("p_partkey", metadata.sidecar_line(*columns).alias("line"), metadata.bridge_line(F.col("load"), F.col("start_sector"), F.col("attr")).alias("bridge"))


@query(
    """SELECT p_partkey, CAST(CAST(p_size AS BIGINT) * CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN 1024 WHEN 4 THEN 1000000 WHEN 5 THEN 1048576 WHEN 6 THEN 1000000000 END AS BIGINT) AS bytes FROM part"""
)
def q10_capacity_parse(spark: SparkSession, d: str) -> DataFrame:
    units = F.array(*[F.lit(x) for x in ("", "B", " kB", "KiB", " mb", "MiB", "GB", "furlongs")])
    told = F.concat(F.col("p_size").cast("string"), F.element_at(units, (F.col("p_partkey") % 8 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", numbers.capacity_bytes(told).alias("bytes"))


@query(
    """SELECT o_orderkey, CAST(day(o_orderdate) + month(o_orderdate) * 256 + ((year(o_orderdate) - 1981) % 16) * 4096 + ((year(o_orderdate) - 1981) // 16) * 32 AS BIGINT) AS packed,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders"""
)
def q11_packed_date_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "orders").select("o_orderkey", dates.pack_date(F.col("o_orderdate").cast("date")).alias("packed"))
    return packed.withColumn("day", dates.unpack_date(F.col("packed")).cast("string"))


_ASCII_NAME = r"regexp_replace(text, '[^\x00-\x7F]', '~', 'g')"


@query(
    rf"""WITH a AS (SELECT doc_id, {_ASCII_NAME} AS t FROM documents)
  SELECT doc_id, regexp_replace(upper(t), '[^A-Z0-9$%&()+@^_-]', '', 'g') AS flat,
         substr(CASE WHEN regexp_replace(translate(t, '. :/', '____'), '[^\x21-\x7E]', '', 'g') = '' THEN 'UNNAMED'
                ELSE regexp_replace(translate(t, '. :/', '____'), '[^\x21-\x7E]', '', 'g') END, 1, 10) AS server FROM a"""
)
def q12_sanitise_names(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "~")
    return table(spark, d, "documents").select("doc_id", text.flat_name(ascii_only).alias("flat"), text.server_name(ascii_only).alias("server"))


@query(r"""SELECT doc_id, regexp_replace(translate(text, '`|', '??'), '[^\x00-\xFF]', '?', 'g') AS back, NOT regexp_matches(text, '[^\x00-\xFF]|[`|]') AS clean FROM documents""")
def q13_character_set(spark: SparkSession, d: str) -> DataFrame:
    back = text.decode_text(text.encode_text(F.col("text")))
    return table(spark, d, "documents").select("doc_id", back.alias("back"), text.can_encode(F.col("text")).alias("clean"))


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, CASE depth WHEN 0 THEN NULL WHEN 1 THEN path END AS flat FROM t")
def q14_flat_path_map(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_paths(bridge.tree(spark, d)).select("id", paths.to_flat(F.col("path")).alias("flat"))


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, name, ordinal FROM n WHERE parent_id = 'R1'")
def q15_iterdir(spark: SparkSession, d: str) -> DataFrame:
    return tree.children(bridge.tree(spark, d), F.lit("R1")).select("id", "name", "ordinal")


@query(
    f"""WITH RECURSIVE {bridge.SQL_TREE} SELECT path, depth, coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM n c WHERE c.parent_id = t.id AND c.is_dir), '') AS dirnames,
  coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM n c WHERE c.parent_id = t.id AND NOT c.is_dir), '') AS filenames FROM t WHERE is_dir"""
)
def q16_walk(spark: SparkSession, d: str) -> DataFrame:
    walked = tree.walk(bridge.tree(spark, d))
    return walked.select("path", F.col("depth").cast("long").alias("depth"), F.array_join("dirnames", ",").alias("dirnames"), F.array_join("filenames", ",").alias("filenames"))


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, path, depth FROM t")
def q17_tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_paths(bridge.tree(spark, d)).select("id", "path", F.col("depth").cast("long").alias("depth"))


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, path FROM t WHERE depth > 0 AND (regexp_full_match(upper(name), '.*I[AN].*') OR regexp_full_match(upper(path), '.*I[AN].*'))")
def q18_find_glob(spark: SparkSession, d: str) -> DataFrame:
    return tree.find(tree.tree_paths(bridge.tree(spark, d)), "*i[an]*").select("id", "path")


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, path FROM t WHERE depth = 2 AND path LIKE '$.ASIA.%' AND regexp_full_match(upper(name), '.....*')")
def q19_bulk_glob(spark: SparkSession, d: str) -> DataFrame:
    return tree.bulk_targets(tree.tree_paths(bridge.tree(spark, d)), "$.asia", "####*").select("id", "path")


@query(f"WITH RECURSIVE {bridge.SQL_TREE} SELECT id, path, -depth AS step FROM t")
def q20_post_order(spark: SparkSession, d: str) -> DataFrame:
    return tree.post_order(tree.tree_paths(bridge.tree(spark, d))).select("id", "path", F.col("step").cast("long").alias("step"))


@query(f"WITH {bridge.SQL_FREE} SELECT image_id, count(*) AS regions, CAST(sum(length) AS BIGINT) AS free_sectors, max(length) AS largest FROM f GROUP BY image_id")
def q22_free_summary(spark: SparkSession, d: str) -> DataFrame:
    return space.free_summary(q21_free_map(spark, d))


@query(f"WITH {bridge.SQL_FREE} SELECT image_id, min(start_sector) AS start_sector FROM f WHERE length >= 4 GROUP BY image_id")
def q23_first_fit(spark: SparkSession, d: str) -> DataFrame:
    return space.first_fit(q21_free_map(spark, d), F.lit(4))


@query(f"WITH {bridge.SQL_ENTRIES} SELECT image_id, CAST(800 - 2 - sum(sectors) AS BIGINT) AS free_sectors FROM e GROUP BY image_id")
def q24_free_sectors(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.entries(spark, d)
    return space.free_sectors(files, bridge.totals(files))


@query(
    f"""WITH {bridge.SQL_EXTENTS}, k AS (SELECT *, CASE WHEN lag(start + length) OVER (PARTITION BY object_id ORDER BY ordinal) = start THEN 0 ELSE 1 END AS fresh FROM x),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY object_id ORDER BY ordinal) AS run FROM k)
  SELECT object_id, CAST(run AS BIGINT) AS run, min_by(start, ordinal) AS start, CAST(sum(length) AS BIGINT) AS length FROM i GROUP BY object_id, run"""
)
def q25_extent_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return space.coalesce_extents(bridge.extents(spark, d)).withColumn("run", F.col("run").cast("long"))


@query(
    f"""WITH {bridge.SQL_EXTENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY object_id) AS c FROM x)
  SELECT object_id, ordinal, CAST(floor(i / 3.0) AS BIGINT) AS block_no, i % 3 AS slot, floor(i / 3.0) = floor((c - 1) / 3.0) AS is_last FROM r"""
)
def q26_map_block_chunks(spark: SparkSession, d: str) -> DataFrame:
    return space.map_blocks(bridge.extents(spark, d), 3).select("object_id", "ordinal", "block_no", "slot", "is_last")


@query(
    f"""WITH {bridge.SQL_EXTENTS}, o AS (SELECT object_id, CAST(sum(length) AS BIGINT) AS sectors, object_id % 256 AS last FROM x GROUP BY object_id)
  SELECT object_id, CASE WHEN last = 0 THEN sectors * 256 ELSE (sectors - 1) * 256 + last END AS bytes FROM o"""
)
def q27_object_size(spark: SparkSession, d: str) -> DataFrame:
    sums = bridge.extents(spark, d).groupBy("object_id").agg(F.sum("length").alias("sectors"))
    return sums.select("object_id", numbers.object_bytes(F.col("sectors"), F.col("object_id") % 256).alias("bytes"))


@query(
    f"""WITH {bridge.SQL_EXTENTS}, q AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY object_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM x),
  w AS (SELECT o_orderkey AS object_id, (o_orderkey * 977) % 40000 AS "offset" FROM orders)
  SELECT q.object_id, w."offset", CAST(start + floor(w."offset" / 256.0) - low AS BIGINT) AS sector FROM w JOIN q ON w.object_id = q.object_id
  WHERE floor(w."offset" / 256.0) >= low AND floor(w."offset" / 256.0) < low + length"""
)
def q28_offset_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), ((F.col("o_orderkey") * 977) % 40000).alias("offset"))
    return space.locate_offsets(bridge.extents(spark, d), wanted).withColumn("sector", F.col("sector").cast("long"))


@query(
    f"""WITH {bridge.SQL_ENTRIES}, k AS (SELECT * FROM e WHERE image_id NOT IN (SELECT image_id FROM e WHERE p_partkey % 49 = 0))
  SELECT image_id, ordinal, CAST(2 + coalesce(sum(sectors) OVER (PARTITION BY image_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM k"""
)
def q29_compaction_layout(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.entries(spark, d).withColumn("locked", F.col("p_partkey") % 49 == 0)
    return space.compaction_layout(files).select("image_id", "ordinal", "new_start")


@query(
    f"""WITH {bridge.SQL_FREE}, c AS (SELECT image_id, i, CAST(floor(i * 800 / 64.0) AS BIGINT) AS lo, CAST(floor((i + 1) * 800 / 64.0) AS BIGINT) AS hi FROM (SELECT DISTINCT image_id FROM e), range(64) r(i))
  SELECT image_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.image_id = c.image_id AND f.start_sector < c.hi AND f.start_sector + f.length > c.lo) THEN '.' ELSE '#' END, '' ORDER BY i) AS bar FROM c GROUP BY image_id"""
)
def q30_usage_bar(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.entries(spark, d)
    return space.usage_bar(space.free_map(files, bridge.totals(files)), bridge.totals(files))


@query(f"WITH {_MEMBERS} SELECT archive, 'd/F' || k AS target, 'd/F' || k || '.inf' AS sidecar, 'inf-trad' AS source FROM m WHERE r = 4")
def q31_inf_join(spark: SparkSession, d: str) -> DataFrame:
    return sources.pair_sidecars(bridge.members(spark, d)).select("archive", "target", "sidecar", "source")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return sources.resolve_members(bridge.members(spark, d).withColumn("extra_meta", F.lit(None).cast(metadata.META)))


_RESOLVED = f"""{_MEMBERS}, z AS (SELECT archive, k * 2 AS ordinal, 'd/F' || k AS filename, CASE WHEN r < 3 THEN 'filename' WHEN r = 4 THEN 'inf-trad' END AS source,
  CAST(CASE r WHEN 0 THEN 4293918720 + (k % 4096) * 256 WHEN 1 THEN a WHEN 2 THEN k WHEN 4 THEN 4294966016 END AS BIGINT) AS load FROM m)"""


@query(f"WITH {_RESOLVED} SELECT * FROM z")
def q32_meta_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("archive", "ordinal", "filename", "source", "meta.load")


@query(
    f"""WITH {_RESOLVED} SELECT archive, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_dirs, CAST(0 AS BIGINT) AS n_sparkfs, count(*) FILTER (source = 'inf-trad') AS n_inf_trad,
  CAST(0 AS BIGINT) AS n_inf_pieb, count(*) FILTER (source = 'filename') AS n_filename, count(*) FILTER (source IS NULL) AS n_plain FROM z GROUP BY archive"""
)
def q33_archive_summary(spark: SparkSession, d: str) -> DataFrame:
    return sources.summarise(_resolved(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select(F.concat(F.lit("$."), F.col("c_mktsegment"), F.lit(".U"), F.col("c_custkey").cast("string")).alias("path"), "c_custkey", (F.col("c_custkey") % 9).alias("value"))
    source = c.where("c_custkey % 2 = 0").select("path", "value")
    return source, c.where("c_custkey % 3 <> 0").select("path", (F.col("value") % 7).alias("value"))


_SIDES = """
c AS (SELECT '$.' || c_mktsegment || '.U' || c_custkey AS path, c_custkey, c_custkey % 9 AS value FROM customer),
a AS (SELECT path, value FROM c WHERE c_custkey % 2 = 0), b AS (SELECT path, value % 7 AS value FROM c WHERE c_custkey % 3 <> 0)"""


@query(f"WITH {_SIDES} SELECT path FROM a WHERE path IN (SELECT path FROM b)")
def q34_merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.conflicts(*_sides(spark, d), ["path"]).select("path")


@query(f"WITH {_SIDES} SELECT * FROM b UNION ALL SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)")
def q35_merge_skip(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.merge(*_sides(spark, d), ["path"], "skip")


@query(f"WITH {_SIDES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE path NOT IN (SELECT path FROM a)")
def q36_merge_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.merge(*_sides(spark, d), ["path"], "overwrite")


@query(
    f"""WITH {_SIDES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.value <> b.value"""
)
def q37_diff(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.diff(*_sides(spark, d), ["path"], "value")


@query(
    f"""WITH {bridge.SQL_USERS}, h AS (SELECT slot, row_number() OVER (ORDER BY slot) AS n FROM u WHERE NOT in_use),
  w AS (SELECT 'V' || s_suppkey AS name, row_number() OVER (ORDER BY 'V' || s_suppkey) AS n FROM supplier)
  SELECT coalesce(h.slot, (SELECT max(slot) FROM u) + w.n - (SELECT count(*) FROM h)) AS slot, name FROM w LEFT JOIN h ON w.n = h.n
  UNION ALL SELECT slot, name FROM u WHERE in_use"""
)
def q38_user_admin(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "supplier").select(F.lit(0).cast("long").alias("image_id"), F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(0).cast("long").alias("free_space"))
    return users.active(users.add_users(bridge.users(spark, d), new)).select("slot", "name")


@query(
    f"""WITH {bridge.SQL_USERS}, {bridge.SQL_WRITES} SELECT c."user", seq, cost, CAST(free_space - sum(cost) OVER (PARTITION BY c."user" ORDER BY seq) AS BIGINT) AS balance FROM c JOIN u ON u.name = c."user" """
)
def q38b_quota_balance(spark: SparkSession, d: str) -> DataFrame:
    owners = bridge.users(spark, d).withColumnRenamed("name", "user")
    return users.balances(owners, bridge.writes(spark, d)).select("user", "seq", "cost", "balance")


@query(
    f"""WITH RECURSIVE {bridge.SQL_USERS}, {bridge.SQL_WRITES}, o AS (SELECT c.*, u.free_space, row_number() OVER (PARTITION BY c."user" ORDER BY seq) AS n FROM c JOIN u ON u.name = c."user"),
  r AS (SELECT "user", seq, n, cost, cost <= free_space AS accepted, CASE WHEN cost <= free_space THEN free_space - cost ELSE free_space END AS balance FROM o WHERE n = 1
    UNION ALL SELECT o."user", o.seq, o.n, o.cost, o.cost <= r.balance, CASE WHEN o.cost <= r.balance THEN r.balance - o.cost ELSE r.balance END FROM o JOIN r ON o."user" = r."user" AND o.n = r.n + 1)
  SELECT "user", seq, cost, accepted, balance FROM r"""
)
def q38c_quota_accept(spark: SparkSession, d: str) -> DataFrame:
    owners = bridge.users(spark, d).select(F.col("name").alias("user"), (F.col("free_space") * 100).alias("free_space"))
    return users.accepted_writes(owners, bridge.writes(spark, d))


ORACLE_SQL["q38c_quota_accept"] = ORACLE_SQL["q38c_quota_accept"].replace("u.free_space, row_number()", "u.free_space * 100 AS free_space, row_number()")


@query(
    f"""WITH {bridge.SQL_BAD}, y AS (SELECT image_id, ordinal, path, unnest(range(start_sector, start_sector + sectors)) AS sector FROM x),
  z AS (SELECT *, first_value(path) OVER w AS first_path, row_number() OVER w AS n FROM y WINDOW w AS (PARTITION BY image_id, sector ORDER BY ordinal))
  SELECT image_id, sector, first_path, path FROM z WHERE n > 1"""
)
def q39_sector_collisions(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.sector_collisions(bridge.bad_entries(spark, d))


@query(f"WITH {bridge.SQL_BAD} SELECT image_id, upper(path) AS path, count(*) AS copies FROM x GROUP BY ALL HAVING count(*) > 1")
def q40_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.duplicate_names(bridge.bad_entries(spark, d))


@query(f"WITH {bridge.SQL_BAD} SELECT image_id, path, start_sector + sectors AS end_sector, CAST(300 AS BIGINT) AS total_sectors FROM x WHERE start_sector + sectors > 300")
def q41_out_of_bounds(spark: SparkSession, d: str) -> DataFrame:
    bad = bridge.bad_entries(spark, d)
    return catalogue.beyond_end(bad, bridge.totals(bad, 300))


@query(
    """WITH d AS (SELECT s_suppkey AS image_id, 40 + s_suppkey % 120 AS cylinders, CAST(16 AS BIGINT) AS spc, (s_suppkey * 37) % 1500 AS tail_free, s_suppkey % 6 AS m,
      CAST(CASE s_suppkey % 6 WHEN 1 THEN s_suppkey % 30 WHEN 2 THEN s_suppkey % 700 WHEN 3 THEN s_suppkey * 4096 % 200000 WHEN 4 THEN (s_suppkey % 90) / 100.0 ELSE 0 END AS DOUBLE) AS amount FROM supplier),
  w AS (SELECT *, CAST(CASE m WHEN 0 THEN floor(tail_free / 16.0) WHEN 1 THEN amount WHEN 2 THEN ceil(amount / 16.0) WHEN 3 THEN ceil(ceil(amount / 256.0) / 16.0)
      WHEN 4 THEN ceil(cylinders * amount) ELSE floor(tail_free / 16.0) END AS BIGINT) AS wanted FROM d),
  c AS (SELECT *, CASE WHEN wanted < 1 THEN 'empty' WHEN wanted > cylinders - 1 THEN 'no-room' WHEN wanted > floor(tail_free / 16.0) THEN 'not-compacted' END AS code FROM w)
  SELECT image_id, code, CASE WHEN code IS NULL THEN wanted END AS partition_cylinders, CASE WHEN code IS NULL THEN CAST((cylinders - wanted) * 16 AS BIGINT) END AS start_sector FROM c"""
)
def q42_partition_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    amount = F.when(k % 6 == 1, k % 30).when(k % 6 == 2, k % 700).when(k % 6 == 3, k * 4096 % 200000).when(k % 6 == 4, (k % 90) / 100.0).otherwise(0)
    mode = F.element_at(F.array(*[F.lit(x) for x in ("max", "cylinders", "sectors", "bytes", "ratio", "existing_free")]), (k % 6 + 1).cast("int"))
    discs = table(spark, d, "supplier").select(k.alias("image_id"), (k % 120 + 40).alias("cylinders"), F.lit(16).cast("long").alias("sectors_per_cylinder"), (k * 37 % 1500).alias("tail_free"), mode.alias("mode"), amount.cast("double").alias("amount"))
    return partition.plan_partition(discs, F.col("mode"), F.col("amount")).select("image_id", "code", "partition_cylinders", "start_sector")


@query(
    """WITH c AS (SELECT s_nationkey AS image_id, s_suppkey AS cylinder, (s_suppkey * 7919) % 13 AS free FROM supplier)
  SELECT CAST(image_id AS BIGINT) AS image_id, max(free) AS free, min(cylinder) FILTER (free = m) AS cylinder FROM (SELECT *, max(free) OVER (PARTITION BY image_id) AS m FROM c WHERE free > 0) GROUP BY image_id"""
)
def q43_best_cylinder(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return space.best_cylinder(table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("image_id"), k.alias("cylinder"), (k * 7919 % 13).alias("free")))


@query(
    """WITH h AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m FROM orders WHERE o_orderkey IS NOT NULL),
  y AS (SELECT o_orderkey, list_transform(range(16), lambda i: CAST(('0x' || substr(m, CAST(i * 2 + 1 AS INT), 2)) AS INT)) AS b FROM h)
  SELECT o_orderkey, CAST(list_reduce(list_concat([0], list_reverse(b)), lambda t, v: t % 256 + t // 256 + v) % 256 AS BIGINT) AS checksum FROM y"""
)
def q44_checksum_fold(spark: SparkSession, d: str) -> DataFrame:
    data = F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    return table(spark, d, "orders").select("o_orderkey", space.old_map_checksum(data, 16).cast("long").alias("checksum"))
