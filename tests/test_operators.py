"""Operators against brute force on small discs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from platterlake.operators import catalogue, copying, metadata, partition, space, tree, users


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def discs(seed, n=6, total=60):
    rng = random.Random(seed)
    out = []
    for image in range(n):
        for k in range(rng.randrange(0, 8)):
            start = rng.randrange(2, total - 4)
            out.append((image, k, f"$.F{rng.randrange(5)}", start, rng.randrange(0, 5), bool(rng.randrange(2))))
    return out


SCHEMA = "image_id long, ordinal long, path string, start_sector long, sectors long, locked boolean"


@pytest.mark.parametrize("seed", range(4))
def test_free_map_collisions_and_bounds(spark, seed):
    made = discs(seed)
    entries = spark.createDataFrame(made, SCHEMA)
    totals = spark.createDataFrame([(i, 60) for i in range(6)], "image_id long, total_sectors long")
    expected, claims = [], []
    for image in range(6):
        used = {0, 1}
        owner: dict[int, str] = {}
        for _, _, path, start, n, _ in (r for r in made if r[0] == image):
            for s in range(start, start + n):
                used.add(s)
                if s in owner:
                    claims.append((image, s, owner[s], path))
                owner.setdefault(s, path)
        free = [s for s in range(60) if s not in used]
        for s in free:
            if s - 1 not in free:
                n = 1
                while s + n in free:
                    n += 1
                expected.append((image, s, n))
    assert rows(space.free_map(entries, totals)) == sorted(expected)
    assert rows(catalogue.sector_collisions(entries)) == sorted(claims)
    beyond = [(i, p, s + n, 60) for i, _, p, s, n, _ in made if s + n > 60]
    assert rows(catalogue.beyond_end(entries, totals)) == sorted(beyond)


def test_merge_free_joins_neighbours(spark):
    free = spark.createDataFrame([(1, 10, 5), (1, 20, 2)], "image_id long, start_sector long, length long")
    freed = spark.createDataFrame([(1, 15, 5), (1, 40, 1)], "image_id long, start_sector long, length long")
    assert rows(space.merge_free(free, freed)) == [(1, 10, 12), (1, 40, 1)]


def test_allocate_takes_the_freest_cylinder_first(spark):
    runs = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 17, 2), (1, 1, 20, 4), (2, 0, 1, 1)], "image_id long, cylinder long, start long, length long")
    assert rows(space.allocate(runs, 7)) == [(1, 1, 1, 17, 2), (1, 2, 1, 20, 4), (1, 3, 0, 1, 1)]


def test_bitmaps(spark):
    made = spark.createDataFrame([(1, b"\xff\x0f", 16), (1, b"\xff\xff", 12), (1, b"\x00\x00", 16)], "image_id long, bitmap binary, sectors int")
    assert [r["free"] for r in space.bitmap_free(made).collect()] == [12, 12, 0]


def test_checksum_carries(spark):
    data = bytes((7 * k * k + 250) % 256 for k in range(256))
    total, carry = 0, 0
    for b in reversed(data[:255]):
        total += b + carry
        carry, total = total > 255, total % 256
    got = spark.createDataFrame([(data,)], "b binary").select(space.old_map_checksum(F.col("b"))).first()[0]
    assert got == total


NODES = [("$", None, "$", 0, True), ("a", "$", "A", 0, True), ("b", "$", "B", 1, False), ("c", "a", "C", 0, True), ("d", "c", "D", 0, False), ("x", "gone", "X", 0, False)]


def nodes(spark):
    return spark.createDataFrame([(1, *n) for n in NODES], "image_id long, id string, parent_id string, name string, ordinal long, is_dir boolean")


def test_tree(spark):
    placed = tree.tree_paths(nodes(spark))
    assert rows(placed.where("path is not null"), "id", "path", "depth") == [("$", "$", 0), ("a", "$.A", 1), ("b", "$.B", 1), ("c", "$.A.C", 2), ("d", "$.A.C.D", 3)]
    order = [r["id"] for r in placed.where("path is not null").orderBy("place").collect()]
    assert order == ["$", "a", "c", "d", "b"]
    walked = rows(tree.walk(nodes(spark)).where("path is not null"), "path", "dirnames", "filenames")
    assert walked == [("$", ["A"], ["B"]), ("$.A", ["C"], []), ("$.A.C", [], ["D"])]
    assert rows(tree.find(placed.where("path is not null"), "*c*"), "id") == [("c",), ("d",)]
    banned = spark.createDataFrame([("c",)], "name string")
    assert rows(tree.without_subtrees(placed.where("path is not null"), banned), "id") == [("$",), ("a",), ("b",)]
    lines = dict(tree.glyph_lines(nodes(spark).where("id <> 'x'")).select("id", "line").collect())
    assert lines == {"$": "$", "a": "├── A", "b": "└── B", "c": "│   └── C", "d": "│       └── D"}


def entries(spark):
    made = [(1, 0, "$.A", False), (1, 1, "$.B", True), (1, 2, "$.a", False), (2, 0, "$.A", False)]
    return spark.createDataFrame(made, "image_id long, ordinal long, path string, locked boolean")


def test_mutations(spark):
    left, issues = catalogue.delete(entries(spark), "$.?")
    assert rows(left, "path") == [("$.B",)] and rows(issues, "code", "path") == [("locked", "$.B")]
    assert rows(catalogue.delete(entries(spark), "$.?", force=True)[0]) == []
    wanted = spark.createDataFrame([(1, "$.a")], "image_id long, path string")
    assert rows(catalogue.lookup(entries(spark), wanted), "ordinal", "path") == [(0, "$.A")]
    new = spark.createDataFrame([(1, 9, "$.a", False)], "image_id long, ordinal long, path string, locked boolean")
    assert rows(catalogue.upsert(entries(spark), new), "image_id", "path") == [(1, "$.B"), (1, "$.a"), (2, "$.A")]
    moves = spark.createDataFrame([(2, "$.A", "$.C"), (1, "$.B", "$.A")], "image_id long, path string, new_path string")
    moved, refused = catalogue.rename(entries(spark), moves)
    assert rows(moved.where("image_id = 2"), "path") == [("$.C",)] and rows(refused, "code", "path") == [("exists", "$.A")]


def test_validate_and_conflicts(spark):
    made = spark.createDataFrame([(1, 0, "$.A", 2, 3), (1, 1, "$.a", 4, 10)], "image_id long, ordinal long, path string, start_sector long, sectors long")
    totals = spark.createDataFrame([(1, 10)], "image_id long, total_sectors long")
    assert [r[0] for r in rows(catalogue.validate(made, totals), "code")] == ["beyond-end", "duplicate-name", "sector-collision"]
    many = spark.range(8).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("p"))
    assert tuple(catalogue.conflict_summary(many, F.col("p")).first()) == (8, ["P0", "P1", "P2", "P3", "P4"], 3)


def test_resolve_members_prefers_extra_then_sidecar_then_name(spark):
    made = [("z", 0, "D/", 0, None, None), ("z", 1, "D.inf", 1, "D 1 2 00000003", None), ("z", 2, "F,fff", 1, None, None), ("z", 3, "F,fff.inf", 1, "F 1900 8023 00000001 33", None), ("z", 4, "G,ffb", 1, None, (1, 2, 3, None)), ("z", 5, "bad.inf", 1, "nothing here", None)]
    schema = "archive string, ordinal int, filename string, file_size long, content string, extra_meta struct<load: bigint, exec: bigint, attr: bigint, filetype: bigint>"
    got = rows(metadata.resolve_members(spark.createDataFrame(made, schema)), "ordinal", "filename", "source", "meta.load")
    assert got == [(0, "D/", "inf-trad", 1), (2, "F", "inf-trad", 0x1900), (4, "G", "sparkfs", 1), (5, "bad.inf", None, None)]


def test_users_and_specs(spark):
    table = spark.createDataFrame([(1, 0, "Syst", True), (1, 1, "Old", False), (1, 2, "Ann", True)], "image_id long, slot long, name string, in_use boolean")
    new = spark.createDataFrame([(1, "ANN"), (1, "Bob"), (1, "Cy")], "image_id long, name string")
    assert rows(users.active(users.add_users(table, new)), "slot", "name") == [(0, "Syst"), (1, "Bob"), (2, "Ann"), (3, "Cy")]
    gone = spark.createDataFrame([(1, "ann")], "image_id long, name string")
    assert rows(users.active(users.remove_users(table, gone)), "name") == [("Syst",)]
    specs = users.parse_specs(spark.createDataFrame([("Ann:40kB",), ("Root:s:1MB",), ("Boot",)], "spec string"))
    assert rows(specs) == [("Ann", False, 40000), ("Boot", False, None), ("Root", True, 1000000)]
    both, issues = users.with_built_ins(spark, specs, omit=("Welcome",))
    assert rows(both, "name") == [("Ann",), ("Boot",), ("Root",), ("Syst",)] and rows(issues) == []


def test_partition_plan(spark):
    made = spark.createDataFrame([(1, 80, 16, 320, "cylinders", 10.0), (2, 80, 16, 320, "max", 0.0), (3, 80, 16, 320, "ratio", 0.5), (4, 80, 16, 10, "max", 0.0), (5, 80, 16, 320, "cylinders", 80.0)], "image_id long, cylinders long, sectors_per_cylinder long, tail_free long, mode string, amount double")
    plan = partition.plan_partition(made, F.col("mode"), F.col("amount"))
    assert rows(plan, "image_id", "code", "partition_cylinders", "start_sector") == [(1, None, 10, 1120), (2, None, 20, 960), (3, "not-compacted", None, None), (4, "empty", None, None), (5, "no-room", None, None)]
    free = spark.createDataFrame([(1, 100, 1180), (1, 1200, 5)], "image_id long, start_sector long, length long")
    assert rows(partition.clip_free(free, plan), "start_sector", "length") == [(100, 1020)]


def test_first_fit_in_sequence(spark):
    free = spark.createDataFrame([(1, 10, 4), (1, 20, 10), (2, 5, 1)], "image_id long, start_sector long, length long")
    asked = spark.createDataFrame([(1, 1, 3), (1, 2, 6), (1, 3, 1), (1, 4, 5), (2, 1, 2), (3, 1, 1)], "image_id long, seq long, need long")
    got = rows(copying.first_fit_sequence(free, asked), "image_id", "seq", "start")
    assert got == [(1, 1, 10), (1, 2, 20), (1, 3, 13), (1, 4, None), (2, 1, None), (3, 1, None)]


def test_scopes_and_emplaced_libraries(spark):
    scoped = spark.createDataFrame([("afs:$.F",), ("$.F",)], "p string").select(copying.scope(F.col("p")).alias("s")).select("s.*").collect()
    assert [tuple(s) for s in scoped] == [("afs", "$.F"), (None, "$.F")]
    placed = tree.tree_paths(nodes(spark)).where("path is not null")
    target = spark.createDataFrame([(1, "$.lib.b")], "image_id long, path string")
    assert rows(copying.emplace(placed, target, "LIB"), "path", "replaced") == [("$.LIB.B", True)]
    assert rows(catalogue.track_overlaps(spark.createDataFrame([(1, 0, 5), (1, 4, 6), (1, 6, 7)], "image_id long, start long, end long")), "start") == [(0,)]


def test_paths_of_any_depth_and_cycles(spark):
    chain = [(1, f"n{k}", f"n{k - 1}" if k else None, f"d{k}", 0, True) for k in range(80)] + [(2, "a", "b", "a", 0, True), (2, "b", "a", "b", 0, True), (3, "r", None, "$", 0, True)]
    placed = tree.tree_paths(spark.createDataFrame(chain, "image_id long, id string, parent_id string, name string, ordinal int, is_dir boolean")).collect()
    depths = {r["id"]: (r["depth"], r["path"]) for r in placed}
    assert depths["n79"] == (79, ".".join(f"d{k}" for k in range(80))) and depths["r"] == (0, "$")
    assert depths["a"][1] is None and depths["b"][1] is None


def test_writes_are_folded_in_order(spark):
    """Against plain code: refused writes cost nothing, whatever the number of writes."""
    rng = random.Random(1)
    left = {f"u{k}": rng.randrange(5_000, 60_000) for k in range(7)}
    asked = [(rng.choice([*left, "nobody"]), k, rng.randrange(0, 9_000)) for k in range(400)]
    expected, now = [], dict(left)
    for u, seq, size in asked:
        if u in now:
            data = -(-size // 256)
            cost = (data + -(-data // 48)) * 256
            now[u] -= cost if cost <= now[u] else 0
            expected.append((u, seq, cost, now[u]))
    got = users.accepted_writes(spark.createDataFrame(list(left.items()), "user string, free_space long"), spark.createDataFrame(asked, "user string, seq long, bytes long")).collect()
    assert sorted((r["user"], r["seq"], r["cost"], r["balance"]) for r in got) == sorted(expected)
    assert any(not r["accepted"] for r in got) and any(r["accepted"] for r in got)


def test_map_checksum_equals_the_byte_by_byte_sum(spark):
    rng = random.Random(2)
    blocks = [bytes(rng.randrange(256) for _ in range(256)) for _ in range(60)] + [bytes(256), b"\xff" * 256, b"\x01" + bytes(255), bytes(254) + b"\xff\x00", bytes(100) + b"\xff\xff" + bytes(154)]
    expected = []
    for block in blocks:
        total = 0
        for k in range(254, -1, -1):
            total = total % 256 + total // 256 + block[k]
        expected.append(total % 256)
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b binary")
    got = [r["c"] for r in df.select("i", space.old_map_checksum(F.col("b")).alias("c")).orderBy("i").collect()]
    assert got == expected
    assert [r["c"] for r in df.select("i", space.old_map_checksum(F.col("b").substr(F.lit(1), F.lit(255))).alias("c")).orderBy("i").collect()] == expected


def test_map_checksum_reads_each_byte_once(spark):
    rng = random.Random(3)
    blocks = [bytes(rng.randrange(256) for _ in range(16)) for _ in range(50)] + [bytes(16), b"\xff" * 16, b"\x05" + bytes(15)]
    got = spark.createDataFrame([(b,) for b in blocks], "b binary").select("b", space.old_map_checksum(F.col("b"), 16).alias("c"))
    for b, c in got.collect():
        total = 0
        for x in reversed(b):
            total = total % 256 + total // 256 + x
        assert c == total % 256
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("conv(") == 4  # 15 bytes in parts of 7, and the first
