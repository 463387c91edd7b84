"""Images: layouts, damaged structures, patches and exports."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from platterlake.sinks.export import with_metadata, write_report
from platterlake.sinks.images import patched, write_files
from platterlake.plans.fixtures import build_partition, server_images
from platterlake.sources import adfs, afs, archives, dfs, hosts
from platterlake.sources.images import byte_slice, expanded, filing_system, in_file_order, in_linear_order, parse_geometry, surfaces, with_layout


def image_rows(spark, rows):
    return spark.createDataFrame(rows, "image_id string, path string, length long, content binary")


def flat_catalogue(title=b"TEST", files=(), total=400):
    s0, s1 = bytearray(256), bytearray(256)
    s0[: len(title)] = title
    s1[5] = len(files) * 8
    s1[6], s1[7] = 0x20 | total >> 8, total & 0xFF
    for i, (name, letter, load, length, start) in enumerate(files):
        at = 8 + 8 * i
        s0[at : at + 7] = name.ljust(7)
        s0[at + 7] = letter
        s1[at : at + 2] = (load & 0xFFFF).to_bytes(2, "little")
        s1[at + 4 : at + 6] = (length & 0xFFFF).to_bytes(2, "little")
        s1[at + 6] = (load >> 16 & 3) << 2 | (length >> 16 & 3) << 4 | start >> 8
        s1[at + 7] = start & 0xFF
    return bytes(s0 + s1)


def test_layouts_and_padding(spark):
    rows = [("a", "x.ssd", 102400, b""), ("b", "x.dsd", 204800, b""), ("c", "x.adl", 655360, b""), ("d", "x.bin", 5, b""), ("e", "y.ssd", 1000, b"")]
    got = {r["image_id"]: r for r in with_layout(image_rows(spark, rows)).collect()}
    assert [got[k]["tracks"] for k in "abc"] == [40, 40, 80] and [got[k]["sides"] for k in "abc"] == [1, 2, 2]
    assert got["d"]["code"] == "unknown-extension" and got["e"]["code"] == "not-whole-sectors"
    short = image_rows(spark, [("a", "x.dsd", 512, b"\x01" * 512)])
    full = expanded(with_layout(short)).first()
    assert len(full["content"]) == 204800 and full["added"] == 204800 - 512
    assert spark.createDataFrame([("a.DAT",), ("b.txt",)], "p string").select(filing_system(F.col("p"))).collect() == [("adfs",), (None,)]


def test_interleaved_sides_are_read_track_by_track(spark):
    data = bytes(range(256)) * 11
    track = 2560
    image = bytearray(204800)
    head = flat_catalogue(files=[(b"BIG", ord("$") | 0x80, 0x31900, len(data), 5)])
    image[track : track + 512] = head  # side 1 begins with the second track of the file
    first = 5 * 256
    image[track + 5 * 256 : 2 * track] = data[:first]
    image[3 * track : 3 * track + len(data) - first] = data[first:]
    image[:512] = flat_catalogue(b"ZERO")
    catalogued = dfs.identify(surfaces(with_layout(image_rows(spark, [("i", "i.dsd", len(image), bytes(image))]))))
    info = {r["side"]: r["title"].rstrip("\0") for r in dfs.disc_info(catalogued).collect()}
    assert info == {0: "ZERO", 1: "TEST"}
    (entry,) = dfs.entries(catalogued, with_data=True).collect()
    assert (entry["path"], entry["locked"], entry["load"], entry["length"], bytes(entry["data"])) == ("$.BIG", True, 0x31900, len(data), data)


def test_double_catalogues(spark):
    first, second = flat_catalogue(files=[(b"A", ord("$"), 0, 10, 4)]), bytearray(flat_catalogue(files=[(b"B", ord("X"), 0, 0, 5)]))
    second[:8] = b"\xaa" * 8
    second[0:12] = b"\xaa" * 12
    second[8:16] = b"\xaa" * 4 + bytes(second[12:16])
    second[256:260] = bytes(4)
    catalogued = dfs.identify(surfaces(with_layout(image_rows(spark, [("w", "w.ssd", 102400, (first + bytes(second)).ljust(102400, b"\0")), ("z", "z.ssd", 102400, bytes(102400))]))))
    kinds = {r["image_id"]: r["catalogue"] for r in catalogued.collect()}
    assert kinds == {"w": "double", "z": None}
    assert dfs.disc_info(catalogued).first()["num_files"] == 2
    assert dfs.marker_issues(catalogued).collect() == []


def test_broken_server_structures_become_issues(spark):
    content, root = build_partition([("A", 1, 2, 0x0C, 0xD828, b"hello"), ("B", 1, 2, 0x0C, 0xD828, b"")])
    assert [e["path"] for e in afs.walk_tree(content, root)] == ["$.A", "$.B"]
    cut = content[: (root + 1) * 256 - 1] + b"\x07"
    assert [e["issue"] for e in afs.walk_tree(cut, root)] == ["broken-map"]
    assert afs.read_chain(content, 10**6)[2] == "broken-map"
    files = spark.createDataFrame([(1, "A", 1, 2, 12, 0xD828, b"x" * 40000)], "image_id long, name string, load long, exec long, access int, packed_date int, data binary")
    images = server_images(files)
    found = afs.object_bytes(images, afs.objects(images)).first()
    assert bytes(found["data"]) == b"x" * 40000 and len(found["extents"]) == 79


def test_users_table(spark):
    row = b"GRP.ANN\r".ljust(20, b"\0") + b"PW\r\0\0\0" + (12345).to_bytes(4, "little") + bytes([0x80 | 0x40 | 2])
    got = afs.users(spark.createDataFrame([("i", row + row[:10])], "image_id string, data binary")).collect()
    assert len(got) == 1
    assert tuple(got[0])[1:] == (0, "GRP", "ANN", "GRP.ANN", "PW", 12345, True, True, False, 2)


def test_archives_that_cannot_be_read(spark):
    got = archives.members(spark.createDataFrame([("bad.zip", b"no zip")], "archive string, content binary")).first()
    assert got["issue"] == "BadZipFile" and got["filename"] is None
    names = spark.createDataFrame([("../../etc/x",), ("/a/b",), ("..",)], "f string").select(archives.safe_path(F.col("f"))).collect()
    assert [n[0] for n in names] == ["etc/x", "a/b", "_"]


def test_patches_and_geometry(spark):
    images = spark.createDataFrame([("a", bytes(1024)), ("b", bytes(512))], "image_id string, content binary")
    patches = spark.createDataFrame([("a", 1, b"\x01" * 256), ("a", 3, b"\x03" * 256)], "image_id string, lba long, data binary")
    got = {r["image_id"]: bytes(r["content"]) for r in patched(images, patches).collect()}
    assert got["a"] == bytes(256) + b"\x01" * 256 + bytes(256) + b"\x03" * 256 and got["b"] == bytes(512)
    dsc = bytes(13) + b"\x01\x02\x04".ljust(9, b"\0")
    geometry = spark.createDataFrame([(dsc,), (b"",)], "c binary").select(parse_geometry(F.col("c")).alias("g")).collect()
    assert tuple(geometry[0]["g"])[:3] == (258, 4, 33) and geometry[1]["g"] is None


def test_export_writes_sidecars(spark, tmp_path):
    files = spark.createDataFrame([("d/F", "F", 0x1900, 0x8023, 2, 3, b"hi"), ("d/G", "G", None, None, 1, None, b"x")], "path string, name string, load long, exec long, length long, attr long, data binary")
    write_files(with_metadata(files), str(tmp_path))
    assert sorted(os.listdir(tmp_path / "d")) == ["F", "F.inf", "G"]
    assert (tmp_path / "d/F.inf").read_text() == "F           00001900 00008023 00000002 03\n"
    named = {r["path"] for r in with_metadata(files, "filename-mos").collect()}
    assert named == {"d/F,1900-8023", "d/G"}


# --- hierarchical images made byte by byte, without the library's sinks -----------------------------------------


def hierarchical(total, files, linear=True):
    """Content of a disc in linear order: free map, root at sector 2, directories and files given by (path, data or None) behind it."""
    content = bytearray(total * 256)
    content[0xFC:0xFF] = total.to_bytes(3, "little")
    free, dirs, at = 7, {"$": (2, "$", 2)}, 7
    listed = {"$": []}
    for path, data in files:
        parent, _, name = path.rpartition(".")
        if data is None:
            dirs[path] = (at, name, dirs[parent][0])
            listed[path] = []
            size, sectors = 1280, 5
        else:
            size, sectors = len(data), -(-len(data) // 256)
            content[at * 256 : at * 256 + size] = data
        listed[parent].append((name, data is None, size, at))
        at += sectors
    for path, (sector, name, parent) in dirs.items():
        block = bytearray(1280)
        block[0], block[1:5] = 9, b"Hugo"
        for k, (entry, is_dir, size, start) in enumerate(sorted(listed[path])):
            row = bytearray(entry.encode().ljust(10, b"\r"))
            row[0] |= 0x80  # readable
            row[3] |= 0x80 * is_dir
            row += (0x1900).to_bytes(4, "little") + (0x8023).to_bytes(4, "little") + size.to_bytes(4, "little") + start.to_bytes(3, "little") + b"\x05"
            block[5 + 26 * k : 31 + 26 * k] = row
        block[0x4CC:0x4D6] = name.encode().ljust(10, b"\r")
        block[0x4D6:0x4D9] = parent.to_bytes(3, "little")
        block[0x4FA], block[0x4FB:0x4FF] = 9, b"Hugo"
        content[sector * 256 : sector * 256 + 1280] = block
    assert free and at <= total
    return bytes(content)


def in_turn(linear):
    """Side 0 and side 1, a track of each in turn, as a two-sided floppy's file holds them."""
    half, track = len(linear) // 2, 4096
    return b"".join(linear[side * half + t * track : side * half + (t + 1) * track] for t in range(80) for side in range(2))


def test_hierarchical_images_of_every_size(spark):
    big = bytes(range(256)) * 1400  # reaches over the end of side 0 of the largest floppy
    files = [("$.Dir", None), ("$.Dir.Sub", None), ("$.Dir.Sub.Deep", b"deep" * 100), ("$.Empty", b""), ("$.One", b"1")]
    rows = []
    for name, total, more in (("s.adf", 640, []), ("m.adf", 1280, []), ("l.adl", 2560, [("$.Big", big)]), ("h.dat", 33 * 100, [("$.Big", big)])):
        content = hierarchical(total, files + more)
        rows.append((name, name, len(content), in_turn(content) if name == "l.adl" else content))
    images = in_linear_order(with_layout(image_rows(spark, rows)))
    found = adfs.read_files(images, adfs.entries(images)).collect()
    expected = dict(files + [("$.Big", big)])
    for name, *_ in rows:
        own = {r["id"]: bytes(r["data"]) for r in found if r["image_id"] == name and not r["is_dir"]}
        assert own == {p: d for p, d in expected.items() if d is not None and (p != "$.Big" or name[0] in "lh")}
    assert {r["id"] for r in found if r["is_dir"]} == {"$.Dir", "$.Dir.Sub"} and {r["load"] for r in found} == {0x1900}
    assert adfs.tree_issues(images).collect() == []
    again = {r["image_id"]: bytes(r["content"]) for r in in_file_order(images).collect()}
    assert all(again[name] == content for name, _, _, content in rows)


def test_directories_of_any_depth_and_damaged_ones(spark):
    files, path = [], "$"
    for k in range(40):
        path += f".D{k}"
        files.append((path, None))
    deep = hierarchical(640, [*files, (path + ".F", b"x")])
    cyclic = bytearray(hierarchical(640, [("$.A", None), ("$.B", None)]))
    at = 2 * 256 + 5 + 22
    cyclic[at : at + 3] = (2).to_bytes(3, "little")  # A is the root again
    cyclic[(12 + 4) * 256 + 0xFF] = 1  # B's check byte
    images = image_rows(spark, [("deep", "d.adf", len(deep), deep), ("cyclic", "c.adf", len(cyclic), bytes(cyclic))])
    assert adfs.entries(images.where("image_id = 'deep'")).count() == 41
    issues = {(r["path"], r["code"]) for r in adfs.tree_issues(images).collect()}
    assert issues == {("$.A", "directory-cycle"), ("$.B", "check-byte")}


def test_sides_one_after_the_other(spark):
    image = bytearray(204800)
    image[:512], image[102400:102912] = flat_catalogue(b"ZERO"), flat_catalogue(b"ONE")
    catalogued = dfs.identify(surfaces(with_layout(image_rows(spark, [("i", "i.dsd", len(image), bytes(image))])), sequential=True))
    assert {r["side"]: r["title"].rstrip("\0") for r in dfs.disc_info(catalogued).collect()} == {0: "ZERO", 1: "ONE"}


def test_host_folders(spark, tmp_path):
    for name in ("a/F,fff", "a/F.inf", "b/c/G", "H", ".hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = hosts.host_tree(spark, str(tmp_path)).withColumn("image_id", F.lit(1))
    got = [(r["path"], r["target"]) for r in hosts.import_plan(files, flat=False).orderBy("step").collect()]
    assert got == [("H", "$.H"), ("a/F,fff", "$.a.F"), ("b/c/G", "$.b.c.G")]
    assert {r["target"] for r in hosts.import_plan(files, flat=True).collect()} == {"$.H", "$.F", "$.G"}
    assert {bytes(r["data"]) for r in files.where("path = 'H'").collect()} == {b"H"}


@pytest.mark.parametrize("cut", [(None, None, 1), (2, 7, 1), (-4, None, 1), (None, -3, 1), (50, 60, 1), (7, 2, 1), (None, None, -1), (8, 1, -2), (-1, -8, -3), (1, None, 4), (None, 3, -1)])
def test_byte_slices(spark, cut):
    rows = [(bytes(range(10)),), (b"",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(byte_slice(F.col("c"), *cut)).collect()]
    assert [None if x is None else bytes(x) for x in got] == [bytes(range(10))[slice(*cut)], b"", None]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("b", 1)], "code string, n int")
    for form in ("json", "tsv"):
        write_report(rows, f"{tmp_path}/{form}", form)
    assert {r["code"] for r in spark.read.json(f"{tmp_path}/json").collect()} == {"a", "b"}
    assert {r["code"] for r in spark.read.csv(f"{tmp_path}/tsv", header=True, sep="\t").collect()} == {"a", "b"}


def test_archive_members_are_read_by_range(spark):
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("d/", b""), ("d/F", b"abc" * 5000), ("é.inf", b"F 1900 8023"), ("e", b"")):
            z.writestr(name, data)
        z.writestr(zipfile.ZipInfo("plain"), b"stored")
        z.comment = b"a comment at the end"
    whole = packed.getvalue()
    at = whole.index(b"d/F") + 3
    broken = whole[: at + 2] + b"\xff\xff\xff" + whole[at + 5 :]
    rows = [("ok", whole), ("broken", broken), ("empty", b""), ("none", None)]
    got = {(r["archive"], r["filename"]): (r["ordinal"], r["file_size"], r["data"] and bytes(r["data"]), r["issue"]) for r in archives.members(spark.createDataFrame(rows, "archive string, content binary"), with_content=True).collect()}
    assert got["ok", "d/F"] == (1, 15000, b"abc" * 5000, None) and got["ok", "plain"] == (4, 6, b"stored", None)
    assert got["ok", "é.inf"][2] == b"F 1900 8023" and got["ok", "d/"] == (0, 0, None, None) and got["ok", "e"][3] is None
    assert got["broken", "d/F"][2:] == (None, "broken-data") and got["broken", "plain"][2] == b"stored"
    assert got["empty", None][3] == got["none", None][3] == "BadZipFile"
    few = archives.members(spark.createDataFrame(rows[:1], "archive string, content binary")).where("data is not null").collect()
    assert [r["filename"] for r in few] == ["é.inf"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(plan, kind):
    """The first line of a plan that names `kind`, and all lines under it."""
    lines = plan.splitlines()
    return "\n".join(lines[next(k for k, line in enumerate(lines) if kind in line) :])


def test_objects_come_with_their_bytes(spark):
    files = spark.createDataFrame([(i, f"F{k}", 1, 2, 12, 0xD828, bytes([k]) * (k * 300)) for i in (1, 2) for k in range(5)], "image_id long, name string, load long, exec long, access int, packed_date int, data binary")
    images = server_images(files)
    joined = {(r["image_id"], r["path"]): bytes(r["data"]) for r in afs.object_bytes(images, afs.objects(images)).collect()}
    got = {(r["image_id"], r["path"]): bytes(r["data"]) for r in afs.objects(images, with_data=True).collect()}
    assert got == joined and len(got) == 10
    broken = images.limit(1).withColumn("content", F.lit(b"\0" * 512)).withColumn("root_sin", F.lit(1).cast("long"))
    assert [(r["issue"], r["data"]) for r in afs.objects(broken, with_data=True).collect()] == [("broken-map", None)]


def test_partitions_are_built_one_by_one_from_shuffled_keys(spark):
    from platterlake.plans import checks, images

    for q in (images.q47_server_objects, checks.q102_partition_issues):
        plan = plan_of(q(spark, "/root/testdata/sf0.001"))
        assert "FlatMapGroupsInArrow" in plan and "Join" not in plan and "ObjectHashAggregate" not in plan and "collect_list" not in plan
        assert "data" not in below(plan, "Sort").replace("DataFilters", "").replace("testdata", "")  # no file's bytes are sorted or shuffled


def test_images_are_built_as_rows_stream_by(spark):
    from platterlake.plans import checks, discs, images

    for q in (images.q46_hierarchical_roundtrip, images.q46b_hierarchical_map, discs.q83_set_map_boot, checks.q85_expanded, images.q45_image_roundtrip):
        plan = plan_of(q(spark, "/root/testdata/sf0.001"))
        assert "ObjectHashAggregate" not in plan
        for k, line in enumerate(plan.splitlines()):
            if "Sort [" in line or "Exchange hashpartitioning" in line:
                under = plan.splitlines()[k + 1]
                assert "rpad" not in under and "content" not in under and "data" not in under


def test_images_are_built_once_with_their_discs_columns(spark):
    """One scan, no join: each join sorts, and a task holds the pages of all its sorts at once."""
    from platterlake.plans import checks, discs

    for q, sorts in ((discs.q83_set_map_boot, 1), (checks.q85_expanded, 2)):
        plan = plan_of(q(spark, "/root/testdata/sf0.001"))
        assert "Join" not in plan and plan.count("FileScan") == 1 and plan.count("Sort [") == sorts
        assert "REPARTITION_BY_NUM" in plan  # the number of partitions stands


def test_names_that_do_not_fit_a_flat_catalogue(spark, tmp_path):
    from platterlake.plans.images import q45_image_roundtrip
    from platterlake.sinks.images import dfs_images, long_names

    parts = spark.createDataFrame([(1_000_000 + k, 1 + k % 3) for k in range(25)], "p_partkey long, p_size int")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = q45_image_roundtrip(spark, str(tmp_path)).collect()
    assert {r["path"].partition(".")[2] for r in got} == {f"P{1_000_000 + k}" for k in range(25)}
    row = (0, "$", False, 0, 0, 1, b"x")
    files = spark.createDataFrame([(1, "SHORT", 2, *row), (2, "SHORT", 2, *row), (2, "TOOLONGNAME", 3, *row)], "image_id long, name string, start_sector long, ordinal long, directory string, locked boolean, load long, exec long, length long, data binary")
    discs = spark.createDataFrame([(1, "A", 0, 0, 400), (2, "B", 0, 0, 400), (3, "C", 0, 0, 400)], "image_id long, title string, cycle int, boot_option int, total_sectors int")
    assert sorted(r["image_id"] for r in dfs_images(files, discs).collect()) == [1, 3]
    assert [tuple(r) for r in long_names(files).collect()] == [(2, "name-too-long", "TOOLONGNAME")]


def test_hierarchical_entries_come_with_their_bytes(spark):
    content = hierarchical(640, [("$.Dir", None), ("$.Dir.F", b"deep" * 100), ("$.Empty", b""), ("$.One", b"1")])
    images = image_rows(spark, [("s", "s.adf", len(content), content)])
    joined = {r["id"]: bytes(r["data"]) for r in adfs.read_files(images, adfs.entries(images)).collect()}
    got = {r["id"]: bytes(r["data"]) for r in adfs.entries(images, with_data=True).collect()}
    assert got == joined and got["$.Dir.F"] == b"deep" * 100
