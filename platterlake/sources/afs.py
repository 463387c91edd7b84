"""File-server partitions: info sectors and users as expressions, map chains and directory lists followed image by image.

A directory is a linked list inside an object whose extents are a linked list of map blocks, so an image's tree is
read by one small function in the task that holds the image; a broken pointer becomes an issue row, never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.functions.dates import unpack_date
from platterlake.functions.numbers import SECTOR, byte_at, uint_le
from platterlake.functions.text import decode_text, field_text

#: Fixed values of the formats.
INFO_MAGIC, MAP_MAGIC = "AFS0", b"JesMap"
EXTENTS_A_BLOCK, EXTENTS_AT, CHAIN_AT = 48, 10, 250
DIR_HEADER, DIR_SLOT, USER_BYTES = 17, 26, 31
DIRECTORY_BIT = 0x20


def _sector(lba: Column) -> Column:
    return F.col("content").substr((lba * SECTOR + 1).cast("int"), F.lit(SECTOR))


def info_sectors(located: DataFrame) -> DataFrame:
    """Both copies of the info sector of images with info_sector_1 and info_sector_2 (content as linear sectors)."""
    copies = F.array(F.struct(F.lit(1).alias("copy"), F.col("info_sector_1").alias("lba")), F.struct(F.lit(2).alias("copy"), F.col("info_sector_2").alias("lba")))
    s = located.where("info_sector_1 is not null").withColumn("_c", F.explode(copies)).withColumn("_s", _sector(F.col("_c.lba")))
    b = F.col("_s")
    return s.select(
        "image_id",
        F.col("_c.copy").alias("copy"),
        (b.substr(F.lit(1), F.lit(4)).cast("string") == INFO_MAGIC).alias("valid"),
        F.regexp_replace(decode_text(b.substr(F.lit(5), F.lit(16))), r"\s+$", "").alias("title"),
        uint_le(b, 20, 2).alias("cylinders"),
        uint_le(b, 22, 3).alias("total_sectors"),
        byte_at(b, 25).alias("discs"),
        uint_le(b, 26, 2).alias("sectors_per_cylinder"),
        byte_at(b, 28).alias("bitmap_sectors"),
        uint_le(b, 31, 3).alias("root_sin"),
        unpack_date(uint_le(b, 34, 2)).alias("created"),
        uint_le(b, 36, 2).alias("start_cylinder"),
        byte_at(b, 38).alias("media"),
    )


def agreed_info(info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per image whose copies are valid and equal, issues for the others)."""
    fields = [c for c in info.columns if c not in ("image_id", "copy")]
    both = info.groupBy("image_id").agg(F.count("copy").alias("n"), F.count_if("valid").alias("ok"), F.count_distinct(F.struct(*fields)).alias("kinds"), F.min_by(F.struct(*fields), "copy").alias("first"))
    good = (F.col("n") == 2) & (F.col("ok") == 2) & (F.col("kinds") == 1)
    issues = both.where(~good).select("image_id", F.when(F.col("ok") < 2, "bad-magic").otherwise("copies-differ").alias("code"))
    return both.where(good).select("image_id", "first.*"), issues


def read_chain(content: bytes, sin: int) -> tuple[list[tuple[int, int, int, int]], int, str | None]:
    """((block, ordinal, start, length) of an object's extents, bytes used in its last sector, what is wrong)."""
    found, seen, block, last = [], set(), 0, 0
    while sin:
        data = content[sin * SECTOR : (sin + 1) * SECTOR]
        if sin in seen:
            return found, last, "map-cycle"
        if len(data) < SECTOR or data[:6] != MAP_MAGIC or data[6] != data[255]:
            return found, last, "broken-map"
        seen.add(sin)
        last = struct.unpack_from("<H", data, 8)[0]
        slots = [(int.from_bytes(data[p : p + 3], "little"), int.from_bytes(data[p + 3 : p + 5], "little")) for p in range(EXTENTS_AT, CHAIN_AT, 5)]
        used = [(s, n) for s, n in slots if n]
        found += [(block, k, s, n) for k, (s, n) in enumerate(used)]
        sin = int.from_bytes(data[CHAIN_AT : CHAIN_AT + 3], "little") if len(used) == EXTENTS_A_BLOCK else 0
        block += 1
    return found, last, None


def read_object(content: bytes, sin: int) -> tuple[bytes, str | None]:
    extents, last, wrong = read_chain(content, sin)
    data = b"".join(content[s * SECTOR : (s + n) * SECTOR] for _, _, s, n in extents)
    return (data[: len(data) - SECTOR + last] if last and data else data), wrong


def read_directory(data: bytes) -> tuple[list[dict], str | None]:
    """Entries along the list of a directory object."""
    if len(data) < DIR_HEADER + 1 or data[2] != data[-1]:
        return [], "broken-directory"
    at, count = struct.unpack_from("<H", data, 0)[0], struct.unpack_from("<H", data, 15)[0] & 0xFF
    found, seen = [], set()
    while at:
        if at in seen or (at - DIR_HEADER) % DIR_SLOT or at < DIR_HEADER or at + DIR_SLOT >= len(data) + 1:
            return found, "broken-list"
        seen.add(at)
        link, name, load, exec_, access, day = struct.unpack_from("<H10sIIBH", data, at)
        sin = int.from_bytes(data[at + 23 : at + 26], "little")
        text = name.decode("latin-1").split("\r")[0].split("\0")[0].rstrip()
        found.append({"name": text, "load": load, "exec": exec_, "access": access, "packed_date": day, "sin": sin})
        at = link
    return found, None if len(found) == count else "count-differs"


def walk_tree(content: bytes, root: int, max_depth: int = 32) -> Iterator[dict]:
    """All objects below the root, parents first; a row with `issue` for what can't be followed."""
    todo = [("$", root, 0)]
    while todo:
        path, sin, depth = todo.pop()
        data, wrong = read_object(content, sin)
        listed, broken = read_directory(data) if not wrong else ([], None)
        if wrong or broken:
            yield {"path": path, "issue": wrong or broken}
        for ordinal, e in enumerate(listed):
            inside = f"{path}.{e['name']}"
            is_dir = bool(e["access"] & DIRECTORY_BIT)
            extents, last, bad = read_chain(content, e["sin"])
            sectors = sum(x[3] for x in extents)
            size = 0 if not sectors else sectors * SECTOR if not last else (sectors - 1) * SECTOR + last
            yield {"parent_id": path, "path": inside, "ordinal": ordinal, "is_dir": is_dir, "length": size, "extents": extents, "issue": bad, **e}
            if is_dir and not bad and depth < max_depth:
                todo.append((inside, e["sin"], depth + 1))


_EXTENTS = pa.list_(pa.struct([("block", pa.int32()), ("ordinal", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_ENTRY = {"parent_id": pa.string(), "path": pa.string(), "name": pa.string(), "ordinal": pa.int32(), "is_dir": pa.bool_()}
_ENTRY |= {"length": pa.int64(), "load": pa.int64(), "exec": pa.int64(), "access": pa.int32(), "packed_date": pa.int32(), "sin": pa.int64(), "extents": _EXTENTS, "issue": pa.string()}
_SCHEMA = (
    "image_id string, parent_id string, path string, name string, ordinal int, is_dir boolean, length bigint, load bigint, exec bigint, access int, packed_date int,"
    " sin bigint, extents array<struct<block: int, ordinal: int, start: bigint, length: bigint>>, issue string"
)


def objects(images: DataFrame, with_data: bool = False) -> DataFrame:
    """The tree of each image (image_id, root_sin, content), with the objects' bytes if wanted, as the image is at hand here."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, root, content in zip(*batch.columns, strict=True):
                whole = content.as_py()
                rows = list(walk_tree(whole, root.as_py()))
                for row in rows:
                    if with_data and "extents" in row:
                        row["data"] = b"".join(whole[s * SECTOR : (s + n) * SECTOR] for _, _, s, n in row["extents"])[: row["length"]]
                    row["extents"] = [dict(zip(("block", "ordinal", "start", "length"), x, strict=True)) for x in row.get("extents") or ()]
                columns = [pa.array([row.get(name) for row in rows], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([image.as_py()] * len(rows), pa.string()), *columns], ["image_id", *kinds])

    kinds = _ENTRY | ({"data": pa.binary()} if with_data else {})
    return images.select(F.col("image_id").cast("string"), F.col("root_sin").cast("long"), "content").mapInArrow(read, _SCHEMA + (", data binary" if with_data else ""))


def users(tables: DataFrame) -> DataFrame:
    """Rows of the users' tables (image_id, data): 31 bytes each, a rest at the end is ignored."""
    n = F.floor(F.length("data") / USER_BYTES).cast("int")
    rows = tables.withColumn("slot", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    at = F.col("slot") * USER_BYTES
    status = byte_at(F.col("data"), at + 30)
    identity = field_text(F.col("data").substr(at + 1, F.lit(20)))
    bit = lambda mask: status.bitwiseAND(F.lit(mask)) != 0
    return rows.select(
        "image_id",
        "slot",
        F.when(F.contains(identity, F.lit(".")), F.substring_index(identity, ".", 1)).otherwise("").alias("grp"),
        F.regexp_extract(identity, r"([^.]*)$", 1).alias("name"),
        identity.alias("full_id"),
        field_text(F.col("data").substr(at + 21, F.lit(6))).alias("password"),
        uint_le(F.col("data"), at + 26, 4).alias("free_space"),
        bit(0x80).alias("in_use"),
        bit(0x40).alias("is_system"),
        bit(0x20).alias("priv_locked"),
        status.bitwiseAND(F.lit(3)).alias("boot_option"),
    )


def cylinder_bitmaps(images: DataFrame) -> DataFrame:
    """(image_id, cylinder, bitmap, sectors): the bitmap in the first sector of each cylinder of the partition."""
    cylinders = F.sequence(F.col("start_cylinder").cast("int"), F.col("cylinders").cast("int") - 1)
    rows = images.where("start_cylinder < cylinders").withColumn("cylinder", F.explode(cylinders))
    return rows.select("image_id", "cylinder", _sector(F.col("cylinder") * F.col("sectors_per_cylinder")).alias("bitmap"), F.col("sectors_per_cylinder").alias("sectors"))


def object_bytes(images: DataFrame, found: DataFrame) -> DataFrame:
    """The objects (image_id, path, length, extents) with their bytes, joined to the image's content."""
    joined = found.join(images.select("image_id", "content"), "image_id")
    cut = lambda done, x: F.concat(done, F.col("content").substr((x["start"] * SECTOR + 1).cast("int"), (x["length"] * SECTOR).cast("int")))
    whole = F.aggregate("extents", F.lit(b""), cut)
    return joined.withColumn("data", whole.substr(F.lit(1), F.col("length").cast("int"))).drop("content")
