"""Hierarchical discs: the free map as built-in expressions; directories are followed in the task that holds the image.

Content is in linear order (`sources.images.in_linear_order`).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR, byte_at, uint_le
from platterlake.functions.text import decode_text
from platterlake.operators.space import old_map_checksum

#: Directory block size and entry size, entries at most, first sector of the root, signatures.
DIR_BYTES, ENTRY_BYTES, MAX_ENTRIES, ROOT_SECTOR = 1280, 26, 47, 2
SIGNATURES = ("Hugo", "Nick")
TAIL_NAME = 0x4FB
#: Attributes in the top bits of a name's characters, in order.
ATTRIBUTES = ("R", "W", "L", "D", "E", "r", "w", "e", "P")


def _content(offset: Column | int, width: int) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.col("content").substr((at + 1).cast("int"), F.lit(width))


def free_regions(images: DataFrame) -> DataFrame:
    """(image_id, ordinal, start_sector, length) of the free map in sectors 0 and 1."""
    n = F.floor(byte_at(F.col("content"), 0x1FE) / 3).cast("int")
    rows = images.withColumn("ordinal", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(82)) - 1)).otherwise(F.array().cast("array<int>"))))
    at = F.col("ordinal") * 3
    return rows.select("image_id", "ordinal", uint_le(F.col("content"), at, 3).alias("start_sector"), uint_le(F.col("content"), at + 0x100, 3).alias("length"))


def disc_info(images: DataFrame, *more: Column) -> DataFrame:
    """Size, name, id, boot option and file-server pointers (null where there is no such partition); and further columns of the same pass."""
    c = F.col("content")
    letters = [part.substr(F.lit(k + 1), F.lit(1)) for k in range(5) for part in (_content(0x1F6, 5), _content(0x0F7, 5))]
    name = F.regexp_replace(F.regexp_replace(decode_text(F.concat(*letters[:10])), r"[\r\x00].*$", ""), r"\s+$", "")
    one, two = uint_le(c, 0x0F6, 4), uint_le(c, 0x1F6, 4)
    server = (one > 0) & (two > 0)
    return images.select(
        "image_id",
        uint_le(c, 0x0FC, 3).alias("total_sectors"),
        name.alias("title"),
        uint_le(c, 0x1FB, 2).alias("disc_id"),
        byte_at(c, 0x1FD).alias("boot_option"),
        F.when(server, one).alias("info_sector_1"),
        F.when(server, two).alias("info_sector_2"),
        *more,
    )


def map_codes() -> Column:
    """What is wrong with checksums and the end pointer of the free map of `content`."""
    c = F.col("content")
    end = byte_at(c, 0x1FE)
    checks = F.array(
        F.when(old_map_checksum(_content(0, 256)) != byte_at(c, 0x0FF), F.lit("checksum-0")),
        F.when(old_map_checksum(_content(256, 256)) != byte_at(c, 0x1FF), F.lit("checksum-1")),
        F.when(end % 3 != 0, F.lit("free-end-not-of-3")),
        F.when(end > 246, F.lit("free-end-too-large")),
        F.when(~_content(ROOT_SECTOR * SECTOR + 1, 4).cast("string").isin(*SIGNATURES), F.lit("root-unreadable")),
    )
    return F.array_compact(checks)


def map_issues(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.explode(map_codes()).alias("code"))


def read_directory(block: bytes) -> tuple[list[dict], str | None]:
    """Entries of a directory block in stored order, or what is wrong with it."""
    if len(block) < DIR_BYTES:
        return [], "short-directory"
    if block[1:5].decode("latin-1") not in SIGNATURES:
        return [], "bad-signature"
    if block[TAIL_NAME : TAIL_NAME + 4] != block[1:5]:
        return [], "tail-differs"
    if block[TAIL_NAME - 1] != block[0]:
        return [], "broken-directory"
    if block[TAIL_NAME + 4]:
        return [], "check-byte"
    found = []
    for ordinal in range(MAX_ENTRIES):
        at = ordinal * ENTRY_BYTES + 5
        if not block[at]:
            break
        letters = block[at : at + 10]
        load, exec_, length, start = struct.unpack_from("<III3s", block, at + 10)
        name = bytes(c & 0x7F for c in letters).decode("latin-1")
        flags = "".join(flag for c, flag in zip(letters, ATTRIBUTES, strict=False) if c & 0x80)
        found.append(
            {
                "ordinal": ordinal,
                "name": re.split(r"[\r\x00]", name)[0].rstrip(),
                "flags": flags,
                "is_dir": "D" in flags,
                "load": load,
                "exec": exec_,
                "length": length,
                "start_sector": int.from_bytes(start, "little"),
                "seq": block[at + 25],
            }
        )
    return found, None


def walk_tree(content: bytes) -> Iterator[dict]:
    """All entries, parents first and to any depth; a row with `issue` for a directory that can't be followed."""
    todo = [("$", ROOT_SECTOR)]
    seen = set()
    while todo:
        path, sector = todo.pop()
        if sector in seen:
            yield {"id": path, "issue": "directory-cycle"}
            continue
        seen.add(sector)
        listed, wrong = read_directory(content[sector * SECTOR : sector * SECTOR + DIR_BYTES])
        if wrong:
            yield {"id": path, "issue": wrong}
        for e in listed:
            inside = f"{path}.{e['name']}"
            yield {"parent_id": path, "id": inside, **e}
        todo += [(f"{path}.{e['name']}", e["start_sector"]) for e in reversed(listed) if e["is_dir"]]


_FIELDS = "parent_id string, ordinal int, name string, flags string, is_dir boolean, load bigint, exec bigint, length bigint, start_sector bigint, seq bigint, id string, issue string"


def tree(images: DataFrame, with_data: bool = False) -> DataFrame:
    """Entries and issues of each image (image_id, content in linear order), read in the task that holds the image; with the entries' bytes if wanted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content = batch.column(1)[i].as_py() or b""
                rows = list(walk_tree(content))
                for r in rows if with_data else ():
                    if "length" in r:
                        r["data"] = content[r["start_sector"] * SECTOR : r["start_sector"] * SECTOR + r["length"]]
                columns = [pa.array([r.get(name) for r in rows], kind) for name, kind in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), *columns], ["image_id", *names])

    fields = _FIELDS + (", data binary" if with_data else "")
    names = [f.split()[0] for f in fields.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in fields.split(", ")]
    return images.select("image_id", "content").mapInArrow(read, f"image_id {images.schema['image_id'].dataType.simpleString()}, {fields}")


def entries(images: DataFrame, with_data: bool = False) -> DataFrame:
    """All entries of all directories, with id (the path) and parent_id; the root's children have parent `$`. Files are contiguous, an empty one has no bytes."""
    return tree(images, with_data).where("issue is null").drop("issue")


def tree_issues(images: DataFrame) -> DataFrame:
    """(image_id, path, code) of directories that can't be read: signatures, sequence numbers, check byte, cycles."""
    return tree(images).where("issue is not null").select("image_id", F.col("id").alias("path"), F.col("issue").alias("code"))


def read_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """The files with their bytes: files are contiguous, an empty one has none."""
    joined = files.join(images.select("image_id", "content"), "image_id")
    data = F.when(F.col("length") > 0, F.col("content").substr((F.col("start_sector") * SECTOR + 1).cast("int"), F.col("length").cast("int"))).otherwise(F.lit(b""))
    return joined.withColumn("data", data).drop("content")
