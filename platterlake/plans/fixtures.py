"""Inputs of the registered queries: file-server partitions and archives built from files, one a row, in the task that has its files."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.functions.numbers import SECTOR
from platterlake.sources.afs import DIR_HEADER, DIR_SLOT, EXTENTS_A_BLOCK, MAP_MAGIC
from platterlake.sources.archives import EXTRA_ID, EXTRA_SIGNATURE


def _map_block(extents: list[tuple[int, int]], last: int, following: int) -> bytes:
    rows = b"".join(s.to_bytes(3, "little") + n.to_bytes(2, "little") for s, n in extents).ljust(5 * EXTENTS_A_BLOCK, b"\0")
    return (MAP_MAGIC + b"\0\0" + struct.pack("<H", last) + rows + following.to_bytes(3, "little")).ljust(255, b"\0") + b"\0"


def _directory(entries: list[tuple]) -> bytes:
    """A directory object of (name, load, exec, access, date, sin), linked in the order of the names."""
    slots = b""
    for k, (name, load, exec_, access, day, sin) in enumerate(entries):
        link = DIR_HEADER + (k + 1) * DIR_SLOT if k + 1 < len(entries) else 0
        slots += struct.pack("<H10sIIBH", link, name.encode("latin-1").ljust(10), load, exec_, access, day) + sin.to_bytes(3, "little")
    head = struct.pack("<HB10sHH", DIR_HEADER if entries else 0, 0, b"$".ljust(10), 0, len(entries))
    return (head + slots).ljust(-(-(len(head) + len(slots) + 1) // SECTOR) * SECTOR - 1, b"\0") + b"\0"


def build_partition(files: list[tuple], piece: int = 2) -> tuple[bytes, int]:
    """(content, sector of the root's map) of files (name, load, exec, access, date, data) in the root.

    Objects lie in extents of `piece` sectors with a sector between them, so that the extents of an object are
    several and those of a large one fill more than one map block.
    """
    content = bytearray(SECTOR)  # sector 0 stays empty: a pointer of 0 is none

    def put(data: bytes) -> int:
        extents = []
        for at in range(0, len(data), piece * SECTOR):
            chunk = data[at : at + piece * SECTOR]
            extents.append((len(content) // SECTOR, -(-len(chunk) // SECTOR)))
            content.extend(chunk.ljust(-(-len(chunk) // SECTOR) * SECTOR, b"\0") + bytes(SECTOR))
        groups = [extents[k : k + EXTENTS_A_BLOCK] for k in range(0, len(extents), EXTENTS_A_BLOCK)] or [[]]
        first = len(content) // SECTOR
        for k, group in enumerate(groups):
            content.extend(_map_block(group, len(data) % SECTOR, first + k + 1 if k + 1 < len(groups) else 0))
        return first

    listed = [(name, load, exec_, access, day, put(bytes(data))) for name, load, exec_, access, day, data in sorted(files, key=lambda f: f[0].upper())]
    root = put(_directory(listed))
    return bytes(content), root


def server_images(files: DataFrame) -> DataFrame:
    """(image_id, root_sin, content) from files (image_id, name, load, exec, access, packed_date, data), one image at a time."""

    def build(own: pa.Table) -> pa.Table:
        image = own.column("image_id").slice(0, 1).cast(pa.string())
        content, root = build_partition(list(zip(*(own.column(c).to_pylist() for c in fields), strict=True)))
        return pa.table([image, pa.array([root]), pa.array([content], pa.binary())], ["image_id", "root_sin", "content"])

    fields = ("name", "load", "exec", "access", "packed_date", "data")
    return files.select("image_id", *fields).groupBy("image_id").applyInArrow(build, "image_id string, root_sin long, content binary")


def archive_files(members: DataFrame) -> DataFrame:
    """(archive, content) of ZIP archives from members (archive, ordinal, filename, data, extra_meta); stored, not deflated."""
    gathered = members.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("ordinal", "filename", "data", F.col("extra_meta.load").alias("load"), F.col("extra_meta.exec").alias("exec"), F.col("extra_meta.attr").alias("attr")))).alias("files"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for archive, files in frame.itertuples(index=False):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for f in files:
                        info = zipfile.ZipInfo(f["filename"])
                        if pd.notna(f["load"]):
                            numbers = [0 if pd.isna(f[x]) else int(f[x]) for x in ("load", "exec", "attr")]
                            info.extra = struct.pack("<HH4sIIII", EXTRA_ID, 20, EXTRA_SIGNATURE, *numbers, 0)
                        z.writestr(info, bytes(f["data"] or b""))
                rows.append((archive, out.getvalue()))
            yield pd.DataFrame(rows, columns=["archive", "content"])

    return gathered.select(F.col("archive").cast("string"), "files").mapInPandas(build, "archive string, content binary")
