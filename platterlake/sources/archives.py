"""ZIP archives as rows of members, with the metadata in their extra fields: directories are listed, members cut out by range."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.functions.metadata import META, meta
from platterlake.functions.numbers import uint_le

#: Id and signature of the extra field that carries addresses and attributes.
EXTRA_ID, EXTRA_SIGNATURE = 0x4341, b"ARC0"
#: Marks of the end record and of a directory entry, and how far from the end the end record can begin.
END_MARK, ENTRY_MARK, END_BYTES = b"PK\x05\x06", b"PK\x01\x02", 65_557
_ENTRY = "filename: string, method: int, packed: bigint, file_size: bigint, header: bigint, load: bigint, exec: bigint, attr: bigint"
#: Contents are carried for sidecars only, unless asked for.
SIDECAR = ".inf"


def extra_addresses(extra: bytes) -> tuple[int, int, int] | None:
    """(load, exec, attr) of the first such field; a block that runs past the end stops the search."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        block = extra[at + 4 : at + 4 + size]
        if len(block) < size:
            return None
        if kind == EXTRA_ID and size >= 20 and block[:4] == EXTRA_SIGNATURE:
            load, exec_, attr = struct.unpack_from("<III", block, 4)
            return load, exec_, attr & 0xFF
        at += 4 + size
    return None


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("archive"), "content")


def directories(archives: DataFrame) -> DataFrame:
    """A row for each member by the archive's central directory (archive, content, ordinal, filename, method, packed, file_size, header, extra, issue).

    Python sees the end record and the directory, never the members; an archive without either is one row with an issue.
    """

    @F.pandas_udf("at bigint, bytes bigint, issue string")
    def end_record(tail: pd.Series) -> pd.DataFrame:
        found = []
        for t in tail:
            at = bytes(t or b"").rfind(END_MARK)
            if at < 0 or at + 22 > len(t):
                found.append((0, 0, "BadZipFile"))
            else:
                count, size, offset = struct.unpack_from("<HII", t, at + 10)
                found.append((offset, size, "zip64" if 0xFFFFFFFF in (size, offset) or count == 0xFFFF else None))
        return pd.DataFrame(found, columns=["at", "bytes", "issue"])

    @F.pandas_udf(f"array<struct<{_ENTRY}>>")
    def listed(directory: pd.Series) -> pd.Series:
        return pd.Series([list(_entries(bytes(d or b""))) for d in directory])

    tail = F.col("content").substr(F.greatest(F.length("content") - END_BYTES, F.lit(0)) + 1, F.lit(END_BYTES))
    ends = archives.select("archive", "content", end_record(tail).alias("end"))
    cut = F.when(F.col("end.issue").isNull(), F.col("content").substr((F.col("end.at") + 1).cast("int"), F.col("end.bytes").cast("int")))
    return ends.withColumn("listed", listed(cut)).select("archive", "content", "end.issue", F.posexplode_outer("listed").alias("ordinal", "m")).select(
        "archive", "content", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "m.*", "issue"
    ).where("filename is not null or issue is not null")


def _entries(directory: bytes) -> Iterator[dict]:
    at = 0
    while at + 46 <= len(directory) and directory[at : at + 4] == ENTRY_MARK:
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name, extra = directory[at + 46 : at + 46 + n_name], directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        load, exec_, attr = extra_addresses(extra) or (None, None, None)
        text = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        yield {"filename": text, "method": -1 if flags & 1 else method, "packed": packed, "file_size": size, "header": header, "load": load, "exec": exec_, "attr": attr}
        at += 46 + n_name + n_extra + n_comment


def members(archives: DataFrame, with_content: bool = False) -> DataFrame:
    """Members of archives (archive, content), in stored order; an unreadable archive is one row with an issue.

    A member's bytes are cut from the archive by its own range, and only those of members that are asked for are
    inflated, each by itself. Encrypted ones and other methods than stored and deflated are issues.
    """

    @F.pandas_udf("binary")
    def inflated(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: None if x is None else _inflate(bytes(x)))

    own = directories(archives)
    wanted = F.lit(with_content) | F.lower("filename").endswith(SIDECAR)
    wanted = wanted & ~F.endswith("filename", F.lit("/"))
    start = F.col("header") + 30 + uint_le(F.col("content"), F.col("header").cast("int") + 26, 2) + uint_le(F.col("content"), F.col("header").cast("int") + 28, 2)
    stored = F.when(wanted, F.col("content").substr((start + 1).cast("int"), F.col("packed").cast("int")))
    code = F.coalesce("issue", F.when(wanted & (F.col("method") == -1), "encrypted"), F.when(wanted & ~F.col("method").isin(0, 8), F.concat(F.lit("method-"), F.col("method").cast("string"))))
    cut = own.select("archive", "ordinal", "filename", "file_size", "load", "exec", "attr", "method", stored.alias("stored"), code.alias("issue"))
    opened = cut.withColumn("opened", inflated(F.when(F.col("method") == 8, F.col("stored"))))
    data = F.when(F.col("method") == 0, F.col("stored")).when(F.col("method") == 8, F.col("opened"))
    broken = (F.col("method") == 8) & F.col("stored").isNotNull() & F.col("opened").isNull()
    extra = F.when(F.col("load").isNotNull(), meta(F.col("load"), F.col("exec"), F.col("attr"))).otherwise(F.lit(None).cast(META))
    return opened.select(
        "archive", "ordinal", "filename", "file_size", extra.alias("extra_meta"), F.decode(data, "ISO-8859-1").alias("content"), data.alias("data"), F.coalesce("issue", F.when(broken, "broken-data")).alias("issue")
    )


def _inflate(packed: bytes) -> bytes | None:
    try:
        return zlib.decompress(packed, -15)
    except zlib.error:
        return None


def safe_path(filename):
    """The member's path without parts that would leave the target folder; `_` where nothing is left."""
    parts = F.filter(F.split(filename, r"[/\\]"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("_")
