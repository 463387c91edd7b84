"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass takes at once; a longer single text is still taken whole.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset, a temporary one on a local master (tests), else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="platterlake-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def written(df: DataFrame, *over: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows to a table of their own in the shared folder and read them again.

    `over`: tables written before that nothing but these rows was read for; they are deleted. `by`: a column of few
    values, each of which gets files of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    for old in over:
        forget(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(old: DataFrame) -> None:
    """Delete the table of a frame that `written` returned; its rows can't be read any more."""
    context = old.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(old._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    return text_bytes(batch.column(batch.schema.get_field_index(name)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most `limit` bytes of text each, or of one row."""
    _, at = texts(batch, name)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit words (xor-shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys`; a table ends at the first group end past `rows` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            end = int(group_starts(whole, keys)[-1])
            if end:
                yield whole.slice(0, end)
            held, n = whole.slice(end).to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each group of rows sorted by `keys` (numbers without nulls)."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for key in keys:
        x = column(rows, key)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def group_pairs(starts: np.ndarray, total: int, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i < j, of all pairs inside each group, about `at_once` at a time."""
    size = np.diff(np.append(starts, total))
    end = np.repeat(starts + size, size)
    later = end - np.arange(total) - 1
    low, sums = 0, np.concatenate([[0], np.cumsum(later)])
    while low < total:
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + at_once, "right")) - 1)
        k = later[low:high]
        i = np.repeat(np.arange(low, high), k)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        low = high


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node it is joined to by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    return root
