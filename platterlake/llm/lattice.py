"""Near-duplicate embeddings by lattice hashing.

In each table a random projection to 8 dimensions is decoded to the nearest point of the E8 lattice. A vector
lives in the cell of that point (its home) and also probes the neighbouring cells it is nearest to; two vectors
meet where one's home is the other's home or probe. Each pair that meets is verified by its cosine in double
precision. Cells are split into blocks of bounded size, each pair is counted in the first place where it
meets, and only sums and one link per vector to the block's component leave a block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.llm.components import connected_components
from platterlake.llm.shared import column, group_starts, local_roots, mix64, whole_groups, written

#: With these a pair of cosine 0.93 in 64 dimensions meets in a table with probability 0.90: one in 10,000 is missed.
TABLES, PROBES, CELL = 4, 8, 0.2
BLOCK = 1024


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if np.prod(v) > 0]
    return np.array(found)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1))[:, None], half, whole)


def _named(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each lattice point (the last axis)."""
    doubled = (2 * points).astype(np.int64).view(np.uint64)
    name = np.full(points.shape[:-1], salt, np.uint64)
    for k in range(8):
        name = mix64(name ^ (doubled[..., k] + np.uint64(0x9E3779B97F4A7C15)))
    return name.view(np.int64)


class Lattice:
    """Cells of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int, probes: int, cell: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        width = min(dim, 8)
        cell *= (64 / max(dim, 8)) ** 0.5  # as far as a projection to 8 dimensions brings two vectors closer
        self.maps = [np.pad(np.linalg.qr(rng.normal(size=(dim, width)))[0], ((0, 0), (0, 8 - width))) / cell for _ in range(tables)]
        self.probes = probes

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(vectors, 1 + probes): the home first, then the cells probed."""
        x = unit @ self.maps[table]
        home = decode(x)
        toward = (x - home) @ NEIGHBOURS.T
        near = np.argsort(-toward, axis=1, kind="stable")[:, : self.probes]
        return _named(np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[near]], axis=1), table)


def _scaled(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, scaled by a power of two each (which changes no cosine), and their norms."""
    x = packed.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(packed), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    tables: int = TABLES,
    probes: int = PROBES,
    cell: float = CELL,
    block: int = BLOCK,
    seed: int = 0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links join vectors of equal label and length.

    Null, empty and zero vectors, vectors with null or non-finite components and rows with null label link with
    nothing: no links, their own component, kept. Equal vectors of a label are one class inside, so thousands
    of copies cost no more than one; a repeated row is one more vector (it links with its twin), and rows that share
    an id are vectors like any others (component_id is the least id reached). A row with
    null id is given back without links. Empty table: no rows. Other columns are ignored.
    """
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    biggest = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & (biggest > 0), F.lit(False))
    rows = rows.withColumn("ok", usable).withColumn("hash", F.when(F.col("ok"), F.xxhash64("label", "v")))
    classes = rows.where("ok").groupBy("hash", "label", "v").agg(F.min("vec_id").alias("first_id"), F.count("v").alias("n"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()))  # numbered once, as they are written

    lattices: dict[int, Lattice] = {}

    def lattice(dim: int) -> Lattice:
        return lattices.setdefault(dim, Lattice(dim, tables, probes, cell, seed))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, space, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x, norm = _scaled(batch.column(2).take(pa.array(own)))
                unit = x / norm[:, None]
                for t in range(tables):
                    cells = lattice(int(dim)).cells(unit, t)
                    cells = mix64(cells.view(np.uint64) ^ mix64(space[own].view(np.uint64))[:, None]).view(np.int64)
                    k = cells.shape[1]
                    home = np.tile(np.arange(k) == 0, len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[own], k)), pa.array(cells.ravel()), pa.array(home), pa.array(np.full(len(home), t, np.int32))], ["cls", "cell", "home", "t"])

    spaces = classes.select("cls", F.xxhash64("label", F.size("v")).alias("space"), "v", F.size("v").alias("dim"))
    met = spaces.mapInArrow(celled, "cls long, cell long, home boolean, t int")
    met = met.groupBy("cell", "t", "cls").agg(F.max("home").alias("home"))
    crowd = met.groupBy("cell", "t").agg(F.count("cls").alias("members"), F.count(F.when(F.col("home"), 1)).alias("homes")).where("members > 1 and homes > 0")
    blocks = F.ceil(F.col("members") / block).cast("int")
    part = F.pmod(F.xxhash64("cls", "cell"), F.col("blocks")).cast("int")
    placed = met.join(crowd, ["cell", "t"]).withColumn("blocks", blocks).withColumn("part", part)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least("part", o).alias("low"), F.greatest("part", o).alias("high")))
    placed = placed.select("cell", "t", "cls", "home", "part", F.explode(pairs).alias("p")).select("cell", "t", "cls", "home", "part", "p.low", "p.high")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["cell", "t", "low", "high"]):
            yield from _links(group, threshold, lattice, tables)

    full = placed.join(classes.select("cls", "v", "n", F.xxhash64("label", F.size("v")).alias("space")), "cls")
    keys = ["cell", "t", "low", "high"]
    found = written(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    components = connected_components(found, "cls", "root").withColumnRenamed("node", "cls")
    placed_in = classes.join(components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = placed_in.groupBy("component").agg(F.min("first_id").alias("head"))
    each = placed_in.join(heads, "component").join(links, "cls", "left").select(
        F.col("hash").alias("_hash"),
        F.col("v").alias("_v"),
        F.col("label").alias("_label"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.col("head").alias("component_id"),
    )
    joined = rows.join(each, (rows["hash"] == each["_hash"]) & (rows["label"] == each["_label"]) & (rows["v"] == each["_v"]), "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(rows: pa.Table, threshold: float, lattice, tables: int) -> Iterator[pa.RecordBatch]:
    """Sums of links and roots of the pairs verified in these blocks and met nowhere before."""
    starts = group_starts(rows, ["cell", "t", "low", "high"])
    size = np.diff(np.append(starts, len(rows)))
    cls, n, space = column(rows, "cls"), column(rows, "n"), column(rows, "space")
    home, part, t = column(rows, "home"), column(rows, "part"), column(rows, "t")
    low, high = column(rows, "low"), column(rows, "high")
    distinct, first, who = np.unique(cls, return_index=True, return_inverse=True)
    vectors = rows.column("v").combine_chunks().take(pa.array(first))
    dims = np.array([len(v) for v in vectors])
    links, a_all, b_all = np.zeros(len(distinct), np.int64), [], []
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        at = np.zeros(len(distinct), np.int64)
        at[own] = np.arange(len(own))
        x, norm = _scaled(vectors.take(pa.array(own)))
        unit = x / norm[:, None]
        cells = np.stack([lattice(int(dim)).cells(unit, k) for k in range(tables)], axis=1)
        groups = [g for g in range(len(starts)) if dims[who[starts[g]]] == dim and size[g] > 1]
        for i, j in _candidates(starts, size, groups, x, norm, at[who], threshold):
            keep = (space[i] == space[j]) & (home[i] | home[j]) & (cls[i] != cls[j])
            keep &= (low[i] == high[i]) | (part[i] != part[j])
            i, j = i[keep], j[keep]
            i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
            cx, cy = cells[at[who[i]]], cells[at[who[j]]]
            same = cx[:, :, 0] == cy[:, :, 0]
            to_x, to_y = (cy[:, :, 1:] == cx[:, :, :1]).any(2), (cx[:, :, 1:] == cy[:, :, :1]).any(2)
            met = same | to_x | to_y
            r = np.arange(len(i))
            here = met.argmax(1) == t[i]
            where = np.where(same[r, t[i]], home[i] & home[j], np.where(to_x[r, t[i]], home[i], home[j]))
            i, j = i[here & where], j[here & where]
            np.add.at(links, who[i], n[j])
            np.add.at(links, who[j], n[i])
            a_all.append(who[i])
            b_all.append(who[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
    root = local_roots(len(distinct), a, b)
    out = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(distinct[out]), pa.array(links[out]), pa.array(distinct[root[out]])], ["cls", "links", "root"])


def _candidates(starts: np.ndarray, size: np.ndarray, groups: list[int], x: np.ndarray, norm: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each group whose cosine reaches the threshold, gathered to arrays of some size."""
    found_i, found_j, held = [], [], 0
    for g in groups:
        rows = np.arange(starts[g], starts[g] + size[g])
        v, length = x[at[rows]], norm[at[rows]]
        i, j = np.nonzero(np.triu(v @ v.T >= (threshold - 1e-9) * np.outer(length, length), 1))
        exact = np.einsum("ij,ij->i", v[i], v[j]) / (length[i] * length[j]) >= threshold
        found_i.append(rows[i[exact]])
        found_j.append(rows[j[exact]])
        held += len(found_i[-1])
        if held > 200_000:
            yield np.concatenate(found_i), np.concatenate(found_j)
            found_i, found_j, held = [], [], 0
    if held:
        yield np.concatenate(found_i), np.concatenate(found_j)


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
r AS (SELECT vec_id AS x, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON r.x = l.x),
k AS (SELECT x, min(root) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN k ON k.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
