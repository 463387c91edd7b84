"""N-gram Jaccard join by a MinHash LSH forest.

A signature holds, for each tree of the forest, a string of MinHash values; the tree is the sorted trie of those
strings. Two sets of Jaccard similarity s share a prefix of length d in a tree with probability s^d, so the
matched prefix is shortened from the full depth until the probability of sharing one in some tree reaches the
target recall at the threshold. That length holds for all sets: one chosen for each set by how crowded its prefixes are
loses links, as the trees in which a set is alone are those in which its partner isn't. Sets below one prefix meet in blocks of bounded size. There, pairs whose
signatures show them to be far apart are passed over, each other pair is taken in the first tree where it meets,
and its Jaccard similarity is computed from the texts. Only counts and one link per set leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterlake.llm.components import connected_components
from platterlake.llm.shared import column, group_pairs, group_starts, local_roots, mix64, pieces, texts, whole_groups, written

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 4, 0.999999
BLOCK = 512
#: Standard errors below the threshold at which a pair's estimated similarity rules it out (about one in 10^9).
DOUBT = 6.0


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, at most `depth`, by which a pair at the threshold meets in some tree with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of `width` words (A-Z in lower case); of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - width + 1, 1)
    g = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        g = mix64(g ^ h[k : k + n]) + np.uint64(k)
    return np.unique(g)


def set_name(found: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def signature(found: np.ndarray, odd: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """16 bits of the least value of the set under each hash function."""
    least = np.full(len(odd), ~np.uint64(0))
    for low in range(0, len(found), 4096):
        least = np.minimum(least, ((found[None, low : low + 4096] ^ flip[:, None]) * odd[:, None]).min(1))
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def similarities(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets of each pair, where equal i stand together: a set is marked once for all its pairs."""
    vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    begin = np.cumsum(size) - size
    both = np.zeros(len(i), np.int64)
    mark = np.zeros(len(vocabulary), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
    for low, high in zip(heads, np.append(heads[1:], len(i)), strict=True):
        own = code[begin[i[low]] : begin[i[low]] + size[i[low]]]
        mark[own] = 1
        for at in range(low, high, 2_000):
            others = j[at : min(high, at + 2_000)]
            n = size[others]
            offset = np.cumsum(n) - n
            place = np.arange(n.sum()) + np.repeat(begin[others] - offset, n)
            both[at : at + len(others)] = np.add.reduceat(mark[code[place]], offset)
        mark[own] = 0
    return both / (size[i] + size[j] - both)


def near_documents(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, n_links, component_id, kept) for each row; text_hash is the text's xxhash64.

    Two rows are linked where the Jaccard similarity of their shingle sets reaches the threshold; n_links counts
    the other rows linked, copies included. component_id is the least doc_id that can be reached by links (null
    where all are null). One row of a component is kept: that of least id (null ids last), then of least text_hash.
    Texts of equal shingles are one set inside and cost no more than one. Null and empty texts and texts without
    words link with nothing and are kept, each by itself. Fewer words than a shingle has: all of them are one
    shingle. Rows that share an id are rows like any others; a repeated row (same id, same text) is linked with its
    twin and decided alike. Empty table: no rows. Other columns are ignored.
    """
    prefix = prefix_depth(threshold, trees, depth, recall)
    rng = np.random.default_rng(seed)
    odd, flip = (rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))
    least_estimate = threshold - DOUBT * np.sqrt(threshold * (1 - threshold) / (trees * depth))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, at = texts(piece, "text")
                names, signatures = [], []
                for low, high in zip(at[:-1], at[1:], strict=True):
                    found = shingles(raw[low:high].tobytes(), shingle)
                    names.append(set_name(found) if len(found) else None)
                    signatures.append(signature(found, odd, flip).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(names, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "th", "cls", "sig"])

    each = written(rows.mapInArrow(signed, "doc_id long, th long, cls long, sig binary"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    classes = written(each.where("cls is not null").groupBy("cls").agg(F.min(row).alias("head"), F.count("cls").alias("n"), F.first("sig").alias("sig")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch.column(1), trees, depth)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), t, np.int32)), pa.array(_path(values[:, t, :prefix]))], ["cls", "t", "path"])

    met = classes.select("cls", "sig").mapInArrow(prefixes, "cls long, t int, path long")
    crowd = met.groupBy("t", "path").agg(F.count("cls").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    part = F.pmod(F.xxhash64("cls", "path"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least("part", o).alias("low"), F.greatest("part", o).alias("high")))
    placed = met.join(crowd, ["t", "path"]).withColumn("blocks", blocks).withColumn("part", part)
    placed = placed.select("t", "path", "cls", "part", F.explode(pairs).alias("p")).select("t", "path", "cls", "part", "p.low", "p.high")
    keys = ["t", "path", "low", "high"]

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys):
            needed = np.zeros(len(group), bool)
            for i, j in _close(group, keys, trees, depth, prefix, least_estimate):
                needed[i] = needed[j] = True
            yield from group.filter(pa.array(needed)).to_batches()

    signed_blocks = placed.join(classes.select("cls", "n", "sig"), "cls").select(*keys, "part", "cls", "n", "sig")
    near = written(signed_blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(promising, signed_blocks.schema))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys, 4_000):
            yield from _links(group, keys, trees, depth, prefix, least_estimate, threshold, shingle)

    shown = near.join(classes.select("cls", "head.doc_id", "head.th"), "cls")
    with_text = shown.join(rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "text"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    with_text = with_text.select(*keys, "part", "cls", "n", "sig", "text").repartition(*keys).sortWithinPartitions(*keys)
    found = written(with_text.mapInArrow(verified, "cls long, links long, root long"), near)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    components = connected_components(found, "cls", "root").withColumnRenamed("node", "cls")
    placed_in = classes.join(components, "cls", "left").select("cls", "head", "n", F.coalesce("component", "cls").alias("component"))
    heads = placed_in.groupBy("component").agg(F.min("head").alias("first"))
    known = placed_in.join(heads, "component").join(links, "cls", "left").select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("found_links"))
    own = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("th") == F.col("first.th"))
    return each.drop("sig").join(known, "cls", "left").select(
        "doc_id",
        F.col("th").alias("text_hash"),
        F.coalesce("found_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (F.col("first").isNull() | own).alias("kept"),
        F.col("cls").isNotNull().alias("has_words"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all their columns, without those that `near_documents` doesn't keep; of a repeated row (same id, same text) one.

    Rows without words all stay. Null ids are ids like any others. Empty table: no rows.
    """
    found = near_documents(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash"), "kept", "has_words")
    found = written(found)
    gone = found.where("not kept").select("_near_id", "_near_hash").distinct()
    again = found.where("kept and has_words").groupBy("_near_id", "_near_hash").agg(F.count("kept").alias("n")).where("n > 1").drop("n")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_near_id")) & (F.xxhash64(text_col) == F.col("_near_hash"))
    left = docs.join(gone, same, "left_anti")
    repeated = left.join(again, same).dropDuplicates(["_near_id", "_near_hash"]).select(*docs.columns)
    return left.join(again, same, "left_anti").unionByName(repeated)


def _values(packed: pa.Array, trees: int, depth: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(-1, trees, depth)


def _path(values: np.ndarray) -> np.ndarray:
    """A tree's prefix of up to four 16-bit values as one number."""
    path = np.zeros(len(values), np.int64)
    for k in range(values.shape[1]):
        path = (path << 16) | values[:, k]
    return path


def _close(rows: pa.Table, keys: list[str], trees: int, depth: int, prefix: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each block that meet in no earlier tree and whose signatures agree often enough."""
    values = _values(rows.column("sig").combine_chunks(), trees, depth)
    paths = np.stack([_path(values[:, t, :prefix]) for t in range(trees)], axis=1)
    flat = values.reshape(len(values), -1)
    cls, part, t, low, high = (column(rows, x) for x in ("cls", "part", "t", "low", "high"))
    for i, j in group_pairs(group_starts(rows, keys), len(rows), 100_000):
        keep = (cls[i] != cls[j]) & ((low[i] == high[i]) | (part[i] != part[j]))
        i, j = i[keep], j[keep]
        keep = (paths[i] == paths[j]).argmax(1) == t[i]
        i, j = i[keep], j[keep]
        keep = (flat[i] == flat[j]).mean(1) >= least
        yield i[keep], j[keep]


def _links(rows: pa.Table, keys: list[str], trees: int, depth: int, prefix: int, least: float, threshold: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Sums of links and roots of the pairs of these blocks whose similarity reaches the threshold."""
    starts = group_starts(rows, keys)
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    cls, known, sets, kept = column(rows, "cls"), {}, [], []
    taken: set[tuple[int, int]] = set()
    for i, (c, text) in enumerate(zip(cls.tolist(), rows.column("text").to_pylist(), strict=True)):
        if known.get(c, (None,))[0] != text:
            found = shingles((text or "").encode("utf-8", "surrogatepass"), shingle)
            if not len(found) or set_name(found) != c:
                continue  # where an id has several texts: the text of another set
            known[c] = (text, known[c][1] if c in known else len(sets))
            if known[c][1] == len(sets):
                sets.append(found)
        if (block[i], c) not in taken:
            taken.add((block[i], c))
            kept.append(i)
    rows = rows.take(pa.array(kept, pa.int64())).drop_columns(["text"])
    cls, n = column(rows, "cls"), column(rows, "n")
    distinct = np.unique(cls)
    who = np.searchsorted(distinct, cls)
    place = np.array([known[c][1] for c in cls.tolist()], np.int64)
    total, a_all, b_all = np.zeros(len(distinct), np.int64), [], []
    for i, j in _close(rows, keys, trees, depth, prefix, least):
        linked = similarities(sets, place[i], place[j]) >= threshold
        i, j = i[linked], j[linked]
        np.add.at(total, who[i], n[j])
        np.add.at(total, who[j], n[i])
        a_all.append(who[i])
        b_all.append(who[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
    root = local_roots(len(distinct), a, b)
    out = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(distinct[out]), pa.array(total[out]), pa.array(distinct[root[out]])], ["cls", "links", "root"])


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE c / (n1.n + n2.n - c) >= 0.8::DOUBLE),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.x = l.x),
k AS (SELECT x, min(root) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN k ON k.x = d.doc_id
"""
