"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to `order` bytes. A byte is coded in the longest context that
the tree has; where that context never saw the byte, an escape is coded (method C: as many escapes as distinct
bytes seen) and the next shorter context is tried, down to a uniform code of 8 bits. The counts are frozen, so
a text's code length is a sum over its bytes of a cost that depends on the last `order` + 1 bytes alone: each
distinct (order + 1)-gram of a batch is costed once. Trees too large to broadcast are a table: then the distinct grams of
all texts are costed by joins with it, one for each length of context, and each text sums the costs of its grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.llm.shared import pieces, text_bytes, written

#: Bytes of context; a gram of one byte more must fit a signed 64-bit word.
ORDER = 3
#: Trees of at most so many grams, over all languages, are broadcast; larger ones are joined with the texts' grams.
BROADCAST_GRAMS = 1 << 20
UNDETERMINED = "und"
_LETTER = r"\p{L}"
_START = 0x0A  # what stands before a text


def grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte of the lower-cased texts, big-endian, and the texts' offsets."""
    raw, at = text_bytes(pc.utf8_lower(column.fill_null("")))
    n = len(at) - 1
    lengths = np.diff(at)
    padded = np.full(len(raw) + n * order, _START, np.uint8)
    where = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * order, lengths)
    padded[where] = raw
    codes = np.zeros(len(raw), np.int64)
    for back in range(order, -1, -1):
        codes = (codes << 8) | padded[where - back]
    return codes, at


class ContextTrees:
    """Frozen trees of several languages, as sorted arrays of contexts and grams for each length."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        """counts: for each language, its (order + 1)-grams and how often each was seen."""
        self.order, self.langs = order, sorted(counts)
        self.levels = []
        for lang in self.langs:
            codes, seen = counts[lang]
            levels = []
            for k in range(order, -1, -1):
                found, back = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(back, seen, len(found))
                contexts, inside = np.unique(found >> 8, return_inverse=True)
                total = np.bincount(inside, n, len(contexts))
                distinct = np.bincount(inside, minlength=len(contexts))
                bits = -np.log2(n / (total + distinct)[inside])
                levels.append((k, found, bits, contexts, -np.log2(distinct / (total + distinct))))
            self.levels.append(levels)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the bytes before it; a row for each language."""
        out = np.zeros((len(self.langs), len(codes)))
        for row, levels in zip(out, self.levels, strict=True):
            todo = np.arange(len(codes))
            for k, found, bits, contexts, escape in levels:
                if not len(todo) or not len(found):
                    break
                now = codes[todo] & ((1 << 8 * (k + 1)) - 1)
                i = np.minimum(np.searchsorted(found, now), len(found) - 1)
                hit = found[i] == now
                row[todo[hit]] += bits[i[hit]]
                todo, now = todo[~hit], now[~hit] >> 8
                j = np.minimum(np.searchsorted(contexts, now), len(contexts) - 1)
                known = contexts[j] == now
                row[todo[known]] += escape[j[known]]
            row[todo] += 8.0
        return out

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each text under each language: (texts, languages)."""
        codes, at = grams(column, self.order)
        distinct, back = np.unique(codes, return_inverse=True)
        out = np.zeros((len(at) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            for j, row in enumerate(self.costs(distinct)):
                out[full, j] = np.add.reduceat(row[back], at[:-1][full])
        return out


def gram_counts(docs: DataFrame, text_col: str, lang_col: str, order: int) -> DataFrame:
    """(lang, gram, n) of all rows that have a language: every language and every gram."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                langs = piece.column(1)
                for lang in pc.unique(langs):
                    codes, _ = grams(piece.column(0).filter(pc.equal(langs, lang)), order)
                    found, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

    return rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def identify_language(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; the trees learn from the rows where `train` holds.

    score: the share of the predicted language among all, each weighed by 2 to the minus its bits a byte; so it tells
    how much shorter the code is, whatever the length of the text. Null text or a text without a letter: `und` with
    score 0, and so every text where nothing could be learned. Rows with null language are predicted but not learned
    from. Ties go to the language first by name. Ids only pass through: null or repeated ids and repeated rows give a
    row each. Empty table: no rows. Other columns are ignored. Every language and gram is learned; whether the trees
    are broadcast or joined depends on their counted size, and the results don't.
    """
    counts = written(gram_counts(docs.where(train), text_col, lang_col, order))
    rows = docs.select(F.col(id_col).alias("doc_id"), (~train).alias("held_out"), F.col(text_col).alias("text"))
    found = counts.agg(F.count("gram")).first()[0]
    if not found:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return _by_broadcast(rows, counts, order) if found <= broadcast_grams else _by_joins(rows, counts, order)


def _spoken(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column, _LETTER).fill_null(False).to_numpy(zero_copy_only=False)


def _by_broadcast(rows: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    held = counts.toArrow()
    langs = held.column("lang").combine_chunks().dictionary_encode()
    own = langs.indices.to_numpy()
    gram, n = (held.column(x).to_numpy() for x in ("gram", "n"))
    trees = ContextTrees({lang: (gram[own == k], n[own == k]) for k, lang in enumerate(langs.dictionary.to_pylist())}, order)
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.langs, object)
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                spoken, bits = _spoken(piece.column(2)), shared.value.lengths(piece.column(2))
                size = np.maximum(np.diff(grams(piece.column(2), 0)[1]), 1)
                score = 1 / np.exp2((bits.min(1)[:, None] - bits) / size[:, None]).sum(1)
                best = np.where(spoken, names[bits.argmin(1)], UNDETERMINED)
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(best, pa.string()), pa.array(np.where(spoken, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def gram_costs(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(gram, lang, cost): the bits of each wanted gram's last byte under every language, by a join for each length of context."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    costs = wanted.select("gram", F.explode(F.array(*map(F.lit, langs))).alias("lang")).withColumns({"cost": F.lit(0.0), "open": F.lit(True)})
    for k in range(order, -1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        level = counts.groupBy("lang", suffix.alias("suffix")).agg(F.sum("n").alias("seen"))
        contexts = level.groupBy("lang", F.shiftright("suffix", 8).alias("context")).agg(F.sum("seen").alias("total"), F.count("seen").alias("distinct"))
        costs = costs.withColumn("suffix", suffix).join(level, ["lang", "suffix"], "left").withColumn("context", F.shiftright("suffix", 8)).join(contexts, ["lang", "context"], "left")
        part = F.coalesce("seen", "distinct") / (F.col("total") + F.col("distinct"))
        cost = F.when(F.col("open") & F.col("total").isNotNull(), -F.log2(part)).otherwise(0.0)
        costs = costs.select("gram", "lang", (F.col("cost") + cost).alias("cost"), (F.col("open") & F.col("seen").isNull()).alias("open"))
    return costs.select("gram", "lang", (F.col("cost") + F.when(F.col("open"), 8.0).otherwise(0.0)).alias("cost"))


def _by_joins(rows: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each gram of it."""
        names = ["row", "gram", "n", "doc_id", "held_out", "spoken", "size"]
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                codes, at = grams(piece.column(2), order)
                size, ids = np.diff(at), row + np.arange(len(piece))
                row += len(piece)
                none = pa.nulls(len(piece), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), none, none, *piece.columns[:2], pa.array(_spoken(piece.column(2))), pa.array(size)], names)
                held = pa.table([np.repeat(ids, size), codes], ["row", "gram"]).group_by(["row", "gram"]).aggregate([([], "count_all")])
                own = [pa.nulls(len(held), t) for t in (piece.schema.field(0).type, pa.bool_(), pa.bool_(), pa.int64())]
                yield from pa.table([*(held.column(x) for x in ("row", "gram", "count_all")), *own], names).to_batches()

    parts = written(rows.mapInArrow(spread, f"row long, gram long, n long, doc_id {kind.simpleString()}, held_out boolean, spoken boolean, size long"))
    held = parts.where("gram is not null").select("row", "gram", "n")
    costs = written(gram_costs(held.select("gram").distinct(), counts, order))
    bits = held.join(costs, "gram").groupBy("row", "lang").agg(F.sum(F.col("n") * F.col("cost")).alias("bits"))
    told = bits.groupBy("row").agg(F.min(F.struct("bits", "lang")).alias("best"), F.collect_list("bits").alias("all"))
    texts_ = parts.where("gram is null").select("row", "doc_id", "held_out", "spoken", "size")
    weights = F.transform("all", lambda b: F.pow(F.lit(2.0), (F.col("best.bits") - b) / F.col("size")))
    score = 1 / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return texts_.join(told, "row", "left").select(
        "doc_id", "held_out", F.when(F.col("spoken"), F.col("best.lang")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("spoken"), score).otherwise(0.0).alias("score")
    )


ORACLE = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
crc AS (SELECT doc_id, s, 0 AS pos, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT doc_id, s, pos + 1, list_reduce([xor(c, ascii(substr(s, pos + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) FROM crc WHERE pos < len(s)),
fold AS (SELECT doc_id, xor(c, 4294967295) % 5 AS fold FROM crc WHERE pos = len(s)),
d AS (SELECT row_number() OVER () AS r, x.doc_id, text, lang, fold = 0 AS held_out, hex(encode(lower(coalesce(text, '')))) AS h FROM documents x JOIN fold f ON x.doc_id IS NOT DISTINCT FROM f.doc_id),
p AS (SELECT r, lang, held_out, substr('0A0A0A' || h, 2 * i + 1, 8) AS g FROM (SELECT r, lang, held_out, h, unnest(range(0, len(h) // 2)) AS i FROM d WHERE len(h) > 0)),
c AS (SELECT lang, g, count(*) AS n FROM p WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
l AS (SELECT lang, k, right(g, 2 * k + 2) AS s, sum(n) AS n FROM c, range(0, 4) q(k) GROUP BY ALL),
x AS (SELECT lang, k, left(s, 2 * k) AS s, sum(n) AS t, count(*) AS m FROM l GROUP BY ALL),
w AS (SELECT g, lang FROM (SELECT DISTINCT g FROM p), (SELECT DISTINCT lang FROM c)),
o AS (SELECT w.g, w.lang, coalesce(max(CASE WHEN l.n IS NOT NULL THEN q.k END), -1) AS hit
      FROM w JOIN range(0, 4) q(k) ON true LEFT JOIN l ON l.lang = w.lang AND l.k = q.k AND l.s = right(w.g, 2 * q.k + 2) GROUP BY ALL),
e AS (SELECT o.g, o.lang, sum(CASE WHEN q.k = hit THEN -log2(l.n / (x.t + x.m)) WHEN q.k > hit AND x.t IS NOT NULL THEN -log2(x.m / (x.t + x.m)) ELSE 0 END) + CASE WHEN any_value(hit) < 0 THEN 8 ELSE 0 END AS cost
      FROM o JOIN range(0, 4) q(k) ON true LEFT JOIN l ON l.lang = o.lang AND l.k = q.k AND l.s = right(o.g, 2 * q.k + 2)
      LEFT JOIN x ON x.lang = o.lang AND x.k = q.k AND x.s = left(right(o.g, 2 * q.k + 2), 2 * q.k) GROUP BY o.g, o.lang),
b AS (SELECT r, e.lang, sum(n * cost) AS bits FROM (SELECT r, g, count(*) AS n FROM p GROUP BY ALL) z JOIN e ON z.g = e.g GROUP BY ALL),
t AS (SELECT b.r, first(lang ORDER BY bits, lang) AS best, sum(pow(2.0, (low - bits) / size)) AS total
      FROM b JOIN (SELECT r, min(bits) AS low FROM b GROUP BY r) m ON b.r = m.r JOIN (SELECT r, len(h) / 2 AS size FROM d) z ON b.r = z.r GROUP BY b.r)
SELECT doc_id, held_out, CASE WHEN coalesce(regexp_matches(text, '\p{L}'), false) AND best IS NOT NULL THEN best ELSE 'und' END AS lang_pred,
       CASE WHEN coalesce(regexp_matches(text, '\p{L}'), false) AND best IS NOT NULL THEN round(1 / total, 6) ELSE 0.0 END AS score
FROM d LEFT JOIN t ON d.r = t.r
"""
