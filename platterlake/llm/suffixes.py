"""Exact repeated-substring removal: suffixes ordered through `width` bytes by most-significant-digit passes.

Suffixes that agree in `width` bytes are the repeats; their order beyond that is never needed. A digit is a
fixed run of bytes, compared by its hash (windows by two independent ones, 128 bits), and after each pass groups of
one suffix are done.

Pass 1 takes suffixes at synchronising places only: the place of the least hash of a `gram`-byte digit in each
window. Equal windows have it at equal offsets, so it divides a text into blocks of consecutive windows with one
place each. A block that another block equals whole is removed at once, and the first of its kind stands for the
others; a block whose digit begins no other kind has no repeats. Pass 2 takes the blocks left (the ends of
repeats) in cells of `CELL` windows at fixed offsets from the place, with all the bytes that a cell's windows
share as the digit, and decides cells as pass 1 decides blocks. Pass 3 compares the windows of the cells left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platterlake.llm.shared import pieces, texts

WIDTH, GRAM, CELL = 100, 24, 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: For a second hash of the same bytes.
_OTHER = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_PIECE = 3 << 20
_LAST_ID = (1 << 63) - 1


def _step(h: np.ndarray, word: np.ndarray, k: int, odd: list[np.uint64] = _ODD) -> np.ndarray:
    h = (h ^ word) * odd[k % 3]
    return h ^ (h >> np.uint64(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two that may be equal."""
    return _step(_step(a, _ODD[1], 0), b, 1)


class Digits:
    """Hashes of runs of bytes at any place of a buffer."""

    def __init__(self, raw: np.ndarray):
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(raw) + 1,), "<u8", padded.tobytes(), strides=(1,)).astype(np.uint64)

    def everywhere(self, width: int) -> np.ndarray:
        """Of the `width` bytes (8 at least) from each place on."""
        n = max(len(self.words) - width, 0)
        h = np.full(n, np.uint64(width))
        for k, at in enumerate(self._offsets(width)):
            h = _step(h, self.words[at : at + n], k)
        return _step(h, h >> np.uint64(29), 2)

    def at(self, places: np.ndarray, width: int, odd: list[np.uint64] = _ODD) -> np.ndarray:
        h = np.full(len(places), np.uint64(width + 1))
        for k, at in enumerate(self._offsets(width)):
            h = _step(h, self.words[places + at], k, odd)
        return _step(h, h >> np.uint64(29), 2, odd)

    @staticmethod
    def _offsets(width: int) -> list[int]:
        return [*range(0, width - 8, 8), width - 8]


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each `span` neighbours, by doubling."""
    if len(x) < span:
        return x[:0]
    done = 1
    while done * 2 <= span:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (span - done)], x[span - done :]) if span > done else x


def blocks_of(raw: np.ndarray, at: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Blocks of consecutive windows with one synchronising place: row of the text, first and last window, place, digit, kind."""
    digits = Digits(raw)
    h = digits.everywhere(gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(key, width - gram + 1)
    sizes = np.diff(at)
    inside = np.zeros(len(raw) + 1, np.int32)
    long = np.flatnonzero(sizes >= width)
    inside[at[:-1][long]] += 1
    np.add.at(inside, at[1:][long] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    place = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(windows)) - 1 if len(begin) else begin
    first, final, place = windows[begin], windows[last], place[begin]
    row = np.searchsorted(at, first, "right") - 1
    kind = _join(digits.at(first, width), digits.at(final, width))
    kind = _step(kind, ((final - first) * width + (place - first)).astype(np.uint64), 2)
    return {"row": row, "first": first - at[row], "last": final - at[row], "place": place - at[row], "digit": h[place].view(np.int64), "kind": kind.view(np.int64)}


def _later(doc: np.ndarray, at: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Which entries stand after another of the same names (after: by document, then by place)."""
    order = np.lexsort((at, doc, *names))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[head]) | (at[order] != at[head])
    return later


def _runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring ranges [first, last] of a document made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)
    begin = np.flatnonzero(new)
    return doc[begin], first[begin], last[np.append(begin[1:], len(doc)) - 1] if len(begin) else last


class _Docs:
    """The documents of a piece in order: by id, then by hash of the text. Rows of the same id and text are one."""

    def __init__(self, piece: pa.RecordBatch):
        doc, text = piece.column(0).fill_null(_LAST_ID).to_numpy(), piece.column(1).to_numpy()
        order = np.lexsort((text, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (np.diff(text[order]) != 0)
        self.doc, self.text = doc[order][new], text[order][new]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new) - 1


#: `span` holds, from its 8th bit on, the windows after the first, and in the low bits how far the place is from the first.
_ROW = "digit long, kind long, doc long, hash long, first int, span long"
_PLACE, _DONE = 127, 127


def _rows(docs: _Docs, digit, kind, rank, first, last, ahead) -> pa.RecordBatch:
    span = ((last - first).astype(np.int64) << 7) | ahead
    columns = [digit, kind, docs.doc[rank], docs.text[rank], first.astype(np.int32), span]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digit", "kind", "doc", "hash", "first", "span"])


def _done(docs: _Docs, rank, first, last) -> pa.RecordBatch:
    rank, first, last = _runs(rank, first, last)
    spread = _step(docs.text[rank].view(np.uint64), first.astype(np.uint64), 0).view(np.int64)  # deals them out evenly
    return _rows(docs, spread, spread, rank, first, last, np.full(len(rank), _DONE))


def _decided(docs: _Docs, digit, kind, rank, first, last, ahead) -> Iterator[pa.RecordBatch]:
    """What an earlier entry of the same batch repeats is done; of the rest, one entry of each kind goes on."""
    later = _later(rank, first, digit, kind)
    keep = ~later
    yield _rows(docs, digit[keep], kind[keep], rank[keep], first[keep], last[keep], ahead[keep])
    yield _done(docs, rank[later], first[later], last[later])


def _settled(rows: DataFrame, last_pass: bool = False) -> DataFrame:
    """Per document, its entries that are done (now or before) and those that the next pass has to look into.

    Both windows are served by one shuffle by digit. A digit's rows meet in one task: one for each kind and batch, as a
    batch has settled its own repeats.
    """
    if not last_pass:
        digit = Window.partitionBy("digit")
        rows = rows.withColumn("mixed", F.min("kind").over(digit) != F.max("kind").over(digit))
    place = F.struct("doc", "hash", "first")
    done = (F.col("span").bitwiseAND(_PLACE) == _DONE) | (place > F.min(place).over(Window.partitionBy("digit", "kind")))
    rows = rows.withColumn("done", done)
    rows = rows.where("done") if last_pass else rows.where("done or mixed")
    span = F.when(F.col("done"), F.col("span").bitwiseOR(_DONE)).otherwise(F.col("span"))
    return rows.groupBy("doc", "hash").agg(F.collect_list(F.struct("first", span.alias("span"))).alias("found"))


def _entries(piece: pa.RecordBatch, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Row of the text, first and last window and place of each entry found before; only those the text has room for."""
    lists = piece.column(piece.schema.get_field_index("found"))
    own = np.repeat(np.arange(len(piece)), np.diff(lists.offsets.to_numpy()))
    first, span = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in ("first", "span"))
    last, ahead = first + (span >> 7), span & _PLACE
    fits = at[own] + last + width <= at[own + 1]
    return own[fits], first[fits], last[fits], ahead[fits]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry and the window of each window of the entries."""
    n = last - first + 1
    entry = np.repeat(np.arange(len(n)), n)
    return entry, first[entry] + np.arange(len(entry)) - (np.cumsum(n) - n)[entry]


def with_found(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Documents (id, hash, text) with what was found of them."""
    own = found.select("doc", F.col("hash").alias("_hash"), "found")
    return docs.join(own, (F.coalesce("id", F.lit(_LAST_ID)) == F.col("doc")) & (F.col("hash") == F.col("_hash")), how).select("id", "hash", "text", "found")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(doc, hash, found array<struct<first, span>>): windows of documents (id, hash, text) that also start earlier; a null id comes last.

    Each pass joins the same columns of the documents, so their texts are shuffled once for all.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                b, docs = blocks_of(*texts(piece, "text"), width, gram), _Docs(piece)
                yield from _decided(docs, b["digit"], b["kind"], docs.rank[b["row"]], b["first"], b["last"], b["place"] - b["first"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                raw, at = texts(piece, "text")
                docs = _Docs(piece)
                own, first, last, ahead = _entries(piece, at, width)
                done = ahead == _DONE
                yield _done(docs, docs.rank[own[done]], first[done], last[done])
                own, first, last, place = own[~done], first[~done], last[~done], (first + ahead)[~done]
                grid = (place - first) // cell  # cells are counted back from the place
                entry, number = _spread((place - last) // cell, grid)
                own, place = own[entry], place[entry]
                low = np.maximum(first[entry], place - number * cell - cell + 1)
                high = np.minimum(last[entry], place - number * cell)
                digits, base = Digits(raw), at[own]
                core = _step(digits.at(base + place - number * cell, width - cell + 1), number.astype(np.uint64), 1)
                kind = _join(digits.at(base + low, width), digits.at(base + high, width))
                kind = _step(kind, ((high - low) * width + (place - low)).astype(np.uint64), 2)
                yield from _decided(docs, core.view(np.int64), kind.view(np.int64), docs.rank[own], low, high, place - low)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                raw, at = texts(piece, "text")
                docs = _Docs(piece)
                own, first, last, ahead = _entries(piece, at, width)
                done = ahead == _DONE
                yield _done(docs, docs.rank[own[done]], first[done], last[done])
                entry, start = _spread(first[~done], last[~done])
                own, digits = own[~done][entry], Digits(raw)
                name, other = (digits.at(at[own] + start, width, odd) for odd in (_ODD, _OTHER))
                yield from _decided(docs, other.view(np.int64), name.view(np.int64), docs.rank[own], start, start, np.zeros(len(own), np.int64))

    found = _settled(docs.mapInArrow(blocks, _ROW))
    for step in (cells, windows):
        found = _settled(with_found(docs, found).mapInArrow(step, _ROW), step is windows)
    return found


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array<struct<start, stop>>) for each document row.

    Each byte of a `width`-byte string that also starts earlier goes: in a smaller id, or earlier in the same
    text; strings never cross documents, overlaps count, and all are judged on the input. Null and empty texts
    have no bytes; texts shorter than `width` are kept whole. Null ids come after all others. Rows that share an id
    (or have none) are documents of their own, in order of the hashes of their texts; a repeated row (same id, same
    text) is cut as its twin is. Empty table: no rows. Other columns are ignored.
    """
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("id"), F.xxhash64(own, text_col).alias("hash"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows, width, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, at = texts(piece, "text")
                kept, runs = [], []
                own, first, last, _ = _entries(piece, at, width)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, at[own] + first, 1)
                np.add.at(edge, at[own] + last + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                for low, high in zip(at[:-1], at[1:], strict=True):
                    cut_out = gone[low:high]
                    kept.append(raw[low:high][~cut_out].tobytes())
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], cut_out.astype(np.int8), [0]])))
                    runs.append([{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(at)), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    ["doc_id", "n_bytes", "kept", "spans"],
                )

    return with_found(rows, spans, "left").mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")


def digests(cut: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
f AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, r, i) AS n FROM w) WHERE n > 1),
u AS (SELECT r, i, coalesce(max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) AS prev FROM f),
g AS (SELECT r, i, sum(CASE WHEN i > prev + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM u),
s AS (SELECT r, span, min(i) AS low, max(i) + 100 AS high FROM g GROUP BY r, span),
k AS (SELECT r, low, high, coalesce(max(high) OVER (PARTITION BY r ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_ FROM s),
p AS (SELECT k.r, count(*) AS n_spans, sum(high - low) AS n_removed, string_agg(substr(d.h, 2 * after_ + 1, 2 * (low - after_)), '' ORDER BY low) || substr(any_value(d.h), 2 * max(high) + 1) AS kept
      FROM k JOIN d ON k.r = d.r GROUP BY k.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN p ON d.r = p.r
"""
