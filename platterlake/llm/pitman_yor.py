"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every word of the training texts is a context with a restaurant of its own for the word that follows (the end of a
text is a word, and as a context it is the start of the next). All restaurants share one parent, the restaurant of
words, whose customers are the tables of its children and whose base is uniform over the known words and one unknown.

Seating is sampled by Gibbs steps. The number of tables of a cell (context, word, n customers) is drawn anew from its
exact conditional, given all other cells' tables and the parent without the cell's own tables: a weight
S(n, t) * (strength + discount * T)(...)(strength + discount * (T + t - 1)) * p^t for each t, with S the generalised
Stirling numbers. Cells of one customer have one table; for cells of over `EXACT` customers those numbers come from the
saddle point of their generating function and their scaling limit. A round makes some sweeps over all cells, then the parent's tables are drawn
the same way. In the last round the predictive probabilities of the sweeps after burn-in are averaged, and texts are scored.

How it is dealt out. The `FREQUENT` most frequent words are broadcast with their counts, and their tables after each
round; all other words are rare, by definition no more than one in FREQUENT tokens each. Pairs with a frequent word
go to buckets by context (by the pair, where the context is frequent too), pairs with a rare word to buckets by that
word. So a rare context's cells, or a rare word's tables, are in one bucket and are sampled in sequence; a frequent
context's are spread over all buckets, which take its tables as of the last round. A pair of two rare words is among the cells
of its context's bucket and of its word's. Its tables are drawn at the word, given the context's as of the last round, and handed
back for the next. Only pairs that some sweep could give a second table are handed on: a draw's tables grow with the context's
and with the word's, so one given the most of both that there can be bounds it (`open_pairs`). Other pairs have one table in any
case. Handed numbers go to the buckets by a join; another brings the two buckets together for the scores.

A bucket is a row: sorted cells and the texts that hold them as compressed arrays, so sweeps read it without a shuffle.
The number of buckets grows with the tokens, and each holds about `BUCKET_TOKENS` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.llm.shared import mix64, pieces, texts, whole_groups, written

#: Words whose counts and tables are broadcast: a bound of what reaches the driver and every worker, not of what is learned.
FREQUENT = 1 << 17
STRENGTH = 1.0
ROUNDS, SWEEPS, BURN_IN = 3, 4, 1
FEW, EXACT = 16, 1024
BUCKET_TOKENS = 1 << 18
#: The end's key; frequent words are numbered from 1; rare ones are a hash from RARE on.
END, RARE = 0, 1 << 62
_PIECE, _SLICES = 8 << 20, 16
_GROUP = 12  # neighbouring texts, 4,096 of them, are summed together
_FREQUENT_WORD, _RARE_WORD, _TEXT = 0, 1, 2  # kinds of rows


# --- arrays as bytes ------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, byte k of all of them together."""
    body = b"".join(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    head = np.array([len(a) for a in arrays], np.int64)
    return head.tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack(packed: bytes, count: int) -> list[np.ndarray]:
    sizes = np.frombuffer(packed, np.int64, count)
    body = np.frombuffer(pa.decompress(packed[8 * count :], int(sizes.sum()) * 8, "zstd", asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * 8
    return [np.ascontiguousarray(body[e - 8 * n : e].reshape(8, n).T).view(np.int64).ravel() for e, n in zip(ends, sizes, strict=True)]


# --- seating --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int) -> np.ndarray:
    """log S(n, t) for n, t up to `most`: the weight of seating n customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for n in range(1, most):
        t = np.arange(1, n + 2)
        s[n + 1, t] = np.logaddexp(s[n, t - 1], np.log(np.maximum(n - discount * t, 1e-300)) + s[n, t])
    return s


def cell_keys(context: np.ndarray, word: np.ndarray, seed: int) -> np.ndarray:
    return mix64(mix64(context.astype(np.uint64)) + word.astype(np.uint64) * np.uint64(3)) + np.uint64(seed)


def uniform(keys: np.ndarray, sweep: int, step: int = 0) -> np.ndarray:
    """A number in [0, 1) for each key; it depends on nothing else, so neither does what is drawn."""
    return (mix64(keys + np.uint64(sweep << 32 | step)) >> np.uint64(11)) * 2.0**-53


def draw(n: np.ndarray, outside: np.ndarray, p: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of cells of n customers each (1 at least), `outside` tables being elsewhere in the restaurant."""
    out = np.ones(len(n), np.int64)
    small = np.flatnonzero((n > 1) & (n <= EXACT))
    if len(small):
        at_random = uniform(keys, sweep)
        two = small[n[small] == 2]
        once, twice = 1 - discount, (STRENGTH + discount * (outside[two] + 1)) * p[two]
        out[two] += once <= at_random[two] * (once + twice)
        for least, most in ((3, 4), (5, FEW)):  # by products, all sizes together: S(n, t) is 0 for t > n
            cells_of = small[(n[small] >= least) & (n[small] <= most)]
            s = np.exp(log_stirling(discount, FEW)[:, 1 : most + 1]) if len(cells_of) else None
            for at in range(0, len(cells_of), (1 << 19) // most):
                cells = cells_of[at : at + (1 << 19) // most]
                opened = (STRENGTH + discount * (outside[cells, None] + np.arange(most))) * p[cells, None]
                total = np.cumsum(s[n[cells]] * np.cumprod(opened, axis=1), axis=1)
                out[cells] = 1 + (total <= at_random[cells, None] * total[:, -1:]).sum(1)
        small = small[n[small] > FEW]
    if len(small):
        by_n = small[np.argsort(n[small], kind="stable")]
        most = int(n[by_n[-1]])
        log_s = log_stirling(discount, next(m for m in (128, EXACT) if m >= most))
        begin = np.flatnonzero(np.diff(n[by_n], prepend=0))
        for low, high in zip(begin, np.append(begin[1:], len(by_n)), strict=True):
            k = int(n[by_n[low]])
            for at in range(low, high, max(1, (1 << 19) // k)):
                cells = by_n[at : min(high, at + max(1, (1 << 19) // k))]
                opened = np.log(STRENGTH + discount * (outside[cells, None] + np.arange(k))) + np.log(p[cells, None])
                weight = log_s[k, 1 : k + 1] + np.cumsum(opened, axis=1)
                total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
                out[cells] = 1 + (total[:, :-1] <= at_random[cells, None] * total[:, -1:]).sum(1)
    for i in np.flatnonzero(n > EXACT):
        u, v = (uniform(keys[i : i + 1], sweep, step)[0] for step in (0, 1))
        out[i] = _draw_large(int(n[i]), int(outside[i]), float(p[i]), discount, u, v)
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 0, by Stirling's series 8 places on."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return series - sum(np.log(x + k) for k in range(8))


@lru_cache(maxsize=4)
def _saddles(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """For log(n / t), the log of 1 - z at the saddle point of (1 - (1 - z)^discount)^t / z^n."""
    log_q = -np.geomspace(1e-7, 400, 60_000)
    ratio = discount * -np.expm1(log_q) * np.exp((discount - 1) * log_q) / -np.expm1(discount * log_q)
    return np.log(ratio), log_q


def _by_saddle(n: int, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(n, t) * Gamma(t) * discount^t by the saddle point of the generating function."""
    x = np.interp(np.log(n / t), *_saddles(discount))
    z, f, f1, f2 = -np.expm1(x), -np.expm1(discount * x), discount * np.exp((discount - 1) * x), discount * (1 - discount) * np.exp((discount - 2) * x)
    r = z * f1 / f
    spread = np.maximum(t * (r + z * z * f2 / f - r * r), 1e-300)
    return log_gamma(np.float64(n + 1)) - np.log(t) + t * np.log(f) - n * np.log(z) - 0.5 * np.log(2 * np.pi * spread)


@lru_cache(maxsize=4)
def _scaled_stirling(discount: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For t / most^discount: log S(most, t) * Gamma(t) * discount^t, and by how much the saddle point misses it."""
    t = np.arange(1, most // 2 + 1).astype(float)
    exact = log_stirling(discount, most)[most, 1 : len(t) + 1] + log_gamma(t) + t * np.log(discount)
    return t / most**discount, exact, exact - _by_saddle(most, t, discount)


def log_stirling_large(n: int, t: np.ndarray, discount: float, most: int = EXACT) -> np.ndarray:
    """log S(n, t) * Gamma(t) * discount^t for n over `most`, but for a constant.

    Where t / n^discount is small, it is a function of that alone, in the limit of large n; elsewhere the saddle point
    gives it but for an error that is a function of that, too. Both functions are read from the exact numbers at n = most.
    """
    at, exact, missed = _scaled_stirling(discount, most)
    scaled, turn = t / n**discount, at[int(most**0.5)]
    here = np.array([turn * n**discount])
    shift = _by_saddle(n, here, discount)[0] + np.interp(turn, at, missed) - np.interp(turn, at, exact)
    return np.where(scaled <= turn, np.interp(scaled, at, exact) + shift, _by_saddle(n, t, discount) + np.interp(scaled, at, missed, right=0.0))


def _draw_large(n: int, outside: int, p: float, discount: float, u: float, v: float, most: int = EXACT) -> int:
    """Tables of one cell of more than `most` customers, from two random numbers; where there are thousands, from steps of even length."""

    def weight(t: np.ndarray) -> np.ndarray:
        return log_stirling_large(n, t, discount, most) + log_gamma(STRENGTH / discount + outside + t) - log_gamma(t) + t * np.log(p)

    coarse = np.unique(np.floor(np.geomspace(1, n, 256)))
    found = weight(coarse)
    near = np.flatnonzero(found > found.max() - 40)
    low, high = coarse[max(near[0] - 1, 0)], coarse[min(near[-1] + 1, len(coarse) - 1)]
    step = max(1, int((high - low) // 2048))
    t = np.arange(low, high + 1, step)
    w = weight(t)
    total = np.cumsum(np.exp(w - w.max()))
    return min(n, int(t[min(np.searchsorted(total, u * total[-1], "right"), len(t) - 1)] + int(v * step)))


def discount_of(once: float, twice: float) -> float:
    return float(np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.95))


@dataclass
class State:
    """What all tasks share: counts of the frequent words (by number; the end is 0), and their tables as of the last round."""

    hashes: np.ndarray  # of the frequent words, in order of their numbers from 1
    counts: np.ndarray
    total: int  # training tokens
    distinct: int
    buckets: int
    seed: int
    most_rare: int = 0  # the most training tokens that a rare word can have
    context_tables: np.ndarray | None = None  # of each frequent word as a context
    word_tables: np.ndarray | None = None  # of each frequent word in all contexts: the parent's customers
    own_tables: np.ndarray | None = None  # the parent's tables of it
    all_tables: int = 0  # the parent's customers
    all_own: int = 0
    discount: float = 0.5
    parent_discount: float = 0.5
    round: int = 0

    @property
    def rare_buckets(self) -> int:
        return max(1, self.buckets // 8)

    def parent(self, tables: np.ndarray, own: np.ndarray, without: np.ndarray | int = 0) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there, `without` some of the customers."""
        fresh = (STRENGTH + self.parent_discount * self.all_own) / (self.distinct + 1)
        return (np.maximum(tables - without - self.parent_discount * own, 0) + fresh) / (STRENGTH + self.all_tables)

    def base(self, count):
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


@dataclass
class Handed:
    """Pairs of two rare words that may have more than one table: their cells in a bucket, and what the other bucket says.

    That is their tables for the context's bucket, the context's other tables for the word's.
    """

    at: np.ndarray
    value: np.ndarray


def open_pairs(u: np.ndarray, w: np.ndarray, n: np.ndarray, s: State, rounds: int) -> np.ndarray:
    """Cells of two rare words (of a bucket of rare words) to which a sweep of any round could give a second table."""
    at = np.flatnonzero((u >= RARE) & (w >= RARE) & (n > 1))
    if not len(at):
        return at
    of = np.unique(w, return_inverse=True)[1]
    p = (np.bincount(of, n)[of[at]] + (STRENGTH + s.parent_discount * s.total) / (s.distinct + 1)) / (STRENGTH + s.all_tables)
    keys, outside = cell_keys(u[at], w[at], s.seed), np.full(len(at), s.most_rare)
    can = n[at] > EXACT
    few = np.where(can, 1, n[at])
    for sweep in range(rounds * SWEEPS):
        can |= draw(few, outside, p, s.discount, keys, sweep) > 1
    return at[can]


def sweeps(kind: int, u: np.ndarray, w: np.ndarray, n: np.ndarray, s: State, handed: Handed | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of a bucket's cells (sorted by context) after each sweep, with sums of tables.

    Of frequent words' pairs: (tables, tables of each restaurant, -); of rare words' pairs: (tables, each word's
    tables in all contexts, the parent's tables of it).
    """
    t = (n > 0).astype(np.int64)
    if handed and kind == _FREQUENT_WORD:
        t[handed.at] = handed.value
    keys = cell_keys(u, w, s.seed)
    rare_u, rare_w = u >= RARE, w >= RARE
    own_u = np.where(rare_u, 0, u)
    todo = np.flatnonzero((n > 1) & ~(rare_u & rare_w))
    if kind == _FREQUENT_WORD:
        new = np.diff(u, prepend=-1) != 0
        of = np.cumsum(new) - 1
        tables = np.bincount(of, t).astype(np.int64)
        spread, local = todo[~rare_u[todo]], todo[rare_u[todo]]
        place = np.arange(len(local)) - np.searchsorted(of[local], of[local])  # in its restaurant
        turns = [local[place == k] for k in range(place.max() + 1 if len(place) else 0)]
        known, seen = s.word_tables[np.where(rare_w, 0, w)], s.own_tables[np.where(rare_w, 0, w)]
        for k in range(SWEEPS):
            for at, is_local in [(spread, False), *((x, True) for x in turns)]:
                outside = np.maximum((tables[of[at]] if is_local else s.context_tables[u[at]]) - t[at], 0)
                now = draw(n[at], outside, s.parent(known[at], seen[at], t[at]), s.discount, keys[at], s.round * SWEEPS + k)
                if is_local:
                    tables[of[at]] += now - t[at]
                t[at] = now
            yield t, tables, of
    else:
        others = np.full(len(n), -1)
        if handed:
            others[handed.at] = handed.value
            todo = np.union1d(todo, handed.at)
        others = others[todo]
        words, of = np.unique(w, return_inverse=True)
        tables = np.bincount(of, t, len(words)).astype(np.int64)
        own, known = np.minimum(tables, 1), np.flatnonzero(tables)
        word_keys = cell_keys(words, words, s.seed)
        for k in range(SWEEPS):
            outside = np.where(others < 0, np.maximum(s.context_tables[own_u[todo]] - t[todo], 0), others)
            p = s.parent(tables[of[todo]], own[of[todo]], t[todo])
            t[todo] = draw(n[todo], outside, p, s.discount, keys[todo], s.round * SWEEPS + k)
            tables = np.bincount(of, t, len(words)).astype(np.int64)
            flat = np.full(len(known), 1 / (s.distinct + 1))
            own[known] = draw(tables[known], np.maximum(s.all_own - own[known], 0), flat, s.parent_discount, word_keys[known], s.round * SWEEPS + k)
            yield t, tables, own


# --- words ----------------------------------------------------------------------------------------------------


def token_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of all words (A-Z in lower case, split at ASCII white space), and how many each text has."""
    found, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
        words = raw[low:high].tobytes().lower().split()
        sizes[i] = len(words)
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return (np.concatenate(found) >> np.uint64(2)).astype(np.int64) if found else np.zeros(0, np.int64), sizes


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all texts, by hash; the end is word -1."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                found, n = np.unique(token_hashes(*texts(piece, "text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(n, len(piece)))], ["word", "n"])

    return train.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(words: DataFrame, most: int) -> pd.DataFrame:
    """At most `most` words, the most frequent first.

    Words of near counts fall in a bucket; whole buckets are taken from the top, as many as fit. So only buckets
    and taken words reach the driver, however many tasks there are.
    """
    bucket = F.floor(F.log2("n") * 32).cast("int")
    sizes = words.groupBy(bucket.alias("bucket")).agg(F.count("n").alias("words")).toPandas().sort_values("bucket", ascending=False)
    fits = sizes["bucket"][sizes["words"].cumsum() <= most]
    taken = words.where(bucket >= int(fits.min())) if len(fits) else words.limit(0)
    return taken.toPandas().sort_values(["n", "word"], ascending=[False, True])


def learn_words(train: DataFrame, frequent: int, bucket_tokens: int, seed: int) -> State:
    counts = written(word_counts(train))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n"), F.coalesce(F.sum(F.when(F.col("word") == -1, F.col("n"))), F.lit(0))).first()
    top = _most_frequent(counts.where("word >= 0"), frequent)
    number = np.concatenate([[ends], top["n"].to_numpy(np.int64)])
    return State(top["word"].to_numpy(np.int64), number, int(total), int(distinct), max(1, -(-int(total) // bucket_tokens)), seed, int(top["n"].min()) if len(top) else int(total))


# --- buckets --------------------------------------------------------------------------------------------------


def bucketed(rows: DataFrame, shared) -> DataFrame:
    """Rows of buckets (kind, cells, texts), and a row for each text (kind 2) with what its frequent words make known.

    cells: contexts, words, training counts and numbers of texts that hold the pair, sorted; texts: their rows and how
    often each holds the pair, in the cells' order. Pairs of two rare words are among the cells of both kinds, with their
    texts at the word's.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: State = shared.value
        sort = np.argsort(s.hashes)
        hashes, numbers = s.hashes[sort], sort + 1
        base, known = s.base(s.counts), s.counts > 0
        next_row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                h, sizes = token_hashes(*texts(piece, "text"))
                distinct, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(hashes, distinct), max(len(hashes) - 1, 0))
                keys = np.where(hashes[at] == distinct, numbers[at], distinct | RARE) if len(hashes) else distinct | RARE
                order = np.argsort(keys)
                place = np.empty(len(keys), np.int64)
                place[order] = np.arange(1, len(keys) + 1)
                words = np.concatenate([[END], keys[order]])  # of this piece, sorted; pairs are sorted by their places here
                ends = np.cumsum(sizes + 1) - 1
                own = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
                own[np.delete(np.arange(len(own)), ends)] = place[back]
                before = np.concatenate([[END], own[:-1]])
                u, w = words[before], words[own]
                doc = np.repeat(np.arange(len(piece)), sizes + 1)
                row = next_row + np.arange(len(piece))
                next_row += len(piece)
                easy = w < RARE
                kept = [np.bincount(doc[easy], x[w[easy]], len(piece)) for x in (known, base)]
                spread = (mix64(row.astype(np.uint64)) % np.uint64(s.buckets)).astype(np.int64)
                yield _batch(_TEXT, spread, None, row, piece.column(0), piece.column(1), pa.array(sizes + 1), *map(pa.array, kept))

                by = np.where(easy, np.where(u < RARE, cell_keys(u, w, 0), mix64(u.astype(np.uint64))), mix64(w.astype(np.uint64)))
                bucket = (by % np.where(easy, np.uint64(s.buckets), np.uint64(s.rare_buckets))).astype(np.int64) + np.where(easy, 0, s.buckets)
                learned = ~piece.column(1).to_numpy(zero_copy_only=False)[doc]
                yield from _blocks(bucket, before, own, words, doc, learned, row)
                both = np.flatnonzero(~easy & (u >= RARE))
                yield from _blocks((mix64(u[both].astype(np.uint64)) % np.uint64(s.buckets)).astype(np.int64), before[both], own[both], words, doc[both], learned[both], None)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["kind", "bucket"], 1_000):
            kind, bucket = (group.column(x).to_numpy() for x in ("kind", "bucket"))
            yield from group.filter(pa.array(kind == _TEXT)).append_column("texts", pa.nulls(int((kind == _TEXT).sum()), pa.binary())).to_batches()
            ids = kind * np.int64(1 << 40) + bucket
            for name in np.unique(ids[kind != _TEXT]):
                at = np.flatnonzero(ids == name)
                cells, held = _merge([unpack(x.as_py(), 6) for x in group.column("cells").take(pa.array(at))])
                found = _batch(int(kind[at[0]]), bucket[at[:1]], [pack(*cells)], *[None] * 6)
                yield found.append_column("texts", pa.array([pack(*held)], pa.binary()))

    spread = rows.select("doc_id", "held_out", "text").mapInArrow(blocks, _ROW)
    return written(spread.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(merged, f"{_ROW}, texts binary"), by="kind")


_ROW = "kind int, bucket long, cells binary, row long, doc_id long, held_out boolean, tokens long, known double, base double"


def _batch(kind: int, bucket: np.ndarray, cells, row, doc_id, held_out, tokens, known, base) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()]
    columns = [np.full(len(bucket), kind), bucket, cells, row, doc_id, held_out, tokens, known, base]
    made = [pa.nulls(len(bucket), k) if c is None else pa.array(c, k) if isinstance(c, (np.ndarray, list)) else c.cast(k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in _ROW.split(", ")])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _blocks(bucket: np.ndarray, u: np.ndarray, w: np.ndarray, words: np.ndarray, doc: np.ndarray, learned: np.ndarray, row: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of a piece's pairs (places in `words`); without `row`, the texts that hold them are left out."""
    if not len(u):
        return
    if len(words) < 1 << 21 and int(bucket.max()) < 1 << 22:  # one number then
        order = np.argsort(bucket << 42 | u << 21 | w, kind="stable")  # keeps the order of texts
    else:
        order = np.lexsort((w, u, bucket))
    bucket, u, w, doc, learned = bucket[order], words[u[order]], words[w[order]], doc[order], learned[order]
    cell = _runs(bucket, u, w)
    n = np.add.reduceat(learned.astype(np.int64), cell)
    if row is None:
        texts_of, often, many = (np.zeros(0, np.int64),) * 2 + (np.zeros(len(cell), np.int64),)
    else:
        entry = _runs(bucket, u, w, doc)
        texts_of, often = row[doc[entry]], np.diff(np.append(entry, len(u)))
        many = np.diff(np.append(np.searchsorted(entry, cell), len(entry)))
    edges = np.flatnonzero(np.diff(bucket[cell], prepend=-1))
    first = np.concatenate([[0], np.cumsum(many)])
    packed = []
    for low, high in zip(edges, np.append(edges[1:], len(cell)), strict=True):
        held = slice(first[low], first[high])
        packed.append(pack(u[cell[low:high]], w[cell[low:high]], n[low:high], many[low:high], texts_of[held], often[held]))
    own, rare = bucket[cell[edges]], (w[cell[edges]] >= RARE) & (row is not None)  # a bucket's pairs are of one kind
    for kind in (_FREQUENT_WORD, _RARE_WORD):
        at = np.flatnonzero(rare == (kind == _RARE_WORD))
        if len(at):
            yield _batch(kind, own[at], [packed[k] for k in at], *[None] * 6)


def _merge(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    u, w, n, many, held, often = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((w, u))
    cell = _runs(u[order], w[order])
    number = np.empty(len(u), np.int32)
    number[order] = np.repeat(np.arange(len(cell), dtype=np.int32), np.diff(np.append(cell, len(u))))
    of = np.argsort(np.repeat(number, many), kind="stable")
    u, w, n, many = (x[order] for x in (u, w, n, many))
    return [u[cell], w[cell], np.add.reduceat(n, cell), np.add.reduceat(many, cell)], [held[of], often[of]]


# --- sampling and scoring -------------------------------------------------------------------------------------


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], bytes | None, Handed | None]]:
    """Of rows (kind, cells, links[, texts])."""
    for batch in batches:
        held = batch.column(3) if batch.num_columns > 3 else None
        for i, (kind, cells, links) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)):
            u, w, n, many = unpack(cells.as_py(), 4)
            yield kind, [u, w, n, many], held[i].as_py() if held is not None else None, _handed(u, w, links)


def _handed(u: np.ndarray, w: np.ndarray, links: list[bytes] | None) -> Handed | None:
    """Where the linked pairs are among cells sorted by context and word."""
    if not links:
        return None
    of_u, of_w, value = (np.concatenate(x) for x in zip(*(unpack(x, 3) for x in links), strict=True))
    low, high = np.searchsorted(u, of_u), np.searchsorted(u, of_u, "right")
    at = np.array([a + np.searchsorted(w[a:b], x) for a, b, x in zip(low, high, of_w, strict=True)], np.int64)
    order = np.argsort(at)
    return Handed(at[order], value[order])


def _links(kind: int, u: np.ndarray, w: np.ndarray, value: np.ndarray, s: State) -> Iterator[pa.RecordBatch]:
    """What a bucket hands on of its pairs: a row for each bucket of the other kind."""
    to = mix64((w if kind == _FREQUENT_WORD else u).astype(np.uint64)) % np.uint64(s.rare_buckets if kind == _FREQUENT_WORD else s.buckets)
    to = to.astype(np.int64) + (s.buckets if kind == _FREQUENT_WORD else 0)
    found = np.unique(to)
    packed = [pack(u[to == b], w[to == b], value[to == b]) for b in found]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(packed, pa.binary()), pa.array(np.full(len(found), _RARE_WORD + _FREQUENT_WORD - kind), pa.int32()), pa.array(found)], _LINKS)


_LINKS = ["slice", "tables", "kind", "bucket"]
_LINK_ROW = "slice long, tables binary, kind int, bucket long"


def linked(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    """The buckets with what others handed them (`links`); few of them do, or the join is a shuffle."""
    if links is None:
        return buckets.withColumn("links", F.lit(None).cast("array<binary>"))
    mine = links.where("slice is null").groupBy("kind", "bucket").agg(F.collect_list("tables").alias("links"))
    return buckets.join(mine, ["kind", "bucket"], "left")


def first_links(buckets: DataFrame, shared, rounds: int) -> DataFrame | None:
    """The open pairs with their contexts' other tables, one for each cell, handed to the words' buckets, and one table each to the contexts'. None where there are none."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (u, w, n, _), _, _ in _each(batches):
            at = open_pairs(u, w, n, shared.value, rounds)
            yield from _links(kind, u[at], w[at], np.ones(len(at), np.int64), shared.value)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (u, w, n, _), _, handed in _each(batches):
            of = np.unique(u, return_inverse=True)[1]
            at = handed.at
            yield from _links(kind, u[at], w[at], np.bincount(of, n > 0).astype(np.int64)[of[at]] - 1, shared.value)

    cells = linked(buckets.where(f"kind = {_RARE_WORD}"), None).select("kind", "cells", "links")
    ones = written(cells.mapInArrow(opened, _LINK_ROW))
    if ones.isEmpty():
        return None
    contexts = linked(buckets.where(f"kind = {_FREQUENT_WORD}"), ones).where("links is not null").select("kind", "cells", "links")
    return ones.unionByName(written(contexts.mapInArrow(others, _LINK_ROW)))


def round_sums(buckets: DataFrame, shared, sample: bool, links: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame | None]:
    """Tables of frequent contexts and of frequent words after a round's last sweep (one a cell, where none is sampled), sums, and links for the next round.

    The sums: cells of one and of two customers; rare words of one and of two tables; rare words' tables, and the parent's of them.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: State = shared.value
        of_context, of_word, sums = np.zeros(len(s.counts), np.int64), np.zeros(len(s.counts), np.int64), np.zeros(6, np.int64)
        for kind, (u, w, n, _), _, handed in _each(batches):
            t, tables, own = (n > 0).astype(np.int64), None, None
            for t, tables, own in sweeps(kind, u, w, n, s, handed) if sample else ():
                pass
            if handed:
                at = handed.at
                yield from _links(kind, u[at], w[at], tables[own[at]] - t[at] if kind == _FREQUENT_WORD else t[at], s)
            if kind == _RARE_WORD:
                if not sample:
                    tables = np.bincount(np.unique(w, return_inverse=True)[1], t).astype(np.int64)
                    own = np.minimum(tables, 1)
                sums[2:] += ((tables == 1).sum(), (tables == 2).sum(), tables.sum(), own.sum())
            else:
                easy = w < RARE
                of_word += np.bincount(w[easy], t[easy], len(of_word)).astype(np.int64)
            told = (w < RARE) == (kind == _FREQUENT_WORD)  # a pair of two rare words is told of once
            sums[:2] += ((n[told] == 1).sum(), (n[told] == 2).sum())
            easy = u < RARE
            of_context += np.bincount(u[easy], t[easy], len(of_context)).astype(np.int64)
        for k, (a, b) in enumerate(zip(np.array_split(of_context, _SLICES), np.array_split(of_word, _SLICES), strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pack(a, b, sums if k == 0 else sums * 0)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], _LINKS)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpack(packed, 3)
                totals[k] = [a + b for a, b in zip(totals[k], x, strict=True)] if k in totals else x
        for k, x in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pack(*x)], pa.binary())], ["slice", "tables"])

    cells = linked(buckets.where(f"kind <> {_TEXT}"), links).select("kind", "cells", "links").mapInArrow(summed, _LINK_ROW)
    cells = cells if links is None else written(cells)
    rows = cells.where("slice is not null").select("slice", "tables").repartition(_SLICES, "slice").mapInArrow(added, "slice long, tables binary").collect()
    after = None if links is None else cells
    found = {r["slice"]: unpack(bytes(r["tables"]), 3) for r in rows}
    if not found:
        return np.zeros(len(shared.value.counts), np.int64), np.zeros(len(shared.value.counts), np.int64), np.zeros(6, np.int64), after
    return np.concatenate([found[k][0] for k in range(_SLICES)]), np.concatenate([found[k][1] for k in range(_SLICES)]), found[0][2], after


def seat_words(s: State) -> State:
    """The parent's tables of the frequent words, given their customers."""
    at = np.flatnonzero(s.word_tables)
    own = s.own_tables.copy()
    keys = cell_keys(at, at, s.seed)
    flat = np.full(len(at), 1 / (s.distinct + 1))
    own[at] = draw(s.word_tables[at], np.maximum(s.all_own - own[at], 0), flat, s.parent_discount, keys, s.round)
    return replace(s, own_tables=np.where(s.word_tables > 0, own, 0))


def sample(buckets: DataFrame, s: State, rounds: int) -> tuple[State, DataFrame | None]:
    """The state before the last round, and the links: one table for each cell at first, then `rounds` - 1 rounds."""
    context = buckets.sparkSession.sparkContext
    of_context, of_word, sums, _ = round_sums(buckets, context.broadcast(s), sample=False)
    own = np.minimum(of_word, 1)
    of_words = [int(sums[2 + k] + (of_word[1:] == k + 1).sum()) for k in range(2)]
    s = replace(s, discount=discount_of(*sums[:2]), parent_discount=discount_of(*of_words), context_tables=of_context, word_tables=of_word, own_tables=own, all_tables=int(of_word.sum() + sums[4]), all_own=int(own.sum() + sums[5]))
    links = first_links(buckets, context.broadcast(s), rounds)
    s = seat_words(s)
    for k in range(rounds - 1):
        s = replace(s, round=k, all_own=int(s.own_tables.sum() + sums[5]))
        of_context, of_word, sums, links = round_sums(buckets, context.broadcast(s), True, links)
        s = seat_words(replace(s, round=k + 1, context_tables=of_context, word_tables=of_word, own_tables=np.minimum(np.maximum(s.own_tables, 1), of_word), all_tables=int(of_word.sum() + sums[4])))
    return replace(s, round=rounds - 1, all_own=int(s.own_tables.sum() + sums[5])), links


class _TextSums:
    """Sums by text, handed on as a row for each group of neighbouring texts when there are many."""

    def __init__(self, most: int = 1 << 21):
        self.parts, self.held, self.most = [], 0, most

    def add(self, rows: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((rows, *values))
        self.held += len(rows)
        if self.held > self.most:
            yield from self.done()

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            found, of = np.unique(rows, return_inverse=True)
            totals = [np.bincount(of, x).view(np.int64) for x in values]
            group = found >> _GROUP
            first = _runs(group)
            slices = [slice(low, high) for low, high in zip(first, np.append(first[1:], len(found)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array([pack(found[x], *(t[x] for t in totals)) for x in slices], pa.binary())], ["group", "sums"])
        self.parts, self.held = [], 0


def finished(parts: DataFrame) -> DataFrame:
    """(doc_id, held_out, tokens, known, base, score) of texts (group, row, ...), their packed sums, and rows of single sums."""
    names = ["group", "row", "doc_id", "held_out", "tokens", "known", "base", "score", "sums"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["group"], 4_000):
            told = rows.filter(rows.column("tokens").is_valid()).sort_by("row")
            at = told.column("row").to_numpy()
            total = [told.column(x).to_numpy().copy() for x in ("known", "base")] + [np.zeros(len(at))]
            single = rows.filter(pa.compute.and_(rows.column("tokens").is_null(), rows.column("sums").is_null()))
            np.add.at(total[2], np.searchsorted(at, single.column("row").to_numpy()), single.column("score").to_numpy())
            for packed in rows.column("sums").drop_null():
                own, *values = unpack(packed.as_py(), 4)
                for x, v in zip(total, values, strict=True):
                    x[np.searchsorted(at, own)] += v.view(np.float64)  # a text stands once in it
            columns = [told.column(x) for x in ("doc_id", "held_out", "tokens")] + [pa.array(x) for x in total]
            yield from pa.table(columns, ["doc_id", "held_out", "tokens", "known", "base", "score"]).to_batches()

    in_order = parts.select(*names).repartition("group").sortWithinPartitions("group")
    return in_order.mapInArrow(added, "doc_id long, held_out boolean, tokens long, known double, base double, score double")


def _averages(kind: int, u: np.ndarray, w: np.ndarray, n: np.ndarray, s: State, handed: Handed | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the sweeps after burn-in, for each cell: its own share, what its context leaves to the parent, the parent's share; and the context's customers (of a rare context only at its own bucket, else 0)."""
    rare_u = u >= RARE
    known_u = np.where(rare_u, 0, u)
    customers, tables_u = np.where(rare_u, 0, s.counts[known_u]), np.where(rare_u, 0, s.context_tables[known_u])
    kept = SWEEPS - BURN_IN
    share, left, p = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    if kind == _FREQUENT_WORD:
        of = np.cumsum(np.diff(u, prepend=-1) != 0) - 1
        customers = np.where(rare_u, np.bincount(of, n)[of] if len(n) else n.astype(float), customers)
        p = s.parent(s.word_tables[np.where(w >= RARE, 0, w)], s.own_tables[np.where(w >= RARE, 0, w)])
    of_word = np.unique(w, return_inverse=True)[1] if kind == _RARE_WORD else None
    for k, (t, tables, own) in enumerate(sweeps(kind, u, w, n, s, handed)):
        if k >= BURN_IN:
            share += (n - s.discount * t) / kept
            if kind == _FREQUENT_WORD:
                left += (STRENGTH + s.discount * np.where(rare_u, tables[own], tables_u)) / kept
            else:
                p += s.parent(tables, own)[of_word] / kept
    if kind == _RARE_WORD:
        left += STRENGTH + s.discount * tables_u
    return share / (STRENGTH + customers), left / (STRENGTH + customers), p, customers


def score_buckets(buckets: DataFrame, shared, links: DataFrame | None = None) -> DataFrame:
    """Rows of sums over texts of what the buckets make known: (group, sums) of many texts, (group, row, score) of one."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sums = shared.value, _TextSums()
        for kind, (u, w, n, many), held, handed in _each(batches):
            rows, often = unpack(held, 2)
            share, left, p, _ = _averages(kind, u, w, n, s, handed)
            ready = ~((u >= RARE) & (w >= RARE))
            score = np.where(ready, np.log10(np.where(ready, share + left * p, 1.0)), 0.0)
            known = base = np.zeros(len(n))
            if kind == _RARE_WORD:
                of = np.unique(w, return_inverse=True)[1]
                count = np.bincount(of, n)[of]
                known, base = (count > 0).astype(float), s.base(count)
            yield from sums.add(rows, *(np.repeat(x, many) * often for x in (known, base, score)))
        yield from sums.done()

    def rare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (u, w, n, _), _, handed in _each(batches):
            low = np.searchsorted(u, RARE)  # the rare ones are the last
            u, w, n = (x[low:] for x in (u, w, n))
            _, left, _, customers = _averages(kind, u, w, n, shared.value, handed and Handed(handed.at - low, handed.value))
            at = np.flatnonzero(w >= RARE)
            at = at[_runs(u[at])] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(left[at]), pa.array(customers[at])], ["u", "left", "customers"])

    def rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (u, w, n, many), held, handed in _each(batches):
            rows, often = unpack(held, 2)
            share, _, p, _ = _averages(kind, u, w, n, shared.value, handed)
            at = np.repeat(np.arange(len(u)), many)
            both = (u[at] >= RARE) & (w[at] >= RARE)
            at = at[both]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u[at], share[at] * STRENGTH, p[at], rows[both], often[both])], ["u", "share", "p", "row", "often"])

    buckets = linked(buckets.where(f"kind <> {_TEXT}"), links)
    frequent, rare = buckets.where(f"kind = {_FREQUENT_WORD}"), buckets.where(f"kind = {_RARE_WORD}")
    whole = buckets.select("kind", "cells", "links", "texts").mapInArrow(scored, "group long, sums binary")
    contexts = frequent.select("kind", "cells", "links").mapInArrow(rare_contexts, "u long, left double, customers double")
    pairs = rare.select("kind", "cells", "links", "texts").mapInArrow(rare_pairs, "u long, share double, p double, row long, often long").join(contexts, "u", "left")
    own = F.coalesce(F.col("share") / (STRENGTH + F.col("customers")), F.lit(0.0))
    score = F.col("often") * F.log10(own + F.coalesce("left", F.lit(1.0)) * F.col("p"))
    return whole.unionByName(pairs.select(F.shiftright("row", _GROUP).alias("group"), "row", score.alias("score")), allowMissingColumns=True)


def score_texts(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS, bucket_tokens: int = BUCKET_TOKENS, seed: int = 0
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; the model learns where `train` holds.

    Words are told apart by 62 bits of a hash. Null and empty texts are an end alone. Null and shared ids: a row each,
    as for a repeated row. Without training rows both scores stay defined (every word is unseen). Empty table: no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (~train).alias("held_out"))
    spark = docs.sparkSession.sparkContext
    state = learn_words(rows.where("not held_out"), frequent, bucket_tokens, seed)
    buckets = bucketed(rows, spark.broadcast(state))
    state, links = sample(buckets, state, rounds)
    own = buckets.where(f"kind = {_TEXT}").select(F.shiftright("row", _GROUP).alias("group"), "row", "doc_id", "held_out", "tokens", "known", "base")
    found = finished(own.unionByName(score_buckets(buckets, spark.broadcast(state), links), allowMissingColumns=True))
    known = F.round("known").cast("long").alias("n_known")
    return found.select("doc_id", "held_out", F.col("tokens").alias("n_tokens"), known, F.lit(state.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
