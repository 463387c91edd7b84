"""The language model against plain loops over all cells, and its seating against the enumeration of all seatings."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platterlake.llm import pitman_yor
from platterlake.llm.pitman_yor import BURN_IN, END, RARE, STRENGTH, SWEEPS, cell_keys, uniform
from platterlake.llm.shared import fold
from tests.llm.test_operators import corpus, empty, fold_of, frame, words


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


@pytest.mark.parametrize(("n", "outside", "p", "discount"), [(3, 0, 0.2, 0.5), (3, 7, 0.01, 0.8), (5, 2, 0.6, 0.3)])
def test_tables_are_drawn_from_the_weights_of_all_seatings(n, outside, p, discount):
    weight = np.zeros(n + 1)
    for seating in partitions(list(range(n))):
        x = 1.0
        for k, table in enumerate(seating):
            x *= (STRENGTH + discount * (outside + k)) * p * math.prod(i - discount for i in range(1, len(table)))
        weight[len(seating)] += x
    expected = weight / weight.sum()
    many = 200_000
    keys = cell_keys(np.arange(many), np.arange(many) + 7, 0)
    got = pitman_yor.draw(np.full(many, n), np.full(many, outside), np.full(many, p), discount, keys, 3)
    assert np.bincount(got, minlength=n + 1) / many == pytest.approx(expected, abs=5 * 0.5 / many**0.5)


@pytest.mark.parametrize(("outside", "p", "discount"), [(50, 0.01, 0.6), (20_000, 0.01, 0.7), (400_000, 0.002, 0.4), (0, 0.5, 0.8), (3_000, 0.02, 0.3), (10**6, 0.05, 0.5)])
def test_large_cells_are_drawn_as_the_exact_draw_draws_them(outside, p, discount):
    """By numbers that go out from 256 customers, at 1,024."""
    many, n = 4_000, pitman_yor.EXACT
    keys = cell_keys(np.arange(many), np.arange(many) + 7, 0)
    exact = pitman_yor.draw(np.full(many, n), np.full(many, outside), np.full(many, p), discount, keys, 1)
    u, v = uniform(keys, 1, 0), uniform(keys, 1, 1)
    large = np.array([pitman_yor._draw_large(n, outside, p, discount, a, b, most=256) for a, b in zip(u, v, strict=True)])
    assert large.mean() == pytest.approx(exact.mean(), rel=0.04)
    assert large.std() == pytest.approx(exact.std(), rel=0.1, abs=0.05)


def test_packed_numbers_come_back():
    arrays = [np.array([0, 1, 1 << 62, -5]), np.zeros(0, np.int64), np.arange(1000)]
    assert all((a == b).all() for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays), 3), strict=True))


class Plain:
    """The model by dictionaries, one cell at a time."""

    def __init__(self, rows, frequent, rounds=3, seed=0):
        tokens = [((t or "").encode().lower().split(), held) for _, t, held in rows]
        h = {w: xxhash.xxh3_64_intdigest(w) >> 2 for ws, _ in tokens for w in ws}
        count: dict = {}
        for ws, held in tokens:
            for w in [] if held else ws:
                count[w] = count.get(w, 0) + 1
        ends = sum(not held for _, held in tokens)
        self.total, self.distinct = sum(count.values()) + ends, len(count) + (ends > 0)
        levels: dict = {}
        for w, n in count.items():
            levels.setdefault(math.floor(math.log2(n) * 32), []).append(w)
        top: list = []
        for level in sorted(levels, reverse=True):
            if len(top) + len(levels[level]) > frequent:
                break
            top += levels[level]
        top.sort(key=lambda w: (-count[w], h[w]))
        self.key = {w: top.index(w) + 1 if w in top else h[w] | RARE for w in h}
        self.count = {END: ends} | {self.key[w]: n for w, n in count.items()}
        self.chains = [[END, *(self.key[w] for w in ws), END] for ws, _ in tokens]
        self.n: dict = {}
        for chain, (_, held) in zip(self.chains, tokens, strict=True):
            for pair in itertools.pairwise(chain):
                self.n[pair] = self.n.get(pair, 0) + (not held)
        self.cells = sorted(c for c, n in self.n.items() if n)
        self.seed, self.frequent = seed, [END, *range(1, len(top) + 1)]
        self.run(rounds)

    def sums(self, t, side):
        out: dict = {}
        for cell in self.cells:
            out[cell[side]] = out.get(cell[side], 0) + t[cell]
        return out

    def draw(self, n, outside, p, d, key, sweep):
        if n < 2:
            return 1
        s = [[0.0] * (n + 2) for _ in range(n + 1)]
        s[1][1] = 1.0
        for k in range(1, n):
            for t in range(1, k + 2):
                s[k + 1][t] = s[k][t - 1] + (k - d * t) * s[k][t]
        weight, opened = [], 1.0
        for t in range(1, n + 1):
            opened *= (STRENGTH + d * (outside + t - 1)) * p
            weight.append(s[n][t] * opened)
        at = uniform(np.array([key], np.uint64), sweep)[0] * sum(weight)
        for t, reached in enumerate(itertools.accumulate(weight), 1):
            if at < reached:
                return t
        return n

    def of(self, u, w):
        return cell_keys(np.array([u]), np.array([w]), self.seed)[0]

    def parent(self, tables, own, without=0):
        fresh = (STRENGTH + self.d0 * self.all_own) / (self.distinct + 1)
        return (max(tables - without - self.d0 * own, 0) + fresh) / (STRENGTH + self.all_tables)

    def seat_words(self, sweep):
        self.own = {w: self.draw(n, max(self.all_own - self.own[w], 0), 1 / (self.distinct + 1), self.d0, self.of(w, w), sweep) if n else 0 for w, n in self.word_tables.items()}

    def run(self, rounds):
        ones = dict.fromkeys(self.cells, 1)
        types = self.sums(ones, 1)
        share = lambda a, b: min(max((a + 1) / (a + 2 * b + 2), 0.05), 0.95)
        values = [self.n[c] for c in self.cells]
        kinds = [n for w, n in types.items() if w != END]
        self.d, self.d0 = share(values.count(1), values.count(2)), share(kinds.count(1), kinds.count(2))
        of_u = self.sums(ones, 0)
        self.context_tables = {u: of_u.get(u, 0) for u in self.frequent}
        self.word_tables = {w: types.get(w, 0) for w in self.frequent}
        self.own = {w: min(n, 1) for w, n in self.word_tables.items()}
        rare_own = len([w for w in types if w >= RARE])
        self.all_tables, self.all_own = sum(types.values()), sum(self.own.values()) + rare_own
        self.round = 0
        self.seat_words(0)
        for k in range(rounds - 1):
            self.round, self.all_own = k, sum(self.own.values()) + rare_own
            *_, (t, rare_tables, rare_seats) = self.sweeps()
            of_u, of_w = self.sums(t, 0), self.sums(t, 1)
            rare_own = sum(rare_seats.values())
            self.context_tables = {u: of_u.get(u, 0) for u in self.frequent}
            self.word_tables = {w: of_w.get(w, 0) for w in self.frequent}
            self.own = {w: min(max(self.own[w], 1), n) for w, n in self.word_tables.items()}
            self.all_tables = sum(self.word_tables.values()) + sum(rare_tables.values())
            self.seat_words(k + 1)
        self.round, self.all_own = rounds - 1, sum(self.own.values()) + rare_own
        self.samples = [({**t}, {**a}, {**b}) for t, a, b in self.sweeps()][BURN_IN:]

    def sweeps(self):
        t = dict.fromkeys(self.cells, 1)
        rare_words = sorted({w for _, w in self.cells if w >= RARE})
        tables = {w: sum(1 for c in self.cells if c[1] == w) for w in rare_words}
        own = dict.fromkeys(rare_words, 1)
        for k in range(SWEEPS):
            sweep = self.round * SWEEPS + k
            before, before_tables, before_own = dict(t), dict(tables), dict(own)
            for u, w in self.cells:
                if u >= RARE and w >= RARE:
                    continue
                outside = self.context_tables[u] - before[u, w] if u < RARE else sum(t[c] for c in self.cells if c[0] == u) - t[u, w]
                seen = (self.word_tables[w], self.own[w]) if w < RARE else (before_tables[w], before_own[w])
                t[u, w] = self.draw(self.n[u, w], max(outside, 0), self.parent(*seen, before[u, w]), self.d, self.of(u, w), sweep)
            tables = {w: sum(t[c] for c in self.cells if c[1] == w) for w in rare_words}
            own = {w: self.draw(tables[w], max(self.all_own - own[w], 0), 1 / (self.distinct + 1), self.d0, self.of(w, w), sweep) for w in rare_words}
            yield t, tables, own

    def p(self, u, w):
        """Of a word after another; -1: a word never seen."""
        customers = self.count.get(u, 0)
        n = self.n.get((u, w), 0)
        k = len(self.samples)
        if w < RARE:
            parent = self.parent(self.word_tables[w], self.own[w]) if w >= 0 else self.parent(0, 0)
        else:
            parent = sum(self.parent(a.get(w, 0), b.get(w, 0)) for _, a, b in self.samples) / k
        restaurant = [self.context_tables[u] if u < RARE else sum(t[c] for c in self.cells if c[0] == u) for t, _, _ in self.samples]
        left = sum(STRENGTH + self.d * x for x in restaurant) / k / (STRENGTH + customers)
        own = sum(n - self.d * t[u, w] for t, _, _ in self.samples) / k / (STRENGTH + customers) if n else 0.0
        return own + left * parent


@pytest.mark.parametrize(("frequent", "bucket_tokens"), [(6, 60), (30, 200), (1000, 1 << 19), (0, 100)])
def test_scores_equal_plain_loops(spark, frequent, bucket_tokens):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.expovariate(0.12))}" for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    texts += [texts[3], texts[3], "new words only", "W1 w2\tw1\nw2 w1 w2", ""]
    rows = [(i, t, fold_of(i) == 1) for i, t in enumerate(texts)]
    plain = Plain(rows, frequent)
    got = pitman_yor.score_texts(frame(spark, [(i, t, "en", "s", 0) for i, t, _ in rows]).repartition(3), fold(F.col("doc_id")) != 1, frequent=frequent, bucket_tokens=bucket_tokens).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    for (i, _, _), chain in zip(rows, plain.chains, strict=True):
        assert scores[i] == pytest.approx(sum(math.log10(plain.p(u, w)) for u, w in itertools.pairwise(chain)), abs=1e-6)


def test_probabilities_sum_to_one():
    rng = random.Random(8)
    plain = Plain([(i, words(rng, 20, 12), False) for i in range(30)], 1000)
    for u in plain.count:
        assert sum(plain.p(u, w) for w in plain.count) + plain.p(u, -1) == pytest.approx(1, abs=0.02)


def test_base_scores_and_counts(spark):
    rows = corpus()
    got = pitman_yor.score_texts(frame(spark, rows), fold(F.col("doc_id")) != 1, frequent=100).collect()
    assert len(got) == len(rows)
    seen: dict = {}
    for r in rows:
        for w in [*(r[1] or "").lower().split(), None] if fold_of(r[0]) != 1 else []:
            seen[w] = seen.get(w, 0) + 1
    total, distinct = sum(seen.values()), len(seen)
    by = {r["doc_id"]: r for r in got}
    for r in rows:
        tokens = [*(r[1] or "").lower().split(), None]
        base = sum(math.log10((seen.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        x = by[r[0]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (len(tokens), sum(w in seen for w in tokens), total, fold_of(r[0]) == 1)
        assert x["base_score"] == pytest.approx(base) and x["score"] < 0
    again = pitman_yor.score_texts(frame(spark, rows).repartition(3), fold(F.col("doc_id")) != 1, frequent=100).collect()
    assert np.allclose(sorted(r["score"] for r in got), sorted(r["score"] for r in again))


def test_without_training_rows_and_with_repeats(spark):
    got = pitman_yor.score_texts(frame(spark, corpus()), F.lit(False)).collect()
    assert len(got) == len(corpus()) and all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in got)
    assert pitman_yor.score_texts(empty(spark), F.lit(True)).collect() == []
    twice = [(None, "a b", "en", "s", 3)] * 2 + [(5, "a b", "en", "s", 3), (5, "c", "en", "s", 1)]
    got = pitman_yor.score_texts(frame(spark, twice), F.lit(True)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("5", 2), ("5", 3), ("None", 3), ("None", 3)]
    assert len({round(r["score"], 9) for r in got if r["n_tokens"] == 3}) == 1


def test_pairs_of_rare_words_are_learned(spark):
    """`red` and `blue`, `fox` and `owl` are equally frequent; only the pairs differ."""
    texts = ["a b " * 30 + f"{'red fox' if i % 2 else 'blue owl'} b a" for i in range(40)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(100, "red fox", "en", "s", 0), (101, "red owl", "en", "s", 0), (102, "blue fox", "en", "s", 0)]
    for frequent in (2, 100):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(frame(spark, rows), F.col("doc_id") < 100, frequent=frequent).collect()}
        assert got[100] > got[101] + 1 and got[100] > got[102] + 1
