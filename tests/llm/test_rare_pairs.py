"""Pairs of two rare words: their tables are drawn at the word and handed to the context's bucket."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platterlake.llm import pitman_yor
from platterlake.llm.pitman_yor import BURN_IN, RARE, STRENGTH, SWEEPS, State, cell_keys
from platterlake.llm.shared import fold
from tests.llm.test_language_model import Plain
from tests.llm.test_operators import fold_of, frame


class Whole(Plain):
    """The plain loops, with tables of rare pairs drawn by the context's tables of the last round; the context has those pairs' of the last round."""

    def sweeps(self):
        rare = {c for c in self.cells if min(c) >= RARE}
        t = dict.fromkeys(self.cells, 1)
        if not self.round:
            self.held, self.others = dict.fromkeys(rare, 1), {c: sum(x[0] == c[0] for x in self.cells) - 1 for c in rare}
        self.seated = []
        words = sorted({w for _, w in self.cells if w >= RARE})
        tables, own = {w: sum(c[1] == w for c in self.cells) for w in words}, dict.fromkeys(words, 1)
        around = lambda u: sum(self.held.get(c, t[c]) for c in self.cells if c[0] == u)
        for k in range(SWEEPS):
            sweep, before, before_tables, before_own = self.round * SWEEPS + k, dict(t), dict(tables), dict(own)
            for u, w in self.cells:
                outside = self.others[u, w] if (u, w) in rare else self.context_tables[u] - before[u, w] if u < RARE else around(u) - t[u, w]
                seen = (self.word_tables[w], self.own[w]) if w < RARE else (before_tables[w], before_own[w])
                t[u, w] = self.draw(self.n[u, w], max(outside, 0), self.parent(*seen, before[u, w]), self.d, self.of(u, w), sweep)
            tables = {w: sum(t[c] for c in self.cells if c[1] == w) for w in words}
            own = {w: self.draw(tables[w], max(self.all_own - own[w], 0), 1 / (self.distinct + 1), self.d0, self.of(w, w), sweep) for w in words}
            self.seated.append({u: around(u) for u in {c[0] for c in self.cells}})
            yield t, tables, own
        self.others = {c: around(c[0]) - self.held[c] for c in rare}
        self.held = {c: t[c] for c in rare}

    def p(self, u, w):
        if u < RARE or u not in self.count:
            return super().p(u, w)
        k, n, customers = len(self.samples), self.n.get((u, w), 0), self.count[u]
        parent = self.parent(self.word_tables[w], self.own[w]) if w < RARE else sum(self.parent(a.get(w, 0), b.get(w, 0)) for _, a, b in self.samples) / k
        left = sum(STRENGTH + self.d * x[u] for x in self.seated[BURN_IN:]) / k
        own = sum(n - self.d * t[u, w] for t, _, _ in self.samples) / k if n else 0.0
        return (own + left * parent) / (STRENGTH + customers)


@pytest.mark.parametrize(("frequent", "bucket_tokens"), [(6, 60), (0, 100), (0, 20)])
def test_scores_equal_plain_loops_that_draw_rare_pairs(spark, frequent, bucket_tokens):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.expovariate(0.12))}" for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    texts += [texts[3], texts[3], "new words only", "W1 w2\tw1\nw2 w1 w2", "fox owl " * 40, ""]
    rows = [(i, t, fold_of(i) == 1) for i, t in enumerate(texts)]
    plain = Whole(rows, frequent)
    assert any(t > 1 for t in plain.held.values())
    got = pitman_yor.score_texts(frame(spark, [(i, t, "en", "s", 0) for i, t, _ in rows]).repartition(3), fold(F.col("doc_id")) != 1, frequent=frequent, bucket_tokens=bucket_tokens).collect()
    scores = {r["doc_id"]: r["score"] for r in got}
    for (i, _, _), chain in zip(rows, plain.chains, strict=True):
        assert scores[i] == pytest.approx(sum(math.log10(plain.p(u, w)) for u, w in itertools.pairwise(chain)), abs=1e-6)


def test_pairs_that_are_not_open_get_one_table_whatever_the_context():
    """Drawn for the tables that contexts and words can have, of 200,000 pairs none that was left out gets a second."""
    many = 200_000
    rng = np.random.default_rng(3)
    u, w = np.arange(many) + RARE, rng.integers(0, 20_000, many) + RARE
    n = rng.integers(0, 9, many)
    s = State(np.zeros(0, np.int64), np.zeros(1, np.int64), 2_000_000, 100_000, 1, 0, most_rare=200, all_tables=900_000, discount=0.6, parent_discount=0.4)
    found = pitman_yor.open_pairs(u, w, n, s, 2)
    assert 0 < len(found) < many / 4
    left_out = np.setdiff1d(np.flatnonzero(n > 1), found)
    p = np.full(len(left_out), 0.0) + (n[left_out] + 1) / 950_000
    for sweep in range(2 * SWEEPS):
        assert (pitman_yor.draw(n[left_out], rng.integers(0, 201, len(left_out)), p, 0.6, cell_keys(u[left_out], w[left_out], 0), sweep) == 1).all()
