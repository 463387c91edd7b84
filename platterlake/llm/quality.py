"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train a linear model on a few hundred features of the whole text. The risk is
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); where the second part is negative the
step goes against it, as in the published method. Labels of other value than positive are never used.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.llm.shared import mix64, pieces, texts

#: At most so many trusted positives, and so many unlabelled texts, are fitted on; scoring covers all rows.
MAX_FIT_ROWS = 8_000
THRESHOLD = 0.3
#: Byte classes: the first entry that holds a byte gives its class; the rest are bytes of other letters.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", ";:'\"()-", "|", "#$%&*@^~=+_", "<>{}[]\\/`")
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_N = len(_CLASSES) + 1
N_FEATURES = _N * _N + _N + 8
#: The class shares and word figures, cut at these quantiles of the fitted rows: steps that a line through them can't take.
_STEPPED = slice(_N * _N, N_FEATURES)
_QUANTILES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.8, 0.9, 0.94, 0.97, 0.99)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of byte classes and of pairs of them, and how words repeat."""
    n, sizes = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n), sizes)
    kind = _CLASS[raw].astype(np.int64)
    out = np.zeros((n, N_FEATURES), np.float32)
    inside = doc[1:] == doc[:-1]
    pair = (doc[1:] * _N * _N + kind[1:] * _N + kind[:-1])[inside]
    out[:, : _N * _N] = np.sqrt(np.bincount(pair, minlength=n * _N * _N).reshape(n, -1) / np.maximum(sizes, 1)[:, None])
    one = np.bincount(doc * _N + kind, minlength=n * _N).reshape(n, -1)
    out[:, _N * _N : _N * _N + _N] = np.sqrt(one / np.maximum(sizes, 1)[:, None])
    word = (raw > 32) & ~((raw >= 33) & (raw <= 47))
    first = word & ~np.concatenate([[False], word[:-1] & inside]) if len(raw) else word
    starts = np.flatnonzero(first)
    more = out[:, _N * _N + _N :]
    more[:, 0] = np.log1p(sizes) / 10
    if len(starts):
        weight = mix64(raw.astype(np.uint64) + np.uint64(1)) * word
        place = np.arange(len(raw)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(raw)), "right") - 1, 0)]
        names = mix64(np.add.reduceat(mix64(weight + place.astype(np.uint64)) * word, starts))
        owner = doc[starts]
        words = np.bincount(owner, minlength=n)
        same = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((names, owner))
        new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
        types = np.bincount(owner[order][new], minlength=n)
        run = np.flatnonzero(new)
        length = np.diff(np.append(run, len(order)))
        top = np.zeros(n)
        np.maximum.at(top, owner[order][run], length)
        count = np.maximum(words, 1)
        more[:, 1] = np.bincount(owner[1:][same], minlength=n) / count
        more[:, 2] = types / count
        more[:, 3] = types / np.maximum(words, 1) ** 0.75
        more[:, 4] = top / count
        more[:, 5] = np.log1p(words) / 10
        more[:, 6] = sizes / count / 10
        more[:, 7] = words < 5
    return out


def featured(rows: DataFrame) -> DataFrame:
    """(kind, h, x binary): the features of rows (kind, h, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                x = features(*texts(piece, "text"))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["kind", "h", "x"])

    return rows.select("kind", "h", "text").mapInArrow(made, "kind int, h long, x binary")


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 200) -> float:
    """Share of positives among the unlabelled: the least ratio, over thresholds, of the two samples' shares above it.

    A set that holds a share p of the positives and u of the unlabelled shows the prior to be u / p at most.
    Thresholds that leave too few positives above them are passed over, as their ratio is noise.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    ok = p * len(positive) >= min(least, len(positive) / 2)
    return float(np.clip((u / np.maximum(p, 1e-9))[ok].min(), 0.02, 0.98))


@dataclass
class LinearModel:
    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    prior: float = 0.5

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """The features brought to scale, and for each stepped one which of its cuts it is above."""
        above = x[:, _STEPPED, None] > self.cuts[None]
        out = np.empty((len(x), N_FEATURES + self.cuts.size))
        out[:, :N_FEATURES] = np.clip((x - self.mean) / self.scale, -4, 4)
        out[:, N_FEATURES:] = above.reshape(len(x), -1)
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600, rate: float = 0.03, decay: float = 1e-4) -> LinearModel:
    """Two rounds of full-batch Adam on the non-negative risk: with a prior of 1/2 to rank, then with the estimate."""
    both = np.concatenate([positive, unlabelled, np.zeros((int(not len(positive) + len(unlabelled)), N_FEATURES))])
    cuts = np.quantile(both[:, _STEPPED], _QUANTILES, axis=0).T
    model = LinearModel(both.mean(0), both.std(0) + 1e-3, cuts, np.zeros(N_FEATURES + cuts.size))
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.inputs(positive), model.inputs(unlabelled)
    half = len(p) // 2  # the prior is read from positives that the ranking has not seen
    w, b = _descend(p[:half] if half else p, u, 0.5, steps, rate, decay)
    model.prior = estimate_prior(p[half:] @ w + b, u @ w + b)
    model.weight, model.bias = _descend(p, u, model.prior, steps, rate, decay)
    return model


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    theta = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def slope(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(x.T @ by, by.sum()) / len(x)

    for step in range(1, steps + 1):
        zp, zu = (x @ theta[:-1] + theta[-1] for x in (p, u))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = slope(u, su) - prior * slope(p, sp)
        g = g_negative - prior * slope(p, 1 - sp) if negative >= 0 else -g_negative
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, use: Column, max_rows: int = MAX_FIT_ROWS) -> LinearModel:
    """Fit on at most `max_rows` trusted positives (quality 1) and as many unlabelled documents.

    Rows where `use` (of doc_id) doesn't hold are taken neither as positives nor as unlabelled text, nor are rows of
    null id or null labels as positives. Both samples are the rows whose seeded hashes of id and text are least, so
    repeated rows and ids change neither the bound nor which rows are taken; only ids, `max_rows` at most, are
    broadcast. Features are made where the texts are read; one task fits the bounded sample, and its weights alone
    come to the driver. Without positives or unlabelled rows all scores are 1/2.

    The prior is read from the samples: with 8,000 rows of each kind the standard error of a share is 0.006 at most.
    """
    docs = docs.select("doc_id", "text").where(use & F.col("doc_id").isNotNull())

    def least(rows: DataFrame, kind: int) -> DataFrame:
        own = rows.select(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), "doc_id", "text").alias("h"), "text")
        return featured(own).orderBy("h", "x").limit(max_rows)

    by_id = F.xxhash64(F.lit(1), "doc_id")
    trusted = labels.where((F.col("quality") == 1) & use).select("doc_id").where("doc_id is not null").distinct()
    trusted = docs.join(F.broadcast(trusted.orderBy(by_id, "doc_id").limit(max_rows)), "doc_id")
    cut = docs.select(by_id.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    some = docs.where(by_id <= F.lit(cut).cast("long"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((kind, h, bytes(x)) for b in batches for kind, h, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        of_kind = [np.frombuffer(b"".join(x for k, _, x in rows if k == kind), np.float32).reshape(-1, N_FEATURES).astype(np.float64) for kind in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*of_kind))], pa.binary())], ["model"])

    both = least(trusted, 1).unionByName(least(some, 2)).coalesce(1)
    found = both.mapInArrow(fitted, "model binary").first()
    return pickle.loads(bytes(found[0])) if found else fit(*[np.zeros((0, N_FEATURES))] * 2)


def score_quality(docs: DataFrame, model: LinearModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in `keep` and `score` (0 to 1, higher: the better) for each row.

    Null and empty texts have the features of no bytes and get a score too. Repeated rows get equal scores;
    nulls in other columns pass through; an empty table gives no rows. Columns not named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[c for c in keep if c != text_col], F.lit(True).alias("_")).alias("kept"), F.col(text_col).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = pa.array(shared.value.score(features(*texts(piece, "text")).astype(np.float64)))
                shown = piece.column(1) if text_col in keep else pa.nulls(len(piece), pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), shown, found], ["kept", "text", "score"])

    done = rows.mapInArrow(scored, f"kept {rows.schema['kept'].dataType.simpleString()}, text string, score double")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("kept").getField(c).alias(c) for c in keep], "score")
