"""Quality classifier: a linear hinge-loss model over naive Bayes log-count ratios.

A document is the set of its n-grams: words and word pairs, and runs of up to four token shapes, in
which repetition shows. The indicator of each n-gram is scaled by the log ratio of its smoothed counts
in the two classes; a support vector machine over these features is fitted by dual coordinate descent,
and margins become probabilities by a logistic fit on margins of held-out parts of the training rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_columns, ship, slices

#: The n-gram indicators are hashed to so many features.
FEATURES = 1 << 18
#: At most so many labelled rows are fitted.
TRAINING_ROWS = 12_000
#: Smoothing of the counts; bound of each dual variable; passes of coordinate descent.
SMOOTHING, COST, PASSES = 1.0, 1.0, 12
#: Words whose codes a task remembers at most.
MEMORY = 300_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> int:
    """A number below 16 for the kind of token."""
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 1
        if token.isupper():
            return 2 if len(token) > 1 else 3
        if token.islower():
            return 4
        return 5 if token[0].isupper() and token[1:].islower() else 6
    return {".": 7, ",": 8}.get(token, 9 if len(token) == 1 else 10)


class Codes(dict):
    """token -> 64-bit code: a 32-bit hash above, the shape below."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        code = self[token] = zlib.crc32(token.lower().encode()) << 8 | _shape(token)
        return code


def _features(codes: np.ndarray) -> np.ndarray:
    word, shape = codes >> np.uint64(8), codes & np.uint64(15)
    again = np.zeros(len(codes), np.uint64)  # 16: a word like the token before or the one before that
    for back in (1, 2):
        if len(codes) > back:
            again[back:] |= ((word[back:] == word[:-back]) & (shape[back:] < 7)).astype(np.uint64) << np.uint64(4)
    shape = shape | again
    grams = [word + np.uint64(1 << 40)]
    if len(word) > 1:
        grams.append(word[:-1] * np.uint64(31) + word[1:] + np.uint64(1 << 41))
    run = np.zeros(len(shape), np.uint64)
    for n in range(1, 5):
        if len(shape) >= n:
            run = run[: len(shape) - n + 1] * np.uint64(32) + shape[n - 1:]
            grams.append(run + np.uint64(n << 44))
    mixed = np.concatenate(grams) * _MIX
    return np.unique((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)


def featurise(text: str, memory: Codes) -> np.ndarray:
    """The sorted features of a text; none for a text without tokens."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32)
    return _features(np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log ratio of each feature's smoothed share of the counts of class 1 to that of class 0."""
    shares = []
    for label in (1, 0):
        counts = np.full(FEATURES, SMOOTHING)
        for row, mine in zip(rows, y == label):
            if mine:
                counts[row] += 1
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, seed: int = 0, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L1-loss support vector machine with rows scale[features], each of length
    1, and a constant feature; both classes weigh the same in sum."""
    sign = np.where(y == 1, 1.0, -1.0)
    bound = COST * np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    values = [v / (np.sqrt((v * v).sum()) or 1.0) for v in (scale[row] for row in rows)]
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            row, x = rows[i], values[i]
            gradient = sign[i] * (x @ w[row] + bias) - 1.0
            new = min(max(alpha[i] - gradient / ((1.0 if len(row) else 0.0) + 1.0), 0.0), bound[i])
            if step := (new - alpha[i]) * sign[i]:
                w[row] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the probability of class 1 by margin; Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0])), -2, 2)
    return float(max(beta[0], 0.1)), float(beta[1])


@dataclass
class Model:
    ratio: np.ndarray  # of each feature
    weight: np.ndarray  # of each feature: ratio times the machine's weight
    bias: float
    slope: float
    offset: float

    def probability(self, features: np.ndarray) -> float:
        norm = float(np.sqrt((self.ratio[features].astype(np.float64) ** 2).sum())) or 1.0
        margin = float(self.weight[features].sum(dtype=np.float64)) / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of at most TRAINING_ROWS rows. With one class or none there is nothing to separate: every
    score is then the smoothed share of class 1."""
    y = np.asarray(y)
    if len(set(y.tolist())) < 2:
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):
        own = [rows[i] for i in np.flatnonzero(part != k)]
        ratio = log_count_ratio(own, y[part != k])
        w, bias = dual_coordinate_descent(own, ratio, y[part != k])
        for i in np.flatnonzero(part == k):
            v = ratio[rows[i]]
            margin[i] = (v @ w[rows[i]]) / (np.sqrt((v * v).sum()) or 1.0) + bias
    ratio = log_count_ratio(rows, y)
    w, bias = dual_coordinate_descent(rows, ratio, y)
    return Model(ratio.astype(np.float32), (ratio * w).astype(np.float32), bias, *logistic_fit(margin, y))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, bound: int = TRAINING_ROWS) -> Model:
    """Fits on at most bound labelled rows outside the held fold. The rows are cut into features where they
    lie; one task then fits them, since coordinate descent goes through them in turn. Labels count as labelled_sample says;
    null and empty texts have no features, long ones count whole; without rows of both labels the model is constant."""
    sample = labelled_sample(docs, labels, "quality", modulus, held, bound)

    def make():
        memory = Codes()
        return lambda texts, ys: ([featurise(t, memory).tobytes() for t in texts], ys)

    cut = map_columns(sample, "features binary, label int", make)

    def descend(batches):
        rows, ys = [], []
        for batch in batches:
            rows += [np.frombuffer(x, np.int32) for x in batch["features"]]
            ys += batch["label"].tolist()
        order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), ys[i]))  # whatever order rows came in
        yield pd.DataFrame({"model": [pickle.dumps(fit([rows[i] for i in order], np.array([ys[i] for i in order])))]})

    row = cut.repartition(1).mapInPandas(descend, "model binary").first()
    return pickle.loads(bytes(row["model"])) if row else fit([], np.zeros(0, int))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score double) for each row of docs (doc_id, text): the probability of class 1. Null and
    empty texts get the score of a text without features; long texts are read whole; equal texts get equal
    scores, repeated rows each their own; an empty table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        memory, m = Codes(), shared.value
        return lambda ids, texts: (ids, [m.probability(featurise(t, memory)) for t in texts])

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id long, text_score double", make)


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns. A score of exactly `least`
    stays; null and empty texts are judged as texts without features; repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = docs.schema
    place = docs.columns.index("text")

    def run(batches):
        memory, m = Codes(), shared.value
        for part in (part for batch in batches for part in slices(batch)):
            good = [m.probability(featurise(t or "", memory)) >= least for t in part.column(place).to_pylist()]
            yield part.filter(pa.array(good, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, kinds)
