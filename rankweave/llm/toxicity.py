"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, whole-corpus texts of any kind the
unlabelled ones; a label 0 is never used as a negative. With the class prior p
the linear classifier g minimises

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

with the logistic loss l; when the second term falls below zero, the step goes
back up it, as the non-negative estimator asks. The inputs are the distinct
lower-case words of a text, hashed to 32 bits and weighted by their smoothed
log odds between the two samples; words whose odds are within noise carry no
weight, so that long texts of unknown words stay near the prior.

The fit reads at most `positives` toxic and `unlabelled` other texts, those
with the smallest hash of their id; what the driver gets of them are word
hashes. The class prior is counted over all labelled training rows. Scoring
reads every whole text.

Null and empty texts score what the bias alone says. Null ids and labels take
no part in learning. Without a positive or without an unlabelled text the
score is the prior, 0 where there are no labels. Rows that repeat an id are
scored each by its own text and are learnt from each for itself; of several
labels of an id the largest counts. Texts may be very long: only their distinct
words are held. An existing column named like the score is replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.scratch import fold, text_of

WORD = regex.compile(r"[^\W\d_]+")


def place_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Known(dict):
    """Word to the value of its hash, kept for a bounded number of words."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: str):
        found = self.value(place_of(word))
        if len(self) < 1 << 19:
            self[word] = found
        return found


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    weights: dict[int, float]  # by hash, of the words that say something
    bias: float
    prior: float

    def known(self) -> dict:
        return _Known(lambda place: self.weights.get(place, 0.0))

    def score(self, text: str, known: dict) -> float:
        total = math.fsum(map(known.__getitem__, words_of(text))) + self.bias
        return 1 / (1 + math.exp(-min(max(total, -50.0), 50.0)))


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])) if rows else (np.empty(0, np.uint32), np.empty(0, np.int64))


def _log_odds(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, rising, and their smoothed log odds between toxic and other texts; those within noise are left out."""
    (all_p, _), (all_u, _) = _sparse(pos), _sparse(unl)
    places = np.unique(np.concatenate([all_p, all_u]))
    n_p, n_u = len(pos), len(unl)
    in_p = np.bincount(np.searchsorted(places, all_p), minlength=len(places)).astype(float)
    in_u = np.bincount(np.searchsorted(places, all_u), minlength=len(places)).astype(float)
    rate_p = (in_p + 0.5) / (n_p + 1)
    # the unlabelled texts hold a share of toxic ones
    rate_n = np.maximum((in_u + 0.5) / (n_u + 1) - prior * rate_p, 0.5 / (n_u + 1)) / (1 - prior)
    odds = np.log(rate_p / rate_n)
    noise = np.sqrt(1 / (in_p + 0.5) + 1 / (in_u + 0.5))
    raw = np.log(rate_p) - np.log((in_u + 0.5) / (n_u + 1))
    on = (np.abs(raw) > 4 * noise) & (in_p + in_u >= 8)
    return places[on], odds[on]


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Full-batch gradient descent with Adam on the non-negative risk."""
    active, odds = _log_odds(pos, unl, prior)

    def design(rows):
        place, row = _sparse(rows)
        at = np.searchsorted(active, place)
        on = active[np.minimum(at, len(active) - 1)] == place if len(active) else np.zeros(len(place), bool)
        return at[on], row[on]

    (col_p, row_p), (col_u, row_u) = design(pos), design(unl)
    scale, w, b = odds, np.full(len(active), 0.5), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def forward(col, row, n):
        return np.bincount(row, (w * scale)[col], minlength=n) + b

    def back(col, row, grad):
        return np.r_[np.bincount(col, grad[row], minlength=len(w)) * scale, grad.sum()]

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for step in range(1, steps + 1):
        g_p, g_u = forward(col_p, row_p, len(pos)), forward(col_u, row_u, len(unl))
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        down = back(col_p, row_p, prior * (sigmoid(g_p) - 1) / len(pos))
        other = back(col_u, row_u, sigmoid(g_u) / len(unl)) - back(col_p, row_p, prior * sigmoid(g_p) / len(pos))
        grad = down + other if negative >= 0 else -other
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(dict(zip(active.tolist(), (w * scale).tolist(), strict=True)), float(b), prior)


def _hashed(df: DataFrame) -> DataFrame:
    """(positive, places): the distinct hashed words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Known(int)
        for batch in batches:
            rows = [np.unique(np.fromiter(map(places.__getitem__, words_of(t or "")), np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["positive", "places"])

    return df.select("positive", "text").mapInArrow(run, "positive boolean, places binary")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, positives: int = 5000, unlabelled: int = 15000, most_bytes: int = 128 << 20) -> Model:
    """Learn from rows that have a label and whose fold is not 0.

    The sample that is learnt from goes to the driver: at most `positives`
    different toxic rows and `unlabelled` different rows of any label, which is
    not looked at, and of either at most `most_bytes` of text. They are those of
    smallest id hash; rows that repeat id and text count once.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold(id_col, folds) != 0)).groupBy(F.col(id_col).alias("own_id")).agg(F.max("toxic").alias("toxic"))
    counted = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).head()
    prior = (counted["p"] or 0) / counted["n"] if counted["n"] else 0.0
    if not 0 < prior < 1:
        return Model({}, 50.0 if prior else -50.0, prior)
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("own_id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    rows = texts.select("own_id", "mark", F.octet_length("text").alias("size")).join(marks, "own_id").groupBy("own_id", "mark").agg(F.max("size").alias("size"), F.max("toxic").alias("toxic"))

    def first(some: DataFrame, most: int, positive: bool) -> DataFrame:
        order = (F.xxhash64("own_id"), F.col("own_id"), F.col("mark"))
        so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return some.orderBy(*order).limit(most).withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("own_id", "mark", F.lit(positive).alias("positive"))

    chosen = first(rows.where("toxic = 1"), positives, True).unionByName(first(rows, unlabelled, False))  # so many rows, one task
    wanted = texts.join(F.broadcast(chosen), ["own_id", "mark"]).groupBy("own_id", "mark", "positive").agg(F.first("text").alias("text"))
    rows = _hashed(wanted).collect()
    pos = [np.frombuffer(r["places"], np.uint32) for r in rows if r["positive"]]
    unl = [np.frombuffer(r["places"], np.uint32) for r in rows if not r["positive"]]
    order_key = lambda r: r.tobytes()  # noqa: E731  the sums must not depend on the order in which tasks end
    if not pos or not unl:
        return Model({}, math.log(prior / (1 - prior)), prior)
    return fit_nnpu(sorted(pos, key=order_key), sorted(unl, key=order_key), prior)


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the probability of toxicity in `out`, by whole texts."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))  # the words of a bounded sample
    others = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*others, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        known = own.known()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            scores = [own.score(t or "", known) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return df.select(*[df[f"`{f.name}`"] for f in others]).mapInArrow(run, schema)
