"""Logistic fits by Newton steps and monotone calibration, on sums that Spark adds up.

A fit reads its rows once for each step. Tasks reduce their rows to a Gram
matrix and a gradient, p * p + p numbers for p inputs, whatever the number of
rows; the driver solves the small system and sends p weights back. Rows should
be written or persisted before, as every step reads them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.relative import normalise
from rankweave.operators.statistics import quantiles

STEPS = 8
RIDGE = 1.0  # the penalty is half of it times the squared weights of scaled inputs; the intercept has none


class Logistic(NamedTuple):
    """A fitted model; without inputs that matter (one class only, or no row) a constant."""

    inputs: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]  # the intercept first
    constant: float | None = None

    def probability(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.weights[0])
        for c, median, mean, scale, w in zip(self.inputs, self.medians, self.means, self.scales, self.weights[1:], strict=True):
            total = total + w * (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / scale
        return 1 / (1 + F.exp(-total))


def fit_logistic(rows: DataFrame, inputs: Sequence[str], label: str, steps: int = STEPS, ridge: float = RIDGE) -> Logistic:
    """Missing inputs become medians, inputs are scaled to mean 0 and deviation 1, weights come from Newton steps.

    Rows without a label are left out. One class gives a constant, no row the
    constant 0.
    """
    rows = rows.where(F.col(label).isNotNull())
    seen = rows.agg(F.min(label).alias("low"), F.max(label).alias("high")).head()
    if seen["low"] is None or seen["low"] == seen["high"]:
        return Logistic((), (), (), (), (), float(seen["low"] or 0))
    some = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in inputs]).head()
    missing = [c for c in inputs if some[c]]
    middle = quantiles(rows, missing, (0.5,)).head().asDict() if missing else {}
    medians = tuple(middle.get(f"{c}_q50") or 0.0 for c in inputs)
    filled = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(inputs, medians, strict=True))], F.col(label).cast("double").alias("y"))
    facts = filled.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(inputs)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    means = tuple(facts[f"m{i}"] for i in range(len(inputs)))
    scales = tuple(facts[f"s{i}"] or 1.0 for i in range(len(inputs)))
    weights = np.zeros(len(inputs) + 1)
    for _ in range(steps):
        gram, gradient = _sums(filled, means, scales, weights)
        penalty = np.r_[0.0, np.full(len(inputs), ridge)]
        weights = weights + np.linalg.solve(gram + np.diag(penalty), gradient - penalty * weights)
    return Logistic(tuple(inputs), medians, means, scales, tuple(weights.tolist()))


def _sums(filled: DataFrame, means: Sequence[float], scales: Sequence[float], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Gram matrix and gradient of the log likelihood over all rows."""
    p = len(weights)
    mean, scale = np.array(means), np.array(scales)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p * p + p)
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(np.asarray(batch.column(i)) for i in range(p - 1))])
            x[:, 1:] = (x[:, 1:] - mean) / scale
            chance = 1 / (1 + np.exp(-(x @ weights)))
            total[: p * p] += ((x.T * (chance * (1 - chance))) @ x).ravel()
            total[p * p :] += x.T @ (np.asarray(batch.column(p - 1)) - chance)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "total"])

    found = {r["at"]: r["total"] for r in filled.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    total = np.array([found[i] for i in range(p * p + p)])
    return total[: p * p].reshape(p, p), total[p * p :]


def logistic_sql(rows: str, inputs: Sequence[str], label: str, steps: int = STEPS, ridge: float = RIDGE, name: str = "lg") -> dict[str, str]:
    """The same steps as tables of a query: {name}_w has the list w of weights, {name}_f the facts of inputs without nulls."""
    p = len(inputs) + 1
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - m{i}) / s{i}" for i, c in enumerate(inputs))
    facts = ", ".join(f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}" for i, c in enumerate(inputs))
    tables = {f"{name}_f": f"SELECT {facts} FROM {rows} WHERE {label} IS NOT NULL", f"{name}_x": f"SELECT [1.0::DOUBLE, {scaled}] AS x, CAST({label} AS DOUBLE) AS y FROM {rows}, {name}_f WHERE {label} IS NOT NULL", f"{name}_0": f"SELECT list_resize([0.0::DOUBLE], {p}, 0.0::DOUBLE) AS w"}
    for k in range(steps):
        tables[f"{name}_p{k}"] = f"SELECT x, y, 1 / (1 + exp(-list_inner_product(x, w))) AS c FROM {name}_x, {name}_{k}"
        tables[f"{name}_g{k}"] = f"""
SELECT list(row ORDER BY i) AS m FROM (
    SELECT i, list_append(list(g ORDER BY j), any_value(r)) AS row FROM (
        SELECT i, j, sum(c * (1 - c) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END AS g, sum((y - c) * x[i]) - CASE WHEN i > 1 THEN {ridge} ELSE 0 END * (SELECT w FROM {name}_{k})[i] AS r
        FROM {name}_p{k}, range(1, {p + 1}) AS a(i), range(1, {p + 1}) AS b(j) GROUP BY i, j) GROUP BY i)"""
        tables[f"{name}_{k + 1}"] = f"""
WITH RECURSIVE e(k, m) AS (
    SELECT CAST(1 AS BIGINT), m FROM {name}_g{k}
    UNION ALL
    SELECT k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM e WHERE k <= {p}
)
SELECT list_transform(range(1, {p + 1}), lambda i: w[i] + m[i][{p + 1}]) AS w FROM e, {name}_{k} WHERE k = {p + 1}"""
    tables[f"{name}_w"] = f"SELECT w FROM {name}_{steps}"
    return tables


def logistic_sql_probability(inputs: Sequence[str], name: str = "lg") -> str:
    """For rows beside {name}_f and {name}_w."""
    return "1 / (1 + exp(-(w[1] + " + " + ".join(f"w[{i + 2}] * (CAST({c} AS DOUBLE) - m{i}) / s{i}" for i, c in enumerate(inputs)) + ")))"


class Steps(NamedTuple):
    """A rising piecewise-linear function: places and values."""

    x: tuple[float, ...]
    y: tuple[float, ...]


def pooled(x: np.ndarray, total: np.ndarray, n: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Adjacent blocks of rising x whose means don't rise, put together: first and last x, sum and number of each block."""
    last = x if last is None else last
    out: list[list[float]] = []
    for row in zip(x.tolist(), last.tolist(), total.tolist(), n.tolist(), strict=True):
        out.append(list(row))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, high, s, m = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = high, out[-1][2] + s, out[-1][3] + m
    return tuple(np.array(c, float) for c in zip(*out, strict=True)) if out else tuple(np.empty(0) for _ in range(4))


def fit_monotone(rows: DataFrame, x: str, label: str, most_blocks: int = 1 << 20) -> Steps:
    """The rising function of x with the least squared distance to the labels (pool adjacent violators), exactly.

    Rows become one for each distinct x with its sum and number of labels.
    These are sorted in ranges of x; a task pools its range, and as pooling
    goes on from blocks as from values, the driver pools what the ranges
    leave: blocks of different means, not values. More than `most_blocks` of
    them is an error. Rows with a null are left out.
    """
    distinct = rows.where(F.col(x).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("n"))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = tuple(np.empty(0) for _ in range(4))
        for batch in batches:
            own = [np.asarray(batch.column(i)) for i in (0, 0, 1, 2)]
            first, last, total, n = (np.r_[a, b] for a, b in zip(held, own, strict=True))
            held = pooled(first, total, n, last)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in held], names=["first", "last", "total", "n"])

    blocks = distinct.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(pool, "first double, last double, total double, n double")
    found = sorted(tuple(r) for r in blocks.limit(most_blocks + 1).collect())
    if len(found) > most_blocks:
        raise ValueError(f"more than {most_blocks} blocks")
    first, last, total, n = pooled(*(np.array([r[i] for r in found], float) for i in (0, 2, 3, 1))) if found else (np.empty(0),) * 4
    places, values = [], []
    for a, b, s, m in zip(first.tolist(), last.tolist(), total.tolist(), n.tolist(), strict=True):
        for at in (a, b) if b > a else (a,):
            places.append(at)
            values.append(s / m)
    return Steps(tuple(places), tuple(values))


def interpolated(x: Column, steps: DataFrame) -> Column:
    """The value at x between the places of `steps_of`, whose one row is joined; outside them that of the nearest end.

    The place is found by bisection: the number of steps is the logarithm of
    that of places.
    """
    xs, ys, n = F.col("__xs"), F.col("__ys"), F.size("__xs")
    halves = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n + 1)).cast("int"), F.lit(1)))
    start = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(xs, middle) <= x
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(s["high"]).alias("high"))

    at = F.aggregate(halves, start, halve)["low"]  # how many places are not beyond x
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    return F.when(n == 0, x).when(at == 0, F.get(ys, F.lit(0))).when(at == n, F.get(ys, n - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def looked_up(x: Column, steps: Steps) -> Column:
    """The values of `interpolated` for a whole column: tasks hold the places once, rows don't carry them."""
    if not steps.x:
        return x
    xs, ys = np.array(steps.x), np.array(steps.y)

    @F.pandas_udf("double")
    def at(values: pd.Series) -> pd.Series:
        v = values.to_numpy(float)
        k = np.searchsorted(xs, v, side="right")  # how many places are not beyond v
        low, high = np.clip(k - 1, 0, None), np.clip(k, None, len(xs) - 1)
        gap = np.where(high > low, xs[high] - xs[low], 1.0)
        inside = ys[low] + (ys[high] - ys[low]) * (v - xs[low]) / gap
        return pd.Series(np.where(k == 0, ys[0], np.where(k == len(xs), ys[-1], inside)))

    return F.when(x.isNull(), ys[0].item()).otherwise(at(x))


def calibrated(df: DataFrame, steps: Steps, x: str, out: str, key: str = "contest_id", floor: float = 1e-9) -> DataFrame:
    """df with x put through the steps, at least `floor`, adding up to 1 in each group again."""
    found = df.withColumn("__p", F.greatest(looked_up(F.col(x).cast("double"), steps), F.lit(floor)))
    return found.withColumn(out, normalise("__p", key=key)).drop("__p")
