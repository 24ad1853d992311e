"""Column profiles, correlations, quantiles and table differences."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, present, missing_rate, mean, std, is_constant), from one pass over the table."""
    one = df.agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("present", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("low", F.min), ("high", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"present_{c}").alias("present"), F.col(f"mean_{c}").cast("double").alias("mean"), F.col(f"std_{c}").alias("std"), (F.col(f"low_{c}").isNull() | (F.col(f"low_{c}") == F.col(f"high_{c}"))).alias("is_constant")) for c in columns])
    return one.select("rows", F.inline(rows)).select("column", "rows", "present", (1 - F.col("present") / F.greatest("rows", F.lit(1))).alias("missing_rate"), "mean", "std", "is_constant")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(x, y, n, pearson) of pairs of columns, rows with a null in one of them left out of that pair; one pass."""
    both = lambda x, y, v: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(v).cast("double"))
    one = df.agg(*[f.alias(f"{n}{i}") for i, (x, y) in enumerate(pairs) for n, f in (("r", F.corr(both(x, y, x), both(x, y, y))), ("n", F.count(both(x, y, x))))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("pearson")) for i, (x, y) in enumerate(pairs)])))


def strongest_pairs(df: DataFrame, columns: Sequence[str], threshold: float, n: int) -> DataFrame:
    """The n pairs of largest absolute correlation, if it reaches the threshold."""
    found = correlations(df, list(combinations(columns, 2)))
    return found.where(F.abs("pearson") >= threshold).orderBy(F.abs(F.col("pearson")).desc(), "x", "y").limit(n)


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of a column over the whole table.

    Ranks come from the counts of distinct values: values, not rows, are put in
    order, by ranges of the value and sums of what lies before each range.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id())
    inside = F.sum("__c").over(Window.partitionBy("__p").orderBy("__v")) - F.col("__c")
    ranged = ranged.withColumn("__inside", inside)
    ranges = ranged.groupBy("__p").agg(F.sum("__c").alias("__s"))
    before = ranges.select(F.col("__p").alias("__q"), (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__before"))  # one row for each partition
    ranks = ranged.join(F.broadcast(before), F.col("__p") == F.col("__q")).select("__v", (F.col("__before") + F.col("__inside") + (F.col("__c") + 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


PARTS = 256  # edges of a bracket that approximate quantiles suggest
FEW = 1 << 16  # distinct values of a bracket that are put in order on one row


class _Bracket(NamedTuple):
    """Where the values of a rank lie: between low and high, behind `before` smaller ones, among n."""

    low: float
    high: float
    before: int
    n: int


def quantiles(df: DataFrame, columns: Sequence[str], q: Sequence[float], exact: bool = True, few: int = FEW) -> DataFrame:
    """One row with column_q70 and so on; exact by linear interpolation, or within a bounded error at scale.

    Exact ones are found by selection: the two values around each quantile lie
    in a bracket. Approximate quantiles suggest a narrower one, whose values
    and those before it are counted, until at most `few` distinct values are
    left; these are counted one by one and put in order. No task and no
    aggregate holds a column, and a pass shuffles a sketch for each task and
    quantile. Nulls are left out; a column without values has null quantiles.
    NaN isn't allowed.
    """
    if not exact:
        return df.agg(*[F.percentile_approx(F.col(c), F.lit(x)).alias(_quantile_name(c, x)) for c in columns for x in q])
    values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))).where("x is not null")
    facts = {r["c"]: _Bracket(r["low"], r["high"], 0, r["n"]) for r in values.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    rank = {(i, x): (f.n - 1) * x for i, f in facts.items() for x in q}
    targets = {key: facts[key[0]] for key in rank}
    found: dict[tuple[int, float], float] = {}
    while targets:
        keys, inside = list(targets), _inside(values, targets)
        facts_of = {r["t"]: r for r in inside.groupBy("t").agg(F.approx_count_distinct("x", 0.01).alias("d"), F.percentile_approx("x", [i / PARTS for i in range(PARTS + 1)], 10 * PARTS).alias("edges")).collect()}
        wanted = {key: _narrower(targets[key], facts_of[n]["edges"], rank[key]) for n, key in enumerate(keys) if facts_of[n]["d"] > 0.9 * few}
        more: dict[tuple[int, float], _Bracket] = {}
        if wanted:
            for key, counted in _counted(values, {k: targets[k] for k in wanted}, wanted).items():
                holds = counted.before <= int(rank[key]) and math.ceil(rank[key]) < counted.before + counted.n
                if holds and counted.n < targets[key].n:
                    more[key] = counted
        last = [n for n, key in enumerate(keys) if key not in more]
        if last:
            for r in inside.where(F.col("t").isin(last)).groupBy("t", "x").agg(F.count("*").alias("n")).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("all")).collect():
                key = keys[r["t"]]
                found[key] = _interpolated(r["all"], targets[key].before, rank[key])
        targets = more
    kept = [F.lit(found.get((i, x))).cast("double").alias(_quantile_name(c, x)) for i, c in enumerate(columns) for x in q]
    return df.sparkSession.range(1).select(*kept)


def _inside(values: DataFrame, targets: Mapping[tuple[int, float], _Bracket]) -> DataFrame:
    """(t, x): the values of each target's bracket; the table of targets has a row for each quantile."""
    rows = [(n, i, b.low, b.high) for n, ((i, _), b) in enumerate(targets.items())]
    return values.join(F.broadcast(values.sparkSession.createDataFrame(rows, "t int, c int, low double, high double")), "c").where("x >= low and x <= high").select("t", "x")


def _narrower(b: _Bracket, edges: Sequence[float], rank: float) -> tuple[float, float]:
    """The edges one part further out than those around the rank."""
    at = (rank - b.before) / max(b.n - 1, 1) * PARTS
    return edges[max(int(at) - 1, 0)], edges[min(math.ceil(at) + 1, PARTS)]


def _counted(values: DataFrame, targets: Mapping[tuple[int, float], _Bracket], wanted: Mapping[tuple[int, float], tuple[float, float]]) -> dict[tuple[int, float], _Bracket]:
    """The wanted brackets with what lies before and in them."""
    keys = list(wanted)
    bounds = values.sparkSession.createDataFrame([(n, *map(float, wanted[k])) for n, k in enumerate(keys)], "t int, from double, to double")
    rows = _inside(values, targets).join(F.broadcast(bounds), "t")
    counts = {r["t"]: r for r in rows.groupBy("t").agg(F.count_if(F.col("x") < F.col("from")).alias("before"), F.count_if(F.col("x").between(F.col("from"), F.col("to"))).alias("n")).collect()}
    return {k: _Bracket(*wanted[k], targets[k].before + counts[n]["before"], counts[n]["n"]) for n, k in enumerate(keys)}


def _quantile_name(column: str, q: float) -> str:
    return f"{column}_q{round(q * 100)}"


def _interpolated(pairs: Sequence, before: int, rank: float) -> float:
    """The value at a rank (from 0, maybe between two) of rising (x, n) that follow `before` others."""
    low, share = int(rank), rank - int(rank)
    at = {}
    for x, n in pairs:
        for k in (low, low + 1):
            if before <= k < before + n:
                at[k] = x
        before += n
    return at[low] if not share else at[low] + (at[low + 1] - at[low]) * share


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """(column, only_left, only_right, different) of two tables; numbers within the tolerance are equal, nulls equal each other."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(1).alias("__l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("__r"))
    both = a.join(b, list(keys), "full")
    kinds = dict(left.dtypes)

    def differs(c: str):
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        near = F.abs(x - y) <= tolerance if kinds[c] in ("double", "float", "int", "bigint") else x == y
        return F.col("__l").isNotNull() & F.col("__r").isNotNull() & ~F.coalesce(near, x.isNull() & y.isNull())

    one = both.agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), *[F.count_if(differs(c)).alias(f"d_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("only_left").alias("only_left"), F.col("only_right").alias("only_right"), F.col(f"d_{c}").alias("different")) for c in columns])))
