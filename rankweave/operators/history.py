"""Rolling history of an entity before each of its rows, and last-N aggregates as of a day."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.core.shared import dealt, spread, stored


class Feature(NamedTuple):
    """out = how(source) over the `window` rows before, null where fewer than `least` of them have a value."""

    out: str
    source: str
    window: int
    least: int
    how: str = "mean"


HOW = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[Feature], block: int | None = None, count_on: DataFrame | None = None) -> DataFrame:
    """df with each feature; windows of one key share a sort, whatever their lengths.

    The order must be total within a key. With few keys of very many rows give
    `block`: where a key has more rows than that (counts by key and day tell,
    written once), a key's days are cut into blocks of about that many rows, and
    each block gets the last days before it that its windows reach, so that no
    task holds a whole key and rows are shuffled once. The order's first column
    must be a date or a timestamp then. count_on: a frame with the same rows
    that is cheaper to count, where df is itself the result of windows. The
    result is the same either way.
    """
    longest = max(f.window for f in features)
    if block is not None:
        day = F.to_date(order[0])
        counts = stored((df if count_on is None else count_on).groupBy(*keys, day.alias("__c")).agg(F.count("*").alias("__n")), "days")
        most, rows = counts.groupBy(*keys).agg(F.sum("__n").alias("n")).agg(F.max("n"), F.sum("n")).head()
        if (most or 0) > block:
            return _blocked(df, keys, order, features, day, _blocks(counts, keys, max(block, longest), longest), rows)
    return _with_features(df, Window.partitionBy(*keys).orderBy(*order), features)


def _columns(window, features: Sequence[Feature]) -> list[Column]:
    out = []
    for f in features:
        frame = window.rowsBetween(-f.window, -1)
        value = HOW[f.how](f.source).over(frame)
        out.append(F.when(F.count(f.source).over(frame) >= f.least, value).alias(f.out))
    return out


def _with_features(df: DataFrame, window, features: Sequence[Feature]) -> DataFrame:
    """df with each feature over the window.

    A sliding frame is read again for each row. Means and sums of whole
    numbers don't need that: they are differences of sums and counts that run
    on over the key, which whole numbers keep exact. Others keep the frame.
    """
    whole = {n for n, kind in df.dtypes if kind in ("tinyint", "smallint", "int")}
    runs = [f for f in features if f.source in whole and f.how in ("mean", "sum")]
    if runs:
        upto = window.rowsBetween(Window.unboundedPreceding, -1)
        sources = dict.fromkeys(f.source for f in runs)
        df = df.withColumns({n: F.coalesce(c, F.lit(0)) for s in sources for n, c in ((f"__sum_{s}", F.sum(F.col(s).cast("long")).over(upto)), (f"__count_{s}", F.count(s).over(upto)))})
    found = dict(zip([f.out for f in features], _columns(window, features), strict=True))
    for f in runs:
        total, n = (F.col(c) - F.lag(c, f.window, 0).over(window) for c in (f"__sum_{f.source}", f"__count_{f.source}"))
        found[f.out] = F.when(n >= f.least, F.when(n > 0, total / n if f.how == "mean" else total)).alias(f.out)
    return df.select("*", *found.values()).drop(*[f"__{k}_{f.source}" for f in runs for k in ("sum", "count")])


def _blocks(counts: DataFrame, keys: Sequence[str], block: int, longest: int) -> DataFrame:
    """For each key and day the block (b) of its rows, and the later ones they are lent to."""
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(key.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = _lent(counts.withColumn("__before", before).withColumn("__own", F.floor(F.col("__before") / block)), keys, longest)
    place = lambda b, lent: F.struct(b.alias("b"), F.lit(lent).alias("lent"))
    return days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__c", F.concat(F.array(place(F.col("__own"), False)), F.transform("__lent", lambda b: place(b, True))).alias("__places"))


def _lent(days: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """days with the later blocks that a day's rows are lent to: those where the key goes on less than `longest` rows behind the day's end."""
    key = Window.partitionBy(*keys)
    days = days.withColumn("__near", F.collect_set("__own").over(key.orderBy("__before").rangeBetween(0, longest - 1)))
    later = F.coalesce(F.lead("__near").over(key.orderBy("__c")), F.array().cast("array<bigint>"))  # the next day begins where this one ends
    return days.withColumn("__lent", F.array_except(later, F.array("__own")))


MOST_BROADCAST = 1 << 18  # keys and days that every task may hold


def _looked_up(df: DataFrame, found: DataFrame, keys: Sequence[str], day: Column, how: str = "inner") -> DataFrame:
    """df joined with what was found by key (__k0..) and day (__c), without these."""
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    same = day.eqNullSafe(F.col("__c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(found, same, how).drop("__c", *[f"__k{i}" for i in range(len(keys))])


def _blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[Feature], day: Column, blocks: DataFrame, rows: int) -> DataFrame:
    placed = spread(_placed(_looked_up(df, blocks, keys, day)), rows, *keys, "__block")
    return _with_features(placed, Window.partitionBy(*keys, "__block").orderBy(*order), features).where(~F.col("__lent")).drop("__block", "__lent")


def _placed(df: DataFrame) -> DataFrame:
    """A row for each of its places."""
    return df.withColumn("__at", F.explode("__places")).withColumn("__block", F.col("__at.b")).withColumn("__lent", F.col("__at.lent")).drop("__at", "__places")


def rolling_together(df: DataFrame, families: Sequence[tuple[Sequence[str], Sequence[Feature]]], order: Sequence[str], block: int, count_on: DataFrame | None = None) -> DataFrame:
    """df with the features of families of few keys with very many rows, all from one shuffle.

    Days are cut into blocks of about `block` rows of whatever keys, and a
    block gets the last days of each key before it that its windows reach. Rows
    lent for one family do no harm to the others: they are older than all that
    the others' windows reach. Where a single day has more rows than a block,
    families are cut by their keys, one after the other (`rolling_history`).
    """
    day, bare = F.to_date(order[0]), df if count_on is None else count_on
    counts = [stored(bare.groupBy(*keys, day.alias("__c")).agg(F.count("*").alias("__n")), "days") for keys, _ in families]
    days = counts[0].groupBy("__c").agg(F.sum("__n").alias("__n"))
    rows, most = days.agg(F.sum("__n"), F.max("__n")).head()
    if (rows or 0) <= block or most > block:
        for keys, features in families:
            df = rolling_history(df, keys, order, features, block // len(families) if (rows or 0) > block else None, bare)
        return df
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a calendar
    own = days.select(F.col("__c").alias("__day"), F.floor(before / block).alias("__own"))
    placed = _looked_up(df, own.withColumnRenamed("__day", "__c"), (), day)
    for n, ((keys, features), found) in enumerate(zip(families, counts, strict=True)):
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
        known = found.join(F.broadcast(own), F.col("__c").eqNullSafe(F.col("__day"))).withColumn("__before", F.coalesce(upto, F.lit(0)))
        lent = _lent(known, keys, max(f.window for f in features)).where(F.size("__lent") > 0)
        lent = lent.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__c", F.col("__lent").alias(f"__to{n}"))
        placed = _looked_up(placed, lent, keys, day, "left")
    place = lambda b, lent: F.struct(b.alias("b"), F.lit(lent).alias("lent"))
    none = F.array().cast("array<bigint>")
    others = functools.reduce(F.array_union, [F.coalesce(f"__to{n}", none) for n in range(len(families))])
    placed = placed.withColumn("__places", F.concat(F.array(place(F.col("__own"), False)), F.transform(others, lambda b: place(b, True))))
    placed = dealt(_placed(placed.drop("__own", *[f"__to{n}" for n in range(len(families))])), 4 * rows, "__block")  # more parts than blocks, so that few meet in a task
    for keys, features in families:
        placed = _with_features(placed, Window.partitionBy("__block", *keys).orderBy(*order), features)
    return placed.where(~F.col("__lent")).drop("__block", "__lent")


def prior_count(keys: Sequence[str], order: Sequence[str]) -> Column:
    """How many rows of the key come before."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


class Recent(NamedTuple):
    """out = how(source) of the last `window` rows of a key that have a value."""

    out: str
    source: str
    window: int
    how: str = "mean"


def recent_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[Recent]) -> DataFrame:
    """One row for each key: aggregates of its last values, nulls left out before counting.

    Values are numbered from the end once for each source; the last of each
    source are then aggregated in one pass.
    """
    sources = list(dict.fromkeys(f.source for f in features))
    back = [F.desc(c) for c in order]
    numbers = {f"__n_{s}": F.when(F.col(s).isNotNull(), F.sum(F.when(F.col(s).isNotNull(), 1)).over(Window.partitionBy(*keys).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0))) for s in sources}
    return df.withColumns(numbers).groupBy(*keys).agg(*(HOW[f.how](F.when(F.col(f"__n_{f.source}") <= f.window, F.col(f.source))).alias(f.out) for f in features))


def tail_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def asof_last_n(queries: DataFrame, history: DataFrame, key: str, day: str, order: Sequence[str], source: str, n: int, out: str) -> DataFrame:
    """Each query row (key, day) with the mean of the last n values of its key on strictly earlier days.

    Values are numbered per key; a query's day is matched with the number of
    values before it by a window over days, and values are found by an equi-join
    on (key, block of n): the last n values lie in two neighbouring blocks, so
    the join never pairs a query with a whole history.
    """
    values = history.where(F.col(source).isNotNull()).select(F.col(key).alias("__k"), F.col(day).alias("__d"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("__n"), F.col(source).alias("__x"))
    per_day = values.groupBy("__k", "__d").agg(F.count("*").alias("__c"))
    days = queries.select(F.col(key).alias("__k"), F.col(day).alias("__d")).distinct().join(per_day, ["__k", "__d"], "full")
    upto = Window.partitionBy("__k").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    wanted = days.select("__k", "__d", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__before"))
    last = F.floor((F.col("__before") - 1) / n)
    wanted = wanted.where("__before > 0").withColumn("__b", F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))))
    blocks = values.withColumn("__b", F.floor((F.col("__n") - 1) / n)).drop("__d")
    hit = wanted.join(blocks, ["__k", "__b"]).where((F.col("__n") <= F.col("__before")) & (F.col("__n") > F.col("__before") - n))
    means = hit.groupBy("__k", "__d").agg(F.avg("__x").alias(out))
    return queries.join(means, (queries[key] == means["__k"]) & (queries[day] == means["__d"]), "left").drop("__k", "__d")


def asof_recent(queries: DataFrame, history: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], features: Sequence[Recent], asked: DataFrame | None = None, shared: Sequence[str] = (), rows: int = 0) -> DataFrame:
    """Each query row with aggregates of its key's last values on strictly earlier days, nulls left out before counting.

    Values of a key and day are trimmed to the longest window and put in one
    row. A day's frame then are the days that hold the last values before it,
    found by a range over the running number of values, so that it holds three
    windows of values at most, however many a day has; days too early for any
    day asked for are dropped before that. A key's history is never gathered,
    and rows of the same day see none of each other. The order decides inside
    a day. Keys and days must not be null. asked: a frame with the same keys
    and days that is cheaper to read, where queries is itself the result of
    joins. shared: some of the keys, with very many values, that all rows are
    shuffled by once (rows: how many there are); else rows are shuffled by key
    and day.
    """
    longest = {s: max(f.window for f in features if f.source == s) for s in dict.fromkeys(f.source for f in features)}
    wanted = (queries if asked is None else asked).select(*keys, day).distinct().withColumn("__asked", F.lit(True))
    both = history.select(*dict.fromkeys([*keys, day, *order, *longest]), F.lit(False).alias("__asked")).unionByName(wanted, allowMissingColumns=True)
    if shared:
        both = spread(both, rows, *shared) if rows else both
    inside = Window.partitionBy(*keys, day).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    values = both.withColumns({f"__n_{s}": F.count(s).over(inside) for s in longest})
    last = {s: F.collect_list(F.when(F.col(s).isNotNull() & (F.col(f"__n_{s}") <= n), F.struct(*[F.col(c) for c in order], F.col(s).cast("double").alias("__x")))) for s, n in longest.items()}
    days = values.groupBy(*keys, day).agg(*(F.transform(F.sort_array(c), lambda v: v["__x"]).alias(f"__v_{s}") for s, c in last.items()), F.max("__asked").alias("__asked"))
    key = Window.partitionBy(*keys)
    upto = key.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    # twice the number of values up to the day; a day without values stands behind the one that it shares the number with
    days = days.withColumns({f"__at_{s}": 2 * F.sum(F.size(f"__v_{s}").cast("long")).over(upto) + F.when(F.size(f"__v_{s}") > 0, 0).otherwise(1) for s in longest})
    # a day's own values are n at most, those wanted end before them: 2n values back from the day's number
    near = [F.col(f"__at_{s}") >= F.min(F.when(F.col("__asked"), F.col(f"__at_{s}"))).over(key) - 4 * n for s, n in longest.items()]
    days = days.withColumn("__near", functools.reduce(operator.or_, near)).where("__near").drop("__near")
    found = {}
    for s, n in longest.items():
        before = key.orderBy(f"__at_{s}").rangeBetween(-4 * n, -1)
        found[f"__l_{s}"] = F.flatten(F.collect_list(F.when(F.size(f"__v_{s}") > 0, F.col(f"__v_{s}"))).over(before))
    days = days.withColumns(found).where("__asked")
    out = [_of_last(F.col(f"__l_{f.source}"), f.window, f.how).alias(f.out) for f in features]
    known = days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(day).alias("__d"), *out)
    same = F.col(day) == F.col("__d")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    return queries.join(known, same, "left").drop("__d", *[f"__k{i}" for i in range(len(keys))])


def reachable(history: DataFrame, first, keys: Sequence[str], day: str, features: Sequence[Recent]) -> DataFrame:
    """Rows of the day `first` and later, and of the days before it that hold the last values of a key which the windows reach back to from there.

    For keys that are few: they are counted by day, and a day for each key is
    looked up in every task.
    """
    longest = {s: max(f.window for f in features if f.source == s) for s in dict.fromkeys(f.source for f in features)}
    counts = history.where(F.col(day) < F.lit(first)).groupBy(*keys, day).agg(*[F.count(s).alias(f"__c_{s}") for s in longest])
    later = Window.partitionBy(*keys).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, -1)
    wanted = [F.coalesce(F.sum(f"__c_{s}").over(later), F.lit(0)) < n for s, n in longest.items()]
    starts = counts.withColumn("__near", functools.reduce(operator.or_, wanted)).where("__near").groupBy(*keys).agg(F.min(day).alias("__from"))
    return history.join(F.broadcast(starts), list(keys), "left").where((F.col(day) >= F.col("__from")) | (F.col(day) >= F.lit(first))).drop("__from")


def _of_last(values: Column, n: int, how: str) -> Column:
    """An aggregate of the last n elements, null where there is none."""
    x = F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    size = F.size(x)
    mean = total(x) / F.when(size > 0, size)
    if how == "std":
        apart = F.transform(x, lambda v: (v - mean) * (v - mean))
        return F.when(size > 1, F.sqrt(total(apart) / (size - 1)))
    return {"mean": mean, "sum": F.when(size > 0, total(x)), "min": F.array_min(x), "max": F.array_max(x)}[how]
