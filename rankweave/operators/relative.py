"""Features of an entrant relative to its contest, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

GROUP = "contest_id"


def group(key: str = GROUP):
    return Window.partitionBy(key)


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rank_min(x: str | Column, ascending: bool = False, key: str = GROUP) -> Column:
    """Rank in the group, ties take the smallest; null for null."""
    x = _col(x)
    by = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    return F.when(x.isNotNull(), F.rank().over(group(key).orderBy(by)))


def rank_first(x: str | Column, *ties: str, key: str = GROUP) -> Column:
    """Unique rank by falling value, ties by the given columns."""
    return F.row_number().over(group(key).orderBy(_col(x).desc_nulls_last(), *ties))


def rank_average(x: str | Column, ascending: bool = True, key: str = GROUP) -> Column:
    """Rank in the group, ties take their average; null for null. Both are windows of one order: rows are sorted once."""
    x = _col(x)
    by = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    ties = F.count("*").over(group(key).orderBy(by).rangeBetween(Window.currentRow, Window.currentRow))
    return rank_min(x, ascending, key) + (ties - 1) / 2


def rank_percent(x: str | Column, key: str = GROUP) -> Column:
    """Average rank over the number of values."""
    return rank_average(x, True, key) / F.count(_col(x)).over(group(key))


def from_mean(x: str | Column, key: str = GROUP) -> Column:
    return _col(x) - F.avg(_col(x)).over(group(key))


def from_best(x: str | Column, lower: bool = False, key: str = GROUP) -> Column:
    return _col(x) - (F.min if lower else F.max)(_col(x)).over(group(key))


def spread(x: str | Column, key: str = GROUP) -> Column:
    return F.stddev_samp(_col(x)).over(group(key))


def zscore(x: str | Column, key: str = GROUP) -> Column:
    """Null where all values are equal."""
    return from_mean(x, key) / F.nullif(spread(x, key), F.lit(0.0))


def clip01(x: Column) -> Column:
    """Clipped to 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def minmax(x: str | Column, lower: bool = False, key: str = GROUP) -> Column:
    """Scaled to 0..1 in the group, 1 best; 0 where there is no value or no spread."""
    x = _col(x)
    low, high = F.min(x).over(group(key)), F.max(x).over(group(key))
    scaled = ((high - x) if lower else (x - low)) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(clip01(scaled), F.lit(0.0))


def neighbour_gap(x: str | Column, step: int, *order: str, key: str = GROUP) -> Column:
    """Difference to the neighbour `step` places inside (positive) or outside (negative)."""
    return _col(x) - F.lag(_col(x), step).over(group(key).orderBy(*order))


def side_gap(x: str | Column, inner: bool, *order: str, key: str = GROUP) -> Column:
    """Difference to the mean of all entrants inside, or outside."""
    ends = (Window.unboundedPreceding, -1) if inner else (1, Window.unboundedFollowing)
    return _col(x) - F.avg(_col(x)).over(group(key).orderBy(*order).rowsBetween(*ends))


def masked_mean(x: str | Column, condition: Column, key: str = GROUP) -> Column:
    return F.avg(F.when(condition, _col(x))).over(group(key))


def halves(x: str, place: str, inner: int = 3) -> dict[str, Column]:
    """Means of the inner and the outer places, how far apart they are, and a row's distance from each."""
    low, high = masked_mean(x, F.col(place) <= inner), masked_mean(x, F.col(place) > inner)
    return {"inner_mean": low, "outer_mean": high, "halves_gap": high - low, "from_inner": F.col(x) - low, "from_outer": F.col(x) - high}


def arg_max(score: str | Column, place: str | Column, allowed: Column, key: str = GROUP) -> Column:
    """The smallest place that has the largest score of the group, among those allowed with a positive score."""
    score = _col(score)
    top = F.max(score).over(group(key))
    return F.min(F.when((score == top) & (score > 0) & allowed, _col(place))).over(group(key))


def softmax(x: str | Column, key: str = GROUP) -> Column:
    """Shares that add up to 1, equal ones where no value counts."""
    x = _col(x)
    e = F.exp(x - F.max(x).over(group(key)))
    return _share(e, key)


def normalise(p: str | Column, key: str = GROUP) -> Column:
    """Divided by the group's sum, equal shares where it isn't positive."""
    return _share(_col(p), key)


def _share(p: Column, key: str) -> Column:
    total = F.sum(p).over(group(key))
    return F.when(total > 0, p / total).otherwise(F.lit(1.0) / F.count("*").over(group(key)))


def entropy(p: str | Column, key: str = GROUP) -> Column:
    """Entropy of the group's shares over its largest value, 0 for a group of one."""
    q = F.greatest(_col(p), F.lit(1e-12))
    n = F.count("*").over(group(key))
    return F.when(n > 1, -F.sum(q * F.ln(q)).over(group(key)) / F.ln(n)).otherwise(0.0)
