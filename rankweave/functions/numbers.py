"""Number columns: fallbacks, blends and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.operators.relative import clip01


def first_available(*columns: str, default: float | None = 0.0) -> Column:
    """The first value that is there and a number."""
    found = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    return F.coalesce(*found, F.lit(default).cast("double"))


def weighted_blend(terms: Sequence[tuple[str | Column, float]]) -> Column:
    """Weighted mean of the terms that are there, clipped to 0..1; 0 where none is."""
    columns = [(F.col(c) if isinstance(c, str) else c, w) for c, w in terms]
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in columns), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in columns), F.lit(0.0))
    return F.coalesce(clip01(total / F.nullif(weight, F.lit(0.0))), F.lit(0.0))


def mapped(x: Column, values: dict[int, float], default: float = 0.0) -> Column:
    """A value for each whole number, else the default."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(x == k, v).otherwise(out)
    return out


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds


def hash_bucket(x: Column, buckets: int) -> Column:
    """A bucket of a text or number from the first 32 bits of its SHA-256, as a number that a learner can read."""
    return F.pmod(F.conv(F.substring(F.sha2(x.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("double")


def round_scaled(x: Column, places: int) -> Column:
    """x rounded as round(x * 10^places) / 10^places, halves away from 0, as SQL engines do.

    F.round reads the shortest decimal text of x instead, in which 260.465 is a
    half; times 100 it is a binary number below one.
    """
    scale = 10.0**places
    return F.round(x * scale) / scale
