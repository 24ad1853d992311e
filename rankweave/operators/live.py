"""Entries of a day joined with what is known before it, and the column roles of a training table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.operators.history import Recent, recent_tail

#: Columns that a contest's outcome brings; none of them is known before it.
OUTCOME = ("outcome_rank", "style", "payout", "target_rank", "is_win", "is_top2", "is_top3")
MEASURED = ("position", "lead_time", "trial_time")
IDENTITY = ("contest_id", "race_date", "contest_no", "slot")


class Family(NamedTuple):
    """Aggregates of the last rows of a key, joined to entries with the same key."""

    keys: tuple[str, ...]
    features: tuple[Recent, ...]


def history_before(df: DataFrame, day: date, months: int, time: str = "race_date") -> DataFrame:
    """Rows strictly before the day and not older than so many months; both bounds reach the scan."""
    start = F.add_months(F.lit(day), -months)
    return df.where((F.col(time) < F.lit(day)) & (F.col(time) >= start))


def entry_columns(df: DataFrame, drop: Sequence[str] = (*OUTCOME, *MEASURED)) -> DataFrame:
    """df without the columns that only a result can fill."""
    return df.drop(*drop)


def with_recent(entries: DataFrame, history: DataFrame, order: Sequence[str], families: Sequence[Family]) -> DataFrame:
    """Entries with every family's aggregates, null where a key has no history.

    A family reads the history of the entries' keys only, and its aggregates
    have one row a key, so the chain of left joins never adds rows.
    """
    bare = entries
    for keys, features in families:
        wanted = bare.select(*keys).distinct()
        known = recent_tail(history.join(wanted, list(keys), "left_semi"), keys, order, features)
        entries = entries.join(known, list(keys), "left")
    return entries


def with_starts(entries: DataFrame, history: DataFrame, key: str, out: str = "starts") -> DataFrame:
    """Entries with the number of rows of their key in the history; null where there is none."""
    return entries.join(history.groupBy(key).agg(F.count("*").alias(out)), key, "left")


def proxies(sources: Mapping[str, Sequence[str]], have: Sequence[str] = ()) -> dict[str, Column]:
    """Measures filled from the first history column that has a value; `have` names measures that are there already."""
    return {m: F.coalesce(*([F.col(m).cast("double")] if m in have else []), *(F.col(c).cast("double") for c in columns)) for m, columns in sources.items()}


def aligned(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The columns a model was fitted on, in order and cast; those that df lacks are typed nulls."""
    return df.select([(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def dropped_relatives(columns: Sequence[str], relative: Mapping[str, str]) -> list[str]:
    """Generated columns to drop: those whose source is still there, to be built again; others can't be and stay.

    relative: generated column to its source.
    """
    return [c for c in columns if c in relative and relative[c] in columns]


def feature_columns(df: DataFrame, exclude: Sequence[str] = (*IDENTITY, *OUTCOME)) -> list[str]:
    """Columns that may be inputs of a model."""
    return [f.name for f in df.schema.fields if f.name not in exclude and not isinstance(f.dataType, (T.DateType, T.TimestampType))]


def categorical_columns(df: DataFrame, columns: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """(column, categorical): named ones, and text columns with a value that is no number; one pass over df."""
    kinds = dict(df.dtypes)
    texts = [c for c in columns if c not in always and kinds[c] == "string"]
    odd = df.agg(F.lit(0).alias("__none"), *[F.coalesce(F.max((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int")), F.lit(0)).alias(c) for c in texts])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.lit(c in always) if c not in texts else F.col(c) == 1).alias("categorical")) for c in columns])
    return odd.select(F.inline(rows))


def feature_subset(columns: Sequence[str], prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> list[str]:
    """Columns with one of the prefixes or suffixes, in their order."""
    return [c for c in columns if c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes))]
