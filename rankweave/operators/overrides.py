"""Positions and lead times that a user sets by hand: parsed, checked in one aggregate, joined to the entries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.tickets import CONTEST

#: Entrants of a contest, the largest change of a lead time, and where a changed one must lie.
SLOTS, LARGEST_DELTA, LEAD_LOW, LEAD_HIGH = 6, 0.10, 0.0, 1.0


def parsed_positions(text: Column) -> Column:
    """Entries (slot, position) from "213456", "2,1,3,4,5,6" or "1=2,2=1"; numbers that can't be read are null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    digits = F.when((F.size(parts) == 1) & F.get(parts, F.lit(0)).rlike(f"^[0-9]{{{SLOTS}}}$"), F.split(F.get(parts, F.lit(0)), "")).otherwise(parts)
    number = lambda s: F.trim(s).try_cast("int")
    pairs = F.transform(parts, lambda p: F.struct(number(F.split_part(p, F.lit("="), F.lit(1))).alias("slot"), number(F.split_part(p, F.lit("="), F.lit(2))).alias("position")))
    listed = F.transform(digits, lambda p, i: F.struct((i + 1).cast("int").alias("slot"), number(p).alias("position")))
    return F.when(F.trim(text) == "", F.slice(listed, 1, 0)).when(text.contains("="), pairs).otherwise(listed)


def refuse(df: DataFrame, faults: Mapping[str, Column]) -> None:
    """Raise with the number of rows for each fault that occurs; one aggregate over df."""
    found = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, c in enumerate(faults.values())]).head()
    if bad := [f"{n}: {found[i]}" for i, n in enumerate(faults) if found[i]]:
        raise ValueError("; ".join(bad))


def position_table(texts: DataFrame, text_col: str = "overrides") -> DataFrame:
    """(contest, slot, new_position) from a text for each contest; a text that can't be right raises. Null and blank texts set nothing."""
    rows = texts.where(F.col(text_col).isNotNull()).withColumn("__all", parsed_positions(F.col(text_col)))
    listed = ~F.col(text_col).contains("=") & (F.trim(text_col) != "")
    refuse(rows, {"a list needs a position for every slot": listed & (F.size("__all") != SLOTS)})
    out = rows.select(CONTEST, F.inline("__all")).select(CONTEST, "slot", F.col("position").alias("new_position"))
    outside = lambda c: F.col(c).isNull() | ~F.col(c).between(1, SLOTS)
    refuse(out, {"slots that don't exist": outside("slot"), "positions that don't exist": outside("new_position")})
    refuse(out.groupBy(CONTEST, "slot").agg(F.count("*").alias("n")), {"slots that are set twice": F.col("n") > 1})
    return out


def with_positions(entries: DataFrame, table: DataFrame) -> DataFrame:
    """Entries whose position is the one set, else their own, else their slot; two entrants at one position of a full contest raise."""
    joined = entries.join(table, [CONTEST, "slot"], "left")
    moved = joined.withColumn("position", F.coalesce("new_position", "position", "slot").cast("int")).drop("new_position")
    per = moved.groupBy(CONTEST).agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.max((F.col("position").isNull() | ~F.col("position").between(1, SLOTS)).cast("int")).alias("bad"))
    refuse(per, {"contests with positions that don't exist": F.col("bad") == 1, "contests with two entrants at one position": (F.col("n") == SLOTS) & (F.col("d") < SLOTS)})
    return moved


def with_lead_deltas(entries: DataFrame, table: DataFrame, lead: str = "lead_time") -> DataFrame:
    """Entries whose lead is changed by the delta of (contest, slot, delta); deltas and results out of range raise, a changed lead that isn't there too."""
    delta = F.col("delta").cast("double")
    refuse(table, {"deltas out of range": delta.isNull() | F.isnan(delta) | (F.abs(delta) > LARGEST_DELTA + 1e-12)})
    refuse(table.groupBy(CONTEST, "slot").agg(F.count("*").alias("n")), {"slots that are changed twice": F.col("n") > 1})
    joined = entries.join(table.select(CONTEST, "slot", delta.alias("__delta")), [CONTEST, "slot"], "left")
    changed = F.col(lead) + F.col("__delta")
    set_ = F.col("__delta").isNotNull() & (F.col("__delta") != 0)
    refuse(joined, {"leads that can't be changed": set_ & (changed.isNull() | ~changed.between(LEAD_LOW, LEAD_HIGH))})
    return joined.withColumn(lead, F.when(set_, changed).otherwise(F.col(lead))).drop("__delta")
