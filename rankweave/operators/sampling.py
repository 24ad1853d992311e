"""Contest-atomic sampling, splits and folds; the same rows whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEST = "contest_id"


def hash_number(x: str | Column, seed: str = "") -> Column:
    """A whole number of 32 bits from the first 8 hex digits of SHA-256; the same in any SQL engine."""
    x = F.col(x) if isinstance(x, str) else x
    text = F.concat(F.lit(seed), x.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def fold(x: str | Column, folds: int, seed: str = "") -> Column:
    """Fold of an id; all rows of a contest fall into one."""
    return F.pmod(hash_number(x, seed), F.lit(folds))


def random_split(df: DataFrame, ratio: float, seed: str) -> DataFrame:
    """df with is_valid: contests whose hash lies in the lowest `ratio` of the hash range.

    Unlike a cut at a counted rank this needs no global order; every contest
    decides for itself, and the share is met up to chance.
    """
    return df.withColumn("is_valid", hash_number(CONTEST, seed) < int(ratio * 2**32))


def exact_split(df: DataFrame, ratio: float, seed: str) -> DataFrame:
    """df with is_valid: exactly round(ratio * contests), at least one, by the order of their hashes.

    The cut is found by a histogram over the leading bits of the hash, and only
    contests in the bucket of the cut are ranked.
    """
    ids = df.select(CONTEST).distinct().withColumn("__h", hash_number(CONTEST, seed)).withColumn("__b", F.shiftright("__h", 20))
    counts = sorted((r["__b"], r["n"]) for r in ids.groupBy("__b").agg(F.count("*").alias("n")).collect())  # at most 4096 rows
    wanted = max(1, math.floor(ratio * sum(n for _, n in counts) + 0.5))
    before, bucket = 0, -1
    for bucket, n in counts:
        if before + n >= wanted:
            break
        before += n
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", CONTEST))
    edge = ids.where(F.col("__b") == bucket).withColumn("__r", rank).where(F.col("__r") <= wanted - before).select(CONTEST)
    chosen = ids.where(F.col("__b") < bucket).select(CONTEST).unionByName(edge).withColumn("__v", F.lit(True))
    return df.join(chosen, CONTEST, "left").withColumn("is_valid", F.coalesce("__v", F.lit(False))).drop("__v")


def hold_out_months(df: DataFrame, months: int, day: str = "race_date") -> DataFrame:
    """df with is_final: rows of the last months by the newest day; none if nothing else would be left."""
    bounds = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    cut = bounds.select(F.date_add(F.add_months("last", -months), 1).alias("cut"), "first")
    with_cut = df.join(F.broadcast(cut))  # one row
    return with_cut.withColumn("is_final", (F.col(day) >= F.col("cut")) & (F.col("first") < F.col("cut"))).drop("cut", "first")


def even_sample(df: DataFrame, size: int, day: str = "race_date") -> DataFrame:
    """Rows of `size` contests spread evenly over the contests in order of day and id.

    Contests are numbered by counts of days, so that no task sorts all of them.
    """
    ids = df.groupBy(CONTEST).agg(F.min(day).alias("__d"))
    per_day = ids.groupBy("__d").agg(F.count("*").alias("__c"))
    # days are few: a window over them all is a window over a calendar
    before = per_day.select("__d", (F.sum("__c").over(Window.orderBy("__d")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
    nth = F.row_number().over(Window.partitionBy("__d").orderBy(CONTEST)) + F.col("__before") - 1
    numbered = ids.join(F.broadcast(before), "__d").withColumn("__i", nth)
    wanted = df.sparkSession.range(size).withColumnRenamed("id", "__k")
    total = per_day.agg(F.sum("__c").alias("__n"))
    index = wanted.join(F.broadcast(total)).select(F.floor(F.col("__k") * (F.col("__n") - 1) / F.lit(max(size - 1, 1))).alias("__i")).distinct()
    kept = numbered.join(F.broadcast(index), "__i", "left_semi").select(CONTEST)
    return df.join(kept, CONTEST, "left_semi")


def matched_controls(df: DataFrame, case: Column, strata: list[str], ratio: int, seed: str) -> DataFrame:
    """Cases, and for each stratum `ratio` times as many controls in the order of their hash; one row for each contest in df."""
    marked = df.withColumn("is_case", case)
    cases = marked.groupBy(*strata).agg(F.count_if("is_case").alias("__cases"))
    order = F.row_number().over(Window.partitionBy(*strata, "is_case").orderBy(hash_number(CONTEST, seed), CONTEST))
    return marked.withColumn("__r", order).join(cases, strata).where(F.col("is_case") | (F.col("__r") <= ratio * F.col("__cases"))).drop("__r", "__cases")


def chronological_blocks(df: DataFrame, blocks: int, day: str = "race_date") -> DataFrame:
    """df with block 1..blocks of whole days, the first blocks a day longer where they don't divide evenly."""
    days = df.select(day).distinct().withColumn("block", F.ntile(blocks).over(Window.orderBy(day)))  # a calendar, not the data
    return df.join(F.broadcast(days), day)


def time_weights(day: str, payout: str, recent: str) -> Column:
    """Weight of a training row: by payout, less if older than `recent`."""
    by_payout = F.when(F.col(payout) >= 100_000, 5.0).when(F.col(payout) >= 50_000, 3.0).when(F.col(payout) >= 10_000, 2.0).otherwise(1.0)
    return by_payout * F.when(F.col(day) >= F.lit(recent).cast("date"), 0.7).otherwise(0.3)


def payout_weights(payout: str) -> Column:
    x = F.col(payout)
    return F.when(x < 1_000, 0.7).when(x < 5_000, 1.0).when(x < 10_000, 1.3).when(x < 30_000, 1.8).when(x < 50_000, 1.2).otherwise(0.6)


def date_splits(df: DataFrame, train_end: str, valid_end: str, first: str | None = None, last: str | None = None, day: str = "race_date") -> DataFrame:
    """df inside its bounds, with part: train, valid or test by day."""
    at = lambda x: F.lit(x).cast("date")
    kept = df if first is None else df.where(F.col(day) >= at(first))
    kept = kept if last is None else kept.where(F.col(day) <= at(last))
    return kept.withColumn("part", F.when(F.col(day) <= at(train_end), "train").when(F.col(day) <= at(valid_end), "valid").otherwise("test"))


def contest_sample(ids: DataFrame, n: int, seed: str) -> DataFrame:
    """n of the contests (one row each), by the order of their hashes."""
    return ids.withColumn("__h", hash_number(CONTEST, seed)).orderBy("__h", CONTEST).limit(n).drop("__h")


def last_contests(ids: DataFrame, n: int, day: str = "race_date") -> DataFrame:
    """The n latest contests (one row each)."""
    return ids.orderBy(F.desc(day), F.desc(CONTEST)).limit(n)


def date_cut(df: DataFrame, share: float, day: str = "race_date") -> DataFrame:
    """df with is_valid: days behind the first `share` of all distinct days."""
    days = df.select(day).distinct()  # a calendar, not the data
    numbered = days.select(F.col(day).alias("__d"), F.row_number().over(Window.orderBy(day)).alias("__n"), F.count("*").over(Window.partitionBy()).alias("__all"))
    cut = numbered.where(F.col("__n") <= F.floor(F.col("__all") * share)).agg(F.max("__d").alias("__cut"))
    return df.join(F.broadcast(cut)).withColumn("is_valid", F.col(day) > F.col("__cut")).drop("__cut")


def upset_training_set(ids: DataFrame, recent_months: int, history_months: int, payout: float, ratio: int, seed: str, recent: str, day: str = "race_date") -> DataFrame:
    """(contest, origin, weight): all recent contests at weight 1, and older ones of large payout with controls of their month and site."""
    bounds = ids.agg(F.add_months(F.max(day), -recent_months).alias("__recent"), F.add_months(F.max(day), -history_months).alias("__oldest"))
    at = ids.join(F.broadcast(bounds))  # one row
    new = at.where(F.col(day) > F.col("__recent")).select(CONTEST, F.lit("recent").alias("origin"), F.lit(1.0).alias("weight"))
    old = at.where((F.col(day) <= F.col("__recent")) & (F.col(day) > F.col("__oldest"))).withColumn("month", F.trunc(day, "month"))
    chosen = matched_controls(old, F.col("payout") >= payout, ["month", "site"], ratio, seed)
    return new.unionByName(chosen.select(CONTEST, F.lit("history").alias("origin"), time_weights(day, "payout", recent).alias("weight")))
