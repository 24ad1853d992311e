"""Metrics of ticket predictions: one row for each contest first, everything else from that.

`contest_fact` ranks the tickets of each contest once; hit rates, losses,
returns and cross tables are then aggregates of a table 120 times smaller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.relative import clip01
from rankweave.operators.tickets import CONTEST, order_of


def contest_fact(tickets: DataFrame, p: str = "probability", keep: Sequence[str] = ("payout",), also: Sequence[Column] = ()) -> DataFrame:
    """(contest, tickets, actuals, actual_rank, p_actual, p_top, brier, first_hit, kept columns); also: more aggregates of the contest's tickets."""
    ranked = tickets.withColumn("__nth", F.row_number().over(order_of(p)))
    fact = ranked.groupBy(CONTEST).agg(*_fact_columns(p, "__nth"), *[F.first(k, ignorenulls=True).alias(k) for k in keep], *also)
    return _covered(fact)


def contest_facts(tickets: DataFrame, variants: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """A contest's fact for each variant, by the column of its probability: tickets are ranked side by side, neither doubled nor shuffled."""
    ranked = tickets.withColumns({f"__nth_{v}": F.row_number().over(order_of(p)) for v, p in variants.items()})
    wide = ranked.groupBy(CONTEST).agg(*[F.struct(F.lit(v).alias("variant"), *_fact_columns(p, f"__nth_{v}")).alias(f"__{v}") for v, p in variants.items()], *[F.first(k, ignorenulls=True).alias(k) for k in keep])
    return _covered(wide.select(CONTEST, *keep, F.inline(F.array(*[f"__{v}" for v in variants]))))


def _fact_columns(p: str, nth: str) -> list[Column]:
    actual = lambda c: F.max(F.when(F.col("is_actual"), F.col(c)))
    top = lambda c: F.max(F.when(F.col(nth) == 1, F.col(c)))
    return [
        F.count("*").alias("tickets"), F.count_if("is_actual").alias("actuals"), actual(nth).alias("actual_rank"), F.greatest(actual(p), F.lit(1e-15)).alias("p_actual"), top(p).alias("p_top"),
        F.avg(F.pow(F.col(p) - F.col("is_actual").cast("double"), 2)).alias("brier"), (top("a") == actual("a")).alias("first_hit"),
    ]


def _covered(fact: DataFrame) -> DataFrame:
    one = F.col("actuals") == 1
    return fact.withColumns({"covered": one, "actual_rank": F.when(one, F.col("actual_rank")), "p_actual": F.when(one, F.col("p_actual")), "brier": F.when(one, F.col("brier")), "first_hit": one & F.coalesce("first_hit", F.lit(False)), "p_top": F.when(one, F.col("p_top"))})


def hit_rate(k: int) -> Column:
    """Share of all contests whose actual ticket is among the k best."""
    return F.avg(F.coalesce(F.col("actual_rank") <= k, F.lit(False)).cast("double"))


def quality(ks: Sequence[int] = (1, 3, 5, 10, 12, 20)) -> list[Column]:
    """Rates over all contests, losses over the covered ones; for use after any groupBy of the fact."""
    return [
        F.count("*").alias("contests"), F.count_if("covered").alias("covered"), F.avg(F.col("first_hit").cast("double")).alias("first_hit_rate"),
        *[hit_rate(k).alias(f"hit{k}") for k in ks], F.avg(-F.ln("p_actual")).alias("log_loss"), F.avg("brier").alias("brier"), F.avg("p_actual").alias("mean_p_actual"), F.avg("p_top").alias("mean_p_top"),
    ]


def strategies(fact: DataFrame, tops: Sequence[int] = (1, 3, 5, 8, 10, 12, 20), bottoms: Sequence[int] = (8, 6), stake: float = 100.0) -> DataFrame:
    """A row for each contest that can be paid out and each strategy: the n best tickets, or the n last of the best twelve."""
    table = F.array(*[F.struct(F.lit(f"top{n}").alias("strategy"), F.lit(0).alias("start"), F.lit(n).alias("wanted")) for n in tops], *[F.struct(F.lit(f"bottom{n}").alias("strategy"), F.lit(12).alias("start"), F.lit(n).alias("wanted")) for n in bottoms])
    rows = fact.where("covered and payout > 0").select("*", F.inline(table)).withColumn("bought", F.least("wanted", F.col("tickets").cast("int")))
    pool = F.least(F.lit(12), F.col("tickets").cast("int"))
    from_ = F.when(F.col("start") == 0, 0).otherwise(F.greatest(pool - F.col("bought"), F.lit(0)))
    upto = F.when(F.col("start") == 0, F.col("bought")).otherwise(pool)
    hit = (F.col("actual_rank") > from_) & (F.col("actual_rank") <= upto)
    return rows.withColumns({"hit": hit, "stake": F.col("bought") * stake, "won": F.when(hit, F.col("payout") * stake / 100).otherwise(0.0)})


def ratio(x: Column, y: Column) -> Column:
    """0 where nothing was staked."""
    return F.when(y != 0, x / y).otherwise(0.0)


def recovery() -> list[Column]:
    return [
        F.count("*").alias("contests"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.sum("stake").alias("total_stake"), F.sum("won").alias("total_return"),
        ratio(F.sum("won"), F.sum("stake")).alias("recovery"), F.avg("payout").alias("mean_payout"), F.coalesce(F.avg(F.when(F.col("hit"), F.col("payout"))), F.lit(0.0)).alias("mean_payout_hit"), F.avg("bought").alias("mean_tickets"),
    ]


def band(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for x in [edges[i], edges[i + 1]); the first has no lower, the last no upper edge."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names[:-1], strict=True))):
        out = F.when(x < edge, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def share_of(count: str, *keys: str) -> Column:
    """A row's share of the count of all rows with its keys; for tables of a few bands."""
    return F.col(count) / F.sum(count).over(Window.partitionBy(*keys))


def long_metrics(df: DataFrame, family: str, levels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(family, level1, level2, level3, metric, value): any metric table in one shape."""
    named = [F.lit(family).alias("family"), *[(F.col(levels[k]).cast("string") if k < len(levels) else F.lit(None).cast("string")).alias(f"level{k + 1}") for k in range(3)]]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*named, F.inline(pairs))


def merge_partial(parts: DataFrame, weight: str = "contests") -> DataFrame:
    """Partial metrics (part, metric, value) to one: counts add up, rates are weighted by the part's count."""
    n = parts.where(F.col("metric") == weight).select("part", F.col("value").alias("__w"))
    joined = parts.join(F.broadcast(n), "part")
    total = F.sum("value")
    weighted = ratio(F.sum(F.col("value") * F.col("__w")), F.sum("__w"))
    return joined.groupBy("metric").agg(F.when(F.first(F.col("metric").isin(weight, "covered")), total).otherwise(weighted).alias("value"))


def rerank_quality(both: DataFrame) -> list[Column]:
    """Of a fact with actual_rank and base_rank: how the second order does against the first."""
    return [F.count("*").alias("covered"), F.avg((F.col("actual_rank") == 1).cast("double")).alias("top1"), F.avg(1 / F.col("actual_rank")).alias("mrr"), F.avg(1 / F.col("base_rank")).alias("base_mrr"), F.avg(F.col("base_rank") - F.col("actual_rank")).alias("mean_gain"), F.count_if(F.col("actual_rank") < F.col("base_rank")).alias("improved"), F.count_if(F.col("actual_rank") > F.col("base_rank")).alias("worsened")]


def binary_quality(truth: Column, p: Column) -> list[Column]:
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    y = truth.cast("double")
    return [F.count("*").alias("n"), F.avg(y).alias("positive_rate"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg(F.pow(q - y, 2)).alias("brier")]


def value_rule(fact: DataFrame, rule: Mapping[str, int], recovery_cap: float, least_purchase: float, penalty: float, label: str = "label", stake: float = 100.0) -> DataFrame:
    """One row: what buying `rule[label]` tickets returns, scaled down where fewer contests than `least_purchase` are bought."""
    n = F.lit(0)
    for name, tickets in rule.items():
        n = F.when(F.col(label) == name, tickets).otherwise(n)
    rows = fact.where("covered and payout > 0").withColumn("n", F.least(n, F.col("tickets").cast("int")))
    bought, hit = F.col("n") > 0, F.col("actual_rank") <= F.col("n")
    facts = rows.agg(F.count("*").alias("contests"), F.count_if(bought).alias("bought"), F.coalesce(F.avg(F.when(bought, hit.cast("double"))), F.lit(0.0)).alias("raw_hit_rate"), F.sum(F.col("n") * stake).alias("total_stake"), F.sum(F.when(bought & hit, F.col("payout") * stake / 100).otherwise(0.0)).alias("total_return"))
    facts = facts.withColumns({"purchase_rate": ratio(F.col("bought"), F.col("contests")), "recovery": ratio(F.col("total_return"), F.col("total_stake"))})
    facts = facts.withColumn("coverage_factor", clip01(F.col("purchase_rate") / least_purchase))
    return facts.withColumns({"hit_rate": F.col("raw_hit_rate") * F.col("coverage_factor"), "normalized_recovery": clip01(F.col("recovery") / recovery_cap) * F.col("coverage_factor"), "penalty": F.greatest(least_purchase - F.col("purchase_rate"), F.lit(0.0)) * penalty})


def payout_capture(fact: DataFrame, k: int, cap: float) -> DataFrame:
    """One row: the payouts that the k best tickets catch, over all contests with a payout and over the hits."""
    hit = F.col("actual_rank") <= k
    got = F.when(hit, F.col("payout")).otherwise(0.0)
    return fact.where("covered and payout > 0").agg(F.coalesce(F.avg(got), F.lit(0.0)).alias("mean_capture"), F.coalesce(F.avg(F.when(hit, F.col("payout"))), F.lit(0.0)).alias("mean_hit"), F.coalesce(F.sum(got), F.lit(0.0)).alias("total"), F.coalesce(clip01(F.avg(got) / cap), F.lit(0.0)).alias("score"))
