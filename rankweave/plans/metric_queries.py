"""Queries over metrics, returns and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import confidence
from rankweave.operators import metrics as m
from rankweave.operators import tickets as t
from rankweave.plans.registry import query
from rankweave.plans.ticket_queries import CONDITIONAL, PRICED, TOP12, WEIGHTS, Q, both_frame, on_tickets, priced, ticket_frame

FACT = """
SELECT contest_id, any_value(payout) AS payout, any_value(site) AS site, any_value(race_date) AS race_date, count(*) AS tickets, max(CASE WHEN is_actual THEN nth END) AS actual_rank, max(CASE WHEN is_actual THEN probability END) AS p_actual,
       max(CASE WHEN nth = 1 THEN probability END) AS p_top, avg((probability - CAST(is_actual AS INT)) ** 2) AS brier, max(CASE WHEN nth = 1 THEN a END) = max(CASE WHEN is_actual THEN a END) AS first_hit
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth FROM t) GROUP BY contest_id
"""
KS = (1, 3, 5, 10, 12, 20)
QUALITY = "count(*) AS contests, count(*) AS covered, round(avg(CAST(first_hit AS INT)), 9) AS first_hit_rate, " + ", ".join(f"round(avg(CAST(actual_rank <= {k} AS INT)), 9) AS hit{k}" for k in KS) + ", round(avg(-ln(p_actual)), 6) AS log_loss, round(avg(brier), 9) AS brier, round(avg(p_actual), 9) AS mean_p_actual, round(avg(p_top), 9) AS mean_p_top"


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.contest_fact(ticket_frame(spark, sf_dir), keep=("payout", "site", "race_date"))


def labelled_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with the contest's confidence label: tickets are expanded once for both."""
    return m.contest_fact(confidence.labelled(ticket_frame(spark, sf_dir)), keep=("payout", "site", "race_date", "top12_label"))


def shown(df: DataFrame, *keys: str) -> DataFrame:
    """Rates rounded, counts as they are."""
    out = []
    for name, kind in df.dtypes:
        out.append(F.col(name) if name in keys or kind != "double" else F.round(name, 6 if name == "log_loss" else 9).alias(name))
    return df.select(out)


@query(on_tickets(f"SELECT {QUALITY} FROM f", f=FACT))
def hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fact(spark, sf_dir).agg(*m.quality()))


@query(on_tickets(f"SELECT CAST(date_trunc('month', race_date) AS DATE) AS month, {QUALITY} FROM f GROUP BY 1", f=FACT))
def monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by month, to be merged by weights."""
    return shown(fact(spark, sf_dir).groupBy(F.trunc("race_date", "month").alias("month")).agg(*m.quality()), "month")


@query(on_tickets("SELECT 'contests' AS metric, CAST(count(*) AS DOUBLE) AS value FROM f UNION ALL SELECT 'covered', count(*) FROM f UNION ALL SELECT 'hit1', round(avg(CAST(actual_rank <= 1 AS INT)), 9) FROM f UNION ALL SELECT 'hit12', round(avg(CAST(actual_rank <= 12 AS INT)), 9) FROM f UNION ALL SELECT 'brier', round(avg(brier), 9) FROM f", f=FACT))
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly metrics merged to those of all months."""
    monthly = fact(spark, sf_dir).groupBy(F.trunc("race_date", "month").alias("part")).agg(*m.quality())
    long = m.long_metrics(monthly, "monthly", ["part"], ["contests", "covered", "hit1", "hit12", "brier"]).withColumnRenamed("level1", "part")
    return m.merge_partial(long).select("metric", F.round("value", 9).alias("value"))


STRATEGIES = "SELECT f.*, strategy, least(wanted, tickets) AS bought, CASE WHEN strategy LIKE 'top%' THEN actual_rank <= wanted ELSE actual_rank > 12 - wanted AND actual_rank <= 12 END AS hit FROM f, (VALUES ('top1', 1), ('top3', 3), ('top5', 5), ('top8', 8), ('top10', 10), ('top12', 12), ('top20', 20), ('bottom8', 8), ('bottom6', 6)) AS s(strategy, wanted) WHERE payout > 0"
RECOVERY = "count(*) AS contests, round(avg(CAST(hit AS INT)), 9) AS hit_rate, round(sum(bought * 100.0), 6) AS total_stake, round(sum(CASE WHEN hit THEN payout ELSE 0 END), 2) AS total_return, round(sum(CASE WHEN hit THEN payout ELSE 0 END) / sum(bought * 100.0), 6) AS recovery, round(avg(payout), 4) AS mean_payout, round(coalesce(avg(CASE WHEN hit THEN payout END), 0), 4) AS mean_payout_hit, round(avg(bought), 6) AS mean_tickets"


def returns(df: DataFrame, *keys: str) -> DataFrame:
    places = {"hit_rate": 9, "total_stake": 6, "total_return": 2, "recovery": 6, "mean_payout": 4, "mean_payout_hit": 4, "mean_tickets": 6}
    return df.select(*keys, "contests", *[F.round(c, p).alias(c) for c, p in places.items()])


@query(on_tickets(f"SELECT strategy, {RECOVERY} FROM s GROUP BY strategy", f=FACT, s=STRATEGIES))
def uniform_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stake and return of nine strategies; the table of strategies is expanded in place of a join."""
    return returns(m.strategies(fact(spark, sf_dir)).groupBy("strategy").agg(*m.recovery()), "strategy")


@query(on_tickets(f"SELECT label AS confidence, strategy, CAST(grouping(strategy) AS INT) AS all_strategies, {RECOVERY} FROM (SELECT s.*, x.label FROM s JOIN x USING (contest_id)) GROUP BY GROUPING SETS ((label, strategy), (label))", f=FACT, s=STRATEGIES, q=Q, x=TOP12))
def return_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return by confidence label and strategy, and by label over all strategies, in one pass."""
    rows = m.strategies(labelled_fact(spark, sf_dir).withColumnRenamed("top12_label", "confidence"))
    sets = rows.groupingSets([["confidence", "strategy"], ["confidence"]], "confidence", "strategy")
    out = sets.agg(F.grouping("strategy").cast("int").alias("all_strategies"), *m.recovery())
    return returns(out, "confidence", "strategy", "all_strategies")


@query(on_tickets("SELECT CASE WHEN payout < 10000 THEN '<10k' WHEN payout < 50000 THEN '10k-50k' WHEN payout < 100000 THEN '50k-100k' ELSE '>=100k' END AS payout_band, count(*) AS contests, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(avg(CAST(actual_rank <= 1 AS INT)), 9) AS hit1, round(avg(CAST(actual_rank <= 12 AS INT)), 9) AS hit12, round(avg(-ln(p_actual)), 6) AS log_loss, round(avg(payout), 4) AS mean_payout FROM f WHERE payout > 0 GROUP BY 1", f=FACT))
def payout_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact(spark, sf_dir).where("covered and payout > 0").withColumn("payout_band", m.band(F.col("payout"), [10_000, 50_000, 100_000], ["<10k", "10k-50k", "50k-100k", ">=100k"]))
    out = rows.groupBy("payout_band").agg(F.count("*").alias("contests"), m.hit_rate(1).alias("hit1"), m.hit_rate(12).alias("hit12"), F.avg(-F.ln("p_actual")).alias("log_loss"), F.avg("payout").alias("mean_payout"))
    total = F.sum("contests").over(Window.partitionBy())  # four rows
    return out.select("payout_band", "contests", F.round(F.col("contests") / total, 9).alias("share"), F.round("hit1", 9).alias("hit1"), F.round("hit12", 9).alias("hit12"), F.round("log_loss", 6).alias("log_loss"), F.round("mean_payout", 4).alias("mean_payout"))


@query(on_tickets("""
SELECT count(*) AS covered, round(avg(CAST(r = 1 AS INT)), 9) AS top1, round(avg(1.0 / r), 9) AS mrr, round(avg(1.0 / b), 9) AS base_mrr, round(avg(b - r), 9) AS mean_gain, count(*) FILTER (r < b) AS improved, count(*) FILTER (r > b) AS worsened
FROM (SELECT contest_id, max(CASE WHEN is_actual THEN nth END) AS b, max(CASE WHEN is_actual THEN again END) AS r
      FROM (SELECT t.*, row_number() OVER (PARTITION BY t.contest_id ORDER BY probability DESC, t.a, t.b, t.c) AS nth, row_number() OVER (PARTITION BY t.contest_id ORDER BY round(k.p, 12) DESC, t.a, t.b, t.c) AS again FROM t JOIN k ON t.contest_id = k.contest_id AND t.a = k.a AND t.b = k.b AND t.c = k.c) GROUP BY contest_id)
""", w=WEIGHTS, k=CONDITIONAL))
def rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional tickets as a new order of the drawn ones."""
    both = both_frame(spark, sf_dir).withColumn("u", F.round("p", 12))
    ranked = both.withColumns({"base": F.row_number().over(t.order_of("probability")), "again": F.row_number().over(t.order_of("u"))}).where("is_actual")
    return shown(ranked.select(F.col("again").alias("actual_rank"), F.col("base").alias("base_rank")).agg(*m.rerank_quality(ranked)))


@query(on_tickets("""
SELECT threshold, round(avg(CAST(ev >= threshold AS INT)), 9) AS purchase_rate, round(count(DISTINCT CASE WHEN ev >= threshold THEN contest_id END) / count(DISTINCT contest_id), 9) AS contest_rate,
       round(coalesce(sum(CASE WHEN ev >= threshold AND is_actual THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN ev >= threshold THEN 1 ELSE 0 END), 0), 0), 9) AS hit_rate,
       round(coalesce(sum(CASE WHEN ev >= threshold AND is_actual THEN odds ELSE 0 END) / nullif(sum(CASE WHEN ev >= threshold THEN 1 ELSE 0 END), 0), 0), 6) AS recovery
FROM (SELECT *, round(probability * odds, 9) AS ev FROM p), (VALUES (0.9), (1.0), (1.05)) AS x(threshold) GROUP BY threshold
""", p=PRICED))
def ev_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit on every ticket whose expected value reaches a threshold."""
    thresholds = F.array(*[F.lit(x) for x in (0.9, 1.0, 1.05)])
    rows = priced(spark, sf_dir).withColumn("ev", F.round(F.col("probability") * F.col("odds"), 9)).withColumn("threshold", F.explode(thresholds))
    bought = F.col("ev") >= F.col("threshold")
    n = F.count_if(bought)
    out = rows.groupBy("threshold").agg(F.avg(bought.cast("double")).alias("purchase_rate"), (F.count_distinct(F.when(bought, F.col("contest_id"))) / F.count_distinct("contest_id")).alias("contest_rate"), m.ratio(F.count_if(bought & F.col("is_actual")), n).alias("hit_rate"), m.ratio(F.sum(F.when(bought & F.col("is_actual"), F.col("odds")).otherwise(0.0)), n).alias("recovery"))
    return out.select("threshold", F.round("purchase_rate", 9).alias("purchase_rate"), F.round("contest_rate", 9).alias("contest_rate"), F.round("hit_rate", 9).alias("hit_rate"), F.round("recovery", 6).alias("recovery"))


BACKTEST = """
SELECT contest_id, race_date, site, count(*) AS bought, max(CASE WHEN is_actual THEN 1 ELSE 0 END) AS hit, count(*) * 100.0 AS stake, sum(CASE WHEN is_actual THEN payout ELSE 0 END) AS won, string_agg(a || '-' || b || '-' || c, ' / ' ORDER BY nth) AS picks
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth FROM t) WHERE nth <= 5 GROUP BY contest_id, race_date, site
"""


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contest: the five best tickets, stake and return."""
    best = t.top_tickets(ticket_frame(spark, sf_dir), 5)
    picks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", t.ticket_text().alias("ticket")))), lambda x: x["ticket"]), " / ")
    return best.groupBy("contest_id", "race_date", "site").agg(F.count("*").alias("bought"), F.max(F.col("is_actual").cast("int")).alias("hit"), (F.count("*") * 100.0).alias("stake"), F.sum(F.when(F.col("is_actual"), F.col("payout")).otherwise(0.0)).alias("won"), picks.alias("picks"))


@query(on_tickets("SELECT contest_id, race_date, site, bought, hit, stake, won, picks FROM b", b=BACKTEST))
def contest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(spark, sf_dir)


DAILY = "count(*) AS contests, sum(hit) AS hits, round(sum(hit) / count(*), 9) AS hit_rate, sum(stake) AS stake, round(sum(won), 2) AS won, round(CASE WHEN sum(stake) > 0 THEN sum(won) / sum(stake) ELSE 0 END, 6) AS recovery"




def _totals() -> list:
    return [F.count("*").alias("contests"), F.sum("hit").alias("hits"), F.round(F.sum("hit") / F.count("*"), 9).alias("hit_rate"), F.sum("stake").alias("stake"), F.round(F.sum("won"), 2).alias("won"), F.round(m.ratio(F.sum("won"), F.sum("stake")), 6).alias("recovery")]


@query(on_tickets(f"SELECT race_date, {DAILY} FROM b GROUP BY race_date", b=BACKTEST))
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(spark, sf_dir).groupBy("race_date").agg(*_totals())


@query(on_tickets(f"SELECT site, month, {DAILY} FROM (SELECT *, month(race_date) AS month FROM b) GROUP BY GROUPING SETS ((site), (month), ())", b=BACKTEST))
def dimension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals by site, by month of the year and over all, in one pass."""
    df = backtest(spark, sf_dir).withColumn("month", F.month("race_date"))
    return df.groupingSets([["site"], ["month"], []], "site", "month").agg(*_totals())


@query(on_tickets("SELECT hit_band, count(*) AS contests, round(avg(hit3), 9) AS observed, round(avg(mass), 9) AS predicted FROM (SELECT CASE WHEN mass < 0.05 THEN '<0.05' WHEN mass < 0.06 THEN '0.05-0.06' WHEN mass < 0.08 THEN '0.06-0.08' ELSE '>=0.08' END AS hit_band, hit3, mass FROM (SELECT contest_id, round(sum(CASE WHEN nth <= 3 THEN probability END), 9) AS mass, max(CASE WHEN is_actual AND nth <= 3 THEN 1 ELSE 0 END) AS hit3 FROM p GROUP BY contest_id)) GROUP BY hit_band", p=PRICED))
def reliability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against observed rate that the best three hold the actual ticket, by band."""
    rows = priced(spark, sf_dir).groupBy("contest_id").agg(F.round(F.sum(F.when(F.col("nth") <= 3, F.col("probability"))), 9).alias("mass"), F.max((F.col("is_actual") & (F.col("nth") <= 3)).cast("int")).alias("hit3"))
    rows = rows.withColumn("hit_band", m.band(F.col("mass"), [0.05, 0.06, 0.08], ["<0.05", "0.05-0.06", "0.06-0.08", ">=0.08"]))
    return rows.groupBy("hit_band").agg(F.count("*").alias("contests"), F.round(F.avg("hit3"), 9).alias("observed"), F.round(F.avg("mass"), 9).alias("predicted"))
