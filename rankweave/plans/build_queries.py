"""Queries over the incremental build and the walk-forward backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.core.shared import shared_folder, stored
from rankweave.operators import live, relative
from rankweave.operators import metrics as m
from rankweave.operators import tickets as t
from rankweave.operators.history import asof_recent, reachable
from rankweave.plans.history_queries import BLOCK, CROWDED, ENTITY, F_SQL, FAMILIES, KEY, ORDER, SQL_HOW, _feature_sql, flagged, rounded, with_targets
from rankweave.plans.live_queries import FAMILIES as RECENT_FAMILIES
from rankweave.plans.live_queries import MONTHS
from rankweave.plans.registry import on_view, query
from rankweave.sources import months
from rankweave.streaming.incremental import Build, Family

FEW = (("machine_a",), ("machine_b",), *CROWDED)  # keys that are few and have very many rows
NINE = [Family(key, tuple(fs), BLOCK if key in FEW else None) for key, fs in {("entity_id",): ENTITY, **FAMILIES, **CROWDED}.items()]
BUILT = [f.out for family in NINE for f in family.features]


def incremental_build(spark: SparkSession, sf_dir: str, size: int) -> Build:
    """What the families need of the view, written by month and built in groups of `size` months."""
    folder = shared_folder(spark)
    build = Build(spark, f"{folder}/build", NINE, ORDER, counted="starts_before")
    months.write_months(flagged(spark, sf_dir).select("contest_id", *[c for c in build.carried if c != build.counted]), f"{folder}/months")
    for group in months.month_groups(spark, f"{folder}/months", size):
        build.advance(months.read_months(spark, f"{folder}/months", group))
    return build


@query(on_view("SELECT contest_id, slot, row_number() OVER (PARTITION BY entity_id ORDER BY race_date, contest_no, slot) - 1 AS starts_before, " + ", ".join(_feature_sql(list(f.features), ", ".join(f.keys)) for f in NINE) + " FROM t", t=F_SQL))
def incremental_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine families of rolling history and a counter of starts, built from groups of 45 months that carry their ends on."""
    return rounded(incremental_build(spark, sf_dir, 45).rows(), *BUILT, keep=[*KEY, "starts_before"])


DAYS = 60


def _period(df: DataFrame) -> tuple:
    """First and last day of the last DAYS days."""
    row = df.agg(F.date_sub(F.max("race_date"), DAYS - 1).alias("first"), F.max("race_date").alias("last")).head()
    return row["first"], row["last"]


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entries with their history, the period's rows with their results): the view is computed once and written from the first day that a window reaches."""
    first, last = _period(spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_orderdate").cast("date").alias("race_date")))
    day = F.col("race_date")
    v = stored(contest_view(spark, sf_dir).where((day >= F.add_months(F.lit(first), -MONTHS)) & (day <= F.lit(last))), "period")
    results = v.where(day >= F.lit(first))
    entries = live.entry_columns(results)
    history = with_targets(v.where(day < F.lit(last)))
    count = history.count()
    rows = entries
    for keys, features in RECENT_FAMILIES:
        if "entity_id" in keys:
            rows = asof_recent(rows, history, keys, "race_date", ORDER, features, entries, ["entity_id"], count)
        else:
            rows = asof_recent(rows, reachable(history, first, keys, "race_date", features), keys, "race_date", ORDER, features, entries)
    return rows, results


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the period with nine families of history from before each one's own day; earlier days of the period count."""
    return _walked(spark, sf_dir)[0]


def _asof_sql(family: live.Family, name: str) -> str:
    sources = dict.fromkeys(f.source for f in family.features)
    numbers = ", ".join(f"h.{s}, CASE WHEN h.{s} IS NOT NULL THEN count(h.{s}) OVER (PARTITION BY q.contest_id, q.slot ORDER BY h.race_date DESC, h.contest_no DESC, h.slot DESC ROWS UNBOUNDED PRECEDING) END AS n_{s}" for s in sources)
    found = ", ".join(f"{SQL_HOW[f.how]}(CASE WHEN n_{f.source} <= {f.window} THEN {f.source} END) AS {f.out}" for f in family.features)
    same = " AND ".join(f"q.{k} = h.{k}" for k in family.keys)
    return f"LEFT JOIN (SELECT contest_id, slot, {found} FROM (SELECT q.contest_id, q.slot AS slot, {numbers} FROM q JOIN h ON {same} AND h.race_date < q.race_date) AS x(contest_id, slot, {', '.join(f'{s}, n_{s}' for s in sources)}) GROUP BY contest_id, slot) AS {name} USING (contest_id, slot)"


PERIOD = f"(SELECT CAST(max(race_date) - INTERVAL {DAYS - 1} DAY AS DATE) FROM v)"
AHEAD = {
    "h": f"{F_SQL} WHERE race_date >= CAST({PERIOD} - INTERVAL {MONTHS} MONTH AS DATE)",
    "q": f"SELECT * FROM v WHERE race_date >= {PERIOD}",
    "w": "SELECT q.*, " + ", ".join(f.out for fam in RECENT_FAMILIES for f in fam.features) + " FROM q " + " ".join(_asof_sql(f, f"f{i}") for i, f in enumerate(RECENT_FAMILIES)),
}
KNOWN = [f.out for fam in RECENT_FAMILIES for f in fam.features]


@query(on_view("SELECT contest_id, slot, race_date, " + ", ".join(f"round({c}, 9) AS {c}" for c in KNOWN) + " FROM w", **AHEAD))
def walk_forward_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each entry of the last 60 days before its day began."""
    return rounded(walk_forward(spark, sf_dir), *KNOWN, keep=[*KEY, "race_date"])


#: Weights of the score that the backtest ranks by.
SCORE = {"win30": 1.2, "top3_30": 0.5, "site_win": 0.6, "slot_top3": 0.4, "machine_a_top3": 0.3, "machine_b_top3": 0.3, "site_slot_win": 0.8}
SCORED = {
    **AHEAD,
    "w6": "SELECT *, round(" + " + ".join(f"{w} * coalesce({c}, 0)" for c, w in SCORE.items()) + ", 9) AS score FROM w WHERE contest_id IN (SELECT contest_id FROM v GROUP BY contest_id HAVING count(*) = 6)",
    "sh": "SELECT *, e / sum(e) OVER (PARTITION BY contest_id) AS share FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY contest_id)) AS e FROM w6)",
    "tk": """
SELECT x.contest_id, x.race_date, x.site, x.payout, x.slot AS a, y.slot AS b, z.slot AS c, round(x.share * (y.share / (1 - x.share)) * (z.share / (1 - x.share - y.share)), 12) AS probability, x.outcome_rank = 1 AND y.outcome_rank = 2 AND z.outcome_rank = 3 AS is_actual
FROM sh AS x JOIN sh AS y ON x.contest_id = y.contest_id AND x.slot <> y.slot JOIN sh AS z ON x.contest_id = z.contest_id AND z.slot <> x.slot AND z.slot <> y.slot""",
    "bt": """
SELECT contest_id, race_date, site, CAST(max(CASE WHEN is_actual THEN nth END) AS INT) AS actual_rank, count(*) FILTER (nth <= 5) AS bought, max(CASE WHEN is_actual AND nth <= 5 THEN 1 ELSE 0 END) AS hit, count(*) FILTER (nth <= 5) * 100.0 AS stake, sum(CASE WHEN is_actual AND nth <= 5 THEN payout ELSE 0 END) AS won, string_agg(a || '-' || b || '-' || c, ' / ' ORDER BY nth) FILTER (nth <= 5) AS picks
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth FROM tk) GROUP BY contest_id, race_date, site""",
}


def walk_forward_backtest_rows(spark: SparkSession, sf_dir: str, n: int = 5, stake: float = 100.0) -> DataFrame:
    """One row for each complete contest of the period: the n best tickets by what was known before its day, stake and return."""
    rows, results = _walked(spark, sf_dir)
    six = t.complete_groups(rows.join(results.select(*KEY, "position", "outcome_rank", "payout"), KEY))
    score = F.round(sum((w * F.coalesce(c, F.lit(0.0)) for c, w in SCORE.items()), F.lit(0.0)), 9)
    shares = six.withColumn("share", relative.softmax(score)).withColumn("total", F.lit(1.0))
    found = t.permutations(shares.select("contest_id", "slot", "race_date", "site", "payout", "share", "outcome_rank", "total"), ["share", "outcome_rank"], keep=["race_date", "site", "payout", "total"])
    actual = (F.col("outcome_rank_a") == 1) & (F.col("outcome_rank_b") == 2) & (F.col("outcome_rank_c") == 3)
    ranked = found.withColumns({"probability": F.round(t.draw_probability("share"), 12), "is_actual": actual}).withColumn("nth", F.row_number().over(t.order_of("probability")))
    bought = F.col("nth") <= n
    hit = bought & F.col("is_actual")
    picks = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(bought, F.struct("nth", t.ticket_text().alias("ticket"))))), lambda x: x["ticket"]), " / ")
    return ranked.groupBy("contest_id", "race_date", "site").agg(
        F.max(F.when(F.col("is_actual"), F.col("nth"))).alias("actual_rank"), F.count_if(bought).alias("bought"), F.max(hit.cast("int")).alias("hit"), (F.count_if(bought) * stake).alias("stake"),
        F.sum(F.when(hit, F.col("payout") * stake / 100).otherwise(0.0)).alias("won"), picks.alias("picks"),
    )


@query(on_view("SELECT contest_id, race_date, site, actual_rank, bought, hit, stake, round(won, 2) AS won, picks FROM bt", **SCORED))
def walk_forward_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets, stake and return of each contest of the last 60 days, no day seen before it was over."""
    return walk_forward_backtest_rows(spark, sf_dir).withColumn("won", F.round("won", 2))


TOPS = (1, 3, 5, 12)


@query(on_view("SELECT race_date, site, CAST(grouping(race_date) + 2 * grouping(site) AS INT) AS level, count(*) AS contests, sum(hit) AS hits, " + ", ".join(f"round(avg(CAST(actual_rank <= {k} AS INT)), 9) AS top{k}" for k in TOPS) + ", sum(stake) AS stake, round(sum(won), 2) AS won, round(sum(won) / sum(stake), 6) AS recovery FROM bt GROUP BY GROUPING SETS ((race_date), (site), ())", **SCORED))
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest by day, by site and over all in one pass, with the share of contests whose outcome is among the k best."""
    rows = walk_forward_backtest_rows(spark, sf_dir)
    level = (F.grouping("race_date") + 2 * F.grouping("site")).cast("int").alias("level")
    rates = [F.round(m.hit_rate(k), 9).alias(f"top{k}") for k in TOPS]
    return rows.groupingSets([["race_date"], ["site"], []], "race_date", "site").agg(level, F.count("*").alias("contests"), F.sum("hit").alias("hits"), *rates, F.sum("stake").alias("stake"), F.round(F.sum("won"), 2).alias("won"), F.round(m.ratio(F.sum("won"), F.sum("stake")), 6).alias("recovery"))
