"""Queries over overrides, slot confidence, upset terms, evaluation as a live day sees it, and a search over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.core.shared import stored
from rankweave.operators import confidence, overrides, relative, sampling, search
from rankweave.operators import metrics as m
from rankweave.operators.history import Feature, rolling_history
from rankweave.operators.tickets import complete_groups
from rankweave.plans.history_queries import KEY, ORDER, flagged
from rankweave.plans.hit_queries import FOLD
from rankweave.plans.metric_queries import KS
from rankweave.plans.model_queries import MIXED, OBJECTIVES, STEPS, WEIGHT_GRID, simplex_grid
from rankweave.plans.registry import on_view, query
from rankweave.plans.ticket_queries import BANDED, SIX, T3, T3F, T3G, TABLE, TOP12, Q, _clip, on_tickets, slot_shares, ticket_frame

G = "PARTITION BY contest_id"
TEXTS = {0: "654321", 3: "2, 1,3,4,6,5", 6: "1=2,2=1"}
MOVED = {0: {k: 7 - k for k in range(1, 7)}, 3: {1: 2, 2: 1, 3: 3, 4: 4, 5: 6, 6: 5}, 6: {1: 2, 2: 1}}
AT_SLOT = "CASE contest_id % 9 " + " ".join(f"WHEN {k} THEN " + "CASE slot " + " ".join(f"WHEN {s} THEN {p}" for s, p in to.items()) + " END" for k, to in MOVED.items()) + " END"


@query(on_view(f"SELECT contest_id, slot, CAST(coalesce({AT_SLOT}, slot) AS INT) AS position, row_number() OVER ({G} ORDER BY coalesce({AT_SLOT}, slot)) = 1 AS is_favourite FROM six", six=SIX))
def position_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without positions, some contests with positions set by a text in one of three forms."""
    six = stored(complete_groups(contest_view(spark, sf_dir)).select(*KEY), "slots")  # every check reads them
    entries = six.select(*KEY, F.lit(None).cast("int").alias("position"))
    text = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])[(F.col("contest_id") % 9).cast("int")]
    table = overrides.position_table(entries.where("slot = 1").select("contest_id", text.alias("overrides")))
    return overrides.with_positions(entries, table).select(*KEY, "position", (relative.rank_min("position", ascending=True) == 1).alias("is_favourite"))


DELTA = "CASE WHEN slot = contest_id % 6 + 1 THEN (contest_id % 5) / 100.0 END"


@query(on_view(f"SELECT contest_id, slot, round(lead_time + coalesce({DELTA}, 0), 9) AS lead_time, rank() OVER ({G} ORDER BY round(lead_time, 9)) AS before, rank() OVER ({G} ORDER BY round(lead_time + coalesce({DELTA}, 0), 9)) AS after FROM six", six=SIX))
def lead_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks before and after lead times are changed by a checked table of deltas."""
    six = complete_groups(contest_view(spark, sf_dir)).withColumn("before", relative.rank_min(F.round("lead_time", 9), ascending=True))
    six = stored(six.select(*KEY, "lead_time", "before"), "leads")  # every check reads them
    table = six.select(*KEY, F.expr(DELTA).alias("delta")).where("delta is not null")
    changed = overrides.with_lead_deltas(six, table)
    return changed.select(*KEY, F.round("lead_time", 9).alias("lead_time"), "before", relative.rank_min(F.round("lead_time", 9), ascending=True).alias("after"))


@query(on_tickets(f"""
SELECT contest_id, score AS first_score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'middle' ELSE 'low' END AS first_label, first_slot, round(p, 6) AS first_probability, round(p - p2, 6) AS first_gap, round(share3, 6) AS share3, round(1 - ent, 6) AS first_concentration
FROM (SELECT *, round(round({_clip(f"0.5 * {_clip('(p - 1 / 6.0) / 0.35')} + 0.35 * {_clip('(p - p2) / 0.2')} + 0.15 * {_clip('(1 - ent) / 0.45')} - 0.08 * {_clip('(1 - p - 0.75) / 0.25')}")} * 100, 9), 1) AS score
      FROM (SELECT contest_id, max(CASE WHEN n = 1 THEN slot END) AS first_slot, max(CASE WHEN n = 1 THEN share END) AS p, max(CASE WHEN n = 2 THEN share END) AS p2, 1 / 3.0 AS share3, -sum(share * ln(greatest(share, 1e-12))) / ln(count(*)) AS ent
            FROM (SELECT *, row_number() OVER ({G} ORDER BY round(share, 12) DESC, slot) AS n FROM sh) GROUP BY contest_id))
"""))
def confidence_slot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slot comes first by the slots' own probabilities, and how surely; it goes before the tickets' view where it is there."""
    shares = slot_shares(spark, sf_dir).withColumn("upset", 1 - F.max("share").over(relative.group()))
    out = confidence.first_slot_from_shares(shares, "share")
    return out.select("contest_id", "first_score", "first_label", "first_slot", *[F.round(c, 6).alias(c) for c in ("first_probability", "first_gap", "share3", "first_concentration")])


UP = "SELECT contest_id, 1 - max(share) AS upset FROM sh GROUP BY contest_id"
UPSET12 = TOP12.replace("0.1 * " + _clip("conc / 0.25"), "0.1 * " + _clip("conc / 0.25") + " - 0.1 * " + _clip("(upset - 0.7) / 0.3")).replace("FROM q GROUP BY contest_id))", "FROM q GROUP BY contest_id) JOIN up USING (contest_id))")
UPSET3 = T3.replace("0.15 * " + _clip("(1 - ent) / 0.25"), "0.15 * " + _clip("(1 - ent) / 0.25") + " - 0.08 * " + _clip("(upset - 0.75) / 0.25")).replace("FROM f JOIN g USING (contest_id)", "FROM f JOIN g USING (contest_id) JOIN up USING (contest_id)")


@query(on_tickets("SELECT contest_id, x.score AS top12_score, x.label AS top12_label, t3.score AS top3_score, round(up.upset, 9) AS upset FROM x JOIN t3 USING (contest_id) JOIN up USING (contest_id)", up=UP, q=Q, x=UPSET12, f=T3F, g=T3G, t3=UPSET3))
def confidence_with_upset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the twelve and three best tickets with what an unsettled contest takes off."""
    tickets = ticket_frame(spark, sf_dir).withColumn("upset", 1 - F.max("share_a").over(relative.group()))
    three = confidence.top3_confidence(tickets, also=[F.max("upset").alias("upset_max")])
    both = confidence.top12_confidence(tickets).join(three, "contest_id")
    return both.select("contest_id", "top12_score", "top12_label", "top3_score", F.round("upset_max", 9).alias("upset"))


VARIANTS = ("raw", "aligned")
MEASURES = ["contests", "covered", "first_hit_rate", *[f"hit{k}" for k in KS], "log_loss", "brier", "mean_p_actual", "mean_p_top"]
ALIGNED = {
    "q": Q, "f": TOP12, "b": BANDED, "ad": TABLE.replace("FROM b GROUP BY", f"FROM b WHERE {FOLD} <> 0 GROUP BY"),
    "al": "SELECT *, round(x / sum(x) OVER (PARTITION BY contest_id), 12) AS aligned FROM (SELECT b.*, least(1, greatest(0, probability * coalesce(factor, 1))) AS x FROM b LEFT JOIN ad USING (confidence, band))",
    "two": "SELECT 'raw' AS variant, contest_id, a, b, c, is_actual, probability AS p FROM al UNION ALL SELECT 'aligned', contest_id, a, b, c, is_actual, aligned FROM al",
    "fa": f"""
SELECT variant, contest_id, {FOLD} = 0 AS held_out, max(CASE WHEN is_actual THEN nth END) AS actual_rank, max(CASE WHEN is_actual THEN p END) AS p_actual, max(CASE WHEN nth = 1 THEN p END) AS p_top, avg((p - CAST(is_actual AS INT)) ** 2) AS brier, max(CASE WHEN nth = 1 THEN a END) = max(CASE WHEN is_actual THEN a END) AS first_hit
FROM (SELECT *, row_number() OVER (PARTITION BY variant, contest_id ORDER BY p DESC, a, b, c) AS nth FROM two) GROUP BY variant, contest_id""",
    "me": "SELECT variant, held_out, CAST(count(*) AS DOUBLE) AS contests, CAST(count(*) AS DOUBLE) AS covered, avg(CAST(first_hit AS INT)) AS first_hit_rate, " + ", ".join(f"avg(CAST(actual_rank <= {k} AS INT)) AS hit{k}" for k in KS) + ", avg(-ln(greatest(p_actual, 1e-15))) AS log_loss, avg(brier) AS brier, avg(p_actual) AS mean_p_actual, avg(p_top) AS mean_p_top FROM fa GROUP BY variant, held_out",
}


@query(on_tickets("SELECT 'evaluation' AS family, variant AS level1, CAST(held_out AS VARCHAR) AS level2, CAST(NULL AS VARCHAR) AS level3, metric, round(value, 6) AS value FROM (UNPIVOT me ON " + ", ".join(MEASURES) + " INTO NAME metric VALUE value)", **ALIGNED))
def live_aligned_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of tickets as they come and as a live day shows them, pulled to rates that other folds had; both ranked side by side."""
    tickets = ticket_frame(spark, sf_dir)
    table = stored(confidence.fit_adjustment(tickets.where(sampling.fold("contest_id", 5) != 0)).select("confidence", "band", "factor"), "factors")
    both = confidence.apply_adjustment(tickets, table).withColumns({"aligned": F.round("adjusted", 12), "held_out": sampling.fold("contest_id", 5) == 0})
    fact = m.contest_facts(both, dict(zip(VARIANTS, ("probability", "aligned"), strict=True)), keep=("held_out",))
    out = m.long_metrics(fact.groupBy("variant", "held_out").agg(*m.quality(KS)), "evaluation", ["variant", "held_out"], MEASURES)
    return out.withColumn("value", F.round("value", 6))


def scored_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each complete contest: its slots with three scores as shares, and a fold."""
    six = complete_groups(flagged(spark, sf_dir))
    df = rolling_history(six, ["entity_id"], ORDER, [Feature("form", "outcome_rank", 30, 3), Feature("win", "is_win", 30, 3)])
    scores = ("raw_score", F.coalesce(-F.col("form"), F.lit(0.0)), F.coalesce("win", F.lit(0.0)))
    df = df.withColumns({f"s{i}": relative.softmax(c) for i, c in enumerate(scores)})
    return df.groupBy("contest_id").agg(F.collect_list(F.struct("slot", "outcome_rank", "s0", "s1", "s2")).alias("slots")).withColumn("fold", sampling.fold("contest_id", FOLDS))


def in_order(at: DataFrame, *keep: str) -> DataFrame:
    """Contests beside weights w: their slots by falling blended score (o), and the winner's place (won)."""
    score = lambda c: F.round(F.col("w.w0") * c["s0"] + F.col("w.w1") * c["s1"] + F.col("w.w2") * c["s2"], 12)
    order = F.sort_array(F.transform("slots", lambda c: F.struct((-score(c)).alias("s"), c["slot"].alias("slot"), c["outcome_rank"].alias("rank"))))
    return at.select(*keep, order.alias("o")).withColumn("won", F.array_position(F.transform("o", lambda c: c["rank"] == 1), F.lit(True)))


FOLDS = 4
PARTS = ("hit1", "overlap", "mrr", "log_loss", "mean_rank")
BY_FOLD = f"""
SELECT w0, w1, w2, fold, count(*) AS n, avg(CAST(won = 1 AS INT)) AS hit1, avg(three / 3.0) AS overlap, avg(1.0 / won) AS mrr, avg(-ln(greatest(p, 1e-15))) AS log_loss, avg(best) AS mean_rank
FROM (SELECT w0, w1, w2, contest_id, CAST(({FOLD.replace('% 5', f'% {FOLDS}')}) AS BIGINT) AS fold, max(CASE WHEN outcome_rank = 1 THEN n END) AS won, count(*) FILTER (n <= 3 AND outcome_rank <= 3) AS three, max(CASE WHEN outcome_rank = 1 THEN score END) AS p, max(CASE WHEN n = 1 THEN outcome_rank END) AS best
      FROM (SELECT *, row_number() OVER (PARTITION BY w0, w1, w2, contest_id ORDER BY score DESC, slot) AS n FROM (SELECT *, round(w0 * s0 + w1 * s1 + w2 * s2, 12) AS score FROM mx, wg)) GROUP BY w0, w1, w2, contest_id) GROUP BY w0, w1, w2, fold
"""
_EACH = " UNION ALL ".join(f"SELECT '{name}' AS objective, w0, w1, w2, fold, n, {' + '.join(f'{w} * {c}' for c, w in table.items())} AS value FROM bf" for name, table in OBJECTIVES.items())
_OVER_FOLDS = f"SELECT objective, w0, w1, w2, round(sum(n * value) / sum(n), 9) AS value, round(min(value), 6) AS worst_fold, count(*) AS folds FROM ({_EACH}) GROUP BY objective, w0, w1, w2"


@query(on_view(f"SELECT objective, w0, w1, w2, round(value, 6) AS value, worst_fold, folds FROM (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY value DESC, w0, w1, w2) AS n FROM ({_OVER_FOLDS})) WHERE n = 1", six=SIX, mx=MIXED, wg=WEIGHT_GRID, bf=BY_FOLD))
def fold_objective_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight vector of a simplex grid over folds: each objective's mean weighted by the folds' contests, the best vector and its worst fold.

    Candidates and folds come from one pass: a contest's slots are one array
    beside the grid, and only metrics of a candidate and fold are shuffled.
    """
    contests = scored_contests(spark, sf_dir)
    points = simplex_grid(spark, 3, STEPS).agg(F.collect_list(F.struct("w0", "w1", "w2")).alias("points"))
    at = contests.join(F.broadcast(points)).withColumn("w", F.explode("points"))  # one row
    at = in_order(at, "w", "fold")
    three = F.size(F.filter(F.slice("o", 1, 3), lambda c: c["rank"] <= 3)) / 3
    loss = -F.ln(F.greatest(-F.element_at("o", F.col("won").cast("int"))["s"], F.lit(1e-15)))
    by_fold = at.groupBy("w.w0", "w.w1", "w.w2", "fold").agg(F.count("*").alias("n"), F.avg((F.col("won") == 1).cast("double")).alias("hit1"), F.avg(three).alias("overlap"), F.avg(1 / F.col("won")).alias("mrr"), F.avg(loss).alias("log_loss"), F.avg(F.element_at("o", 1)["rank"]).alias("mean_rank"))
    value = lambda table: sum((w * F.col(c) for c, w in table.items()), F.lit(0.0))
    long = by_fold.select("w0", "w1", "w2", "fold", "n", F.inline(F.array(*[F.struct(F.lit(name).alias("objective"), value(table).alias("value")) for name, table in OBJECTIVES.items()])))
    over = long.groupBy("objective", "w0", "w1", "w2").agg(F.round(F.sum(F.col("n") * F.col("value")) / F.sum("n"), 9).alias("value"), F.round(F.min("value"), 6).alias("worst_fold"), F.count("*").alias("folds"))
    best = F.struct(F.col("value").alias("v"), -F.col("w0"), -F.col("w1"), -F.col("w2"))
    out = over.groupBy("objective").agg(F.max_by(F.struct("w0", "w1", "w2", "value", "worst_fold", "folds"), best).alias("b"))
    return out.select("objective", "b.w0", "b.w1", "b.w2", F.round("b.value", 6).alias("value"), "b.worst_fold", "b.folds")


TRIALS = 64
BALANCED = OBJECTIVES["balanced"]
_TRIALS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for k, (a, b, c) in enumerate(search.sampled_trials(TRIALS))) + ") AS x(trial, w0, w1, w2)"


def _round_sql(fold: int) -> str:
    score = f"SELECT mx.*, trial, round(w0 * s0 + w1 * s1 + w2 * s2, 12) AS score FROM mx, {'tr' if fold == 0 else f'l{fold}'} WHERE {FOLD.replace('% 5', f'% {FOLDS}')} = {fold}"
    per = f"SELECT trial, contest_id, max(CASE WHEN outcome_rank = 1 THEN n END) AS won, count(*) FILTER (n <= 3 AND outcome_rank <= 3) AS three FROM (SELECT *, row_number() OVER (PARTITION BY trial, contest_id ORDER BY score DESC, slot) AS n FROM ({score})) GROUP BY trial, contest_id"
    means = {"hit1": "avg(CAST(won = 1 AS INT))", "overlap": "avg(three / 3.0)", "mrr": "avg(1.0 / won)"}
    return f"SELECT trial, count(*) AS n, {' + '.join(f'{w} * {means[c]}' for c, w in BALANCED.items())} AS value FROM ({per}) GROUP BY trial"


HALVED = {"six": SIX, "mx": MIXED, "tr": _TRIALS_SQL}
for _f in range(FOLDS):
    HALVED[f"r{_f}"] = _round_sql(_f)
    HALVED[f"a{_f}"] = "SELECT trial, CAST(sum(n) AS BIGINT) AS n, sum(n * value) / sum(n) AS value, count(*) AS folds FROM (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(_f + 1)) + ") GROUP BY trial"
    HALVED[f"l{_f + 1}"] = f"SELECT tr.* FROM tr JOIN (SELECT trial FROM a{_f} WHERE folds = {_f + 1} ORDER BY round(value, 9) DESC, trial LIMIT {max(1, TRIALS >> (_f + 1))}) USING (trial)"


@query(on_view(f"SELECT trial, w0, w1, w2, n AS contests, round(value, 9) AS value, folds, row_number() OVER (ORDER BY folds DESC, round(value, 9) DESC, trial) AS place FROM a{FOLDS - 1} JOIN tr USING (trial)", **HALVED))
def sampled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of an even sample of weight vectors, halved after each fold by the balanced objective: 120 evaluations of 256."""
    contests, trials = stored(scored_contests(spark, sf_dir), "contests"), search.sampled_trials(TRIALS)

    def evaluate(left, fold):
        points = F.array(*[F.struct(F.lit(k).alias("trial"), *[F.lit(w).alias(f"w{i}") for i, w in enumerate(trials[k])]) for k in left])
        at = in_order(contests.where(F.col("fold") == fold).withColumn("w", F.explode(points)), "w")
        means = at.groupBy("w.trial").agg(F.count("*").alias("n"), F.avg((F.col("won") == 1).cast("double")).alias("hit1"), F.avg(F.size(F.filter(F.slice("o", 1, 3), lambda c: c["rank"] <= 3)) / 3).alias("overlap"), F.avg(1 / F.col("won")).alias("mrr"))
        return {r["trial"]: (r["n"], sum(w * r[c] for c, w in BALANCED.items())) for r in means.collect()}

    found = sorted(search.halving(evaluate, TRIALS, FOLDS), key=lambda r: (-r[3], -round(r[2], 9), r[0]))
    rows = [(k, *trials[k], n, round(value, 9), folds, place) for place, (k, n, value, folds) in enumerate(found, 1)]
    return spark.createDataFrame(rows, "trial int, w0 double, w1 double, w2 double, contests long, value double, folds long, place long")
