"""Queries over subsets, bands, value rules, splits and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.core.shared import stored
from rankweave.operators import confidence, relative
from rankweave.operators import metrics as m
from rankweave.operators import prediction as pr
from rankweave.operators import sampling as s
from rankweave.operators import search
from rankweave.operators import tickets as t
from rankweave.plans.metric_queries import FACT, fact
from rankweave.plans.registry import on_view, query
from rankweave.plans.sample_queries import IDS, contests, hashed
from rankweave.plans.ticket_queries import CONDITIONAL, WEIGHTS, Q, _clip, both_frame, on_tickets, slot_shares, ticket_frame

G = "PARTITION BY contest_id"
LABELLED = "CASE WHEN {s} >= 75 THEN 'high' WHEN {s} >= 60 THEN 'middle' ELSE 'low' END"
SCORE3 = f"""
SELECT *, {LABELLED.format(s='score')} AS label, CASE WHEN score < 60 THEN '<60' WHEN score < 65 THEN '60-65' WHEN score < 70 THEN '65-70' WHEN score < 75 THEN '70-75' WHEN score < 80 THEN '75-80' WHEN score < 85 THEN '80-85' WHEN score < 90 THEN '85-90' ELSE '>=90' END AS score_band
FROM (SELECT contest_id, m3, round(round({_clip(f"0.35 * {_clip('(m3 - 0.03) / 0.16')} + 0.2 * {_clip('(q1 - 0.01) / 0.08')} + 0.15 * {_clip('(q1 - q2) / 0.035')} + 0.15 * {_clip('(q3 - q4) / 0.012')} + 0.15 * {_clip('(1 - ent) / 0.25')}")} * 100, 9), 1) AS score
FROM (SELECT contest_id, sum(CASE WHEN nth <= 3 THEN q ELSE 0 END) AS m3, max(CASE WHEN nth = 1 THEN q END) AS q1, max(CASE WHEN nth = 2 THEN q END) AS q2, max(CASE WHEN nth = 3 THEN q END) AS q3, max(CASE WHEN nth = 4 THEN q END) AS q4, -sum(greatest(q, 1e-12) * ln(greatest(q, 1e-12))) / ln(count(*)) AS ent FROM q GROUP BY contest_id))
"""
BANDS = [60, 65, 70, 75, 80, 85, 90]
BAND_NAMES = ["<60", "60-65", "65-70", "70-75", "75-80", "80-85", "85-90", ">=90"]
FIRST_M = f"SELECT contest_id, a, mm, row_number() OVER ({G} ORDER BY round(mm, 12) DESC, a) AS n FROM (SELECT contest_id, a, sum(q) AS mm FROM q GROUP BY contest_id, a)"
SCORE1 = f"""
SELECT contest_id, {LABELLED.format(s='score')} AS first_label FROM (SELECT contest_id, round(round({_clip(f"0.45 * {_clip('(p - 1 / 6.0) / 0.45')} + 0.25 * {_clip('(p - p2) / 0.25')} + 0.15 * share3 + 0.15 * {_clip('(1 - ent) / 0.45')}")} * 100, 9), 1) AS score
FROM (SELECT f.contest_id, p, p2, ent, n3 / 3.0 AS share3 FROM (SELECT contest_id, max(CASE WHEN n = 1 THEN a END) AS first_slot, max(CASE WHEN n = 1 THEN mm END) AS p, max(CASE WHEN n = 2 THEN mm END) AS p2, -sum(mm * ln(greatest(mm, 1e-12))) / ln(6.0) AS ent FROM fm GROUP BY contest_id) AS f
      JOIN (SELECT contest_id, a, sum(CASE WHEN nth <= 3 THEN 1 ELSE 0 END) AS n3 FROM q GROUP BY contest_id, a) AS s ON f.contest_id = s.contest_id AND f.first_slot = s.a))
"""
BAND_QUALITY = "count(*) AS contests, round(avg(CAST(actual_rank <= 1 AS INT)), 9) AS hit1, round(avg(CAST(actual_rank <= 3 AS INT)), 9) AS hit3, round(avg(CAST(actual_rank <= 5 AS INT)), 9) AS hit5, round(avg(CAST(actual_rank <= 12 AS INT)), 9) AS hit12, round(avg(CAST(first_hit AS INT)), 9) AS first_hit_rate, round(avg(-ln(p_actual)), 6) AS log_loss, round(avg(p_top), 9) AS mean_p_top, round(avg(payout), 4) AS mean_payout, round(sum(CASE WHEN actual_rank <= 3 THEN payout ELSE 0 END) / (300.0 * count(*)), 6) AS recovery3"


def band_quality() -> list:
    won = F.sum(F.when(F.col("actual_rank") <= 3, F.col("payout")).otherwise(0.0)) / (300.0 * F.count("*"))
    hits = [F.round(m.hit_rate(k), 9).alias(f"hit{k}") for k in (1, 3, 5, 12)]
    return [F.count("*").alias("contests"), *hits, F.round(F.avg(F.col("first_hit").cast("double")), 9).alias("first_hit_rate"), F.round(F.avg(-F.ln("p_actual")), 6).alias("log_loss"), F.round(F.avg("p_top"), 9).alias("mean_p_top"), F.round(F.avg("payout"), 4).alias("mean_payout"), F.round(won, 6).alias("recovery3")]


def scored_fact(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    """The contest fact with the best three's label and band, and the first slot's label on request; tickets are expanded once."""
    return confidence.labelled_fact(ticket_frame(spark, sf_dir), ("payout", "site", "race_date"), first).withColumn("score_band", m.band(F.col("score"), BANDS, BAND_NAMES))


@query(on_tickets(f"SELECT label, score_band, {BAND_QUALITY} FROM f JOIN x USING (contest_id) GROUP BY GROUPING SETS ((label), (score_band), ())", f=FACT, q=Q, x=SCORE3))
def top3_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, losses and return by label and by band of the best three's score."""
    return scored_fact(spark, sf_dir).groupingSets([["label"], ["score_band"], []], "label", "score_band").agg(*band_quality())


@query(on_tickets(f"SELECT label, first_label, score_band, {BAND_QUALITY} FROM f JOIN x USING (contest_id) JOIN y USING (contest_id) GROUP BY GROUPING SETS ((label, first_label), (label, first_label, score_band), (first_label))", f=FACT, q=Q, x=SCORE3, fm=FIRST_M, y=SCORE1))
def top3_first_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three's label against the first slot's, with and without the score band."""
    rows = scored_fact(spark, sf_dir, first=True)
    return rows.groupingSets([["label", "first_label"], ["label", "first_label", "score_band"], ["first_label"]], "label", "first_label", "score_band").agg(*band_quality())


PLACES = "SELECT contest_id, any_value(site) AS site, CASE WHEN count(*) <> 6 OR count(DISTINCT slot) <> 6 OR count(DISTINCT position) <> 6 THEN 'unknown' WHEN bool_and(slot = position) THEN 'match' ELSE 'mismatch' END AS places FROM v GROUP BY contest_id"


@query(on_view("SELECT contest_id, places FROM pls", pls=PLACES))
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all entrants start where their slots say."""
    return contest_view(spark, sf_dir).groupBy("contest_id").agg(pr.place_label().alias("places"))


@query(on_tickets(f"SELECT subset, {BAND_QUALITY} FROM (SELECT f.*, CASE WHEN count(*) OVER (PARTITION BY subset) < 25 THEN '__small_sample__' ELSE subset END AS subset FROM (SELECT f.*, places || '|' || pls.site AS subset FROM f JOIN pls USING (contest_id)) AS f) GROUP BY subset".replace("SELECT f.*, CASE", "SELECT f.* EXCLUDE (subset), CASE"), f=FACT, pls=PLACES))
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by start order and site; subsets of few contests are put together."""
    labels = contest_view(spark, sf_dir).groupBy("contest_id").agg(F.concat_ws("|", pr.place_label(), F.first("site")).alias("subset"))
    rows = pr.small_samples_merged(fact(spark, sf_dir).join(labels, "contest_id"), "subset", 25)
    return rows.groupBy("subset").agg(*band_quality())


BOTH = "SELECT t.*, round(k.p, 12) AS u FROM t JOIN k ON t.contest_id = k.contest_id AND t.a = k.a AND t.b = k.b AND t.c = k.c"


def both_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with two probabilities: drawn and conditional (u)."""
    return both_frame(spark, sf_dir).withColumn("u", F.round("p", 12)).drop("p")


@query(on_tickets(f"SELECT pls.site, count(*) AS contests, count(*) FILTER (r < b) AS improved, count(*) FILTER (r > b) AS worsened, count(*) FILTER (r = b) AS unchanged, round(avg(b - r), 9) AS mean_gain FROM (SELECT contest_id, max(CASE WHEN is_actual THEN nth END) AS b, max(CASE WHEN is_actual THEN again END) AS r FROM (SELECT *, row_number() OVER ({G} ORDER BY probability DESC, a, b, c) AS nth, row_number() OVER ({G} ORDER BY u DESC, a, b, c) AS again FROM bo) GROUP BY contest_id) JOIN pls USING (contest_id) GROUP BY pls.site", w=WEIGHTS, k=CONDITIONAL, bo=BOTH, pls=PLACES))
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the second order moves the actual ticket, by site."""
    ranked = both_orders(spark, sf_dir).withColumns({"b0": F.row_number().over(t.order_of("probability")), "r0": F.row_number().over(t.order_of("u"))}).where("is_actual")
    n = lambda c: F.count_if(c)
    return ranked.groupBy("site").agg(F.count("*").alias("contests"), n(F.col("r0") < F.col("b0")).alias("improved"), n(F.col("r0") > F.col("b0")).alias("worsened"), n(F.col("r0") == F.col("b0")).alias("unchanged"), F.round(F.avg(F.col("b0") - F.col("r0")), 9).alias("mean_gain"))


RULE, RECOVERY_CAP, LEAST_PURCHASE, PURCHASE_PENALTY, PAYOUT_CAP = {"high": 3, "middle": 5}, 0.80, 0.10, 0.20, 8000.0


@query(on_tickets(f"""
SELECT contests, bought, round(rate, 9) AS purchase_rate, round(hit_rate, 9) AS raw_hit_rate, round(hit_rate * cover, 9) AS hit_rate, stake AS total_stake, round(won, 2) AS total_return, round(recovery, 6) AS recovery, round(cover, 9) AS coverage_factor, round({_clip(f'recovery / {RECOVERY_CAP}')} * cover, 6) AS normalized_recovery, round(greatest({LEAST_PURCHASE} - rate, 0) * {PURCHASE_PENALTY}, 9) AS penalty
FROM (SELECT *, {_clip(f'rate / {LEAST_PURCHASE}')} AS cover, CASE WHEN stake > 0 THEN won / stake ELSE 0 END AS recovery
      FROM (SELECT count(*) AS contests, count(*) FILTER (n > 0) AS bought, count(*) FILTER (n > 0) / count(*) AS rate, coalesce(avg(CASE WHEN n > 0 THEN CAST(actual_rank <= n AS INT) END), 0) AS hit_rate, sum(n * 100.0) AS stake, sum(CASE WHEN n > 0 AND actual_rank <= n THEN payout ELSE 0 END) AS won
            FROM (SELECT f.*, CASE label WHEN 'high' THEN 3 WHEN 'middle' THEN 5 ELSE 0 END AS n FROM f JOIN x USING (contest_id) WHERE payout > 0)))
""", f=FACT, q=Q, x=SCORE3))
def value_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of buying by the best three's label, scaled by how many contests are bought at all."""
    out = m.value_rule(scored_fact(spark, sf_dir), RULE, RECOVERY_CAP, LEAST_PURCHASE, PURCHASE_PENALTY)
    places = {"purchase_rate": 9, "raw_hit_rate": 9, "hit_rate": 9, "total_return": 2, "recovery": 6, "coverage_factor": 9, "normalized_recovery": 6, "penalty": 9}
    return out.select("contests", "bought", "total_stake", *[F.round(c, k).alias(c) for c, k in places.items()])


@query(on_tickets(f"SELECT round(avg(got), 4) AS mean_capture, round(coalesce(avg(CASE WHEN actual_rank <= 12 THEN payout END), 0), 4) AS mean_hit, round(sum(got), 2) AS total, round({_clip(f'avg(got) / {PAYOUT_CAP}')}, 9) AS score FROM (SELECT *, CASE WHEN actual_rank <= 12 THEN payout ELSE 0 END AS got FROM f WHERE payout > 0)", f=FACT))
def payout_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the payouts the twelve best tickets catch."""
    out = m.payout_capture(fact(spark, sf_dir), 12, PAYOUT_CAP)
    return out.select(F.round("mean_capture", 4).alias("mean_capture"), F.round("mean_hit", 4).alias("mean_hit"), F.round("total", 2).alias("total"), F.round("score", 9).alias("score"))


@query(on_tickets(f"SELECT count(*) AS contests, round(avg(CAST(won AS INT)), 9) AS top1, round(avg(loss), 6) AS log_loss, round(avg(CAST(actual_rank <= 5 AS INT)), 9) AS hit5 FROM (SELECT contest_id, bool_or(n = 1 AND outcome_rank = 1) AS won, max(CASE WHEN outcome_rank = 1 THEN -ln(greatest(share, 1e-15)) END) AS loss FROM (SELECT *, row_number() OVER ({G} ORDER BY round(share, 12) DESC, slot) AS n FROM sh) GROUP BY contest_id) JOIN f USING (contest_id)", f=FACT))
def slot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics straight from slot scores: the winner found, its loss, and hits of the tickets they give."""
    ranked = slot_shares(spark, sf_dir).withColumn("n", relative.rank_first(F.round("share", 12), "slot"))
    slots = ranked.groupBy("contest_id").agg(F.bool_or((F.col("n") == 1) & (F.col("outcome_rank") == 1)).alias("won"), F.max(F.when(F.col("outcome_rank") == 1, -F.ln(F.greatest("share", F.lit(1e-15))))).alias("loss"))
    return slots.join(fact(spark, sf_dir), "contest_id").agg(F.count("*").alias("contests"), F.round(F.avg(F.col("won").cast("double")), 9).alias("top1"), F.round(F.avg("loss"), 6).alias("log_loss"), F.round(m.hit_rate(5), 9).alias("hit5"))


@query(on_tickets("SELECT f.contest_id, actual_rank - 1 AS actual_index, payout, round(upset, 9) AS upset FROM f JOIN (SELECT contest_id, 1 - max(share) AS upset FROM sh GROUP BY contest_id) USING (contest_id)", f=FACT))
def evaluation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an evaluation needs of each complete contest: where its actual ticket stands, the payout and how open it was. Every slot comes first in some ticket."""
    rows = m.contest_fact(ticket_frame(spark, sf_dir), also=[F.round(1 - F.max("share_a"), 9).alias("upset")])
    return rows.where("covered").select("contest_id", (F.col("actual_rank") - 1).alias("actual_index"), "payout", "upset")


@query(on_view("SELECT contest_id, CASE WHEN day <= DATE '1998-12-31' THEN 'train' WHEN day <= DATE '1999-12-31' THEN 'valid' ELSE 'test' END AS part FROM i WHERE day >= DATE '1995-06-01'", i=IDS))
def date_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.date_splits(contests(spark, sf_dir), "1998-12-31", "1999-12-31", first="1995-06-01").select("contest_id", "part")


@query(on_view(f"SELECT contest_id FROM i ORDER BY {hashed('contest_id', 'n5')}, contest_id LIMIT 300", i=IDS))
def contest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random sample of a given number of contests, the same for any partitioning."""
    return s.contest_sample(contests(spark, sf_dir), 300, "n5").select("contest_id")


@query(on_view("SELECT contest_id, day AS race_date FROM i ORDER BY day DESC, contest_id DESC LIMIT 250", i=IDS))
def last_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.last_contests(contests(spark, sf_dir), 250).select("contest_id", "race_date")


@query(on_view("SELECT contest_id, day > (SELECT max(day) FROM (SELECT day, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT day FROM i)) WHERE n <= floor(total * 0.8)) AS is_valid FROM i", i=IDS))
def date_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth of the days held out."""
    return s.date_cut(contests(spark, sf_dir), 0.8).select("contest_id", "is_valid")


LATEST = "(SELECT max(day) FROM i)"
PAST = f"SELECT *, CAST(date_trunc('month', day) AS DATE) AS month, payout >= 400000 AS is_case FROM i WHERE day <= CAST({LATEST} - INTERVAL 24 MONTH AS DATE) AND day > CAST({LATEST} - INTERVAL 60 MONTH AS DATE)"


@query(on_view(f"""
SELECT contest_id, 'recent' AS origin, 1.0 AS weight FROM i WHERE day > CAST({LATEST} - INTERVAL 24 MONTH AS DATE)
UNION ALL SELECT contest_id, 'history', round(CASE WHEN payout >= 100000 THEN 5.0 WHEN payout >= 50000 THEN 3.0 WHEN payout >= 10000 THEN 2.0 ELSE 1.0 END * CASE WHEN day >= DATE '1998-01-01' THEN 0.7 ELSE 0.3 END, 9)
FROM (SELECT *, row_number() OVER (PARTITION BY month, site, is_case ORDER BY {hashed('contest_id', 'u')}, contest_id) AS r, count(*) FILTER (is_case) OVER (PARTITION BY month, site) AS cases FROM p) WHERE is_case OR r <= cases
""", i=IDS, p=PAST))
def upset_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recent contests and a sample of older ones that favours large payouts, with weights."""
    rows = s.upset_training_set(contests(spark, sf_dir), recent_months=24, history_months=60, payout=400_000, ratio=1, seed="u", recent="1998-01-01")
    return rows.select("contest_id", "origin", F.round("weight", 9).alias("weight"))


TOP = 20
POINTS = [(w, p) for w in (0.5, 0.6, 0.7, 0.8, 0.9, 1.0) for p in (0.0, 0.2, 0.4)]
PAYLOAD = f"""
SELECT *, 1 - (rank() OVER ({G} ORDER BY probability DESC) + (count(*) OVER (PARTITION BY contest_id, probability) - 1) / 2.0 - 1) / greatest(count(*) OVER ({G}) - 1, 1) AS x, 1 - (rank() OVER ({G} ORDER BY u DESC) + (count(*) OVER (PARTITION BY contest_id, u) - 1) / 2.0 - 1) / greatest(count(*) OVER ({G}) - 1, 1) AS y,
       least(1, greatest(0, (nth - 5) / greatest(count(*) OVER ({G}) - 5, 1.0))) AS late, max(u) OVER ({G}) - min(u) OVER ({G}) <= 1e-8 + 1e-5 * abs(max(u) OVER ({G})) AS flat
FROM (SELECT *, row_number() OVER ({G} ORDER BY probability DESC, a, b, c) AS nth FROM bo) WHERE nth <= {TOP}
"""


def points_sql(payload: str, grid: str) -> str:
    return f"""
SELECT weight, penalty, count(*) AS contests, count(rank) AS covered, {', '.join(f'avg(CAST(coalesce(rank <= {k}, false) AS INT)) AS hit{k}' for k in (1, 3, 5, 12))}, avg(1.0 / rank) AS mrr, avg(-ln(p_actual)) AS log_loss
FROM (SELECT weight, penalty, contest_id, max(CASE WHEN is_actual THEN place END) AS rank, max(CASE WHEN is_actual THEN greatest(z / total, 1e-15) END) AS p_actual
      FROM (SELECT *, row_number() OVER (PARTITION BY weight, penalty, contest_id ORDER BY z DESC, nth) AS place, sum(z) OVER (PARTITION BY weight, penalty, contest_id) AS total
            FROM (SELECT *, round(CASE WHEN flat THEN x ELSE weight * x + (1 - weight) * least(1, greatest(0, y - late * penalty)) END, 12) AS z FROM {payload}, {grid})) GROUP BY weight, penalty, contest_id) GROUP BY weight, penalty
"""


def judged_sql(points: str) -> str:
    excess = f"greatest(log_loss - base_loss - {search.GUARD}, 0)"
    total = " + ".join(f"{w} * {c}" for c, w in search.OBJECTIVE.items())
    return f"SELECT *, round({total} - {excess}, 9) AS objective, hit12 - base_hit12 AS hit12_delta, log_loss - base_loss AS log_loss_delta, {excess} <= 0 AS inside_guard FROM {points}, (SELECT log_loss AS base_loss, hit12 AS base_hit12 FROM {points} WHERE weight = 1 AND penalty = 0)"


GRID = "(SELECT CAST(w AS DOUBLE) AS weight, CAST(p AS DOUBLE) AS penalty FROM (VALUES " + ", ".join(f"({w}, {p})" for w, p in POINTS) + ") AS g(w, p))"
ROUNDED = {"hit1": 9, "hit3": 9, "hit5": 9, "hit12": 9, "mrr": 9, "log_loss": 6, "objective": 6, "hit12_delta": 9, "log_loss_delta": 6}
SHOWN = "weight, penalty, contests, covered, inside_guard, " + ", ".join(f"round({c}, {k}) AS {c}" for c, k in ROUNDED.items())


def shown(df: DataFrame) -> DataFrame:
    return df.select("weight", "penalty", "contests", "covered", "inside_guard", *[F.round(c, k).alias(c) for c, k in ROUNDED.items()])


def grid(spark: SparkSession) -> DataFrame:
    points = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(p).alias("penalty")) for w, p in POINTS])
    return spark.range(1).select(F.inline(points))


@query(on_tickets(f"SELECT {SHOWN} FROM ({judged_sql('po')})", w=WEIGHTS, k=CONDITIONAL, bo=BOTH, pl=PAYLOAD, po=points_sql("pl", GRID)))
def rerank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and penalty of a second order over each contest's best tickets: quality, objective, guard and differences from the base."""
    rows = search.payloads(both_orders(spark, sf_dir), "probability", "u", "is_actual", TOP)
    return shown(search.judged(search.point_metrics(search.outcomes(rows, grid(spark)))))


SAMPLED = "SELECT contest_id FROM (SELECT contest_id, row_number() OVER (ORDER BY race_date, contest_id) - 1 AS k FROM f) WHERE k IN (SELECT CAST(floor(g * ((SELECT count(*) FROM f) - 1) / 149.0) AS BIGINT) FROM range(150) AS r(g))"


@query(on_tickets(f"SELECT {SHOWN} FROM ({judged_sql('p2')})", f=FACT, w=WEIGHTS, k=CONDITIONAL, bo=BOTH, pl=PAYLOAD, sm=SAMPLED, ps="SELECT * FROM pl WHERE contest_id IN (SELECT contest_id FROM sm)", p1=points_sql("ps", GRID), best=f"SELECT weight, penalty FROM ({judged_sql('p1')}) ORDER BY objective DESC, weight DESC, penalty LIMIT 4", p2=points_sql("pl", "(SELECT weight, penalty FROM best UNION SELECT 1.0, 0.0)")))
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid on an even sample of contests, the four best points and the base on all."""
    rows = stored(search.payloads(both_orders(spark, sf_dir), "probability", "u", "is_actual", TOP), "payloads")
    return shown(search.two_stage(rows, grid(spark), slot_shares(spark, sf_dir).select("contest_id", "race_date"), 150, 4))


DAYS = (200, 400, 800)
WINDOWED = f"SELECT t.*, days, dense_rank() OVER (PARTITION BY days ORDER BY race_date) AS d FROM (SELECT *, row_number() OVER ({G} ORDER BY probability DESC, a, b, c) AS nth FROM t) AS t, (VALUES {', '.join(f'({d})' for d in DAYS)}) AS x(days) WHERE race_date > CAST((SELECT max(race_date) FROM t) - days * INTERVAL 1 DAY AS DATE)"
SPLIT = "SELECT *, d > floor(max(d) OVER (PARTITION BY days) * 0.7) AS held, CASE WHEN nth <= 1 THEN 'top1' WHEN nth <= 3 THEN 'top2_3' WHEN nth <= 6 THEN 'top4_6' WHEN nth <= 12 THEN 'top7_12' ELSE 'outside' END AS band FROM wd"
FACTORS = "SELECT days, band, least(2.0, greatest(0.25, 1 + (raw - 1) * n / (n + 300))) AS factor FROM (SELECT days, band, count(*) AS n, CASE WHEN avg(probability) > 0 THEN avg(CAST(is_actual AS INT)) / avg(probability) ELSE 1 END AS raw FROM sp WHERE NOT held GROUP BY days, band)"


@query(on_tickets("SELECT days, count(*) AS contests, round(avg(-ln(greatest(before, 1e-15))), 6) AS loss_before, round(avg(-ln(greatest(after, 1e-15))), 6) AS loss_after FROM (SELECT days, contest_id, max(CASE WHEN is_actual THEN probability END) AS before, max(CASE WHEN is_actual THEN x END) / sum(x) AS after FROM (SELECT sp.*, least(1, greatest(0, probability * coalesce(factor, 1))) AS x FROM sp LEFT JOIN fa USING (days, band) WHERE held) GROUP BY days, contest_id) GROUP BY days", wd=WINDOWED, sp=SPLIT, fa=FACTORS))
def calibration_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors by rank band fitted on the first 70 % of the days of several recent windows, and the loss on the rest."""
    out = confidence.window_search(ticket_frame(spark, sf_dir), DAYS, 0.7)
    return out.select("days", "contests", F.round("loss_before", 6).alias("loss_before"), F.round("loss_after", 6).alias("loss_after"))


@query(on_tickets("SELECT max_by(month, recovery) AS best_month, round(max(recovery), 6) AS best_recovery, min_by(month, recovery) AS worst_month, round(min(recovery), 6) AS worst_recovery FROM (SELECT CAST(date_trunc('month', race_date) AS DATE) AS month, round(sum(CASE WHEN actual_rank <= 12 THEN payout ELSE 0 END) / (1200.0 * count(*)), 9) + epoch(date_trunc('month', race_date)) / 1e15 AS recovery FROM f GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY date_trunc('month', race_date)"), f=FACT))
def trend_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the best and the worst return; of equal ones the later is the better."""
    month = F.trunc("race_date", "month")
    won = F.sum(F.when(F.col("actual_rank") <= 12, F.col("payout")).otherwise(0.0)) / (1200.0 * F.count("*"))
    months = fact(spark, sf_dir).groupBy(month.alias("month")).agg(F.round(won, 9).alias("won")).withColumn("recovery", F.col("won") + F.unix_timestamp(F.col("month").cast("timestamp")) / 1e15)
    return months.agg(F.max_by("month", "recovery").alias("best_month"), F.round(F.max("recovery"), 6).alias("best_recovery"), F.min_by("month", "recovery").alias("worst_month"), F.round(F.min("recovery"), 6).alias("worst_recovery"))
