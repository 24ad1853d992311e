"""Queries over parameter searches, candidate sets and cross tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import confidence
from rankweave.operators import metrics as m
from rankweave.operators import relative
from rankweave.operators import scenario as sc
from rankweave.operators import tickets as t
from rankweave.plans.metric_queries import FACT, labelled_fact, returns
from rankweave.plans.registry import query
from rankweave.plans.scenario_queries import ADV, CONTEXT, CUTS, PRESSED, SCORED, SLOTS, SUBSET, clip, scenarios, subset_labels
from rankweave.plans.ticket_queries import BANDED, CONDITIONAL, TABLE, TOP12, WEIGHTS, Q, both_frame, on_tickets, slot_shares, ticket_frame

KEY = ["contest_id", "a", "b", "c"]
FIT = f"""
SELECT t.contest_id, t.a, t.b, t.c, t.probability, CAST(a = 1 AS INT) * escape AS fit_escape, CAST(a = 2 AND b IN (1, 3, 4) AS INT) * p2i AS fit_second, CAST(a IN (2, 3, 4) AS INT) * greatest(p2a, p3, p4) AS fit_around,
       CAST(a >= 3 AND b <= 4 AS INT) * p36 AS fit_through, CAST(b >= 4 OR c >= 4 AS INT) * greatest(sweep, p5) AS fit_outer, CAST(a = attack_slot OR (b = attack_slot AND a IN (1, 2)) AS INT) * attack AS fit_attack,
       {clip("CAST(escape > 0.45 AND a <> 1 AS INT) * escape + CAST(collapse > 0.45 AND a = 1 AND b IN (2, 3) AS INT) * collapse + CAST(attack > 0.45 AND attack_slot NOT IN (a, b, c) AS INT) * attack")} AS mismatch
FROM t JOIN cx USING (contest_id)
"""


@query(on_tickets("SELECT contest_id, a, b, c, round(fit_escape, 9) AS fit_escape, round(fit_around, 9) AS fit_around, round(fit_outer, 9) AS fit_outer, round(fit_attack, 9) AS fit_attack, round(mismatch, 9) AS mismatch FROM lf", s0=SLOTS, s1=ADV, s2=PRESSED, cx=CONTEXT, lf=FIT))
def ticket_line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets against the scenario context of their contest."""
    df = ticket_frame(spark, sf_dir).select(*KEY).join(scenarios(spark, sf_dir), "contest_id").withColumns(sc.line_fits())
    return df.select(*KEY, *[F.round(c, 9).alias(c) for c in ("fit_escape", "fit_around", "fit_outer", "fit_attack", "mismatch")])


@query(on_tickets("SELECT contest_id, count(*) AS chosen, count(*) FILTER (nth > 10) AS by_fit FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth, row_number() OVER (PARTITION BY contest_id ORDER BY round(fit_escape + fit_second + fit_around + fit_through + fit_outer + fit_attack - mismatch, 9) DESC, a, b, c) AS by_line FROM lf) WHERE nth <= 10 OR by_line <= 5 GROUP BY contest_id", s0=SLOTS, s1=ADV, s2=PRESSED, cx=CONTEXT, lf=FIT))
def rerank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best tickets and the five that fit the scenario best."""
    df = ticket_frame(spark, sf_dir).select(*KEY, "probability").join(scenarios(spark, sf_dir), "contest_id").withColumns(sc.line_fits())
    df = df.withColumns({"nth": F.row_number().over(t.order_of("probability")), "by_line": F.row_number().over(t.order_of(F.round(sc.line_score(), 9)))})
    return df.where("nth <= 10 or by_line <= 5").groupBy("contest_id").agg(F.count("*").alias("chosen"), F.count_if(F.col("nth") > 10).alias("by_fit"))


GRID_WEIGHTS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
GRID = f"(VALUES {', '.join(f'({w})' for w in GRID_WEIGHTS)}) AS g(weight)"


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with both probabilities and those of the contest's actual ticket (won_..), from one expansion of the slots."""
    return both_frame(spark, sf_dir, won=True)


def actual_ranks(tickets: DataFrame) -> DataFrame:
    """(contest_id, weight, nth, s, x): of each weight the actual ticket's place and value, and the sum of all.

    Weights are columns of one aggregate by contest, so rows aren't repeated for
    them. Values are compared and added in whole units of the twelfth place.
    """
    c, unit = F.col, 1e12
    value = lambda w, p, q: F.floor((w * c(p) + (1 - w) * c(q)) * unit + 0.5)
    earlier = (c("a") < c("won_a")) | ((c("a") == c("won_a")) & ((c("b") < c("won_b")) | ((c("b") == c("won_b")) & (c("c") < c("won_c")))))
    sums = []
    for k, w in enumerate(GRID_WEIGHTS):
        x, mine = value(w, "probability", "p"), value(w, "won_probability", "won_p")
        sums += [F.count_if((x > mine) | ((x == mine) & earlier)).alias(f"before{k}"), F.sum(x).alias(f"s{k}")]
    found = tickets.where("won_a is not null and won_b is not null and won_c is not null").groupBy("contest_id").agg(*sums, F.first("won_probability").alias("won_probability"), F.first("won_p").alias("won_p"))
    points = [F.struct(F.lit(w).alias("weight"), (c(f"before{k}") + 1).alias("nth"), (c(f"s{k}") / unit).alias("s"), (value(w, "won_probability", "won_p") / unit).alias("x")) for k, w in enumerate(GRID_WEIGHTS)]
    return found.select("contest_id", F.inline(F.array(*points)))


@query(on_tickets(f"""
SELECT weight, round(hit1 + 0.1 * hit12 - 0.05 * loss, 6) AS objective, round(hit1, 9) AS hit1, round(hit12, 9) AS hit12
FROM (SELECT weight, avg(CAST(nth <= 1 AS INT)) AS hit1, avg(CAST(nth <= 12 AS INT)) AS hit12, avg(-ln(greatest(x / s, 1e-15))) AS loss
      FROM (SELECT *, row_number() OVER (PARTITION BY weight, contest_id ORDER BY x DESC, a, b, c) AS nth, sum(x) OVER (PARTITION BY weight, contest_id) AS s
            FROM (SELECT t.contest_id, t.a, t.b, t.c, t.is_actual, weight, round(weight * t.probability + (1 - weight) * k.p, 12) AS x FROM t JOIN k ON t.contest_id = k.contest_id AND t.a = k.a AND t.b = k.b AND t.c = k.c, {GRID})) WHERE is_actual GROUP BY weight)
""", w=WEIGHTS, k=CONDITIONAL))
def blend_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of two ticket probabilities and what each gives; the grid is eleven rows, expanded in place."""
    ranked = actual_ranks(blended(spark, sf_dir))
    out = ranked.groupBy("weight").agg(F.avg((F.col("nth") <= 1).cast("double")).alias("hit1"), F.avg((F.col("nth") <= 12).cast("double")).alias("hit12"), F.avg(-F.ln(F.greatest(F.col("x") / F.col("s"), F.lit(1e-15)))).alias("loss"))
    return out.select("weight", F.round(F.col("hit1") + 0.1 * F.col("hit12") - 0.05 * F.col("loss"), 6).alias("objective"), F.round("hit1", 9).alias("hit1"), F.round("hit12", 9).alias("hit12"))


@query(on_tickets("SELECT x.label AS top12_label, CASE WHEN f.p_top < 0.03 THEN '<0.03' WHEN f.p_top < 0.05 THEN '0.03-0.05' ELSE '>=0.05' END AS top_band, count(*) AS contests, round(avg(CAST(actual_rank <= 3 AS INT)), 9) AS hit3, round(avg(p_top), 9) AS mean_top FROM f JOIN x USING (contest_id) GROUP BY GROUPING SETS ((1, 2), (1), (2), ())", f=FACT, q=Q, x=TOP12))
def label_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates by confidence label, by band of the best probability, by both and over all."""
    rows = labelled_fact(spark, sf_dir).withColumn("top_band", m.band(F.col("p_top"), [0.03, 0.05], ["<0.03", "0.03-0.05", ">=0.05"]))
    sets = rows.groupingSets([["top12_label", "top_band"], ["top12_label"], ["top_band"], []], "top12_label", "top_band")
    return sets.agg(F.count("*").alias("contests"), F.round(m.hit_rate(3), 9).alias("hit3"), F.round(F.avg("p_top"), 9).alias("mean_top"))


@query(on_tickets("""
SELECT decision, count(*) AS contests, round(avg(CAST(hit AS INT)), 9) AS hit_rate, round(sum(bought * 100.0), 6) AS total_stake, round(sum(CASE WHEN hit THEN payout ELSE 0 END), 2) AS total_return, round(CASE WHEN sum(bought) > 0 THEN sum(CASE WHEN hit THEN payout ELSE 0 END) / sum(bought * 100.0) ELSE 0 END, 6) AS recovery,
       round(avg(payout), 4) AS mean_payout, round(coalesce(avg(CASE WHEN hit THEN payout END), 0), 4) AS mean_payout_hit, round(avg(bought), 6) AS mean_tickets
FROM (SELECT *, CASE WHEN bought > 0 THEN 'top' || bought ELSE 'skip' END AS decision, actual_rank <= bought AS hit FROM (SELECT f.*, CASE label WHEN 'high' THEN 5 WHEN 'middle' THEN 8 ELSE 0 END AS bought FROM f JOIN x USING (contest_id) WHERE payout > 0)) GROUP BY ROLLUP (decision)
""", f=FACT, q=Q, x=TOP12))
def variable_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tickets as the confidence label recommends, by decision and over all."""
    rows = labelled_fact(spark, sf_dir).where("covered and payout > 0").withColumn("bought", confidence.ticket_count(F.col("top12_label"), confidence.TOP12_COUNTS))
    hit = F.col("actual_rank") <= F.col("bought")
    rows = rows.withColumns({"decision": F.when(F.col("bought") > 0, F.concat(F.lit("top"), F.col("bought").cast("string"))).otherwise("skip"), "hit": hit, "stake": F.col("bought") * 100.0, "won": F.when(hit, F.col("payout")).otherwise(0.0)})
    return returns(rows.rollup("decision").agg(*m.recovery()), "decision")


@query(on_tickets("""
SELECT count(*) AS contests, count(*) FILTER (r <= 3 AND b > 3) AS gained, count(*) FILTER (r > 3 AND b <= 3) AS lost, round(avg(CAST(r <= 3 AS INT) - CAST(b <= 3 AS INT)), 9) AS delta, round(stddev_samp(CAST(r <= 3 AS INT) - CAST(b <= 3 AS INT)) / sqrt(count(*)), 9) AS standard_error
FROM (SELECT contest_id, max(CASE WHEN is_actual THEN nth END) AS b, max(CASE WHEN is_actual THEN again END) AS r FROM (SELECT t.*, row_number() OVER (PARTITION BY t.contest_id ORDER BY probability DESC, t.a, t.b, t.c) AS nth, row_number() OVER (PARTITION BY t.contest_id ORDER BY round(k.p, 12) DESC, t.a, t.b, t.c) AS again FROM t JOIN k ON t.contest_id = k.contest_id AND t.a = k.a AND t.b = k.b AND t.c = k.c) GROUP BY contest_id)
""", w=WEIGHTS, k=CONDITIONAL))
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests gained and lost at top 3 by the second order, with the standard error of the difference."""
    both = both_frame(spark, sf_dir).withColumn("u", F.round("p", 12))
    ranked = both.withColumns({"b": F.row_number().over(t.order_of("probability")), "r": F.row_number().over(t.order_of("u"))}).where("is_actual").select("b", "r")
    difference = (F.col("r") <= 3).cast("int") - (F.col("b") <= 3).cast("int")
    return ranked.agg(F.count("*").alias("contests"), F.count_if((F.col("r") <= 3) & (F.col("b") > 3)).alias("gained"), F.count_if((F.col("r") > 3) & (F.col("b") <= 3)).alias("lost"), F.round(F.avg(difference), 9).alias("delta"), F.round(F.stddev_samp(difference) / F.sqrt(F.count("*")), 9).alias("standard_error"))


@query(on_tickets("SELECT x.contest_id, x.slot AS first_slot, y.slot AS second_slot, round(y.share / (1 - x.share), 9) AS follow_share, y.slot - x.slot AS distance, CAST(x.outcome_rank = 1 AND y.outcome_rank = 2 AS INT) AS is_actual, round(x.lead_time - y.lead_time, 9) AS lead_gap FROM sh AS x JOIN sh AS y ON x.contest_id = y.contest_id AND x.slot <> y.slot"))
def second_place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for second place given the first, from one array for each contest."""
    gathered = slot_shares(spark, sf_dir).groupBy("contest_id").agg(F.collect_list(F.struct("slot", "share", "lead_time", "outcome_rank")).alias("all"))
    pairs = gathered.withColumn("x", F.explode("all")).withColumn("y", F.explode("all")).where("x.slot <> y.slot")
    actual = (F.col("x.outcome_rank") == 1) & (F.col("y.outcome_rank") == 2)
    return pairs.select("contest_id", F.col("x.slot").alias("first_slot"), F.col("y.slot").alias("second_slot"), F.round(F.col("y.share") / (1 - F.col("x.share")), 9).alias("follow_share"), (F.col("y.slot") - F.col("x.slot")).alias("distance"), actual.cast("int").alias("is_actual"), F.round(F.col("x.lead_time") - F.col("y.lead_time"), 9).alias("lead_gap"))


@query(on_tickets("SELECT contest_id, a, b, c, round(share_c / (1 - share_a - share_b), 9) AS follow_share, CAST(is_actual AS INT) AS is_actual, CAST(c > b AS INT) + CAST(c > a AS INT) AS outside_of FROM t"))
def third_place_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for third place given the first two."""
    outside = (F.col("c") > F.col("b")).cast("int") + (F.col("c") > F.col("a")).cast("int")
    return ticket_frame(spark, sf_dir).select(*KEY, F.round(F.col("share_c") / (1 - F.col("share_a") - F.col("share_b")), 9).alias("follow_share"), F.col("is_actual").cast("int").alias("is_actual"), outside.alias("outside_of"))


@query(on_tickets("""
SELECT contest_id, a, b, c, nth, adjusted, label AS top12_label, tickets, nth <= tickets AS recommended
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY adjusted DESC, a, b, c) AS nth
      FROM (SELECT b.contest_id, b.a, b.b, b.c, b.confidence AS label, CASE b.confidence WHEN 'high' THEN 5 WHEN 'middle' THEN 8 ELSE 0 END AS tickets, round(least(1, greatest(0, probability * coalesce(factor, 1))) / sum(least(1, greatest(0, probability * coalesce(factor, 1)))) OVER (PARTITION BY b.contest_id), 9) AS adjusted FROM b LEFT JOIN ad USING (confidence, band)))
WHERE nth <= 10
""", q=Q, f=TOP12, b=BANDED, ad=TABLE))
def full_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best tickets by adjusted probability, with the contest's label and the recommended number."""
    tickets = ticket_frame(spark, sf_dir)
    adjusted = confidence.apply_adjustment(tickets, confidence.fit_adjustment(tickets)).withColumn("adjusted", F.round("adjusted", 9))
    best = t.top_tickets(adjusted, 10, "adjusted").withColumn("tickets", confidence.ticket_count(F.col("confidence"), confidence.TOP12_COUNTS))
    return best.select(*KEY, "nth", "adjusted", F.col("confidence").alias("top12_label"), "tickets", (F.col("nth") <= F.col("tickets")).alias("recommended"))


@query(on_tickets(f"""
SELECT subset, contests, weight, hit3 FROM (
    SELECT *, row_number() OVER (PARTITION BY subset ORDER BY hit3 DESC, weight DESC) AS best
    FROM (SELECT subset, weight, count(*) AS contests, round(avg(CAST(nth <= 3 AS INT)), 9) AS hit3
          FROM (SELECT *, row_number() OVER (PARTITION BY weight, contest_id ORDER BY x DESC, a, b, c) AS nth
                FROM (SELECT t.contest_id, t.a, t.b, t.c, t.is_actual, weight, round(weight * t.probability + (1 - weight) * k.p, 12) AS x FROM t JOIN k ON t.contest_id = k.contest_id AND t.a = k.a AND t.b = k.b AND t.c = k.c, {GRID}))
          JOIN su USING (contest_id) WHERE is_actual GROUP BY subset, weight HAVING count(*) >= 20)) WHERE best = 1
""", w=WEIGHTS, k=CONDITIONAL, s0=SLOTS, s1=ADV, s2=PRESSED, cx=CONTEXT, sc=SCORED, u=SUBSET, cuts=CUTS, su="SELECT contest_id, CASE WHEN attack >= attack_q70 - 1e-12 OR collapse >= collapse_q70 - 1e-12 THEN 'attack_or_collapse' WHEN upset >= upset_q70 - 1e-12 OR flat >= flat_q70 - 1e-12 THEN 'upset_or_flat' WHEN escape >= escape_q70 - 1e-12 AND collapse <= collapse_q50 + 1e-12 THEN 'stable_escape' ELSE 'neutral' END AS subset FROM u, cuts"))
def subset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best blend weight for each subset of contests with enough of them; ties keep the larger weight."""
    ranked = actual_ranks(blended(spark, sf_dir))
    found = ranked.join(subset_labels(spark, sf_dir), "contest_id").groupBy("subset", "weight").agg(F.count("*").alias("contests"), F.round(F.avg((F.col("nth") <= 3).cast("double")), 9).alias("hit3")).where("contests >= 20")
    best = F.row_number().over(Window.partitionBy("subset").orderBy(F.desc("hit3"), F.desc("weight")))
    return found.withColumn("best", best).where("best = 1").select("subset", "contests", "weight", "hit3")
