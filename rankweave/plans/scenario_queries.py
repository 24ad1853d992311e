"""Queries over scenarios, challengers, proxies, what-ifs and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.core.shared import stored
from rankweave.functions import numbers, text
from rankweave.operators import challenge as ch
from rankweave.operators import scenario as sc
from rankweave.operators import statistics as st
from rankweave.operators.relative import rank_first, rank_min
from rankweave.plans.history_queries import KEY
from rankweave.plans.registry import on_view, query
from rankweave.plans.ticket_queries import SHARES, SIX, slot_shares

G = "PARTITION BY contest_id"


def clip(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


def scaled(x: str, lower: bool = False) -> str:
    low, high = f"min({x}) OVER ({G})", f"max({x}) OVER ({G})"
    return f"coalesce(CASE WHEN {high} > {low} THEN ({f'{high} - {x}' if lower else f'{x} - {low}'}) / ({high} - {low}) END, 0)"


SLOTS = "SELECT contest_id, slot, outcome_rank, style, share AS rank, share, least(1.0, share * 1.8) AS top2, least(1.0, share * 2.5) AS top3, share AS exact1, raw_score AS k1, lead_time * 5 AS k2, coalesce(trial_time, 0) * 5 AS k3, 1 - raw_score AS k4, share AS site_win, lead_time * 6 AS site2, lead_time * 8 AS site3, lead_time AS lead, trial_time AS trial, machine_a + machine_b AS machine FROM sh"
ADV = f"SELECT *, {scaled('lead', True)} AS lead_adv, {scaled('trial', True)} AS trial_adv, {scaled('machine')} AS machine_adv FROM s0"
REST = "0.17 * rank + 0.14 * top2 + 0.09 * lead_adv + 0.06 * trial_adv + 0.05 * machine_adv"
PRESSED = f"""
SELECT *, {clip("0.2 * rank + 0.16 * top2 + 0.14 * k2 + 0.22 * greatest(k3, k4) + 0.08 * lead_adv + 0.05 * trial_adv + 0.04 * machine_adv + 0.07 * site2 + 0.04 * site3 + CASE slot WHEN 2 THEN 0.07 WHEN 3 THEN 0.1 WHEN 4 THEN 0.12 WHEN 5 THEN 0.06 WHEN 6 THEN 0.04 ELSE 0 END")} AS challenge,
       0.29 * exact1 + 0.18 * rank + 0.21 * k1 + 0.07 * lead_adv + 0.05 * trial_adv + 0.06 * machine_adv + 0.09 * site_win + 0.05 * site2 AS base,
       {clip(f"0.42 * k2 + {REST} + 0.07 * site2")} AS p22, {clip(f"0.42 * k3 + {REST} + 0.07 * site2")} AS p32, {clip(f"0.42 * k3 + {REST} + 0.07 * site3")} AS p33, {clip(f"0.42 * k4 + {REST} + 0.07 * site3")} AS p43
FROM s1
"""


def at(slot: str, c: str) -> str:
    return f"coalesce(max(CASE WHEN slot IN ({slot}) THEN {c} END), 0)"


CONTEXT = f"""
SELECT *, {clip(f"0.34 * CASE WHEN attack >= 0.3 AND second_attack >= 0.25 THEN {clip('(0.12 - greatest(attack - second_attack, 0)) / 0.12')} ELSE 0 END + 0.24 * collapse * attack + 0.18 * greatest(p3, p4, p5) + 0.14 * sweep + 0.1 * (1 - escape) * attack")} AS chaos
FROM (SELECT *, {clip("(1 - escape) * (0.36 + 0.26 * attack) + 0.22 * greatest(p2a, p3, p4) + 0.1 * (1 - top2_1) + 0.06 * (1 - site2_1)")} AS collapse
FROM (SELECT *, {clip("base1 * (1 - 0.3 * attack)")} AS escape, {clip("0.36 * oc + 0.28 * p36 + 0.22 * ot + 0.14 * os")} AS sweep
FROM (SELECT contest_id, max(CASE WHEN slot <> 1 THEN challenge END) AS attack, coalesce(max(CASE WHEN nth = 2 THEN challenge END), 0) AS second_attack, max(CASE WHEN nth = 1 THEN slot END) AS attack_slot, {at('1', 'base')} AS base1, {at('1', 'top2')} AS top2_1, {at('1', 'site2')} AS site2_1,
             {at('2', 'p22')} AS p2i, {at('2', 'p32')} AS p2a, greatest({at('3', 'p32')}, {at('3', 'p43')}) AS p3, greatest({at('4', 'p33')}, {at('4', 'p43')}) AS p4, greatest({at('5', 'p43')}, {at('6', 'p43')}) AS p5, {at('3, 4, 5, 6', 'p43')} AS p36,
             {at('4, 5, 6', 'challenge')} AS oc, {at('4, 5, 6', 'top3')} AS ot, {at('4, 5, 6', 'site3')} AS os
      FROM (SELECT *, CASE WHEN slot <> 1 THEN row_number() OVER ({G}, slot = 1 ORDER BY challenge DESC, slot) END AS nth FROM s2) GROUP BY contest_id)))
"""
SCORED = f"""
SELECT *, {clip("0.68 * escape + 0.18 * (1 - collapse) + 0.14 * (1 - attack)")} AS S0, {clip("0.5 * greatest(p2i - 0.65 * p2a, 0) + 0.2 * p2i + 0.14 * escape + 0.14 * site2_1 + 0.02 * (1 - collapse)")} AS S1, {clip("0.5 * greatest(p2a - 0.75 * p2i, 0) + 0.22 * p2a + 0.16 * collapse + 0.08 * attack + 0.04 * (1 - escape)")} AS S2,
       {clip("0.62 * p3 + 0.12 * greatest(p3, p4) + 0.14 * collapse + 0.12 * attack")} AS S3, {clip("0.64 * p4 + 0.12 * p36 + 0.12 * attack + 0.12 * collapse")} AS S4, {clip("0.64 * p5 + 0.18 * sweep + 0.1 * collapse + 0.08 * os")} AS S5, {clip("0.58 * chaos + 0.18 * collapse + 0.14 * second_attack + 0.1 * (1 - escape) * attack")} AS S6
FROM cx
"""


def on_scenario(select: str, **more: str) -> str:
    return on_view(select, six=SIX, sh=SHARES, s0=SLOTS, s1=ADV, s2=PRESSED, cx=CONTEXT, sc=SCORED, **more)


def scenario_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    df = slot_shares(spark, sf_dir).withColumns({
        "rank": c("share"), "top2": F.least(F.lit(1.0), c("share") * 1.8), "top3": F.least(F.lit(1.0), c("share") * 2.5), "exact1": c("share"), "k1": c("raw_score"), "k2": c("lead_time") * 5, "k3": F.coalesce("trial_time", F.lit(0.0)) * 5,
        "k4": 1 - c("raw_score"), "site_win": c("share"), "site2": c("lead_time") * 6, "site3": c("lead_time") * 8, "lead": c("lead_time"), "trial": c("trial_time"), "machine": c("machine_a") + c("machine_b"),
    })
    return sc.advantages(df)


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.context(scenario_slots(spark, sf_dir)).withColumns(sc.scores())


NINE = ("escape", "collapse", "attack", "second_attack", "sweep", "chaos")


@query(on_scenario("SELECT contest_id, attack_slot, " + ", ".join(f"round({c}, 9) AS {c}" for c in NINE) + " FROM cx"))
def scenario_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressures and risks of a contest from its slots."""
    return scenarios(spark, sf_dir).select("contest_id", "attack_slot", *[F.round(c, 9).alias(c) for c in NINE])


@query(on_scenario("SELECT contest_id, " + ", ".join(f"round({s}, 9) AS {s}" for s in sc.SCENARIOS) + f""",
       CASE WHEN chaos >= 0.65 OR (chaos >= 0.55 AND best - second < 0.05) OR best < 0.28 THEN 'S6' ELSE name END AS label
FROM (SELECT *, greatest(S0, S1, S2, S3, S4, S5) AS best, list_sort([S0, S1, S2, S3, S4, S5])[5] AS second,
             CASE greatest(S0, S1, S2, S3, S4, S5) WHEN S0 THEN 'S0' WHEN S1 THEN 'S1' WHEN S2 THEN 'S2' WHEN S3 THEN 'S3' WHEN S4 THEN 'S4' ELSE 'S5' END AS name FROM sc)"""))
def scenario_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of seven scenarios and the label of the contest."""
    return scenarios(spark, sf_dir).select("contest_id", *[F.round(s, 9).alias(s) for s in sc.SCENARIOS], sc.label().alias("label"))


@query(on_scenario("SELECT contest_id, " + ", ".join(f"CAST(label = '{x}' AS INT) AS is_{x.lower()}, round({x}, 9) AS score_{x.lower()}" for x in sc.SCENARIOS) + """, round(best - second, 9) AS margin
FROM (SELECT *, CASE WHEN chaos >= 0.65 OR (chaos >= 0.55 AND best - second < 0.05) OR best < 0.28 THEN 'S6' ELSE name END AS label
      FROM (SELECT *, greatest(S0, S1, S2, S3, S4, S5) AS best, list_sort([S0, S1, S2, S3, S4, S5])[5] AS second, CASE greatest(S0, S1, S2, S3, S4, S5) WHEN S0 THEN 'S0' WHEN S1 THEN 'S1' WHEN S2 THEN 'S2' WHEN S3 THEN 'S3' WHEN S4 THEN 'S4' ELSE 'S5' END AS name FROM sc))"""))
def scenario_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contest's scenario as inputs of a learner: one flag a label, all scores and the margin of the best."""
    df = scenarios(spark, sf_dir).withColumn("label", sc.label())
    ordered = F.sort_array(F.array(*sc.SCENARIOS[:6]), asc=False)
    flags = [c for x in sc.SCENARIOS for c in ((F.col("label") == x).cast("int").alias(f"is_{x.lower()}"), F.round(x, 9).alias(f"score_{x.lower()}"))]
    return df.select("contest_id", *flags, F.round(ordered[0] - ordered[1], 9).alias("margin"))


BY_SLOT = ("challenge", "share", "top2", "top3", "k1", "k2", "k3", "k4", "lead_adv", "trial_adv")


@query(on_scenario("SELECT contest_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in NINE) + ", " + ", ".join(f"max(CASE WHEN slot = {k} THEN round({c}, 9) END) AS {c}_{k}" for k in range(1, 7) for c in BY_SLOT) + " FROM cx JOIN (SELECT contest_id, slot, " + ", ".join(BY_SLOT) + " FROM s2) AS p USING (contest_id) GROUP BY contest_id, " + ", ".join(NINE)))
def pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contest: its context, and the slots' values side by side."""
    slots = scenario_slots(spark, sf_dir).withColumn("challenge", sc.challenge())
    wide = slots.groupBy("contest_id").agg(*[F.max(F.when(F.col("slot") == k, F.round(c, 9))).alias(f"{c}_{k}") for k in range(1, 7) for c in BY_SLOT])
    return scenarios(spark, sf_dir).select("contest_id", *[F.round(c, 9).alias(c) for c in NINE]).join(wide, "contest_id")


SUBSET = f"""
SELECT *, {clip("0.28 * collapse + 0.24 * attack + 0.2 * sweep + 0.18 * greatest(S3, S4, S5, S6) + 0.1 * flat")} AS upset
FROM sc JOIN (SELECT contest_id, {clip("0.55 * least(1, greatest(0, -sum(share * ln(greatest(share, 1e-12))) / ln(count(*)))) + 0.25 * (1 - max(share)) + 0.2 * (1 - greatest(max(share) - list_sort(list(share))[5], 0))")} AS flat FROM sh GROUP BY contest_id) USING (contest_id)
"""
CUTS = "SELECT " + ", ".join(f"quantile_cont({c}, 0.7) AS {c}_q70" for c in ("attack", "collapse", "upset", "flat", "escape")) + ", quantile_cont(collapse, 0.5) AS collapse_q50 FROM u"


@query(on_scenario("SELECT contest_id, CASE WHEN attack >= attack_q70 - 1e-12 OR collapse >= collapse_q70 - 1e-12 THEN 'attack_or_collapse' WHEN upset >= upset_q70 - 1e-12 OR flat >= flat_q70 - 1e-12 THEN 'upset_or_flat' WHEN escape >= escape_q70 - 1e-12 AND collapse <= collapse_q50 + 1e-12 THEN 'stable_escape' ELSE 'neutral' END AS subset FROM u, cuts", u=SUBSET, cuts=CUTS))
def subset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests by quantiles of their risks; the thresholds are one row."""
    flat = slot_shares(spark, sf_dir).groupBy("contest_id").agg(sc.flatness("share").alias("flat"))
    rows = scenarios(spark, sf_dir).join(flat, "contest_id").withColumn("upset", sc.subset_score())
    rows = stored(rows.select("contest_id", "attack", "collapse", "upset", "flat", "escape"), "risks")  # each step to the quantiles reads it
    high = st.quantiles(rows, ["attack", "collapse", "upset", "flat", "escape"], [0.7, 0.5])
    return rows.join(F.broadcast(high)).select("contest_id", sc.subset_label().alias("subset"))


@query(on_view("""
SELECT contest_id, winner, style, favourite, shape, favourite || '/' || shape AS pattern
FROM (SELECT contest_id, max(CASE WHEN outcome_rank = 1 THEN slot END) AS winner, max(CASE WHEN outcome_rank = 1 THEN style END) AS style,
             CASE WHEN max(CASE WHEN slot = 1 THEN outcome_rank END) = 1 THEN 'won' WHEN max(CASE WHEN slot = 1 THEN outcome_rank END) <= 3 THEN 'placed' ELSE 'lost' END AS favourite,
             CASE count(*) FILTER (outcome_rank <= 3 AND slot >= 4) WHEN 0 THEN 'inside' WHEN 1 THEN 'one outside' ELSE 'outside' END AS shape
      FROM six GROUP BY contest_id)
""", six=SIX))
def result_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a contest went: winner, favourite and the shape of the first three."""
    return sc.observed(slot_shares(spark, sf_dir))


CHALLENGER = f"0.27 * {scaled('lead_time', True)} + 0.16 * {scaled('trial_time', True)} + 0.16 * {scaled('raw_score')} + 0.13 * {scaled('machine_a')} + 0.11 * {scaled('machine_b')} + 0.09 * {scaled('raw_score')} + CASE position WHEN 2 THEN 0.08 WHEN 3 THEN 0.13 WHEN 4 THEN 0.15 WHEN 5 THEN 0.08 WHEN 6 THEN 0.05 ELSE 0 END"
CH0 = f"SELECT *, CASE WHEN position = 1 THEN 0 ELSE round({CHALLENGER}, 12) END AS challenger, 0.25 * {scaled('raw_score')} + 0.12 * {scaled('raw_score')} + 0.18 * {scaled('raw_score')} + 0.16 * {scaled('lead_time', True)} + 0.1 * {scaled('trial_time', True)} + 0.1 * {scaled('machine_a')} + 0.09 * {scaled('machine_b')} AS base FROM six"
CH1 = f"SELECT *, 0.32 * challenger + 0.22 * {scaled('machine_b')} + 0.18 * {scaled('machine_a')} + 0.16 * {scaled('lead_time', True)} + 0.12 * {scaled('trial_time', True)} + CASE position WHEN 4 THEN 0.08 WHEN 5 THEN 0.12 WHEN 6 THEN 0.14 ELSE 0 END AS outer_score, max(challenger) OVER ({G}) AS top FROM c0"
CH2 = f"SELECT *, {clip('top')} AS pressure, {clip(f'max(CASE WHEN position = 1 THEN base END) OVER ({G}) * (1 - 0.35 * ' + clip('top') + ')')} AS reliability, {clip(f'coalesce(max(CASE WHEN position >= 4 THEN outer_score END) OVER ({G}), 0)')} AS outer_risk, min(CASE WHEN challenger = top AND challenger > 0 AND position <> 1 THEN position END) OVER ({G}) AS candidate FROM c1"


def challenged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    return with_challengers(slot_shares(spark, sf_dir))


def with_challengers(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Slots with their challenger score, and the columns that stand for its measures."""
    form, engine, craft = "raw_score", "machine_a", "machine_b"
    measures = {"lead": "lead_time", "trial": "trial_time", "machine": engine, "place_top3": craft, "site_win": craft, "site_top3": craft, "challenger": "challenger", **dict.fromkeys(("top3", "attack", "win", "local"), form)}
    return df.withColumns(ch.scores(measures)).withColumn("challenger", F.round("challenger", 12)), measures


@query(on_view(f"SELECT contest_id, slot, challenger, candidate, round(reliability, 9) AS reliability, round({clip('(1 - reliability) * (0.45 + 0.35 * pressure) + 0.2 * outer_risk')}, 9) AS collapse, round({clip('CASE position WHEN 1 THEN 0.05 WHEN 2 THEN 0.12 WHEN 3 THEN 0.24 WHEN 4 THEN 0.55 WHEN 5 THEN 0.75 ELSE 0.65 END * (1 + 0.15 * CAST(position = candidate AS INT))')}, 9) AS outer_fit, CASE position WHEN 1 THEN 1 WHEN 2 THEN 0.65 WHEN 3 THEN 0.45 WHEN 4 THEN 0.2 WHEN 5 THEN 0.1 ELSE 0.05 END AS support FROM c2", six=SIX, c0=CH0, c1=CH1, c2=CH2))
def challengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenger scores, the main candidate, the favourite's reliability and the risk of a collapse."""
    df, measures = challenged(spark, sf_dir)
    df = df.withColumn("outer", ch.outer(measures)).withColumns(ch.contest_flow()).withColumn("candidate", ch.candidate())
    return df.select(*KEY, "challenger", "candidate", F.round("reliability", 9).alias("reliability"), F.round("collapse", 9).alias("collapse"), F.round(ch.outer_fit(), 9).alias("outer_fit"), ch.support().alias("support"))


@query(on_view("""
SELECT contest_id, slot, round(top, 9) AS candidate_score, round(challenger - top, 9) AS behind_candidate, CASE WHEN candidate > 0 THEN abs(position - candidate) ELSE 0 END AS candidate_distance, CAST(coalesce(position = candidate, false) AS INT) AS is_candidate,
       CAST(CASE WHEN candidate > 0 THEN sign(position - candidate) ELSE 0 END AS INT) AS candidate_side, CASE WHEN candidate > 0 THEN candidate - 1 ELSE 0 END AS inside_candidate, CASE WHEN candidate > 0 THEN greatest(6 - candidate, 0) ELSE 0 END AS outside_candidate
FROM c2
""", six=SIX, c0=CH0, c1=CH1, c2=CH2))
def candidate_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot against the main challenger of its contest."""
    df = challenged(spark, sf_dir)[0].withColumn("candidate", ch.candidate()).withColumns(ch.around_candidate())
    return df.select(*KEY, *[F.round(c, 9).alias(c) for c in ("candidate_score", "behind_candidate")], "candidate_distance", "is_candidate", "candidate_side", "inside_candidate", "outside_candidate")


@query(on_view(f"SELECT contest_id, slot, round({clip('(coalesce(trial_time * 0.45, 0) + lead_time * 0.25 + coalesce(CASE WHEN raw_score > 0.5 THEN raw_score END * 0.3, 0)) / (CASE WHEN trial_time IS NOT NULL THEN 0.45 ELSE 0 END + 0.25 + CASE WHEN raw_score > 0.5 THEN 0.3 ELSE 0 END)')}, 9) AS blend, coalesce(trial_time, CASE WHEN raw_score > 0.5 THEN raw_score END, 0) AS first_value FROM v"))
def blended_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights renormalised over what is there, and the first value that is."""
    df = contest_view(spark, sf_dir).withColumn("high", F.when(F.col("raw_score") > 0.5, F.col("raw_score")))
    return df.select(*KEY, F.round(numbers.weighted_blend([("trial_time", 0.45), ("lead_time", 0.25), ("high", 0.30)]), 9).alias("blend"), numbers.first_available("trial_time", "high").alias("first_value"))


@query(on_view(f"SELECT contest_id, slot, before, after, before - after AS gained FROM (SELECT contest_id, slot, rank() OVER ({G} ORDER BY lead_time) AS before, rank() OVER ({G} ORDER BY round(CASE WHEN slot = 2 THEN lead_time - 0.03 WHEN slot = 3 THEN 0.0 ELSE lead_time END, 9)) AS after FROM six)", six=SIX))
def what_if_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks before and after a change of lead times: slot 2 by -0.03, slot 3 to 0."""
    df = slot_shares(spark, sf_dir)
    changed = F.round(F.when(F.col("slot") == 2, F.col("lead_time") - 0.03).when(F.col("slot") == 3, 0.0).otherwise(F.col("lead_time")), 9)
    df = df.withColumn("changed", changed).select(*KEY, rank_min("lead_time", ascending=True).alias("before"), rank_min("changed", ascending=True).alias("after"))
    return df.withColumn("gained", F.col("before") - F.col("after"))


@query("""
SELECT p_partkey, upper(trim(p_name)) AS name, CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%' THEN 'warm' WHEN p_type LIKE '%STEEL%' THEN 'cold' ELSE 'other' END AS class,
       len(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[0-9]')) AS meet_starts, CAST(right(CAST(p_partkey AS VARCHAR), 1) AS INT) AS meet_last, round(list_avg(list_transform(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[0-9]'), lambda d: CAST(d AS INT))), 9) AS meet_mean,
       CAST(list_max(list_transform(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[0-9]'), lambda d: CAST(d AS INT))) AS INT) AS meet_worst, printf('%.1f%%', p_size * 1.0) AS size_percent,
       round(list_avg(d) - list_avg(list_slice(d, -3, -1)), 9) AS meet_form_gap, round(len(list_filter(d, lambda x: x <= 3)) / len(d), 9) AS meet_top3_share
FROM (SELECT *, list_transform(regexp_extract_all(CAST(p_partkey AS VARCHAR), '[0-9]'), lambda x: CAST(x AS INT)) AS d FROM part)
""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over a column: cleaning, classes by keyword, digit strings, percentages."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    meet = text.meet_features(F.col("p_partkey").cast("string"))
    kinds = text.keyword_class(F.col("p_type"), [(("BRASS", "COPPER"), "warm"), (("STEEL",), "cold")], "other")
    return part.select("p_partkey", F.upper(text.collapse(F.col("p_name"))).alias("name"), kinds.alias("class"), meet["meet_starts"].alias("meet_starts"), meet["meet_last"].alias("meet_last"), F.round(meet["meet_mean"], 9).alias("meet_mean"), meet["meet_worst"].alias("meet_worst"), text.percent(F.col("p_size") / 100).alias("size_percent"), F.round(meet["meet_form_gap"], 9).alias("meet_form_gap"), F.round(meet["meet_top3_share"], 9).alias("meet_top3_share"))


@query(on_view(f"SELECT contest_id, count(*) FILTER (predicted = 1 AND outcome_rank = 1) AS top1, round(count(*) FILTER (predicted <= 3 AND outcome_rank <= 3) / 3.0, 9) AS overlap FROM (SELECT *, row_number() OVER ({G} ORDER BY raw_score DESC, slot) AS predicted FROM six) GROUP BY contest_id", six=SIX))
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best entrant is found, and how many of the best three."""
    df = slot_shares(spark, sf_dir).withColumn("predicted", rank_first("raw_score", "slot"))
    return df.groupBy("contest_id").agg(F.count_if((F.col("predicted") == 1) & (F.col("outcome_rank") == 1)).alias("top1"), F.round(F.count_if((F.col("predicted") <= 3) & (F.col("outcome_rank") <= 3)) / 3, 9).alias("overlap"))
