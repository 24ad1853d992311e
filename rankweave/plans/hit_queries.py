"""Queries over win styles, hit and favourite models and calibrated tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.core.shared import dealt, stored
from rankweave.operators import challenge as ch
from rankweave.operators import confidence, fitting, sampling, styles
from rankweave.operators import metrics as m
from rankweave.operators import prediction as pr
from rankweave.operators.history import Feature, rolling_history
from rankweave.operators.relative import normalise
from rankweave.operators.tickets import with_completeness
from rankweave.plans.history_queries import BLOCK, F_SQL, KEY, ORDER, _feature_sql, rounded, with_targets
from rankweave.plans.registry import on_view, query
from rankweave.plans.sample_queries import hashed
from rankweave.plans.scenario_queries import CH0, CH1, CH2, clip, with_challengers
from rankweave.plans.ticket_queries import SIX, T3, T3F, T3G, Q, on_tickets, ticket_frame


def style() -> Column:
    """The tables hold two styles only: five are told from the contest."""
    return F.element_at(F.array(*[F.lit(k) for k in styles.KINDS]), (F.col("contest_id") % 5 + 1).cast("int"))


STYLED = f"SELECT *, {', '.join(f'CAST(outcome_rank = 1 AND contest_id % 5 = {i} AS INT) AS won_{k}' for i, k in enumerate(styles.KINDS))} FROM f"
RATES = {("entity_id",): styles.rates("entity", 30, 3), ("site", "position"): styles.rates("place", 200, 30), ("entity_id", "position"): styles.rates("entity_place", 15, 2)}
RATED = "SELECT *, " + ", ".join(_feature_sql(fs, ", ".join(key)) for key, fs in RATES.items()) + " FROM s"


FEW = ("site", "position")  # places at a site: few, with very many rows


def with_flags(df: DataFrame) -> DataFrame:
    """df with the targets and win flags by style."""
    return with_targets(df.withColumn("style", style())).withColumns(styles.win_flags())


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with win flags by style and their three families of rates: those of places in blocks while rows are narrow, then one shuffle for those of an entity."""
    view = contest_view(spark, sf_dir).select(*KEY, "race_date", "contest_no", "position", "entity_id", "site", "outcome_rank")
    df = rolling_history(with_flags(view), FEW, ORDER, RATES[FEW], block=BLOCK, count_on=view)
    return of_entities(dealt(df, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), "entity_id"), RATES)


def of_entities(df: DataFrame, families: dict) -> DataFrame:
    for key, features in families.items():
        df = rolling_history(df, key, ORDER, features) if key != FEW else df
    return df


NAMES = [f.out for fs in RATES.values() for f in fs]


@query(on_view("SELECT contest_id, slot, " + ", ".join(f"won_{k}" for k in styles.KINDS) + ", " + ", ".join(NAMES) + " FROM r", f=F_SQL, s=STYLED, r=RATED))
def style_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins by style and how often an entrant, a place at a site and an entrant at a place have won so before."""
    return rounded(styled(spark, sf_dir), *NAMES, keep=[*KEY, *[f"won_{k}" for k in styles.KINDS]])


def _blend_sql(kind: str) -> str:
    terms = [(f"{name}_{kind}", w) for name, w in styles.BLEND.items()]
    total = " + ".join(f"coalesce({c}, 0) * {w}" for c, w in terms)
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in terms)
    return f"coalesce(least(1, greatest(0, ({total}) / nullif({weight}, 0))), 0)"


FLOW = ", ".join(f"{_blend_sql(k)} AS flow_{k}" for k in styles.BLENDED)
FLOWS = f"SELECT *, least(1, flow_turn + flow_turn_slip) AS attack_style, flow_slip AS slip_style FROM (SELECT *, {FLOW} FROM r)"
FLOW_NAMES = [*[f"flow_{k}" for k in styles.BLENDED], "attack_style", "slip_style"]


@query(on_view("SELECT contest_id, slot, " + ", ".join(f"round({c}, 6) AS {c}" for c in FLOW_NAMES) + " FROM fl", f=F_SQL, s=STYLED, r=RATED, fl=FLOWS))
def style_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style in which an entrant is likely to win, from the rates that are there."""
    df = styled(spark, sf_dir)
    df = df.withColumns({c: F.round(c, 9) for c in NAMES}).withColumns(styles.blended())
    return df.select(*KEY, *[F.round(c, 6).alias(c) for c in FLOW_NAMES])


#: Inputs of the hit model, and where its labels and bands begin.
HIT_INPUTS = ("top3_score", "top3_mass", "top1", "gap12", "margin3", "tightness", "first_share", "pair_share", "entropy")
HIGH, MIDDLE = 0.50, 0.35
HIT_EDGES = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55)
HIT_BANDS = ("p_lt_0_30", "p_0_30_0_35", "p_0_35_0_40", "p_0_40_0_45", "p_0_45_0_50", "p_0_50_0_55", "p_ge_0_55")
#: The same of the favourite's models.
SURE, LIKELY = 0.65, 0.45
FAVOURITE_EDGES = (0.40, 0.50, 0.60, 0.70)
FAVOURITE_BANDS = ("p_lt_0_40", "p_0_40_0_50", "p_0_50_0_60", "p_0_60_0_70", "p_ge_0_70")


def level(p: Column, high: float, middle: float) -> Column:
    return F.when(p >= high, "high").when(p >= middle, "middle").otherwise("low")


def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contest with exactly one actual ticket: the inputs, whether it is among the best three, a fold."""
    ranks = F.collect_list(F.when(F.col("is_actual"), F.col("nth"))).alias("actual_ranks")
    rows = confidence.top3_confidence(ticket_frame(spark, sf_dir), also=[ranks]).where(F.size("actual_ranks") == 1)
    return rows.withColumns({"hit": (F.element_at("actual_ranks", 1) <= 3).cast("int"), "fold": sampling.fold("contest_id", 5)})


FOLD = f"CAST({hashed('contest_id')} % 5 AS BIGINT)"
HIT = {
    "q": Q, "f": T3F, "g": T3G, "t3": T3,
    "hr": f"SELECT contest_id, score AS top3_score, m3 AS top3_mass, q1 AS top1, q1 - q2 AS gap12, q3 - q4 AS margin3, tightness, first_share, pair_share, ent AS entropy, hit, {FOLD} AS fold FROM t3 JOIN (SELECT q.contest_id, max(CAST(nth <= 3 AS INT)) AS hit FROM q JOIN t USING (contest_id, a, b, c) WHERE is_actual GROUP BY q.contest_id HAVING count(*) = 1) USING (contest_id)",
    "tr": "SELECT * FROM hr WHERE fold <> 0",
    **fitting.logistic_sql("tr", HIT_INPUTS, "hit"),
    "hp": f"SELECT hr.*, round({fitting.logistic_sql_probability(HIT_INPUTS)}, 9) AS p FROM hr, lg_f, lg_w",
}


@query(on_tickets("SELECT contest_id, fold, hit, " + ", ".join(f"round({c}, 6) AS {c}" for c in HIT_INPUTS) + " FROM hr", **{k: HIT[k] for k in ("q", "f", "g", "t3", "hr")}))
def hit_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hit model learns from."""
    return hit_rows(spark, sf_dir).select("contest_id", "fold", "hit", *[F.round(c, 6).alias(c) for c in HIT_INPUTS])


def with_hit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit_rows with the probability of the model that folds but 0 give."""
    rows = stored(hit_rows(spark, sf_dir), "hit-rows")
    model = fitting.fit_logistic(rows.where("fold <> 0"), HIT_INPUTS, "hit")
    return rows.withColumn("p", F.round(model.probability(), 9))


@query(on_tickets("SELECT contest_id, hit, fold = 0 AS held_out, round(p, 6) AS hit_probability, round(p * 100, 4) AS hit_score, CASE WHEN p >= 0.5 THEN 'high' WHEN p >= 0.35 THEN 'middle' ELSE 'low' END AS hit_label, round(least(1, greatest(0, top3_score / 100)), 9) AS fallback_probability, CASE WHEN top3_score >= 50 THEN 'high' WHEN top3_score >= 35 THEN 'middle' ELSE 'low' END AS fallback_label FROM hp", **HIT))
def hit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that the best three tickets hold the actual one: by the model, and by the score where there is no model."""
    rows = with_hit_probability(spark, sf_dir)
    fallback = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top3_score") / 100))
    return rows.select("contest_id", "hit", (F.col("fold") == 0).alias("held_out"), F.round("p", 6).alias("hit_probability"), F.round(F.col("p") * 100, 4).alias("hit_score"), level(F.col("p"), HIGH, MIDDLE).alias("hit_label"), F.round(fallback, 9).alias("fallback_probability"), level(fallback, HIGH, MIDDLE).alias("fallback_label"))


def _band_sql(p: str, edges: tuple, names: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {p} < {e} THEN '{n}'" for e, n in zip(edges, names[:-1], strict=True)) + f" ELSE '{names[-1]}' END"


@query(on_tickets(f"SELECT held_out, band, contests, round(contests / sum(contests) OVER (PARTITION BY held_out), 9) AS share, mean_probability, hit_rate, mean_score, mean_tightness FROM (SELECT fold = 0 AS held_out, {_band_sql('p', HIT_EDGES, HIT_BANDS)} AS band, count(*) AS contests, round(avg(p), 6) AS mean_probability, round(avg(hit), 9) AS hit_rate, round(avg(top3_score), 6) AS mean_score, round(avg(tightness), 6) AS mean_tightness FROM hp GROUP BY 1, 2)", **HIT))
def hit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against observed hits in seven bands, of the contests learnt from and of those held out."""
    rows = with_hit_probability(spark, sf_dir).withColumns({"held_out": F.col("fold") == 0, "band": m.band(F.col("p"), HIT_EDGES, HIT_BANDS)})
    out = rows.groupBy("held_out", "band").agg(F.count("*").alias("contests"), F.round(F.avg("p"), 6).alias("mean_probability"), F.round(F.avg("hit"), 9).alias("hit_rate"), F.round(F.avg("top3_score"), 6).alias("mean_score"), F.round(F.avg("tightness"), 6).alias("mean_tightness"))
    return out.withColumn("share", F.round(m.share_of("contests", "held_out"), 9))


OWN = ("raw_score", "trial_time", "win", "top3", "lead5", "lead10", "lead_best30", "place_win", "place_top2", "place_top3", "place_inside", "flow_inside")
FLAT = ("reliability", "pressure", "collapse", "outer_risk", "candidate", "candidate_score", "lead_gap")
OUTSIDE = ("challenger", "flow_turn", "flow_turn_slip", "flow_slip", "raw_score")
AT = {"place2_slip": (2, "flow_slip"), "place2_turn": (2, "flow_turn"), "place3_attack": (3, "attack_style"), "place4_attack": (4, "attack_style"), "place2_lead": (2, "lead_time"), "place3_score": (3, "raw_score"), "place4_score": (4, "raw_score")}
FAVOURITE_INPUTS = (*FLAT, *[f"own_{c}" for c in OWN], *[f"max_outer_{c}" for c in OUTSIDE], *AT)
SLOT_HISTORY = {("entity_id",): [Feature("win", "is_win", 30, 3), Feature("top3", "is_top3", 30, 3), Feature("lead5", "lead_time", 5, 2), Feature("lead10", "lead_time", 10, 3), Feature("lead_best30", "lead_time", 30, 3, "min")], ("site", "position"): [Feature("place_win", "is_win", 200, 30), Feature("place_top2", "is_top2", 200, 30), Feature("place_top3", "is_top3", 200, 30)]}


def favourite_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each complete contest: 31 inputs of the favourite's models, what became of it, and a fold. Missing inputs are 0."""
    families = {key: [*SLOT_HISTORY.get(key, []), *fs] for key, fs in RATES.items()}
    measured = ["position", "outcome_rank", "lead_time", "trial_time", "raw_score", "machine_a", "machine_b"]
    view = with_completeness(contest_view(spark, sf_dir), "whole").select(*KEY, "race_date", "contest_no", "entity_id", "site", *measured, "whole")
    view = stored(view, "slots")  # families and contests read it
    runs = [*KEY, "race_date", "contest_no", "position", "outcome_rank", "whole"]
    entities = of_entities(with_flags(dealt(view.select(*runs, "entity_id", "lead_time"), view.count(), "entity_id")), families)
    places = rolling_history(with_flags(view.select(*runs, "site")), FEW, ORDER, families[FEW], block=BLOCK, count_on=view)
    names = [[f.out for key, fs in families.items() if (key == FEW) == few for f in fs] for few in (False, True)]
    # rows of complete contests only go on: measures and rates of a slot meet in the contest's shuffle
    whole = view.where("whole").select(*KEY, *measured)
    for df, known in zip((entities, places), names, strict=True):
        whole = whole.unionByName(rounded(df.where("whole"), *known), allowMissingColumns=True)
    whole = dealt(whole, 3 * view.where("whole").count(), "contest_id").groupBy(*KEY).agg(*[F.max(c).alias(c) for c in whole.columns if c not in KEY])
    slots, measures = with_challengers(whole.withColumns(styles.blended()))
    slots = slots.withColumn("outer", ch.outer(measures)).withColumns(ch.contest_flow()).withColumn("candidate", ch.candidate()).withColumns(ch.around_candidate())
    mean_lead = lambda inside: F.avg(F.when(inside, F.col("lead_time")))
    place = F.col("position")
    flat = [*[F.first(c).alias(c) for c in FLAT if c != "lead_gap"], (mean_lead(place >= 4) - mean_lead(place <= 3)).alias("lead_gap")]
    rows = pr.favourite_row(slots, OWN, OUTSIDE, AT, also=[*flat, pr.favourite_rank().alias("rank")]).where("rank is not null")
    return rows.withColumns(pr.favourite_outcome("rank")).select("contest_id", "won", "collapsed", sampling.fold("contest_id", 5).alias("fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FAVOURITE_INPUTS])


_FIRST = "(CASE WHEN position = 1 THEN 0 WHEN slot = 1 THEN 1 ELSE 2 END) * 1000 + slot"
FAVOURITE = {
    "six": SIX, "c0": CH0, "c1": CH1, "c2": CH2, "f": F_SQL, "s": STYLED,
    "r": "SELECT *, " + ", ".join(_feature_sql([*SLOT_HISTORY.get(key, []), *fs], ", ".join(key)) for key, fs in RATES.items()) + " FROM s",
    "fl": FLOWS,
    "sl": f"SELECT c2.*, {clip('(1 - reliability) * (0.45 + 0.35 * pressure) + 0.2 * outer_risk')} AS collapse, {', '.join('fl.' + c for c in (*[f.out for fs in SLOT_HISTORY.values() for f in fs], 'place_inside', *FLOW_NAMES))} FROM c2 JOIN fl USING (contest_id, slot)",
    "fr": "SELECT contest_id, " + ", ".join(f"coalesce(CAST({x} AS DOUBLE), 0) AS {c}" for c, x in {
        **{c: f"any_value({c})" for c in FLAT[:5]}, "candidate_score": "any_value(top)", "lead_gap": "avg(CASE WHEN position >= 4 THEN lead_time END) - avg(CASE WHEN position <= 3 THEN lead_time END)",
        **{f"own_{c}": f"arg_min_null({c}, {_FIRST})" for c in OWN}, **{f"max_outer_{c}": f"max(CASE WHEN position >= 2 THEN {c} END)" for c in OUTSIDE}, **{n: f"max(CASE WHEN position = {k} THEN {c} END)" for n, (k, c) in AT.items()},
    }.items()) + f", CAST(max(CASE WHEN position = 1 THEN outcome_rank END) = 1 AS INT) AS won, CAST(max(CASE WHEN position = 1 THEN outcome_rank END) >= 3 AS INT) AS collapsed, {FOLD} AS fold FROM sl GROUP BY contest_id",
    "tr": "SELECT * FROM fr WHERE fold <> 0",
    **fitting.logistic_sql("tr", FAVOURITE_INPUTS, "won", name="lw"), **fitting.logistic_sql("tr", FAVOURITE_INPUTS, "collapsed", name="lc"),
    "fw": f"SELECT fr.*, round({fitting.logistic_sql_probability(FAVOURITE_INPUTS, 'lw')}, 9) AS p_won FROM fr, lw_f, lw_w",
    "fp": f"SELECT fw.*, round({fitting.logistic_sql_probability(FAVOURITE_INPUTS, 'lc')}, 9) AS p_collapsed FROM fw, lc_f, lc_w",
}


@query(on_view("SELECT contest_id, won, collapsed, fold, " + ", ".join(f"round({c}, 6) AS {c}" for c in FAVOURITE_INPUTS) + " FROM fr", **{k: v for k, v in FAVOURITE.items() if k in ("six", "c0", "c1", "c2", "f", "s", "r", "fl", "sl", "fr")}))
def favourite_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the favourite's models learn from: the contest, the favourite, the strongest outside and named places."""
    return favourite_inputs(spark, sf_dir).select("contest_id", "won", "collapsed", "fold", *[F.round(c, 6).alias(c) for c in FAVOURITE_INPUTS])


def with_favourite_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(favourite_inputs(spark, sf_dir), "favourite-rows")
    models = {label: fitting.fit_logistic(rows.where("fold <> 0"), FAVOURITE_INPUTS, label) for label in ("won", "collapsed")}
    return rows.withColumns({f"p_{label}": F.round(model.probability(), 9) for label, model in models.items()})


def _level_sql(p: str) -> str:
    return f"CASE WHEN {p} >= 0.65 THEN 'high' WHEN {p} >= 0.45 THEN 'middle' ELSE 'low' END"


@query(on_view(f"SELECT contest_id, fold = 0 AS held_out, won, collapsed, round(p_won, 6) AS win_probability, round(p_won * 100, 4) AS win_score, {_level_sql('p_won')} AS win_label, round(p_collapsed, 6) AS collapse_probability, round(p_collapsed * 100, 4) AS collapse_score, {_level_sql('p_collapsed')} AS collapse_label FROM fp", **FAVOURITE))
def favourite_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that the favourite wins, and that it doesn't even come second."""
    rows = with_favourite_probabilities(spark, sf_dir)
    out = [c for label, name in (("won", "win"), ("collapsed", "collapse")) for c in (F.round(f"p_{label}", 6).alias(f"{name}_probability"), F.round(F.col(f"p_{label}") * 100, 4).alias(f"{name}_score"), level(F.col(f"p_{label}"), SURE, LIKELY).alias(f"{name}_label"))]
    return rows.select("contest_id", (F.col("fold") == 0).alias("held_out"), "won", "collapsed", *out)


_LONG = "SELECT fold = 0 AS held_out, 'win' AS target, p_won AS p, won AS y FROM fp UNION ALL SELECT fold = 0, 'collapse', p_collapsed, collapsed FROM fp"


@query(on_view(f"SELECT *, round(contests / sum(contests) OVER (PARTITION BY target, held_out), 9) AS share FROM (SELECT target, held_out, {_band_sql('p', FAVOURITE_EDGES, FAVOURITE_BANDS)} AS band, count(*) AS contests, round(avg(p), 6) AS mean_probability, round(avg(y), 9) AS hit_rate FROM lo GROUP BY 1, 2, 3)", **FAVOURITE, lo=_LONG))
def favourite_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against observed rates of both models in five bands."""
    rows = with_favourite_probabilities(spark, sf_dir)
    both = F.array(*[F.struct(F.lit(name).alias("target"), F.col(f"p_{label}").alias("p"), F.col(label).alias("y")) for label, name in (("won", "win"), ("collapsed", "collapse"))])
    long = rows.select((F.col("fold") == 0).alias("held_out"), F.inline(both)).withColumn("band", m.band(F.col("p"), FAVOURITE_EDGES, FAVOURITE_BANDS))
    out = long.groupBy("target", "held_out", "band").agg(F.count("*").alias("contests"), F.round(F.avg("p"), 6).alias("mean_probability"), F.round(F.avg("y"), 9).alias("hit_rate"))
    return out.withColumn("share", F.round(m.share_of("contests", "target", "held_out"), 9))


DIGITS = 4  # places of a probability that calibration tells apart
PAV = {
    "tk": f"SELECT contest_id, a, b, c, is_actual, round(probability, {DIGITS}) AS x, {FOLD} AS fold FROM t",
    "dx": "SELECT x, n, s, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS nn, sum(s) OVER (ORDER BY x) AS ss FROM (SELECT x, count(*) AS n, sum(CAST(is_actual AS INT)) AS s FROM tk WHERE fold <> 0 GROUP BY x)",
    # the largest over starts of the smallest mean over ends: what pooling gives
    "mm": "SELECT j.i AS j, k.i AS k, min((k.ss - j.ss + j.s) / (k.nn - j.nn + j.n)) OVER (PARTITION BY j.i ORDER BY k.i DESC) AS low FROM dx AS j JOIN dx AS k ON j.i <= k.i",
    "fit": "SELECT dx.x, max(low) AS y FROM mm JOIN dx ON dx.i = mm.k GROUP BY dx.x",
    # of each stretch of equal values the first and the last place
    "st": "SELECT x, y FROM (SELECT *, lag(y) OVER (ORDER BY x) AS a, lead(y) OVER (ORDER BY x) AS b FROM fit) WHERE a IS NULL OR b IS NULL OR abs(a - y) > 1e-12 OR abs(b - y) > 1e-12",
    "sg": "SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM st",
    "cl": "SELECT tk.*, greatest(CASE WHEN sg.x IS NULL THEN (SELECT min_by(y, x) FROM st) WHEN x1 IS NULL THEN sg.y ELSE sg.y + (y1 - sg.y) * (tk.x - sg.x) / (x1 - sg.x) END, 1e-9) AS v FROM tk ASOF LEFT JOIN sg ON tk.x >= sg.x",
    "ca": "SELECT *, v / sum(v) OVER (PARTITION BY contest_id) AS calibrated, x / sum(x) OVER (PARTITION BY contest_id) AS raw FROM cl",
}


def calibrated_tickets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, fitting.Steps]:
    """Tickets of complete contests with raw and calibrated probabilities; the steps come from folds but 0."""
    tickets = ticket_frame(spark, sf_dir).select("contest_id", "a", "b", "c", F.col("is_actual").cast("int").alias("actual"), F.round("probability", DIGITS).alias("x"), sampling.fold("contest_id", 5).alias("fold"))
    tickets = stored(tickets, "tickets")
    steps = fitting.fit_monotone(tickets.where("fold <> 0"), "x", "actual")
    return fitting.calibrated(tickets, steps, "x", "calibrated").withColumn("raw", normalise("x")), steps


@query(on_tickets("SELECT round(x, 6) AS x, round(y, 9) AS y FROM st", **{k: PAV[k] for k in ("tk", "dx", "mm", "fit", "st")}))
def calibration_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places and values of the rising function that turns a ticket's probability into an observed rate."""
    steps = calibrated_tickets(spark, sf_dir)[1]
    return spark.createDataFrame([(round(x, 6), round(y, 9)) for x, y in zip(steps.x, steps.y, strict=True)], "x double, y double")


@query(on_tickets("SELECT contest_id, a, b, c, round(raw, 9) AS raw, round(calibrated, 9) AS calibrated FROM ca", **PAV))
def calibrated_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with their probability before and after calibration, adding up to 1 in the contest."""
    return calibrated_tickets(spark, sf_dir)[0].select("contest_id", "a", "b", "c", F.round("raw", 9).alias("raw"), F.round("calibrated", 9).alias("calibrated"))


_SPLIT = "CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END"


@query(on_tickets(f"SELECT split, variant, count(*) AS tickets, count(DISTINCT contest_id) AS contests, round(avg(-(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(1 - least(p, 1 - 1e-15)))), 9) AS log_loss, round(avg((p - y) ** 2), 9) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(greatest(p, 1e-15)) END), 6) AS actual_loss FROM (SELECT {_SPLIT} AS split, 'raw' AS variant, contest_id, CAST(is_actual AS INT) AS y, raw AS p FROM ca UNION ALL SELECT {_SPLIT}, 'calibrated', contest_id, CAST(is_actual AS INT), calibrated FROM ca) GROUP BY split, variant", **PAV))
def calibration_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses before and after calibration in three splits, from one pass over the tickets."""
    tickets = calibrated_tickets(spark, sf_dir)[0]
    split = F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "valid").otherwise("train").alias("split")
    both = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("p")) for v in ("raw", "calibrated")])
    long = tickets.select(split, "contest_id", F.col("actual").alias("y"), F.inline(both))
    p, y = F.col("p"), F.col("y")
    loss = -(y * F.ln(F.greatest(p, F.lit(1e-15))) + (1 - y) * F.ln(1 - F.least(p, F.lit(1 - 1e-15))))
    return long.groupBy("split", "variant").agg(F.count("*").alias("tickets"), F.count_distinct("contest_id").alias("contests"), F.round(F.avg(loss), 9).alias("log_loss"), F.round(F.avg(F.pow(p - y, 2)), 9).alias("brier"), F.round(F.avg(F.when(y == 1, -F.ln(F.greatest(p, F.lit(1e-15))))), 6).alias("actual_loss"))
