"""Queries that apply several fitted or saved models to one frame, and searches that go on from saved results."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.shared import shared_folder, stored
from rankweave.operators import relative, sampling, search
from rankweave.operators import scenario as sc
from rankweave.plans.evaluation_queries import BOTH, GRID, PAYLOAD, SHOWN, TOP, both_orders, grid, judged_sql, points_sql, shown
from rankweave.plans.history_queries import KEY
from rankweave.plans.model_queries import INPUTS, PREDICTED, design, out_of_fold_leads, predicted_lead_features, ranked, training
from rankweave.plans.registry import on_view, query
from rankweave.plans.scenario_queries import NINE, scenario_slots
from rankweave.plans.ticket_queries import CONDITIONAL, SIX, WEIGHTS, on_tickets, slot_shares

LEARNT = ("prediction", "rawPrediction", "probability")


@query()
def slot_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot's share by two blended rank models, with probabilities of a win, of the first two and three, of each style and of the exact places appended."""
    df = training(spark, sf_dir)
    prepared = Pipeline(stages=design()).fit(df.where("fold <> 0"))
    frame = stored(prepared.transform(df).select(*KEY, "fold", "label", "outcome_rank", "is_top2", "is_top3", "style", "features"), "prepared")  # every fit reads it
    train = frame.where("fold <> 0")

    def binary(frame: DataFrame, target, name: str, normalised: bool) -> DataFrame:
        fitted = LogisticRegression(labelCol="target", maxIter=20).fit(train.withColumn("target", target.cast("double")))
        p = vector_to_array("probability")[1]
        return fitted.transform(frame).withColumn(name, p).withColumn(name, relative.normalise(F.col(name)) if normalised else F.col(name)).drop(*LEARNT)

    for name, learner in (("ridge", LinearRegression(regParam=1.0)), ("boosted", GBTRegressor(maxIter=5, maxDepth=3, seed=7))):
        frame = ranked(learner.fit(train).transform(frame)).withColumnRenamed("share", name).drop("predicted_rank", *LEARNT)
    frame = frame.withColumn("share", relative.normalise(0.6 * F.col("ridge") + 0.4 * F.col("boosted")))
    place = F.col("outcome_rank")
    for name, target, normalised in (("win", place == 1, False), ("top2", F.col("is_top2"), False), ("top3", F.col("is_top3"), False), ("place2", place == 2, True), ("place3", place == 3, True)):
        frame = binary(frame, target, f"p_{name}", normalised)
    frame = frame.withColumn("p_place1", relative.normalise("p_win"))  # the same target has the same model
    styled = RandomForestClassifier(labelCol="target", numTrees=10, maxDepth=4, seed=7).fit(train.withColumn("target", (F.col("style") != "O").cast("double")))
    p = vector_to_array("probability")
    frame = styled.transform(frame).withColumns({"p_style_o": p[0], "p_style_f": F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))})
    return frame.select(*KEY, "share", *[f"p_{c}" for c in ("win", "top2", "top3", "place1", "place2", "place3", "style_o", "style_f")], relative.rank_first("share", "slot").alias("predicted_rank"))


@query()
def saved_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last block of days scored by a saved pair: a lead model and a rank model that reads its predictions.

    The rank model is fitted on leads predicted out of fold, the lead model on
    all earlier days; both are written to the shared folder and read again.
    """
    df = training(spark, sf_dir)
    rows = sampling.chronological_blocks(df, 4)
    past = rows.where("block < 4")
    lead = Pipeline(stages=[*design(), GBTRegressor(labelCol="lead_time", lossType="absolute", maxIter=5, maxDepth=3, seed=7)]).fit(past)
    known = out_of_fold_leads(past.drop("block"), 3).drop(*[f"{c}_filled" for c in INPUTS], "site_index").withColumns(predicted_lead_features())
    order = Pipeline(stages=[*design([*INPUTS, "predicted_lead", *PREDICTED]), LinearRegression(regParam=1.0)]).fit(known)
    folder = shared_folder(spark)
    lead.write().save(f"{folder}/lead")
    order.write().save(f"{folder}/order")
    lead, order = PipelineModel.load(f"{folder}/lead"), PipelineModel.load(f"{folder}/order")
    new = lead.transform(rows.where("block = 4")).withColumnRenamed("prediction", "predicted_lead").drop("raw", "features", "site_index", *[f"{c}_filled" for c in INPUTS])
    return ranked(order.transform(new.withColumns(predicted_lead_features()))).select(*KEY, "predicted_lead", "share", "predicted_rank")


@query(on_view("""
SELECT contest_id, CASE WHEN w = 1 THEN 'S0' WHEN w = 2 AND style = 'O' AND one <= 3 THEN 'S1' WHEN w = 2 THEN 'S2' WHEN w IN (3, 4) THEN 'S' || w WHEN w IN (5, 6) OR outside >= 2 THEN 'S5' ELSE 'S6' END AS scenario
FROM (SELECT contest_id, max(CASE WHEN outcome_rank = 1 THEN slot END) AS w, max(CASE WHEN outcome_rank = 1 THEN style END) AS style, max(CASE WHEN slot = 1 THEN outcome_rank END) AS one, count(*) FILTER (outcome_rank <= 3 AND slot >= 4) AS outside FROM six GROUP BY contest_id)
""", six=SIX))
def outcome_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenario that a contest's result belongs to."""
    return _outcomes(slot_shares(spark, sf_dir))


def _outcomes(slots: DataFrame) -> DataFrame:
    return sc.observed(slots).select("contest_id", sc.outcome_scenario("O").alias("scenario"))


@query()
def scenario_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the scenario of the result: how often its label and that of the rules is right, by split.

    The forest's probabilities stand for the rules' scores. Under 20 contests,
    or with one scenario only, the rules stay.
    """
    slots = scenario_slots(spark, sf_dir).withColumn("challenge", sc.challenge())
    slots = stored(slots.drop("race_date", "contest_no", "site", "payout", "entity_id", "machine_a", "machine_b"), "scenario-slots")  # three aggregates read them
    wide = slots.groupBy("contest_id").agg(*[F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"slot{k}_{c}") for k in range(1, 7) for c in ("challenge", "top2", "k2", "lead_adv")])
    inputs = [*NINE, *[c for c in wide.columns if c != "contest_id"]]
    rows = sc.context(slots).join(wide, "contest_id").join(_outcomes(slots), "contest_id")
    rows = stored(rows.withColumn("fold", sampling.fold("contest_id", 5)).withColumn("target", F.substring("scenario", 2, 1).cast("double")), "scenario-rows")
    learnable = rows.where("fold <> 0").agg(F.count("*").alias("n"), F.count_distinct("target").alias("kinds")).head()
    scored = rows
    if fitted := learnable["n"] >= 20 and learnable["kinds"] >= 2:
        forest = RandomForestClassifier(labelCol="target", numTrees=20, maxDepth=4, seed=7)
        scored = Pipeline(stages=[*design(inputs, None), forest]).fit(rows.where("fold <> 0")).transform(rows)
        p = vector_to_array("probability")
        scored = scored.withColumns({f"model_{s}": F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i, s in enumerate(sc.SCENARIOS)})
    right = lambda label: F.avg((F.col(label) == F.col("scenario")).cast("double"))
    ruled = scored.withColumns(sc.scores()).withColumn("by_rules", sc.label())
    both = ruled.withColumns(sc.scores([f"model_{s}" for s in sc.SCENARIOS] if fitted else None)).withColumn("by_model", sc.label())
    return both.groupBy((F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("contests"), right("by_rules").alias("rules_right"), right("by_model").alias("model_right"))


@query(on_tickets(f"SELECT {SHOWN} FROM ({judged_sql('po')})", w=WEIGHTS, k=CONDITIONAL, bo=BOTH, pl=PAYLOAD, po=points_sql("pl", GRID)))
def resumed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of `rerank_grid`, with the results of some points saved before: only the open ones are tried."""
    rows = stored(search.payloads(both_orders(spark, sf_dir), "probability", "u", "is_actual", TOP), "payloads")
    folder = f"{shared_folder(spark)}/points"
    search.point_metrics(search.outcomes(rows, grid(spark).where("weight > 0.85"))).write.parquet(folder)
    done = spark.read.parquet(folder)
    left = search.open_points(grid(spark), done, rows.count())
    return shown(search.judged(done.unionByName(search.point_metrics(search.outcomes(rows, left)))))
