"""Model fits on Spark ML and what follows from them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.core.shared import stored
from rankweave.operators import fitting, relative, sampling, styles
from rankweave.operators import metrics as m
from rankweave.operators.history import Feature, rolling_history
from rankweave.operators.tickets import complete_groups
from rankweave.plans.history_queries import KEY, ORDER, flagged, guarded
from rankweave.plans.registry import on_view, query
from rankweave.plans.ticket_queries import SIX, ticket_frame

INPUTS = ["form", "lead", "win", "raw_score"]
LEAST = 100  # winners that a model of styles needs


def design(inputs: list[str] = INPUTS, category: str | None = "site") -> list:
    """Median for missing values, categories as numbers, one scaled vector."""
    filled = [f"{c}_filled" for c in inputs]
    stages = [Imputer(inputCols=inputs, outputCols=filled, strategy="median")]
    if category:
        stages.append(StringIndexer(inputCol=category, outputCol=f"{category}_index", handleInvalid="keep"))
        filled.append(f"{category}_index")
    return [*stages, VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=False)]


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete contests with history features and a hash fold, written once: fits and the frames they give read them. Fold 0 is held out."""
    six = complete_groups(flagged(spark, sf_dir))
    df = rolling_history(six, ["entity_id"], ORDER, [Feature("form", "outcome_rank", 30, 3), Feature("lead", "lead_time", 10, 3), Feature("win", "is_win", 30, 3)])
    return stored(df.withColumn("fold", sampling.fold("contest_id", 5)).withColumn("label", F.col("outcome_rank").cast("double")), "training")


def ranked(scored: DataFrame) -> DataFrame:
    """A regression of the rank, negated, as shares and order of the contest."""
    return scored.withColumn("share", relative.softmax(-F.col("prediction"))).withColumn("predicted_rank", relative.rank_first("share", "slot"))


def quality(df: DataFrame) -> DataFrame:
    """(split, top1, overlap): exact best and mean share of the best three found."""
    contest = df.withColumn("split", F.when(F.col("fold") == 0, "valid").otherwise("train")).groupBy("split", "contest_id").agg(
        F.max(((F.col("predicted_rank") == 1) & (F.col("outcome_rank") == 1)).cast("int")).alias("top1"), (F.count_if((F.col("predicted_rank") <= 3) & (F.col("outcome_rank") <= 3)) / 3).alias("overlap"))
    return contest.groupBy("split").agg(F.count("*").alias("contests"), F.avg("top1").alias("top1"), F.avg("overlap").alias("overlap"))


def _rank_model(learner):  # a function: learners can't be made before there is a session
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = training(spark, sf_dir)
        fitted = Pipeline(stages=[*design(), learner()]).fit(df.where("fold <> 0"))
        return quality(ranked(fitted.transform(df)))

    return run


def _register(name: str, doc: str, learner) -> None:
    run = _rank_model(learner)
    run.__name__, run.__doc__ = name, doc
    query()(run)


_register("ridge_fit", "Ridge regression of the rank, evaluated on held-out contests.", lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0))
_register("boosted_fit", "Boosted trees on the rank.", lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=7))
_register("forest_fit", "A random forest on the rank.", lambda: RandomForestRegressor(numTrees=10, maxDepth=5, seed=7))


@query()
def ensemble_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two learners' shares blended by fixed weights, normalised again."""
    df = training(spark, sf_dir)
    total = None
    for weight, learner in ((0.6, LinearRegression(regParam=1.0)), (0.4, GBTRegressor(maxIter=5, maxDepth=3, seed=7))):
        fitted = Pipeline(stages=[*design(), learner]).fit(df.where("fold <> 0")).transform(df)
        shares = ranked(fitted).select(*KEY, "outcome_rank", "fold", (F.col("share") * weight).alias("part"))
        total = shares if total is None else total.unionByName(shares)
    both = total.groupBy(*KEY, "outcome_rank", "fold").agg(F.sum("part").alias("mixed"))
    return quality(both.withColumn("share", relative.softmax("mixed")).withColumn("predicted_rank", relative.rank_first("share", "slot")))


@query()
def win_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regressions of three binary targets with loss and Brier score by split; a target of one class is a constant."""
    df, out = training(spark, sf_dir), None
    for target in ("is_win", "is_top2", "is_top3"):
        kinds = df.where("fold <> 0").agg(F.min(target).alias("low"), F.max(target).alias("high")).head()
        if kinds["low"] == kinds["high"]:
            scored = df.withColumn("p", F.lit(float(kinds["low"] or 0)))
        else:
            fitted = Pipeline(stages=[*design(), LogisticRegression(labelCol=target, maxIter=30)]).fit(df.where("fold <> 0"))
            scored = fitted.transform(df).withColumn("p", vector_to_array("probability")[1])
        rows = scored.groupBy((F.col("fold") == 0).alias("held_out")).agg(*m.binary_quality(F.col(target), F.col("p"))).withColumn("target", F.lit(target))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def style_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the style of the win, from winners of contests with a known style: accuracy, log loss and Brier score by split.

    Styles are told from the contest. With fewer than LEAST winners to learn from there is no model and no row.
    """
    style = F.element_at(F.array(*[F.lit(k) for k in styles.KINDS]), (F.col("contest_id") % len(styles.KINDS) + 1).cast("int"))
    number = F.array_position(F.array(*[F.lit(k) for k in styles.KINDS]), F.col("style")) - 1
    df = training(spark, sf_dir).withColumn("style", style).where("is_win = 1 and style is not null").withColumn("kind", number.cast("double"))
    seen = df.where("fold <> 0")
    if seen.count() < LEAST:
        return spark.createDataFrame([], "held_out boolean, n long, accuracy double, log_loss double, brier double")
    fitted = Pipeline(stages=[*design(), RandomForestClassifier(labelCol="kind", numTrees=10, maxDepth=4, seed=7)]).fit(seen)
    scored = fitted.transform(df).withColumn("p", vector_to_array("probability"))
    own = F.coalesce(F.try_element_at("p", F.col("kind").cast("int") + 1), F.lit(0.0))
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (F.col("kind") == i).cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return scored.groupBy((F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("kind")).cast("double")).alias("accuracy"), F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), F.avg(brier).alias("brier"))


@query()
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket probabilities calibrated to observed rates, normalised per contest; losses before and after."""
    tickets = ticket_frame(spark, sf_dir).select("contest_id", "probability", F.col("is_actual").cast("double").alias("label"), sampling.fold("contest_id", 5).alias("fold"))
    tickets = stored(tickets, "tickets")
    steps = fitting.fit_monotone(tickets.where("fold <> 0"), "probability", "label")
    calibrated = fitting.calibrated(tickets, steps, "probability", "calibrated")
    both = F.array(*[F.struct(F.lit(name).alias("variant"), F.col(name).alias("p")) for name in ("probability", "calibrated")])
    rows = calibrated.select((F.col("fold") == 0).alias("held_out"), "label", F.inline(both))
    quality = m.binary_quality(F.col("label"), F.col("p"))
    found = rows.groupBy("held_out", "variant").agg(*quality)
    return found.select("held_out", *[c for c in found.columns if c not in ("held_out", "variant")], "variant")


def out_of_fold_leads(df: DataFrame, blocks: int = 4) -> DataFrame:
    """Lead times of all but the first block of days, each predicted from earlier days only."""
    df, out = sampling.chronological_blocks(df, blocks), None
    for block in range(2, blocks + 1):
        learner = GBTRegressor(labelCol="lead_time", lossType="absolute", maxIter=5, maxDepth=3, seed=7)
        fitted = Pipeline(stages=[*design(), learner]).fit(df.where(F.col("block") < block))
        rows = fitted.transform(df.where(F.col("block") == block)).drop("raw", "features").withColumnRenamed("prediction", "predicted_lead")
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def lead_time_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead times predicted block by block from earlier days only; errors and the sign of neighbour gaps."""
    df = training(spark, sf_dir)
    out = out_of_fold_leads(df)
    near = Window.partitionBy("contest_id").orderBy("position", "slot")
    gaps = out.withColumns({"gap": F.col("lead_time") - F.lag("lead_time").over(near), "predicted_gap": F.col("predicted_lead") - F.lag("predicted_lead").over(near)})
    same = F.when(F.col("gap") != 0, (F.signum("gap") == F.signum("predicted_gap")).cast("double"))
    error = F.col("predicted_lead") - F.col("lead_time")
    return gaps.groupBy("block").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(same).alias("sign_accuracy"))


PREDICTED = ["predicted_to_proxy", "predicted_rank_in_contest", "predicted_from_mean", "predicted_spread", "predicted_to_inner", "predicted_to_outer"]


def predicted_lead_features() -> dict[str, Column]:
    """A predicted lead against what was known, against the contest and against its neighbours."""
    near, x = Window.partitionBy("contest_id").orderBy("position", "slot"), F.col("predicted_lead")
    return dict(zip(PREDICTED, (x - F.col("lead"), relative.rank_min("predicted_lead", ascending=True).cast("double"), relative.from_mean("predicted_lead"), relative.spread("predicted_lead"), x - F.lag(x).over(near), x - F.lead(x).over(near)), strict=True))


@query()
def paired_lead_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rank models on the same contests, without and with features of a lead predicted out of fold; quality of each by split."""
    df, out = training(spark, sf_dir), None
    rows = out_of_fold_leads(df).drop(*[f"{c}_filled" for c in INPUTS], "site_index").withColumns(predicted_lead_features()).withColumn("fold", F.when(F.col("block") == 4, 0).otherwise(1))
    for variant, inputs in (("base", INPUTS), ("with_lead", [*INPUTS, "predicted_lead", *PREDICTED])):
        fitted = Pipeline(stages=[*design(inputs), LinearRegression(regParam=1.0)]).fit(rows.where("fold <> 0"))
        found = quality(ranked(fitted.transform(rows))).withColumn("variant", F.lit(variant))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def place_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifiers of the exact places 1, 2 and 3, each normalised in the contest; loss and how often the right slot leads."""
    df, out = training(spark, sf_dir), None
    for place in (1, 2, 3):
        rows = df.withColumn("at_place", (F.col("outcome_rank") == place).cast("double"))
        fitted = Pipeline(stages=[*design(), LogisticRegression(labelCol="at_place", maxIter=20)]).fit(rows.where("fold <> 0"))
        scored = fitted.transform(rows).withColumn("p", relative.normalise(vector_to_array("probability")[1]))
        scored = scored.withColumn("n", relative.rank_first("p", "slot"))
        found = scored.where("at_place = 1").groupBy((F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("contests"), F.avg(-F.ln(F.greatest("p", F.lit(1e-15)))).alias("log_loss"), F.avg((F.col("n") == 1).cast("double")).alias("first_found")).withColumn("place", F.lit(place))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def shape_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on how contests went (three shapes), from one row a contest; classes with fewer than 20 rows are left out."""
    per_slot = [F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}_{k}") for k in range(1, 7) for c in ("raw_score", "win")]
    outside = F.count_if((F.col("outcome_rank") <= 3) & (F.col("slot") >= 4))
    df = training(spark, sf_dir)
    rows = df.groupBy("contest_id", "fold").agg(*per_slot, F.least(outside, F.lit(2)).cast("double").alias("shape"))
    kept = rows.groupBy("shape").agg(F.count("*").alias("n")).where("n >= 20").select("shape")
    rows = rows.join(F.broadcast(kept), "shape", "left_semi")  # three rows at most
    inputs = [f"{c}_{k}" for k in range(1, 7) for c in ("raw_score", "win")]
    fitted = Pipeline(stages=[*design(inputs, None), RandomForestClassifier(labelCol="shape", numTrees=20, maxDepth=4, seed=7)]).fit(rows.where("fold <> 0"))
    scored = fitted.transform(rows)
    return scored.groupBy((F.col("fold") == 0).alias("held_out"), "shape").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("shape")).cast("double")).alias("recall"))


STEPS = 10
OBJECTIVES = {
    "first": {"hit1": 1.0}, "first_and_three": {"hit1": 0.6, "overlap": 0.4}, "balanced": {"hit1": 0.35, "overlap": 0.45, "mrr": 0.2},
    "reciprocal": {"mrr": 1.0}, "loss": {"log_loss": -1.0}, "placed": {"mean_rank": -1.0},
}
SOFT = "exp({x} - max({x}) OVER (PARTITION BY contest_id)) / sum(exp({x})) OVER (PARTITION BY contest_id) * exp(max({x}) OVER (PARTITION BY contest_id))"
MIXED = f"""
SELECT contest_id, slot, outcome_rank, {SOFT.format(x='raw_score')} AS s0, {SOFT.format(x='f')} AS s1, {SOFT.format(x='w')} AS s2
FROM (SELECT *, coalesce(-({guarded('avg', 'outcome_rank', 'entity_id', 30, 3)}), 0) AS f, coalesce({guarded('avg', 'CAST(outcome_rank = 1 AS INT)', 'entity_id', 30, 3)}, 0) AS w FROM six)
"""
WEIGHT_GRID = f"SELECT a / {STEPS}.0::DOUBLE AS w0, b / {STEPS}.0::DOUBLE AS w1, ({STEPS} - a - b) / {STEPS}.0::DOUBLE AS w2 FROM range({STEPS + 1}) AS x(a), range({STEPS + 1}) AS y(b) WHERE a + b <= {STEPS}"
BY_POINT = """
SELECT w0, w1, w2, avg(CAST(won = 1 AS INT)) AS hit1, avg(three / 3.0) AS overlap, avg(1.0 / won) AS mrr, avg(-ln(greatest(p, 1e-15))) AS log_loss, avg(best) AS mean_rank
FROM (SELECT w0, w1, w2, contest_id, max(CASE WHEN outcome_rank = 1 THEN n END) AS won, count(*) FILTER (n <= 3 AND outcome_rank <= 3) AS three, max(CASE WHEN outcome_rank = 1 THEN score END) AS p, max(CASE WHEN n = 1 THEN outcome_rank END) AS best
      FROM (SELECT *, row_number() OVER (PARTITION BY w0, w1, w2, contest_id ORDER BY score DESC, slot) AS n FROM (SELECT *, round(w0 * s0 + w1 * s1 + w2 * s2, 12) AS score FROM mx, wg)) GROUP BY w0, w1, w2, contest_id) GROUP BY w0, w1, w2
"""


def _objective_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{name}' AS objective, w0, w1, w2, round({' + '.join(f'{w} * {c}' for c, w in table.items())}, 9) AS value FROM bp" for name, table in OBJECTIVES.items())
    return f"SELECT objective, w0, w1, w2, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY value DESC, w0, w1, w2) AS n FROM ({each})) WHERE n = 1"


@query(on_view(_objective_sql(), six=SIX, mx=MIXED, wg=WEIGHT_GRID, bp=BY_POINT))
def objective_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight vector of a simplex grid over three scores; the best one for each of six objectives.

    A contest's slots are one array, and the grid is expanded beside it: only
    the metrics of each contest and point are shuffled.
    """
    six = complete_groups(flagged(spark, sf_dir))
    df = rolling_history(six, ["entity_id"], ORDER, [Feature("form", "outcome_rank", 30, 3), Feature("win", "is_win", 30, 3)])
    scores = ("raw_score", F.coalesce(-F.col("form"), F.lit(0.0)), F.coalesce("win", F.lit(0.0)))
    df = df.withColumns({f"s{i}": relative.softmax(c) for i, c in enumerate(scores)})
    contests = df.groupBy("contest_id").agg(F.collect_list(F.struct("slot", "outcome_rank", "s0", "s1", "s2")).alias("slots"))
    points = simplex_grid(spark, 3, STEPS).agg(F.collect_list(F.struct("w0", "w1", "w2")).alias("points"))
    at = contests.join(F.broadcast(points)).withColumn("w", F.explode("points"))  # one row
    score = lambda c: F.round(F.col("w.w0") * c["s0"] + F.col("w.w1") * c["s1"] + F.col("w.w2") * c["s2"], 12)
    order = F.sort_array(F.transform("slots", lambda c: F.struct((-score(c)).alias("s"), c["slot"].alias("slot"), c["outcome_rank"].alias("rank"))))
    at = at.select("w", order.alias("o")).withColumn("won", F.array_position(F.transform("o", lambda c: c["rank"] == 1), F.lit(True)))
    three = F.size(F.filter(F.slice("o", 1, 3), lambda c: c["rank"] <= 3)) / 3
    loss = -F.ln(F.greatest(-F.element_at("o", F.col("won").cast("int"))["s"], F.lit(1e-15)))
    by_point = at.groupBy("w.w0", "w.w1", "w.w2").agg(F.avg((F.col("won") == 1).cast("double")).alias("hit1"), F.avg(three).alias("overlap"), F.avg(1 / F.col("won")).alias("mrr"), F.avg(loss).alias("log_loss"), F.avg(F.element_at("o", 1)["rank"]).alias("mean_rank"))
    value = lambda table: F.round(sum((w * F.col(c) for c, w in table.items()), F.lit(0.0)), 9)
    long = by_point.select("w0", "w1", "w2", F.inline(F.array(*[F.struct(F.lit(name).alias("objective"), value(table).alias("value")) for name, table in OBJECTIVES.items()])))
    best = F.struct(F.col("value").alias("v"), -F.col("w0"), -F.col("w1"), -F.col("w2"))
    return long.groupBy("objective").agg(F.max_by(F.struct("w0", "w1", "w2", "value"), best).alias("b")).select("objective", "b.w0", "b.w1", "b.w2", F.round("b.value", 6).alias("value"))


def simplex_grid(spark: SparkSession, n: int, steps: int, most: float = 1.0, least: float = 0.0) -> DataFrame:
    """Weight vectors w0.. of n parts in steps of 1/steps that add up to 1; parts over `most` or between 0 and `least` are left out."""
    grid = spark.range(1).select(F.lit(0).alias("used"))
    for i in range(n - 1):
        grid = grid.withColumn(f"k{i}", F.explode(F.sequence(F.lit(0), steps - F.col("used")))).withColumn("used", F.col("used") + F.col(f"k{i}"))
    grid = grid.withColumn(f"k{n - 1}", steps - F.col("used"))
    weights = [(F.col(f"k{i}") / steps).alias(f"w{i}") for i in range(n)]
    allowed = F.lit(True)
    for i in range(n):
        w = F.col(f"k{i}") / steps
        allowed = allowed & (w <= most) & ((w == 0) | (w >= least))
    return grid.where(allowed).select(weights)
