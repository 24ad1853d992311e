"""Queries over rolling and recent history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.operators import relative
from rankweave.operators.history import Feature, Recent, asof_last_n, prior_count, recent_tail, rolling_history, tail_rows
from rankweave.plans.registry import on_view, query

ORDER = ["race_date", "contest_no", "slot"]
KEY = ["contest_id", "slot"]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with the targets: target_rank, is_win, is_top2, is_top3."""
    return with_targets(contest_view(spark, sf_dir))


def with_targets(df: DataFrame) -> DataFrame:
    rank = F.col("outcome_rank")
    flags = {"is_win": rank == 1, "is_top2": rank <= 2, "is_top3": rank <= 3}
    return df.withColumns({"target_rank": 7 - rank, **{k: c.cast("int") for k, c in flags.items()}})


def rounded(df: DataFrame, *columns: str, keep: list[str] = KEY) -> DataFrame:
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in columns])


def guarded(how: str, x: str, key: str, n: int, least: int) -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY race_date, contest_no, slot ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {how}({x}) {over} END"


F_SQL = "SELECT *, 7 - outcome_rank AS target_rank, CAST(outcome_rank = 1 AS INT) AS is_win, CAST(outcome_rank <= 2 AS INT) AS is_top2, CAST(outcome_rank <= 3 AS INT) AS is_top3 FROM v"


@query(on_view(f"SELECT contest_id, slot, round(form, 9) AS form, CASE WHEN form IS NOT NULL THEN rank() OVER (PARTITION BY contest_id ORDER BY form NULLS LAST) END AS form_rank FROM h", h=f"SELECT contest_id, slot, round({guarded('avg', 'outcome_rank', 'entity_id', 30, 3)}, 9) AS form FROM v"))
def rolling_form_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean outcome of an entity's 30 rows before, ranked in the contest."""
    h = rolling_history(contest_view(spark, sf_dir), ["entity_id"], ORDER, [Feature("form", "outcome_rank", 30, 3)])
    h = h.withColumn("form", F.round("form", 9))
    return h.select(*KEY, F.round("form", 9).alias("form"), relative.rank_min("form", ascending=True).alias("form_rank"))


ENTITY = [
    Feature("win", "is_win", 30, 3), Feature("top3", "is_top3", 30, 3), Feature("rank30", "outcome_rank", 30, 3),
    Feature("lead30", "lead_time", 30, 3), Feature("trial30", "trial_time", 30, 3), Feature("win5", "is_win", 5, 2),
    Feature("top3_5", "is_top3", 5, 2), Feature("rank5", "outcome_rank", 5, 2), Feature("rank10", "outcome_rank", 10, 3),
    Feature("lead5", "lead_time", 5, 2), Feature("lead10", "lead_time", 10, 3), Feature("lead_std10", "lead_time", 10, 3, "std"),
    Feature("lead_best5", "lead_time", 5, 2, "min"), Feature("lead_best10", "lead_time", 10, 3, "min"), Feature("lead_best30", "lead_time", 30, 3, "min"),
    Feature("lead_worst5", "lead_time", 5, 2, "max"), Feature("lead_worst10", "lead_time", 10, 3, "max"), Feature("lead_worst30", "lead_time", 30, 3, "max"),
    Feature("best_rank5", "outcome_rank", 5, 2, "min"), Feature("worst_rank5", "outcome_rank", 5, 2, "max"),
]
SQL_HOW = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def _feature_sql(features: list[Feature], key: str) -> str:
    return ", ".join(f"round({guarded(SQL_HOW[f.how], f.source, key, f.window, f.least)}, 9) AS {f.out}" for f in features)


@query(on_view(f"SELECT contest_id, slot, {_feature_sql(ENTITY, 'entity_id')} FROM t", t=F_SQL))
def history_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rolling features of the entity from one sorted window."""
    return rounded(rolling_history(flagged(spark, sf_dir), ["entity_id"], ORDER, ENTITY), *[f.out for f in ENTITY])


FAMILIES = {
    ("entity_id", "site"): [Feature("site_win", "is_win", 15, 2), Feature("site_top3", "is_top3", 15, 2)],
    ("entity_id", "slot"): [Feature("slot_win", "is_win", 15, 2), Feature("slot_top3", "is_top3", 15, 2), Feature("slot_lead", "lead_time", 15, 2), Feature("slot_rank", "outcome_rank", 15, 2)],
    ("entity_id", "site", "slot"): [Feature("site_slot_top3", "is_top3", 10, 2), Feature("site_slot_lead", "lead_time", 10, 2)],
    ("entity_id", "position"): [Feature("position_top3", "is_top3", 10, 2), Feature("position_rank", "outcome_rank", 10, 2)],
    ("machine_a",): [Feature("a_top3", "is_top3", 40, 5), Feature("a_win", "is_win", 40, 5), Feature("a_lead", "lead_time", 40, 5)],
    ("machine_b",): [Feature("b_top3", "is_top3", 40, 5), Feature("b_win", "is_win", 40, 5), Feature("b_lead", "lead_time", 40, 5)],
}
BLOCK = 50_000  # rows of a key with very many rows that one task sorts
CROWDED = {
    ("site", "position"): [Feature("place_win", "is_win", 200, 30), Feature("place_top2", "is_top2", 200, 30), Feature("place_top3", "is_top3", 200, 30), Feature("place_rank", "outcome_rank", 200, 30)],
    ("site", "slot"): [Feature("site_slot_win200", "is_win", 200, 30), Feature("site_slot_top2", "is_top2", 200, 30), Feature("site_slot_top3_200", "is_top3", 200, 30), Feature("site_slot_rank", "outcome_rank", 200, 30)],
}


def _families_sql(families: dict) -> str:
    return on_view("SELECT contest_id, slot, " + ", ".join(_feature_sql(fs, ", ".join(key)) for key, fs in families.items()) + " FROM t", t=F_SQL)


@query(_families_sql(FAMILIES))
def history_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling features by entity and place and by machine, in time order; the few machines are cut into blocks."""
    view = flagged(spark, sf_dir)
    df = view.repartition("entity_id")  # one shuffle for all families of an entity
    for key, features in FAMILIES.items():
        few = key in (("machine_a",), ("machine_b",))
        df = rolling_history(df, key, ORDER, features, block=BLOCK if few else None, count_on=view if few else None)
    return rounded(df, *[f.out for fs in FAMILIES.values() for f in fs])


@query(_families_sql(CROWDED))
def history_crowded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 rows over a few keys with very many rows each, cut into blocks that lend their ends."""
    df = view = flagged(spark, sf_dir)
    for key, features in CROWDED.items():
        df = rolling_history(df, key, ORDER, features, block=BLOCK, count_on=view)
    return rounded(df, *[f.out for fs in CROWDED.values() for f in fs])


@query(on_view(f"SELECT contest_id, slot, round({guarded('avg', 'lead_time', 'entity_id', 5, 2)} - {guarded('avg', 'lead_time', 'entity_id', 10, 3)}, 9) AS lead_momentum, round({guarded('avg', 'outcome_rank', 'entity_id', 10, 3)} - {guarded('avg', 'outcome_rank', 'entity_id', 5, 2)}, 9) AS rank_momentum, row_number() OVER (PARTITION BY entity_id ORDER BY race_date, contest_no, slot) - 1 AS starts_before FROM v"))
def history_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short against long form, and the number of starts before."""
    chosen = [f for f in ENTITY if f.out in ("lead5", "lead10", "rank5", "rank10")]
    df = rolling_history(contest_view(spark, sf_dir), ["entity_id"], ORDER, chosen).withColumn("starts_before", prior_count(["entity_id"], ORDER))
    return df.select(*KEY, F.round(F.col("lead5") - F.col("lead10"), 9).alias("lead_momentum"), F.round(F.col("rank10") - F.col("rank5"), 9).alias("rank_momentum"), "starts_before")


RECENT = [Recent("lead15", "lead_time", 15), Recent("trial15", "trial_time", 15), Recent("trial_min5", "trial_time", 5, "min"), Recent("trial_max5", "trial_time", 5, "max"), Recent("lead_std10", "lead_time", 10, "std"), Recent("rank30", "outcome_rank", 30)]


def _recent_sql(key: str, features: list[Recent]) -> str:
    nth = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN count({s}) OVER (PARTITION BY {key} ORDER BY race_date DESC, contest_no DESC, slot DESC ROWS UNBOUNDED PRECEDING) END AS n_{s}" for s in dict.fromkeys(f.source for f in features))
    out = ", ".join(f"round({SQL_HOW[f.how]}(CASE WHEN n_{f.source} <= {f.window} THEN {f.source} END), 9) AS {f.out}" for f in features)
    return on_view(f"SELECT {key}, {out} FROM r GROUP BY {key}", r=f"SELECT *, {nth} FROM v")


@query(_recent_sql("entity_id, site", RECENT))
def recent_tail_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of the last values of an entity at a site, nulls left out before counting."""
    out = recent_tail(contest_view(spark, sf_dir), ["entity_id", "site"], ORDER, RECENT)
    return rounded(out, *[f.out for f in RECENT], keep=["entity_id", "site"])


@query(on_view("""
SELECT q.contest_id, q.slot, round(avg(n.lead_time), 9) AS lead15_before
FROM v AS q
LEFT JOIN d ON d.entity_id = q.entity_id AND d.race_date = q.race_date
LEFT JOIN n ON n.entity_id = q.entity_id AND n.nth <= d.earlier AND n.nth > d.earlier - 15
GROUP BY q.contest_id, q.slot
""", n="SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY race_date, contest_no, slot) AS nth FROM v", d="SELECT entity_id, race_date, min(nth) - 1 AS earlier FROM n GROUP BY entity_id, race_date"))
def asof_last_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of an entity's last 15 values on strictly earlier days."""
    v = contest_view(spark, sf_dir)
    out = asof_last_n(v, v, "entity_id", "race_date", ORDER, "lead_time", 15, "lead15_before")
    return rounded(out, "lead15_before")


@query(on_view("SELECT entity_id, contest_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY race_date DESC, contest_no DESC, slot DESC) AS n FROM v) WHERE n <= 30"))
def carry_over_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 rows of each entity, as a state to carry over."""
    return tail_rows(contest_view(spark, sf_dir), ["entity_id"], ORDER, 30).select("entity_id", *KEY)
