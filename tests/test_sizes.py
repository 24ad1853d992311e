"""Cases that show at larger tables only: long numbers, equal values, columns of many rows."""

import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.core import contest, shared
from rankweave.functions import numbers, text
from rankweave.operators import confidence, fitting, history, metrics, relative, scenario, search, tickets
from rankweave.plans import aligned_queries, catalog, evaluation_queries, hit_queries, scoring_queries, search_queries, ticket_queries
from rankweave.sources import reports
from rankweave.streaming import incremental


def test_calibrated_rows_do_not_carry_the_steps(spark):
    steps = fitting.Steps((0.1, 0.2, 0.2001, 0.7), (0.0, 0.3, 0.5, 0.9))
    df = spark.createDataFrame([(k // 4, x) for k, x in enumerate([0.0, 0.1, 0.15, 0.2, 0.20005, 0.7, 0.8, None])], "contest_id long, x double")
    out = fitting.calibrated(df, steps, "x", "y")
    assert "__xs" not in out._jdf.queryExecution().optimizedPlan().toString()
    one = spark.createDataFrame([(list(steps.x), list(steps.y))], "__xs array<double>, __ys array<double>")
    got = df.crossJoin(one).select("x", fitting.interpolated(F.col("x"), one).alias("old"), fitting.looked_up(F.col("x"), steps).alias("new")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got]
    assert [r["y"] for r in df.select(fitting.looked_up(F.col("x"), fitting.Steps((), ())).alias("y")).collect()][:2] == [0.0, 0.1]


def test_complete_contests_take_one_pass(spark):
    rows = [(1, s, s) for s in range(1, 7)] + [(2, s, min(s, 5)) for s in range(1, 7)] + [(3, s, s) for s in range(1, 8)] + [(4, s, s if s > 1 else None) for s in range(1, 7)] + [(None, s, s) for s in range(1, 7)]
    found = tickets.complete_groups(spark.createDataFrame(rows, "contest_id long, slot int, position int"), columns=("slot", "position"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan
    assert sorted((r["contest_id"], r["slot"]) for r in found.collect()) == [(1, s) for s in range(1, 7)]


def test_a_baseline_does_not_compute_the_points_again(spark):
    points = spark.createDataFrame([(w, 0.0, 4, 4, *[0.5] * 5, loss) for w, loss in ((0.5, 1.5), (1.0, 1.0))], "weight double, penalty double, contests long, covered long, hit1 double, hit3 double, hit5 double, hit12 double, mrr double, log_loss double")
    out = search.judged(points)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["weight"]: round(r["log_loss_delta"], 9) for r in out.collect()} == {0.5: 0.5, 1.0: 0.0}
    assert search.judged(points.where("weight < 1")).count() == 0


def test_blend_ranks_are_sums(spark):
    rows = [(1, a, b, c, p, q, 2, 1, 3, 0.3, 0.1) for a, b, c, p, q in ((1, 2, 3, 0.4, 0.2), (2, 1, 3, 0.3, 0.1), (1, 3, 2, 0.3, 0.1), (3, 2, 1, 0.1, 0.9))]
    df = spark.createDataFrame(rows, "contest_id long, a int, b int, c int, probability double, p double, won_a int, won_b int, won_c int, won_probability double, won_p double")
    out = search_queries.actual_ranks(df)
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["weight"]: (r["nth"], r["s"], r["x"]) for r in out.collect()}
    assert got[1.0] == (3, pytest.approx(1.1), pytest.approx(0.3)) and got[0.5] == (4, pytest.approx(1.2), pytest.approx(0.2))


RESULTS = "\n".join(["01KBGN", "S1［成績］", "   2024/ 1/ 2", ""] + [
    f"  {no}R       heat           H1800m  晴　  風  北　 1m  波　 2cm\n着順 艇 選手名 ﾚｰｽﾀｲﾑ 差し\n-----\n  01  1  {who}  name  5  6  0.10  1  0.05  1.41.5\n\n      ３連単   1-2-3   {paid}  人気  1\n" for no, who, paid in ((10, 4444, 100), (100, 12345, 700))
])


def test_long_numbers_of_entrants_and_contests_in_results(spark):
    lines = reports.lines(spark.createDataFrame([("f", RESULTS)], "file string, content string"))
    assert sorted((r["contest_no"], r["entity_id"], r["payout"]) for r in reports.results(lines).collect()) == [(10, 4444, 100.0), (100, 12345, 700.0)]
    assert sorted((r["contest_no"], r["payout"]) for r in reports.payouts(lines).collect()) == [(10, 100.0), (100, 700.0)]


PROGRAMME = "01BBGN\n 2024年1月2日\n  100R  heat  H1800m  電話投票締切予定時刻09:40\n-----\n番 号\n-----\n1 12345abc30XY46A1 5.00 4.00 0.40 0.50 7 20.04 9 30.04 12 F3  4"


def test_long_numbers_of_entrants_and_contests_in_programmes(spark):
    lines = reports.lines(spark.createDataFrame([("f", PROGRAMME)], "file string, content string"))
    assert [(r["contest_no"], r["entity_id"], r["entity_name"], r["age"]) for r in reports.entries(lines).collect()] == [(100, 12345, "abc", 30)]
    assert [(r["contest_no"], r["hour"], r["minute"]) for r in reports.schedule(lines).collect()] == [(100, 9, 40)]


def test_challenges_add_up_in_the_order_of_the_table(spark):
    names = ["rank", "top2", "k2", "k3", "k4", "lead_adv", "trial_adv", "machine_adv", "site2", "site3"]
    rows = [(int(k % 6 + 1), *map(float, r)) for k, r in enumerate(np.random.default_rng(3).random((200, 10)) / 2)]
    got = spark.createDataFrame(rows, "slot int, " + ", ".join(f"{n} double" for n in names)).select("*", scenario.challenge().alias("x")).collect()
    for r in got:
        x = 0.2 * r["rank"] + 0.16 * r["top2"] + 0.14 * r["k2"] + 0.22 * max(r["k3"], r["k4"]) + 0.08 * r["lead_adv"] + 0.05 * r["trial_adv"] + 0.04 * r["machine_adv"] + 0.07 * r["site2"] + 0.04 * r["site3"] + {2: 0.07, 3: 0.1, 4: 0.12, 5: 0.06, 6: 0.04}.get(r["slot"], 0)
        assert r["x"] == min(1.0, max(0.0, x))


def test_a_value_that_is_the_quantile_but_for_rounding_reaches_it(spark):
    names = ["attack", "collapse", "upset", "flat", "escape"]
    df = spark.createDataFrame([(0.5 - 1e-16, 0.0, 0.0, 0.0, 0.0)], ", ".join(f"{n} double" for n in names)).withColumns({f"{n}_q70": F.lit(0.5) for n in names}).withColumn("collapse_q50", F.lit(0.5))
    assert df.select(scenario.subset_label().alias("s")).head()["s"] == "attack_or_collapse"


def test_isotonic_losses_come_from_steps_in_ranges(spark, monkeypatch):
    from rankweave.plans import model_queries

    slots = [(k, s, s, (k * 7 + s * 3) % 11 / 11) for k in range(40) for s in range(1, 7)]
    df = spark.createDataFrame(slots, "contest_id long, slot int, outcome_rank int, share double")
    rows = df.select("contest_id", F.col("share").alias("probability"), (F.col("outcome_rank") == 1).alias("is_actual"))
    monkeypatch.setattr(model_queries, "ticket_frame", lambda *_: rows)
    fits = []
    monkeypatch.setattr(fitting, "fit_monotone", lambda *a, fit=fitting.fit_monotone, **k: fits.append(fit(*a, **k)) or fits[-1])
    got = model_queries.isotonic_fit(spark, "").collect()
    assert len(fits) == 1 and list(fits[0].y) == sorted(fits[0].y)
    assert {(r["held_out"], r["variant"]) for r in got} == {(h, v) for h in (True, False) for v in ("probability", "calibrated")}


def test_percentages_of_halves_are_those_of_the_sql(spark):
    won = [130232.5, 288027.5, 287092.5, 312837.5, 100.0]  # over 500; printf('%.1f%%', 100.0 * round(won / stake, 2)) in DuckDB
    df = spark.createDataFrame([(k, w) for k, w in enumerate(won)], "k int, won double")
    got = df.select("k", text.percent(numbers.round_scaled(F.col("won") / 500.0, 2)).alias("p")).orderBy("k").collect()
    assert [r["p"] for r in got] == ["26046.0%", "57605.0%", "57418.0%", "62567.0%", "20.0%"]


def test_windows_of_whole_numbers_run_on(spark):
    """Means of whole numbers come from running sums: a frame of 200 rows isn't read again for each row; blocks take one shuffle, also behind a day of many rows."""
    days = [1] * 3 + [2] * 150 + [3] + [4] * 2 + [5] * 90 + [6, 7, 8] * 20
    rows = [(i % 2, date(2024, 1, d), i, i * 7 % 5 if i % 11 else None) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "k int, race_date date, id int, x int")
    features = [history.Feature("m", "x", 20, 3), history.Feature("s", "x", 7, 1, "sum"), history.Feature("hi", "x", 5, 2, "max")]
    plain = history.rolling_history(df, ["k"], ["race_date", "id"], features[:2])
    assert "specifiedwindowframe(RowFrame, -20, -1)" not in plain._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k in (0, 1):
        xs = []
        for _, d, i, x in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            last = lambda n: [v for v in xs[-n:] if v is not None]  # noqa: E731, B023
            want[i] = (sum(last(20)) / len(last(20)) if len(last(20)) >= 3 else None, sum(last(7)) if last(7) else None, max(last(5)) if len(last(5)) >= 2 else None)
            xs.append(x)
    for block in (None, 10, 40):
        out = history.rolling_history(df, ["k"], ["race_date", "id"], features, block=block)
        assert {r["id"]: (r["m"], r["s"], r["hi"]) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number") == 0


def test_labels_and_fact_of_tickets_take_one_aggregate(spark):
    slots = [(k, s, (s + k) % 6 + 1, (k * 5 + s * 3) % 11 + 1.0) for k in range(12) for s in range(1, 7)]
    df = spark.createDataFrame(slots, "contest_id long, slot int, outcome_rank int, share double").withColumn("total", F.sum("share").over(relative.group()))
    found = tickets.permutations(df, ["share", "outcome_rank"], keep=["total"])
    actual = (F.col("outcome_rank_a") == 1) & (F.col("outcome_rank_b") == 2) & (F.col("outcome_rank_c") == 3)
    rows = found.withColumns({"probability": F.round(tickets.draw_probability("share"), 12), "is_actual": actual, "payout": F.lit(1500.0)}).drop("total")
    out = confidence.labelled_fact(rows, ("payout",), first=True)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    first = confidence.first_slot_confidence(rows)
    assert "Join" not in plan(out) and plan(out).count("Generate explode") == 3 and "Join" not in plan(first)
    three = confidence.top3_confidence(rows).select("contest_id", F.col("top3_score").alias("score"), F.col("top3_label").alias("label"))
    want = metrics.contest_fact(rows).join(three, "contest_id").join(first.select("contest_id", "first_label"), "contest_id")
    columns = sorted(want.columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    # the marginals of a contest, added up slot by slot
    mass = {}
    for r in rows.where("contest_id = 3").collect():
        mass[r["a"]] = mass.get(r["a"], 0.0) + r["probability"]
    total = sum(mass.values())
    best = sorted(((-round(m / total, 12), a) for a, m in mass.items()))[:2]
    got = first.where("contest_id = 3").head()
    assert got["first_slot"] == best[0][1] and got["first_probability"] == pytest.approx(-best[0][0]) and got["first_gap"] == pytest.approx(best[1][0] - best[0][0])


def test_families_of_a_build_share_a_shuffle():
    few = incremental.Family(("place",), (), 8)
    families = [incremental.Family(k, ()) for k in (("who",), ("place", "who"), ("other",))]
    assert incremental.Build(None, "f", [*families, few], ["day"])._shared() == [("who", [0, 1]), ("other", [2])]


def test_large_tables_get_parts_by_their_rows(spark, monkeypatch):
    df = spark.range(100).withColumnRenamed("id", "k")
    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    assert shared.spread(df, 40, "k") is df  # the session has four partitions
    assert shared.spread(df, 100, "k").rdd.getNumPartitions() == 10


def test_the_frame_of_a_day_holds_values_and_not_days(spark):
    """With many values a day a frame of as many days as the window would gather the window's square."""
    rows = [(1, date(2024, 1, 1) + timedelta(days=d), i, float(d * 20 + i)) for d in range(40) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, day date, id int, x double")
    features = [history.Recent("m", "x", 15)]
    asked = spark.createDataFrame([(1, date(2024, 2, 5))], "k int, day date")
    found = history.asof_recent(asked, df, ["k"], "day", ["day", "id"], features)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" not in plan
    assert found.head()["m"] == sum(range(35 * 20 - 15, 35 * 20)) / 15
    near = history.reachable(df, date(2024, 2, 5), ["k"], "day", features)
    assert near.where("day < date'2024-02-05'").agg(F.min("day"), F.count("*")).head() == (date(2024, 2, 4), 20)
    assert history.asof_recent(asked, near, ["k"], "day", ["day", "id"], features, shared=["k"], rows=800).head()["m"] == found.head()["m"]


def test_a_ticket_text_is_parsed_without_functions_over_arrays(spark):
    texts = spark.createDataFrame([("1-2-3",), ("t1-2-3",), ("1-2",), ("1-2-3-4",), ("1--3",), (None,)], "x string")
    found = texts.select("x", tickets.parse_ticket("x").alias("t"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r["t"]) if r["t"] else None for r in found.collect()] == [(1, 2, 3), None, None, None, None, None]


def test_average_ranks_sort_once(spark):
    df = spark.createDataFrame([(1, x) for x in (0.3, 0.1, 0.3, None, 0.2)] + [(2, 0.0), (2, -0.0)], "contest_id long, x double")
    found = df.withColumn("r", relative.rank_average("x", ascending=False))
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r["contest_id"], r["x"], r["r"]) for r in found.where("x is not null").collect()) == [(1, 0.1, 4.0), (1, 0.2, 3.0), (1, 0.3, 1.5), (1, 0.3, 1.5), (2, 0.0, 1.5), (2, 0.0, 1.5)]


@pytest.mark.parametrize("name", ["position_overrides", "lead_deltas", "evaluation_context"])
def test_the_view_is_computed_once(spark, monkeypatch, name):
    calls = []
    view = contest.contest_view
    for module in (aligned_queries, evaluation_queries, ticket_queries):
        monkeypatch.setattr(module, "contest_view", lambda *a: calls.append(a) or view(*a))
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and ("lineitem" not in plan if name != "evaluation_context" else "Join LeftSemi" not in plan)


def test_ranked_tickets_are_written_once_for_all_windows(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(confidence, "stored", lambda df, name: calls.append(name) or shared.stored(df, name))
    rows = [(k, date(2024, 1, 1 + k), a, 1, 1, 0.1 * a, a == 4) for k in range(10) for a in range(1, 5)]
    df = spark.createDataFrame(rows, "contest_id long, race_date date, a int, b int, c int, probability double, is_actual boolean")
    got = {r["days"]: r["contests"] for r in confidence.window_search(df, (5, 10), 0.6).collect()}
    assert calls == ["ranked"] and got == {5: 2, 10: 4}


def test_facts_of_two_probabilities_stand_side_by_side(spark):
    rows = [(k, a, 1, 1, 0.1 * a, 0.5 - 0.1 * a + 0.01 * k, a == k % 5, k % 2 == 0) for k in range(9) for a in range(1, 5)]
    df = spark.createDataFrame(rows, "contest_id long, a int, b int, c int, p double, q double, is_actual boolean, even boolean")
    both = metrics.contest_facts(df, {"x": "p", "y": "q"}, ["even"])
    columns = ["variant", *metrics.contest_fact(df, "p", ["even"]).columns]
    columns[columns.index("brier")] = F.round("brier", 12)
    one = lambda v, p: metrics.contest_fact(df, p, ["even"]).withColumn("variant", F.lit(v)).select(columns)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, both.select(columns).collect()), key=key) == sorted(map(tuple, one("x", "p").unionByName(one("y", "q")).collect()), key=key)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_scenario_slots_are_computed_once(spark, monkeypatch):
    calls, view = [], contest.contest_view
    monkeypatch.setattr(ticket_queries, "contest_view", lambda *a: calls.append(a) or view(*a))
    catalog.QUERIES["scenario_model"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_values_of_slots_and_pairs_are_rounded_before_the_expansion(spark):
    plan = catalog.QUERIES["ticket_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.expressions().toString().count("round(") <= 4  # the means


def test_places_with_one_target_share_a_fit(spark, monkeypatch):
    fits, learner = [], scoring_queries.LogisticRegression
    monkeypatch.setattr(scoring_queries, "LogisticRegression", lambda **k: fits.append(k) or learner(**k))
    df = catalog.QUERIES["slot_probabilities"](spark, "/root/testdata/sf0.001")
    assert len(fits) == 5
    assert {"p_win", "p_place1"} <= set(df.columns)


def test_odds_are_joined_by_contest(spark):
    rows = [(k, a, b, 3) for k in (1, 2) for a in (1, 2) for b in (4, 5)]
    df = spark.createDataFrame(rows, "contest_id long, a int, b int, c int")
    odds = spark.createDataFrame([(1, 1, 4, 3, 2.5), (1, 2, 5, 3, None), (2, 1, 5, 3, 7.0), (3, 1, 4, 3, 9.0), (2, 2, None, 3, 1.0)], "contest_id long, a int, b int, c int, paid double")
    found = tickets.with_odds(df, odds)
    assert "Join LeftOuter, (contest_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[:4]: r["odds"] for r in found.collect()} == {**dict.fromkeys(rows), (1, 1, 4, 3): 2.5, (2, 1, 5, 3): 7.0}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        tickets.with_odds(df, odds.unionAll(odds)).collect()


PLACES = [(("place",), [history.Feature("mean6", "x", 6, 3), history.Feature("wins4", "n", 4, 1, "sum")]), (("machine",), [history.Feature("low9", "x", 9, 2, "min"), history.Feature("mean9", "n", 9, 1)])]


def results_of_few_keys(spark):
    rng = np.random.default_rng(5)
    place = lambda i: None if i % 11 == 0 else "rare" if i % 37 == 0 else "ab"[i % 2]
    rows = [(date(2024, 1, 1) + timedelta(days=i // 5), i, place(i), i % 3, int(rng.integers(4)), float(rng.random()) if i % 7 else None) for i in range(300)]
    return spark.createDataFrame(rows, "day date, nth int, place string, machine int, n int, x double").repartition(3)


@pytest.mark.parametrize("block", [25, 4, 1000])
def test_families_of_few_keys_share_one_shuffle(spark, block):
    df = results_of_few_keys(spark)
    found, want = history.rolling_together(df, PLACES, ["day", "nth"], block), df
    for keys, features in PLACES:
        want = history.rolling_history(want, keys, ["day", "nth"], features)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert block != 25 or plan.count("Exchange hashpartitioning(__block") == 1  # the others have a day of more rows, or one block
    assert sorted(found.select("nth", "mean6", "wins4", "low9", "mean9").collect()) == sorted(want.select("nth", "mean6", "wins4", "low9", "mean9").collect())


def test_a_row_is_carried_once_for_all_families(spark, tmp_path):
    df = results_of_few_keys(spark)
    families = [incremental.Family(("machine",), (history.Feature("mean5", "x", 5, 1),)), incremental.Family(("machine", "place"), (history.Feature("low7", "x", 7, 1, "min"),)), *[incremental.Family(k, tuple(fs), 10) for k, fs in PLACES]]
    build = incremental.Build(spark, f"file://{tmp_path}/build", families, ["day", "nth"], counted="before")
    for first, last in ((0, 90), (90, 100), (100, 300)):
        build.advance(df.where(f"nth >= {first} and nth < {last}"))
    rows, state = (spark.read.parquet(f"{tmp_path}/build/{kind}/version=1") for kind in ("rows", "state"))
    older = rows.where("__older")
    assert older.count() > 0 and older.where("nth >= 90").count() == 0
    for part in (rows, state):
        assert part.count() == part.select("nth").distinct().count()
    assert build.rows().count() == 300 and build.rows().columns.count("__older") == 0
    want = df
    for f in families:
        want = history.rolling_history(want, f.keys, ["day", "nth"], f.features)
    want = want.withColumn("before", history.prior_count(["machine"], ["day", "nth"]))
    names = ["nth", "before", "mean5", "low7", "mean6", "wins4", "low9", "mean9"]
    near = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-12)
    for a, b in zip(sorted(build.rows().select(*names).collect()), sorted(want.select(*names).collect()), strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_blocks_of_a_key_get_parts_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    df, (keys, features) = results_of_few_keys(spark), PLACES[0]
    found = history.rolling_history(df, keys, ["day", "nth"], features, block=40)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    want = history.rolling_history(df, keys, ["day", "nth"], features)
    assert sorted(found.select("nth", "mean6", "wins4").collect()) == sorted(want.select("nth", "mean6", "wins4").collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the generated tables are not here")
def test_rows_of_the_favourite_compute_the_view_once(spark):
    rows = hit_queries.favourite_inputs(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Join" not in plan
    assert rows.count() == rows.select("contest_id").distinct().count() > 0
