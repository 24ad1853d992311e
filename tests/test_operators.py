"""Invariants on literal rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from rankweave.core import schemas
from rankweave.functions import dates, text
from rankweave.operators import confidence, metrics, prediction, relative, sampling, search, statistics, tickets
from rankweave.operators.history import Feature, Recent, asof_last_n, recent_tail, rolling_history
from rankweave.sources import reports, tables

SLOTS = [(1, s, r, p) for s, r, p in zip(range(1, 7), (2, 1, 3, 4, 6, 5), (0.3, 0.25, 0.2, 0.1, 0.1, 0.05))]


def ticket_frame(spark):
    df = spark.createDataFrame(SLOTS, "contest_id long, slot int, outcome_rank int, share double").withColumn("total", F.lit(1.0))
    found = tickets.permutations(df, ["share", "outcome_rank"], keep=["total"])
    actual = (F.col("outcome_rank_a") == 1) & (F.col("outcome_rank_b") == 2) & (F.col("outcome_rank_c") == 3)
    return found.withColumns({"probability": tickets.draw_probability("share"), "is_actual": actual, "payout": F.lit(1500.0)})


def test_six_slots_make_120_tickets_that_add_up_to_1(spark):
    t = ticket_frame(spark)
    row = t.agg(F.count("*").alias("n"), F.sum("probability").alias("p"), F.count_distinct("a", "b", "c").alias("d")).head()
    assert (row["n"], row["d"]) == (120, 120) and row["p"] == pytest.approx(1)


def test_history_leaves_out_the_row_itself(spark):
    styles, ranks = ["k1", "k1", "k2", "k3", "k1", "k4"], [1, 1, 1, 1, 2, 1]
    rows = [(1, i, s, r) for i, (s, r) in enumerate(zip(styles, ranks))]
    df = spark.createDataFrame(rows, "entity_id long, day int, style string, outcome_rank int")
    df = df.withColumns({k: ((F.col("style") == k) & (F.col("outcome_rank") == 1)).cast("int") for k in ("k1", "k2", "k3", "k4")})
    last = rolling_history(df, ["entity_id"], ["day"], [Feature(f"{k}_rate", k, 30, 3) for k in ("k1", "k2", "k3", "k4")]).where("day = 5").head()
    assert [last[f"k{i}_rate"] for i in range(1, 5)] == [0.4, 0.2, 0.2, 0.0]


@pytest.mark.parametrize("block", [7, 50])
def test_blocks_give_the_plain_windows(spark, block):
    rows = [(i % 2, date(2024, 1 + i % 12, 1 + i % 28), i, float(i % 5) if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, race_date date, id int, x double")
    features = [Feature("m", "x", 6, 2), Feature("hi", "x", 3, 1, "max")]
    order = ["race_date", "id"]
    got = lambda **kw: sorted(map(tuple, rolling_history(df, ["k"], order, features, **kw).select("id", "m", "hi").collect()))
    assert got() == got(block=block)


def test_last_values_by_day(spark):
    h = spark.createDataFrame([(1, date(2024, 1, d), d, float(d) if d != 3 else None) for d in (1, 2, 3, 4, 4, 6)], "k int, day date, id int, x double").withColumn("id", F.monotonically_increasing_id())
    q = spark.createDataFrame([(1, date(2024, 1, d)) for d in (1, 4, 6, 9)] + [(2, date(2024, 1, 5))], "k int, day date")
    got = {(r["k"], r["day"].day): r["m"] for r in asof_last_n(q, h, "k", "day", ["day", "id"], "x", 2, "m").collect()}
    assert got == {(1, 1): None, (1, 4): 1.5, (1, 6): 4.0, (1, 9): 5.0, (2, 5): None}
    tail = recent_tail(h, ["k"], ["day", "id"], [Recent("a", "x", 3), Recent("s", "x", 2, "std")]).head()
    assert tail["a"] == pytest.approx(14 / 3) and tail["s"] == pytest.approx(2**0.5)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    t = ticket_frame(spark).withColumn("probability", F.lit(1 / 120))
    first = lambda df: [tuple(r) for r in tickets.top_tickets(df, 3).orderBy("nth").select("a", "b", "c").collect()]
    assert first(t) == first(t.orderBy(F.rand(3))) == [(1, 2, 3), (1, 2, 4), (1, 2, 5)]


def test_a_clear_contest_has_high_confidence(spark):
    p = [0.30] + [0.04] * 11 + [0.002] * 108
    order = ticket_frame(spark).select("contest_id", "a", "b", "c").orderBy("a", "b", "c").collect()
    df = spark.createDataFrame([(*r, x) for r, x in zip(order, p, strict=True)], "contest_id long, a int, b int, c int, probability double")
    assert confidence.top12_confidence(df).head()["top12_label"] == "high"


def test_incomplete_and_bad_contests_are_left_out(spark):
    rows = [(1, s, s, s, None) for s in range(1, 7)] + [(2, s, s, s, None) for s in range(1, 6)] + [(3, s, s, 6, None) for s in range(1, 7)] + [(4, s, s, s, "F" if s == 2 else None) for s in range(1, 7)]
    df = spark.createDataFrame(rows, "contest_id long, slot int, position int, outcome_rank int, status string")
    kept = tickets.complete_groups(df, bad=text.flagged(F.col("status")))
    assert {r["contest_id"] for r in kept.collect()} == {1}


def test_metrics_of_one_contest(spark):
    fact = metrics.contest_fact(ticket_frame(spark))
    row = fact.agg(*metrics.quality()).head()
    assert row["contests"] == row["covered"] == 1 and row["hit1"] == 0 and row["hit3"] == 1
    top3 = metrics.strategies(fact).where("strategy = 'top3'").groupBy("strategy").agg(*metrics.recovery()).head()
    assert top3["total_stake"] == 300 and top3["total_return"] == 1500


def test_splits_keep_contests_whole_and_blocks_keep_days(spark):
    df = spark.createDataFrame([(c, date(2024, 1, 1 + c % 20), s) for c in range(200) for s in range(3)], "contest_id long, race_date date, slot int")
    for out, column in ((sampling.exact_split(df, 0.25, "x"), "is_valid"), (sampling.random_split(df, 0.25, "x"), "is_valid"), (sampling.chronological_blocks(df, 3), "block")):
        assert out.count() == 600 and out.groupBy("contest_id").agg(F.count_distinct(column).alias("n")).where("n > 1").count() == 0
    assert sampling.exact_split(df, 0.25, "x").where("is_valid").count() == 150
    assert sampling.even_sample(df, 10).select("contest_id").distinct().count() == 10
    sizes = [r["n"] for r in sampling.chronological_blocks(df, 3).groupBy("block").agg(F.count_distinct("race_date").alias("n")).orderBy("block").collect()]
    assert sizes == [7, 7, 6]


def test_table_diff_and_unique_keys(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 2.0, "z")], "k int, x double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, None, "w"), (4, 2.0, "z")], "k int, x double, s string")
    got = {r["column"]: (r["only_left"], r["only_right"], r["different"]) for r in statistics.table_diff(a, b, ["k"], ["x", "s"], 1e-12).collect()}
    assert got == {"x": (1, 1, 0), "s": (1, 1, 1)}
    with pytest.raises(ValueError, match="unique"):
        tables.join_one_to_one(a.unionAll(a), b, ["k"])


def test_an_empty_column_keeps_its_type(spark, tmp_path):
    path = str(tmp_path / "results")
    for day in (date(2024, 1, 5), date(2024, 2, 5)):
        df = spark.createDataFrame([("a", day, None)], "contest_id string, race_date date, style string")
        tables.append(df, path, schemas.RESULT, month_of="race_date")
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["style"] == "string" and back.where("month = '202402'").count() == 1
    assert tables.read_between(spark, path, date(2024, 2, 1), date(2024, 2, 9), ["contest_id"]).count() == 1


REPORT = """
STARTK
07KBGN
北　浜［成績］     11/ 3

   第 4日          2031/11/ 3                             ボートレース北　浜

   5R       特選　　　　                 H1200m  雨　  風  南　　 7m  波　  4cm
  着 艇 登番 　選　手　名　　ﾓｰﾀｰ ﾎﾞｰﾄ 展示 進入 ｽﾀｰﾄﾀｲﾐﾝｸ ﾚｰｽﾀｲﾑ まくり差し
---------------------------------------
  01  3 1007 青　木　　一 8   9  7.01   2    0.05     2.03.25
  02  1 1008 白　川　二　葉 61  5  6.66   1    0.31     2.04.0
  L1  6 1009 黒　田　三 77  70  .   6   L .
        ３連単   3-1-5       980  人気     2

   6R       特選　　　　                 H1200m  雨　  風  無風　 0m  波　  0cm
---------------------------------------
        ３連単   6-5-4    100400  人気   119
"""


def test_report_lines(spark):
    rows = reports.lines(spark.createDataFrame([("K311103.TXT", REPORT)], "file string, content string"))
    paid = [tuple(r) for r in reports.payouts(rows).select("contest_id", "ticket", "payout").orderBy("contest_id").collect()]
    assert paid == [("2031-11-03_07_05", "3-1-5", 980.0), ("2031-11-03_07_06", "6-5-4", 100400.0)]
    by_slot = {r["slot"]: r for r in reports.results(rows).collect()}
    assert sorted(by_slot) == [1, 3, 6]
    first, flagged = by_slot[3], by_slot[6]
    assert (first["outcome_rank"], first["entity_id"], first["entity_name"], first["machine_a"], first["machine_b"], first["trial_time"]) == (1, 1007, "青木一", 8, 9, 7.01)
    assert (first["position"], first["lead_time"], first["clock"], first["payout"], first["style"]) == (2, 0.05, pytest.approx(123.25), 980.0, "まくり差し")
    assert (first["weather"], first["wind_direction"], first["wind_speed"], first["wave"]) == ("雨", "南", 7, 4)
    assert (flagged["outcome_rank"], flagged["outcome_status"], flagged["trial_time"], flagged["position"], flagged["entity_name"]) == (6, "L1", None, 6, "黒田三")


def test_programme_lines(spark):
    content = "07BBGN\n 第 4日 2031年11月 3日\n  ５Ｒ  特選　Ｈ１２００ｍ\n-----\n番 号\n-----\n" + "1 1007青木　　一37北浜52A1 6.54 43.2112.30 77.88 8 33.33 9 45.60 12 F3  4\n2 1008白川二葉24南53B2 0.00  0.00 0.00  0.00 61 20.10 5 19.99\nnot an entrant\n"
    rows = reports.lines(spark.createDataFrame([("B311103.TXT", content)], "file string, content string"))
    a, b = reports.entries(rows).orderBy("slot").collect()
    assert (a["contest_id"], a["slot"], a["entity_id"], a["entity_name"], a["age"], a["weight"], a["grade"]) == ("2031-11-03_07_05", 1, 1007, "青木一", 37, 52.0, "A1")
    assert (a["win_rate"], a["place_rate"], a["site_win_rate"], a["site_place_rate"], a["machine_a"], a["machine_a_rate"], a["machine_b"], a["machine_b_rate"], a["meet_results"]) == (6.54, 43.21, 12.3, 77.88, 8, 33.33, 9, 45.6, "12 F3")
    assert (b["entity_name"], b["age"], b["grade"], b["machine_a"], b["machine_b_rate"], b["meet_results"]) == ("白川二葉", 24, "B2", 61, 19.99, None)


def test_deadlines(spark):
    content = "15BBGN\n  １Ｒ  予　選　　　          Ｈ１８００ｍ  電話投票締切予定時刻１０：５７ 連複\n24BBGN\n  １Ｒ  朝１戦　　　          Ｈ１８００ｍ  電話投票締切予定０８：３２ "
    rows = reports.lines(spark.createDataFrame([("B", content)], "file string, content string"))
    assert sorted(map(tuple, reports.schedule(rows).drop("file").collect())) == [("15", 1, 10, 57), ("24", 1, 8, 32)]


def test_text_and_dates(spark):
    df = spark.createDataFrame([("x/K990131.TXT", " a　 b ", "1.49.5", "F3 12")], "name string, words string, clock string, meet string")
    meet = text.meet_features(F.col("meet"))
    row = df.select(dates.file_date(F.col("name")).alias("day"), text.collapse(F.col("words")).alias("words"), text.clock_seconds(F.col("clock")).alias("s"), meet["meet_starts"].alias("n"), meet["meet_last"].alias("last"), meet["meet_f"].alias("f"), meet["meet_mean2"].alias("m2")).head()
    assert tuple(row) == (date(1999, 1, 31), "a b", pytest.approx(109.5), 3, 2, 1, 1.5)
    assert text.parse_overrides("213456")[1] == 2 and text.parse_overrides("1=2,2=1") == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        text.parse_overrides("113456")


def test_nulls_and_zero_denominators(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, 3.0), (3, 0.0), (3, 0.0)], "contest_id int, x double")
    out = df.select("contest_id", relative.rank_min("x").alias("r"), relative.zscore("x").alias("z"), relative.minmax("x").alias("m"), relative.normalise("x").alias("n")).distinct().orderBy("contest_id").collect()
    assert [tuple(r) for r in out] == [(1, None, None, 0.0, 0.5), (2, 1, None, 0.0, 0.5), (3, 1, None, 0.0, 0.5)]


def test_gaps_reach_from_the_first_to_the_last_day(spark):
    days = [date(1996, 12, 30), date(1997, 1, 2)]
    df = spark.createDataFrame([(d,) for d in days], "race_date date")
    wanted = tables.calendar_over(df, ("a", "b"))
    present = spark.createDataFrame([(days[0], "a"), (days[1], "a"), (days[1], "b")], "day date, kind string")
    missing = {(r["day"].isoformat(), r["kind"]) for r in tables.gaps(wanted, present).collect()}
    assert missing == {("1996-12-30", "b"), ("1996-12-31", "a"), ("1996-12-31", "b"), ("1997-01-01", "a"), ("1997-01-01", "b")}
    assert {r["status"]: r["n"] for r in tables.gap_report(wanted, present).collect()} == {"missing": 5, "present": 3}
    assert tables.calendar_over(df.limit(0), ("a",)).collect() == []


def test_tables_of_one_version_are_read_together(spark, tmp_path):
    path = str(tmp_path / "versions")
    make = lambda n: {k: spark.createDataFrame([(n,)], "n int") for k in ("entries", "results", "training")}
    tables.write_together(make(1), path)
    tables.write_together(make(2), path)
    assert [tables.read_latest(spark, path, k).head()["n"] for k in ("entries", "results", "training")] == [2, 2, 2]


def test_names_to_codes_and_back(spark):
    dimension = spark.createDataFrame([("01", "north"), ("02", "south")], "code string, name string")
    df = spark.createDataFrame([("01",), ("09",), (None,)], "code string")
    assert {(r["code"], r["name"]) for r in tables.named_by_code(df, dimension, "code", "name").collect()} == {("01", "north"), ("09", "09"), (None, None)}
    names = spark.createDataFrame([("south",), (None,)], "name string")
    assert {(r["name"], r["code"]) for r in tables.coded_by_name(names, dimension, "name", "code").collect()} == {("south", "02"), (None, None)}
    with pytest.raises(Exception, match="unknown name west"):
        tables.coded_by_name(spark.createDataFrame([("west",)], "name string"), dimension, "name", "code").collect()


def test_a_search_goes_on_where_it_stopped(spark):
    grid = spark.createDataFrame([(w / 10, p) for w in range(5, 11) for p in (0.0, 0.2)], "weight double, penalty double")
    done = spark.createDataFrame([(0.5, 0.0, 100), (0.6, 0.2, 99)], "weight double, penalty double, contests int")
    left = {tuple(r) for r in search.open_points(grid, done, 100).collect()}
    assert len(left) == 11 and (0.5, 0.0) not in left and (0.6, 0.2) in left


def test_a_favourite_without_place_1_is_slot_1_else_the_first(spark):
    rows = [(1, 1, 2, 4, 0.5), (1, 2, 1, 1, 0.7), (2, 1, 3, 3, 0.2), (2, 2, 2, 1, 0.9), (3, 4, 5, 2, 0.4), (3, 5, 6, 1, 0.3)]
    df = spark.createDataFrame(rows, "contest_id int, slot int, position int, outcome_rank int, x double")
    got = {r["contest_id"]: (r["own_x"], r["max_outer_x"], r["at2"]) for r in prediction.favourite_row(df, ["x"], ["x"], {"at2": (2, "x")}).collect()}
    assert got == {1: (0.7, 0.5, 0.5), 2: (0.2, 0.9, 0.9), 3: (0.4, 0.4, 0.0)}
    assert {tuple(r) for r in prediction.favourite_target(df).collect()} == {(1, 1, 0), (2, 0, 1)}
