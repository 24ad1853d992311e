"""The incremental build, walk-forward frames, exact quantiles, fits, calibration and overrides on literal and random rows."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import fitting, overrides, search, statistics, styles
from rankweave.operators.history import Feature, Recent, asof_recent, rolling_history
from rankweave.sources import months
from rankweave.streaming.incremental import Build, Family

ORDER = ["day", "nth"]
FAMILIES = [
    Family(("who",), (Feature("mean3", "x", 3, 1), Feature("low5", "x", 5, 2, "min"))),
    Family(("place", "who"), (Feature("std4", "x", 4, 2, "std"),)),
    Family(("place",), (Feature("place_mean", "x", 6, 3),), 8),
]


def results(n=160, seed=1):
    rng = random.Random(seed)
    start = date(2024, 1, 10)
    return [(start + timedelta(days=rng.randrange(200)), i, rng.randrange(4), rng.choice("ab"), rng.choice([None, rng.random()])) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(results(), "day date, nth int, who int, place string, x double")


def batch(frame):
    rows = frame
    for f in FAMILIES:
        rows = rolling_history(rows, f.keys, ORDER, f.features, block=f.block, count_on=frame)
    return rows


COLUMNS = ["nth", "mean3", "low5", "std4", "place_mean"]


def values(df, columns=COLUMNS):
    return sorted(tuple(None if v is None else round(v, 9) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", [2, 5])
def test_build_is_the_batch_whatever_the_months_are_cut_into(spark, frame, tmp_path, size):
    path = f"file://{tmp_path}"
    months.write_months(frame, f"{path}/months", "day")
    build = Build(spark, f"{path}/build", FAMILIES, ORDER, counted="before")
    groups = months.month_groups(spark, f"{path}/months", size)
    assert [x for g in groups for x in g] == sorted({r[0].year * 100 + r[0].month for r in results()})
    for group in groups:
        build.advance(months.read_months(spark, f"{path}/months", group))
    assert values(build.rows()) == values(batch(frame))
    seen, want = {}, {}
    for day, nth, who, _, _ in sorted(results(), key=lambda r: r[:2]):
        want[nth] = seen.get(who, 0)
        seen[who] = want[nth] + 1
    assert {r["nth"]: r["before"] for r in build.rows().collect()} == want
    build.advance(frame, 0)  # a version that counts isn't built again
    assert build.last_version() == len(groups) - 1
    with pytest.raises(ValueError, match="can't follow"):
        build.advance(frame.where("day < date'2024-02-01'"))
    with pytest.raises(ValueError, match="can't follow"):
        build.advance(frame, len(groups) + 1)


def test_a_stream_of_months_builds_the_same(spark, frame, tmp_path):
    path = f"file://{tmp_path}"
    build = Build(spark, f"{path}/build", FAMILIES[:2], ORDER)
    schema = frame.schema
    for start, end in (("2024-01-01", "2024-03-01"), ("2024-03-01", "2024-06-01"), ("2024-06-01", "2025-01-01")):
        frame.where(f"day >= date'{start}' and day < date'{end}'").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        build.follow(stream, f"{path}/checkpoint").awaitTermination()
    assert build.last_version() == 2
    assert values(build.rows(), COLUMNS[:4]) == values(batch(frame), COLUMNS[:4])


def test_months_and_days_prune_folders_and_files(spark, frame, tmp_path):
    months.write_months(frame, f"{tmp_path}/months", "day")
    df = months.read_months(spark, f"{tmp_path}/months", None, date(2024, 3, 5), date(2024, 3, 5), "day")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(day)" in plan
    assert {r["month"] for r in df.collect()} <= {202403}
    assert months.month_groups(spark, f"{tmp_path}/months", 2, date(2024, 2, 1), date(2024, 4, 30)) == [[202402, 202403], [202404]]


def test_no_row_sees_its_own_day(spark, frame):
    features = [Recent("m3", "x", 3), Recent("s5", "x", 5, "std"), Recent("lo2", "x", 2, "min"), Recent("sum9", "x", 9, "sum"), Recent("hi", "nth", 4, "max")]
    asked = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=d), w, p) for d in range(0, 230, 7) for w in range(5) for p in "ab"], "day date, who int, place string")
    found = asof_recent(asked.withColumn("extra", F.lit(1)), frame, ["who", "place"], "day", ORDER, features)
    rows = found.collect()
    assert len(rows) == asked.count()
    for r in rows:
        mine = sorted(x for x in results() if x[0] < r["day"] and (x[2], x[3]) == (r["who"], r["place"]))
        xs = [x[4] for x in mine if x[4] is not None]
        near = lambda a, b: a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))
        assert near(r["m3"], sum(xs[-3:]) / len(xs[-3:]) if xs else None)
        assert near(r["s5"], float(np.std(xs[-5:], ddof=1)) if len(xs) > 1 else None)
        assert near(r["lo2"], min(xs[-2:], default=None)) and near(r["sum9"], sum(xs[-9:]) if xs else None)
        assert r["hi"] == max((x[1] for x in mine[-4:]), default=None)


@pytest.mark.parametrize("few", [20, 1 << 16])
def test_quantiles_by_selection(spark, few):
    rng = np.random.default_rng(few)
    a = np.r_[rng.normal(0, 1, 300), np.full(200, 0.25), 1e300, -1e300, 5e-324, 0.0]
    b = rng.integers(0, 3, len(a)).astype(float)
    rows = [(float(x), float(y) if i % 5 else None, None, 7.0) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    q = (0.0, 0.1, 0.5, 0.77, 1.0)
    found = statistics.quantiles(df, ["a", "b", "c", "d"], q, few=few).head()
    own = [r[1] for r in rows if r[1] is not None]
    for x in q:
        k = round(x * 100)
        assert found[f"a_q{k}"] == pytest.approx(np.quantile(a, x), rel=1e-12, abs=1e-300)
        assert found[f"b_q{k}"] == pytest.approx(np.quantile(own, x))
        assert found[f"c_q{k}"] is None and found[f"d_q{k}"] == 7.0
    assert statistics.quantiles(df.limit(0), ["a"], (0.5,)).head()[0] is None


def test_logistic_fit_is_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(2, 3, (400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * x[:, 0] - 0.2 * x[:, 1] - 1)))).astype(int)
    rows = [(*map(float, r[:2]), float(r[2]) if i % 7 else None, int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(5)
    model = fitting.fit_logistic(df, ["a", "b", "c"], "y")
    third = np.array([np.nan if r[2] is None else r[2] for r in rows])
    third[np.isnan(third)] = np.nanmedian(third)
    z = np.column_stack([x[:, :2], third])
    z = np.column_stack([np.ones(400), (z - z.mean(0)) / z.std(0)])
    w = np.zeros(4)
    for _ in range(20000):  # plain descent
        w -= 0.002 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.r_[0, w[1:]])
    assert np.allclose(model.weights, w, atol=1e-6)
    p = [r["p"] for r in df.select(model.probability().alias("p")).collect()]
    assert 0 < min(p) and max(p) < 1
    for labels, constant in (([1, 1], 1.0), ([0, None], 0.0), ([], 0.0)):
        few = spark.createDataFrame([(1.0, t) for t in labels], "a double, y int")
        assert fitting.fit_logistic(few, ["a"], "y").constant == constant


def test_monotone_fit_is_that_of_plain_pooling(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(500)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "x double, y int").repartition(6)
    steps = fitting.fit_monotone(df, "x", "y")
    xs = sorted({x for x, y in rows if x is not None and y is not None})
    blocks = []
    for x in xs:
        own = [y for a, y in rows if a == x and y is not None]
        blocks.append([[x], sum(own), len(own)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    fit = {x: b[1] / b[2] for b in blocks for x in b[0]}
    assert {*steps.x} == {x for b in blocks for x in (b[0][0], b[0][-1])}
    assert all(math.isclose(fit[x], y) for x, y in zip(steps.x, steps.y, strict=True))
    asked = [-1.0, 2.0, *xs, *((a + b) / 2 for a, b in zip(xs, xs[1:], strict=False))]
    one = spark.createDataFrame([(list(steps.x), list(steps.y))], "__xs array<double>, __ys array<double>")
    got = spark.createDataFrame([(x,) for x in asked], "x double").crossJoin(one).select("x", fitting.interpolated(F.col("x"), one).alias("y")).collect()
    for r in got:
        assert r["y"] == pytest.approx(float(np.interp(r["x"], steps.x, steps.y)), rel=1e-12)
    tickets = spark.createDataFrame([(1, 0.2), (1, 0.8), (2, 0.5), (2, None)], "contest_id int, x double")
    sums = fitting.calibrated(tickets, steps, "x", "p").groupBy("contest_id").agg(F.sum("p").alias("s")).collect()
    assert all(math.isclose(r["s"], 1) for r in sums)
    assert fitting.fit_monotone(df.limit(0), "x", "y") == ((), ())


def test_overrides_are_parsed_checked_and_joined(spark):
    entries = spark.createDataFrame([(c, s, None if c == 3 else s) for c in (1, 2, 3, 4) for s in range(1, 7)], "contest_id int, slot int, position int")
    table = lambda *rows: spark.createDataFrame(rows, "contest_id int, overrides string")
    found = overrides.with_positions(entries, overrides.position_table(table((1, "213456"), (2, " 1=6, 6=1,"), (3, "1, 2,3,4,6,5"), (4, " "), (9, None))))
    by = {}
    for r in found.orderBy("contest_id", "slot").collect():
        by.setdefault(r["contest_id"], []).append(r["position"])
    assert by == {1: [2, 1, 3, 4, 5, 6], 2: [6, 2, 3, 4, 5, 1], 3: [1, 2, 3, 4, 6, 5], 4: [1, 2, 3, 4, 5, 6]}
    for text, what in (("12345", "every slot"), ("1,2,3", "every slot"), ("1=7", "positions that"), ("8=1", "slots that don't"), ("a=1", "slots that don't"), ("1=2,1=3", "set twice"), ("1,2,3,4,5,x", "positions that")):
        with pytest.raises(ValueError, match=what):
            overrides.position_table(table((1, text)))
    with pytest.raises(ValueError, match="two entrants"):
        overrides.with_positions(entries, overrides.position_table(table((1, "1=2"))))


def test_lead_deltas_are_checked(spark):
    entries = spark.createDataFrame([(1, 1, 0.05), (1, 2, 0.5), (1, 3, None)], "contest_id int, slot int, lead_time double")
    deltas = lambda *rows: spark.createDataFrame(rows, "contest_id int, slot int, delta double")
    found = overrides.with_lead_deltas(entries, deltas((1, 1, 0.1), (1, 3, 0.0)))
    assert [r["lead_time"] for r in found.orderBy("slot").collect()] == [pytest.approx(0.15), 0.5, None]
    for row, what in (((1, 1, 0.2), "out of range"), ((1, 1, float("nan")), "out of range"), ((1, 1, None), "out of range"), ((1, 1, -0.1), "can't be changed"), ((1, 3, 0.01), "can't be changed")):
        with pytest.raises(ValueError, match=what):
            overrides.with_lead_deltas(entries, deltas(row))
    with pytest.raises(ValueError, match="twice"):
        overrides.with_lead_deltas(entries, deltas((1, 1, 0.01), (1, 1, 0.02)))


def test_style_rates_leave_the_row_itself_out(spark):
    kinds = ["inside", "inside", "slip", "turn", "inside", "turn_slip"]
    ranks = [1, 1, 1, 1, 2, 1]
    df = spark.createDataFrame([(1, n, k, r) for n, (k, r) in enumerate(zip(kinds, ranks, strict=True))], "who int, nth int, style string, outcome_rank int").withColumns(styles.win_flags())
    names = ("entity", "place", "entity_place")
    rows = rolling_history(df, ["who"], ["nth"], [f for n in names for f in styles.rates(n, 30, 3)]).withColumns(styles.blended())
    last = rows.orderBy(F.desc("nth")).first()
    assert [last[f"entity_{k}"] for k in styles.KINDS] == pytest.approx([0.4, 0.2, 0.2, 0.0, 0.0])
    assert (last["flow_inside"], last["attack_style"]) == pytest.approx((0.4, 0.2))


def test_halving_goes_on_with_the_better_half():
    asked = []
    found = search.halving(lambda left, fold: asked.append(list(left)) or {k: (10, float(k % 4)) for k in left}, 8, 3)
    assert asked == [[*range(8)], [3, 7, 2, 6], [3, 7]]
    assert {k: (n, v, f) for k, n, v, f in found}[7] == (30, 3.0, 3) and {k: f for k, _, _, f in found}[0] == 1
    trials = search.sampled_trials(64)
    assert len({*trials}) == 64 and all(min(t) >= 0 and abs(sum(t) - 1) < 1e-9 for t in trials)
    assert all(any(t[i] > 0.6 for t in trials) for i in range(3))
