"""Queries over rankings, confidence, buy lists, favourites, odds and rescored tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.functions import dates, numbers, text
from rankweave.operators import metrics as m
from rankweave.operators import prediction as pr
from rankweave.operators import relative
from rankweave.operators import tickets as t
from rankweave.plans.history_queries import KEY
from rankweave.plans.metric_queries import BACKTEST, backtest
from rankweave.plans.registry import on_view, query
from rankweave.plans.ticket_queries import PRICED, on_tickets, priced, slot_shares, ticket_frame
from rankweave.sources import tables

TRIPLE = ["contest_id", "a", "b", "c"]


@query(on_tickets("SELECT contest_id, slot, round(share, 9) AS win_probability, row_number() OVER (PARTITION BY contest_id ORDER BY round(share, 12) DESC, slot) AS predicted_rank FROM sh"))
def ranking_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by their chance to win."""
    return slot_shares(spark, sf_dir).select(*KEY, F.round("share", 9).alias("win_probability"), relative.rank_first(F.round("share", 12), "slot").alias("predicted_rank"))


SEEDS = (1, 2, 3)
SEED_SCORE = "raw_score + ((contest_id + 17 * slot) * {k} % 11) / 100.0"


@query(on_tickets("SELECT contest_id, slot, round((" + " + ".join(f"({SEED_SCORE.format(k=k)})" for k in SEEDS) + ") / 3, 9) AS mean_score FROM six"))
def seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the scores that models of several seeds give."""
    rows = slot_shares(spark, sf_dir).withColumns({f"s{k}": F.col("raw_score") + (F.col("contest_id") + 17 * F.col("slot")) * k % 11 / 100.0 for k in SEEDS})
    return rows.select(*KEY, F.round(t.mean_score([f"s{k}" for k in SEEDS]), 9).alias("mean_score"))


@query(on_tickets("""
SELECT contest_id, round(score, 9) AS confidence, CASE WHEN score >= 0.22 THEN 'high' WHEN score >= 0.16 THEN 'middle' ELSE 'low' END AS label
FROM (SELECT contest_id, least(1, greatest(0, 0.5 * s[1] + 0.3 * greatest(s[1] - s[2], 0) + 0.2 * greatest(p[1] - p[2], 0))) AS score
      FROM (SELECT contest_id, list_reverse_sort(list(share)) AS s FROM sh GROUP BY contest_id) JOIN (SELECT contest_id, list_reverse_sort(list(probability)) AS p FROM t GROUP BY contest_id) USING (contest_id))
"""))
def prediction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best slot and the best ticket of a contest are ahead of the next."""
    out = pr.prediction_confidence(slot_shares(spark, sf_dir), ticket_frame(spark, sf_dir))
    return out.select("contest_id", F.round("confidence", 9).alias("confidence"), "label")


AMOUNT = "CASE WHEN nth <= 12 AND probability * odds >= 1 AND odds >= 12 THEN greatest(floor(round(least(greatest(0, least(0.02, ((odds - 1) * probability - (1 - probability)) / (odds - 1))) * 10000, 500.0), 6) / 100) * 100, 100) ELSE 0 END"


@query(on_tickets(f"SELECT contest_id, a, b, c, place, CAST(amount AS BIGINT) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY amount DESC, ev DESC, probability DESC, a, b, c) AS place FROM (SELECT *, max(amount) OVER (PARTITION BY contest_id) AS most FROM (SELECT *, {AMOUNT} AS amount, round(probability * odds, 12) AS ev FROM p)) WHERE amount > 0 OR most = 0) WHERE place <= 5", p=PRICED))
def buy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tickets to buy, by amount, value and probability; the best five where none is worth it."""
    df = priced(spark, sf_dir).withColumns({"amount": t.stake_amount(F.col("nth"), F.col("probability"), F.col("odds")).cast("long"), "ev": F.round(F.col("probability") * F.col("odds"), 12)})
    return pr.buy_list(df, "amount", ["amount", "ev", "probability"], 5).select(*TRIPLE, "place", "amount")


OWN, OUTSIDE = ("raw_score", "lead_time", "trial_time"), ("raw_score", "lead_time")
AT = {"place2_lead": (2, "lead_time"), "place3_score": (3, "raw_score"), "place4_score": (4, "raw_score")}
FAVOURITE = (
    "SELECT contest_id, " + ", ".join(f"arg_min({c}, (CASE WHEN position = 1 THEN 0 WHEN slot = 1 THEN 1 ELSE 2 END) * 1000 + slot) AS own_{c}" for c in OWN if c != "trial_time")
    + ", arg_min_null(trial_time, (CASE WHEN position = 1 THEN 0 WHEN slot = 1 THEN 1 ELSE 2 END) * 1000 + slot) AS own_trial_time, "
    + ", ".join(f"coalesce(max(CASE WHEN position >= 2 THEN {c} END), 0) AS max_outer_{c}" for c in OUTSIDE) + ", " + ", ".join(f"coalesce(max(CASE WHEN position = {k} THEN {c} END), 0) AS {n}" for n, (k, c) in AT.items())
    + " FROM v GROUP BY contest_id"
)
TARGET = "SELECT contest_id, CAST(rank = 1 AS INT) AS won, CAST(rank >= 3 AS INT) AS collapsed FROM (SELECT contest_id, max(CASE WHEN position = 1 THEN outcome_rank END) AS rank FROM v GROUP BY contest_id) WHERE rank IS NOT NULL"


@query(on_view("SELECT f.*, won, collapsed FROM f JOIN t USING (contest_id)", f=FAVOURITE, t=TARGET))
def favourite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each contest's favourite and of those outside, with what became of it."""
    v = contest_view(spark, sf_dir)
    return pr.favourite_row(v, OWN, OUTSIDE, AT).join(pr.favourite_target(v), "contest_id")


@query(on_tickets("""
SELECT t.contest_id, t.a, t.b, t.c, round(probability * greatest(coalesce(s.share / (1 - f.share), 1), 1e-9) * greatest(coalesce(CASE WHEN (a + b + c) % 5 <> 0 THEN share_c / (1 - share_a - share_b) END, 1), 1e-9), 12) AS score
FROM t JOIN sh AS f ON t.contest_id = f.contest_id AND t.a = f.slot LEFT JOIN (SELECT * FROM sh WHERE slot <> 6) AS s ON t.contest_id = s.contest_id AND t.b = s.slot
"""))
def conditional_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets times the probability of their second slot given the first, and of the third given both.

    Some pairs and triples have no probability, as candidates that a model
    never scored: they count as 1.
    """
    shares = slot_shares(spark, sf_dir).groupBy("contest_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "share"))).alias("by_slot"))
    df = ticket_frame(spark, sf_dir).join(shares, "contest_id")
    share = lambda c: F.element_at("by_slot", F.col(c))
    second = F.when(F.col("b") != 6, share("b") / (1 - share("a")))
    third = F.when((F.col("a") + F.col("b") + F.col("c")) % 5 != 0, share("c") / (1 - share("a") - share("b")))
    return df.select(*TRIPLE, F.round(pr.rescored(F.col("probability"), second, third), 12).alias("score"))


CARRIED = ("share", "lead_time", "position", "raw_score")
PAIRS = (("a", "b"), ("a", "c"), ("b", "c"))
TICKET_FEATURES = ", ".join(
    [f"round({n}.{c}, 9) AS {c}_{n}" for c in CARRIED for n in "abc"]
    + [f"round({x}.{c} - {y}.{c}, 9) AS {c}_{x}{y}" for c in CARRIED for x, y in PAIRS]
    + [f"round(({' + '.join(f'{n}.{c}' for n in 'abc')}) / 3, 9) AS {c}_mean" for c in CARRIED]
    + [f"round(least({', '.join(f'{n}.{c}' for n in 'abc')}), 9) AS {c}_min, round(greatest({', '.join(f'{n}.{c}' for n in 'abc')}), 9) AS {c}_max" for c in CARRIED]
)


@query(on_tickets(f"SELECT a.contest_id, a.slot AS a, b.slot AS b, c.slot AS c, {TICKET_FEATURES}, CAST(b.slot > a.slot AS INT) + CAST(c.slot > b.slot AS INT) AS rising, CAST(a.slot = 1 AS INT) AS first_inside, CAST(a.slot >= 4 AS INT) + CAST(b.slot >= 4 AS INT) + CAST(c.slot >= 4 AS INT) AS outside FROM sh AS a JOIN sh AS b ON a.contest_id = b.contest_id AND a.slot <> b.slot JOIN sh AS c ON a.contest_id = c.contest_id AND c.slot <> a.slot AND c.slot <> b.slot"))
def ticket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a learner of tickets reads: the values of the three slots, their differences, means and bounds."""
    slots = slot_shares(spark, sf_dir).select("contest_id", "slot", *CARRIED)
    other = lambda c, k: F.max(F.when(F.col("slot") == k, F.col(c))).over(relative.group())
    # what a slot or a pair of slots says is rounded before the expansion: 6 and 36 times a contest and not 120 times each
    slots = slots.withColumns({f"{c}_from": F.array(*[F.round(F.col(c) - other(c, k), 9) for k in range(1, 7)]) for c in CARRIED} | {f"{c}_shown": F.round(c, 9) for c in CARRIED})
    df = t.permutations(slots, [*CARRIED, *[f"{c}_{k}" for c in CARRIED for k in ("from", "shown")]])
    at = lambda c: [F.col(f"{c}_{n}") for n in "abc"]
    made = {f"{c}_{n}": F.col(f"{c}_shown_{n}") for c in CARRIED for n in "abc"}
    made |= {f"{c}_{x}{y}": F.get(f"{c}_from_{x}", F.col(y) - 1) for c in CARRIED for x, y in PAIRS}
    made |= {f"{c}_mean": F.round(sum(at(c), F.lit(0.0)) / 3, 9) for c in CARRIED} | {f"{c}_{k}": bound(*at(f"{c}_shown")) for c in CARRIED for k, bound in (("min", F.least), ("max", F.greatest))}
    is_ = lambda x: x.cast("int")
    shape = {"rising": is_(F.col("b") > F.col("a")) + is_(F.col("c") > F.col("b")), "first_inside": is_(F.col("a") == 1), "outside": is_(F.col("a") >= 4) + is_(F.col("b") >= 4) + is_(F.col("c") >= 4)}
    names = [f"{c}_{n}" for c in CARRIED for n in "abc"] + [f"{c}_{x}{y}" for c in CARRIED for x, y in PAIRS] + [f"{c}_mean" for c in CARRIED] + [n for c in CARRIED for n in (f"{c}_min", f"{c}_max")]
    return df.select(*TRIPLE, *[made[n].alias(n) for n in names], *[v.alias(k) for k, v in shape.items()])


@query(on_tickets("SELECT contest_id, a, b, c, o AS odds, round(probability * o, 12) AS expected_value, o IS NULL AS no_odds FROM (SELECT *, CASE WHEN (a + b + c) % 7 <> 0 THEN odds END AS o FROM p)", p=PRICED))
def odds_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with the odds of a table that lacks some of them."""
    odds = priced(spark, sf_dir).where("(a + b + c) % 7 <> 0").select(*TRIPLE, "odds")
    joined = t.with_odds(ticket_frame(spark, sf_dir).select(*TRIPLE, "probability"), odds)
    return joined.select(*TRIPLE, "odds", F.round(numbers.expected_value(F.col("probability"), F.col("odds")), 12).alias("expected_value"), F.col("odds").isNull().alias("no_odds"))


@query(on_tickets("SELECT t.contest_id, t.a, t.b, t.c, paid, month, paid IS NULL AS unpaid FROM (SELECT * FROM t WHERE is_actual) AS t LEFT JOIN (SELECT o_orderkey, o_totalprice AS paid FROM orders WHERE o_orderkey % 10 <> 3) AS p ON t.contest_id = p.o_orderkey LEFT JOIN (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders) AS x ON t.contest_id = x.o_orderkey"))
def settled_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual tickets with their payout and the contest's month, each from a table with one row a contest."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    paid = orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("contest_id"), F.col("o_totalprice").alias("paid"))
    month = orders.select(F.col("o_orderkey").alias("contest_id"), F.trunc("o_orderdate", "month").alias("month"))
    actual = ticket_frame(spark, sf_dir).where("is_actual").select(*TRIPLE)
    out = tables.join_many_to_one(tables.join_many_to_one(actual, paid, ["contest_id"]), month, ["contest_id"])
    return out.select(*TRIPLE, "paid", "month", F.col("paid").isNull().alias("unpaid"))


SITES = "SELECT DISTINCT substr(site, 1, 1) AS code, substr(site, 3) AS name FROM v WHERE site <> '5-LOW'"


@query(on_view("SELECT contest_id, substr(v.site, 1, 1) AS code, coalesce(s.name, substr(v.site, 1, 1)) AS site_name FROM (SELECT DISTINCT contest_id, site FROM v) AS v LEFT JOIN s ON s.code = substr(v.site, 1, 1)", s=SITES))
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of sites to names; a code that the dimension lacks stays as it is."""
    v = contest_view(spark, sf_dir).select("contest_id", "site").distinct().withColumn("code", F.substring("site", 1, 1))
    known = v.where("site <> '5-LOW'").select("code", F.substr("site", F.lit(3)).alias("name")).distinct()
    return tables.named_by_code(v, known, "code", "site_name").select("contest_id", "code", "site_name")


@query(on_tickets("SELECT contest_id, race_date, substr(site, 3) AS site_name, picks, CASE WHEN hit = 1 THEN 'hit' ELSE 'miss' END AS outcome, printf('%.1f%%', 100.0 * round(won / stake, 2)) AS recovery, CASE WHEN won >= 100000 THEN 'large' WHEN won > 0 THEN 'small' ELSE 'none' END AS return_class FROM b", b=BACKTEST))
def report_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest of each contest as a reader sees it: names for sites and outcomes, shares as text."""
    b = backtest(spark, sf_dir)
    size = m.band(F.col("won"), [0.005, 100_000], ["none", "small", "large"])
    return b.select("contest_id", "race_date", F.substr("site", F.lit(3)).alias("site_name"), "picks", F.when(F.col("hit") == 1, "hit").otherwise("miss").alias("outcome"), text.percent(numbers.round_scaled(F.col("won") / F.col("stake"), 2)).alias("recovery"), size.alias("return_class"))


@query(on_view("SELECT contest_id, slot, 't' || slot || '-' || position || '-x' AS written, NULL AS broken, CAST(slot AS INT) AS a, CAST(position AS INT) AS b, CAST(outcome_rank AS INT) AS c, CASE WHEN ends_with(site, 'LOW') THEN 'calm' WHEN ends_with(site, 'GH') THEN 'rough' ELSE 'plain' END AS ending, CASE WHEN slot = 1 THEN 'high' WHEN slot = 2 THEN 'middle' ELSE 'low' END AS label, CASE WHEN style <> 'F' AND lead_time <= 0.08 THEN lead_time END AS target, CAST(race_date - INTERVAL 18 MONTH AS DATE) AS before, 19 - slot AS shown FROM v"))
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets from text, classes from endings, keys from labels, targets that flags spoil, and dates before."""
    v = contest_view(spark, sf_dir)
    written = F.concat(F.lit("t"), F.col("slot").cast("string"), F.lit("-"), F.col("position").cast("string"), F.lit("-x"))
    ticket = t.parse_ticket(F.concat_ws("-", "slot", "position", "outcome_rank"))
    label = F.when(F.col("slot") == 1, "高").when(F.col("slot") == 2, " Middle ").otherwise("?")
    lead = F.when(F.col("lead_time") <= 0.08, F.col("lead_time")).otherwise(F.col("lead_time") + 1)
    return v.select(*KEY, written.alias("written"), t.parse_ticket(written)["a"].alias("broken"), *[ticket[n].alias(n) for n in "abc"], text.ending_class(F.col("site"), [("LOW", "calm"), ("GH", "rough")], "plain").alias("ending"), text.label_key(label).alias("label"), text.valid_target(lead, F.col("style")).alias("target"), dates.years_before(F.col("race_date"), 1.5).alias("before"), text.optional_int(F.concat(F.lit(" "), (19 - F.col("slot")).cast("string"), F.lit(" "))).cast("int").alias("shown"))
