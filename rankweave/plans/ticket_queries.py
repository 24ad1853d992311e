"""Queries over tickets: expansion, probabilities, candidates, values and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.operators import confidence, relative
from rankweave.operators import tickets as t
from rankweave.plans.registry import on_view, query

G = "PARTITION BY contest_id"
NATURAL = f"OVER ({G} ORDER BY probability DESC, a, b, c)"
SIX = "SELECT * FROM v WHERE contest_id IN (SELECT contest_id FROM v GROUP BY contest_id HAVING count(*) = 6)"
SHARES = f"SELECT *, e / sum(e) OVER ({G}) AS share FROM (SELECT *, exp(raw_score - max(raw_score) OVER ({G})) AS e FROM six)"
TICKETS = """
SELECT x.contest_id, x.race_date, x.site, x.payout, x.slot AS a, y.slot AS b, z.slot AS c, x.share AS share_a, y.share AS share_b, z.share AS share_c,
       round(x.share / s * (y.share / (s - x.share)) * (z.share / (s - x.share - y.share)), 12) AS probability,
       x.outcome_rank = 1 AND y.outcome_rank = 2 AND z.outcome_rank = 3 AS is_actual
FROM sh AS x JOIN sh AS y ON x.contest_id = y.contest_id AND x.slot <> y.slot
JOIN sh AS z ON x.contest_id = z.contest_id AND x.slot <> z.slot AND y.slot <> z.slot
JOIN (SELECT contest_id, sum(share) AS s FROM sh GROUP BY contest_id) AS total ON x.contest_id = total.contest_id
"""


def on_tickets(select: str, **tables: str) -> str:
    return on_view(select, six=SIX, sh=SHARES, t=TICKETS, **tables)


def slot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of complete contests of six with their softmax shares."""
    six = t.complete_groups(contest_view(spark, sf_dir))
    return six.withColumn("share", relative.softmax("raw_score"))


def ticket_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = slot_shares(spark, sf_dir).withColumn("total", F.sum("share").over(relative.group()))
    found = t.permutations(shares.select("contest_id", "slot", "race_date", "site", "payout", "share", "outcome_rank", "total"), ["share", "outcome_rank"], keep=["race_date", "site", "payout", "total"])
    actual = (F.col("outcome_rank_a") == 1) & (F.col("outcome_rank_b") == 2) & (F.col("outcome_rank_c") == 3)
    return found.withColumns({"probability": F.round(t.draw_probability("share"), 12), "is_actual": actual})


@query(on_tickets("SELECT contest_id, a, b, c, a || '-' || b || '-' || c AS ticket, probability, is_actual FROM t"))
def permutation_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered triples with the probability of drawing them."""
    return ticket_frame(spark, sf_dir).select("contest_id", "a", "b", "c", t.ticket_text().alias("ticket"), "probability", "is_actual")


WEIGHTS = """
SELECT contest_id, slot, 0.7 * greatest(share, 1e-9) + 0.3 * greatest(share, 1e-9) AS w1, 0.7 * greatest(t2 - share, 1e-9) + 0.3 * greatest(share, 1e-9) AS w2, 0.7 * greatest(t3 - t2, 1e-9) + 0.3 * greatest(share, 1e-9) AS w3
FROM (SELECT contest_id, slot, share, coalesce(share + trial_time, share) AS t2, least(1.0, share * 2) AS t3 FROM sh)
"""
CONDITIONAL = """
SELECT x.contest_id, x.slot AS a, y.slot AS b, z.slot AS c, x.w1 / s1 * (y.w2 / (s2 - x.w2)) * (z.w3 / (s3 - x.w3 - y.w3)) AS p
FROM w AS x JOIN w AS y ON x.contest_id = y.contest_id AND x.slot <> y.slot
JOIN w AS z ON x.contest_id = z.contest_id AND x.slot <> z.slot AND y.slot <> z.slot
JOIN (SELECT contest_id, sum(w1) AS s1, sum(w2) AS s2, sum(w3) AS s3 FROM w GROUP BY contest_id) AS total ON x.contest_id = total.contest_id
"""


def conditional_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = slot_shares(spark, sf_dir).withColumns({"top2": F.col("share") + F.col("trial_time"), "top3": F.least(F.lit(1.0), F.col("share") * 2)})
    df = df.withColumns(t.place_weights("share", "share", "top2", "top3"))
    names = ["first_w", "second_w", "third_w"]
    df = df.withColumns({f"{n}_total": F.sum(n).over(relative.group()) for n in names})
    found = t.permutations(df.select("contest_id", "slot", *names, *[f"{n}_total" for n in names]), names, keep=[f"{n}_total" for n in names])
    return found.select("contest_id", "a", "b", "c", t.conditional_probability().alias("p"))


def both_frame(spark: SparkSession, sf_dir: str, won: bool = False) -> DataFrame:
    """Tickets with the probability of drawing them and that from exact-place weights (p), from one expansion of the slots.

    won: also the slots and both probabilities of the contest's actual ticket, from the slots before they are expanded.
    """
    names = ["first_w", "second_w", "third_w"]
    df = slot_shares(spark, sf_dir).withColumns({"top2": F.col("share") + F.col("trial_time"), "top3": F.least(F.lit(1.0), F.col("share") * 2)})
    df = df.withColumns(t.place_weights("share", "share", "top2", "top3"))
    sums = {"total": F.sum("share").over(relative.group()), **{f"{n}_total": F.sum(n).over(relative.group()) for n in names}}
    if won:
        placed = lambda c, k: F.max(F.when(F.col("outcome_rank") == k, F.col(c))).over(relative.group())
        sums |= {f"won_{n}": placed("slot", k) for k, n in enumerate("abc", 1)} | {f"won_{c}_{n}": placed(c, k) for c in ("share", *names) for k, n in enumerate("abc", 1)}
    kept = ["race_date", "site", "payout", *sums]
    found = t.permutations(df.withColumns(sums).select("contest_id", "slot", "share", "outcome_rank", *names, *kept), ["share", "outcome_rank", *names], keep=kept)
    actual = (F.col("outcome_rank_a") == 1) & (F.col("outcome_rank_b") == 2) & (F.col("outcome_rank_c") == 3)
    out = found.withColumns({"probability": F.round(t.draw_probability("share"), 12), "p": t.conditional_probability(), "is_actual": actual})
    if won:
        out = out.withColumns({f"won_{n}_total": F.col(f"{n}_total") for n in names})
        out = out.withColumns({"won_probability": F.round(t.draw_probability("won_share"), 12), "won_p": t.conditional_probability(*[f"won_{n}" for n in names])})
    return out.select("contest_id", "race_date", "site", "payout", "a", "b", "c", "share_a", "share_b", "share_c", "probability", "p", "is_actual", *(["won_a", "won_b", "won_c", "won_probability", "won_p"] if won else []))


@query(on_tickets("SELECT contest_id, a, b, c, round(p, 9) AS probability FROM k", w=WEIGHTS, k=CONDITIONAL))
def conditional_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets from exact-place weights, where the shares of the first two and three are known."""
    return conditional_frame(spark, sf_dir).select("contest_id", "a", "b", "c", F.round("p", 9).alias("probability"))


@query(on_tickets(f"SELECT contest_id, a, b, c, nth, probability FROM (SELECT *, row_number() {NATURAL} AS nth FROM t) WHERE nth <= 5"))
def top_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best tickets of each contest."""
    return t.top_tickets(ticket_frame(spark, sf_dir), 5).select("contest_id", "a", "b", "c", "nth", "probability")


@query(on_tickets("""
SELECT contest_id, slot, round(sum(p1), 13) AS first_p, round(sum(p2), 13) AS second_p, round(sum(p3), 13) AS third_p
FROM (SELECT contest_id, a AS slot, probability AS p1, 0 AS p2, 0 AS p3 FROM t UNION ALL SELECT contest_id, b, 0, probability, 0 FROM t UNION ALL SELECT contest_id, c, 0, 0, probability FROM t)
GROUP BY contest_id, slot
"""))
def slot_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each slot at each place, from the tickets; one pass over them."""
    places = F.array(*[F.struct(F.lit(k).alias("place"), F.col(n).alias("slot")) for k, n in enumerate("abc", 1)])
    long = ticket_frame(spark, sf_dir).select("contest_id", "probability", F.inline(places))
    return long.groupBy("contest_id", "slot").agg(*[F.round(F.sum(F.when(F.col("place") == k, F.col("probability")).otherwise(0.0)), 13).alias(n) for k, n in enumerate(("first_p", "second_p", "third_p"), 1)])


@query(on_tickets("""
SELECT contest_id, a, b, c, two AS top2_overlap, three AS top3_overlap,
       CASE WHEN a = x AND b = y AND c = z THEN 5 WHEN a = x AND b = y THEN 4 WHEN a = x AND three >= 2 THEN 3 WHEN a = x THEN 2 WHEN two >= 2 OR three >= 2 THEN 1 ELSE 0 END AS relevance,
       round(CASE WHEN a = x AND b = y AND c = z THEN 1.0 WHEN a = x AND b = y THEN 0.75 WHEN a = x AND three >= 2 THEN 0.6 WHEN a = x THEN 0.5 WHEN two >= 2 THEN 0.35 WHEN three >= 2 THEN 0.2 ELSE 0.15 END + 0.03 * three, 9) AS sample_weight
FROM (SELECT *, CAST(a IN (x, y) AS INT) + CAST(b IN (x, y) AS INT) AS two, CAST(a IN (x, y, z) AS INT) + CAST(b IN (x, y, z) AS INT) + CAST(c IN (x, y, z) AS INT) AS three, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth FROM t JOIN o USING (contest_id))
WHERE nth <= 24 OR (a = x AND b = y AND c = z) OR a = x OR two >= 2 OR three >= 2
""", o="SELECT contest_id, max(CASE WHEN outcome_rank = 1 THEN slot END) AS x, max(CASE WHEN outcome_rank = 2 THEN slot END) AS y, max(CASE WHEN outcome_rank = 3 THEN slot END) AS z FROM six GROUP BY contest_id"))
def training_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets to learn from, with graded relevance and weights."""
    df, group = ticket_frame(spark, sf_dir), relative.group()
    df = df.withColumns({to: F.max(F.when(F.col("is_actual"), F.col(of))).over(group) for of, to in zip("abc", "xyz", strict=True)})
    chosen = df.where("x is not null").withColumn("chosen", t.training_candidates(24, "probability")).where("chosen").withColumns(t.training_targets())
    return chosen.select("contest_id", "a", "b", "c", "top2_overlap", "top3_overlap", "relevance", F.round("sample_weight", 9).alias("sample_weight"))


@query(on_tickets("""
SELECT contest_id, a, b, c, round(CASE WHEN max(u) OVER g - min(u) OVER g <= 1e-8 + 1e-5 * abs(max(u) OVER g) THEN probability ELSE 0.95 * base + 0.05 * least(1, greatest(0, upd - 0.2 * least(1, greatest(0, (nth - 5) / greatest(n - 5, 1.0))))) END, 9) AS score
FROM (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth,
             1 - (rank() OVER (PARTITION BY contest_id ORDER BY probability DESC) + (count(*) OVER (PARTITION BY contest_id, probability) - 1) / 2.0 - 1) / greatest(count(*) OVER g - 1, 1) AS base,
             1 - (rank() OVER (PARTITION BY contest_id ORDER BY u DESC) + (count(*) OVER (PARTITION BY contest_id, u) - 1) / 2.0 - 1) / greatest(count(*) OVER g - 1, 1) AS upd
      FROM (SELECT t.*, round(k.p, 12) AS u FROM t JOIN k ON t.contest_id = k.contest_id AND t.a = k.a AND t.b = k.b AND t.c = k.c) WINDOW g AS (PARTITION BY contest_id))
WINDOW g AS (PARTITION BY contest_id)
""", w=WEIGHTS, k=CONDITIONAL))
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ticket probabilities joined and blended by rank, with a penalty for late ranks."""
    key = ["contest_id", "a", "b", "c"]
    both = both_frame(spark, sf_dir).withColumn("u", F.round("p", 12))
    return both.select(*key, F.round(t.blend_ranks("probability", "u", 0.95, 0.2, 5), 9).alias("score"))


ODDS = "round(0.75 / greatest(probability, 1e-6) * (0.6 + ((a + 2 * b + 3 * c) % 9) / 10.0), 1)"
PRICED = f"SELECT *, {ODDS} AS odds, row_number() {NATURAL} AS nth FROM t"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with odds made from their probability, and their rank."""
    df = ticket_frame(spark, sf_dir)
    turn = (F.col("a") + 2 * F.col("b") + 3 * F.col("c")) % 9
    odds = F.round(0.75 / F.greatest("probability", F.lit(1e-6)) * (0.6 + turn / 10), 1)
    return df.withColumns({"odds": odds, "nth": F.row_number().over(t.order_of("probability"))})


@query(on_tickets("""
SELECT contest_id, a, b, c, odds, round(probability * odds, 14) AS expected_value, rank() OVER (PARTITION BY contest_id ORDER BY odds) AS market_rank, round(probability * odds, 14) >= 1.1 AS is_value,
       round(stake, 12) AS stake_fraction,
       CAST(CASE WHEN nth <= 12 AND probability * odds >= 1 AND odds >= 12 THEN greatest(floor(round(least(stake * 10000, 500.0), 6) / 100) * 100, 100) ELSE 0 END AS BIGINT) AS amount
FROM (SELECT *, CASE WHEN odds > 1 THEN greatest(0, least(0.02, ((odds - 1) * probability - (1 - probability)) / (odds - 1))) ELSE 0 END AS stake FROM p)
""", p=PRICED))
def ticket_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected value, market rank, stake share and recommended amount."""
    df = priced(spark, sf_dir).withColumns(t.value_columns())
    amount = t.stake_amount(F.col("nth"), F.col("probability"), F.col("odds")).cast("long")
    value = F.round("expected_value", 14)
    return df.select("contest_id", "a", "b", "c", "odds", value.alias("expected_value"), "market_rank", (value >= 1.1).alias("is_value"), F.round("stake_fraction", 12).alias("stake_fraction"), amount.alias("amount"))


@query(on_tickets("""
SELECT contest_id, a, b, c, dark AS longshot, prio AS priority,
       CASE WHEN dark >= 0.7 AND prio >= 0.45 THEN 'value longshot' WHEN dark >= 0.58 THEN 'longshot' WHEN probability >= 0.08 OR prio >= 0.72 THEN 'main' ELSE 'cover' END AS hint,
       CASE WHEN upset >= 0.72 THEN 'upset' WHEN upset >= 0.55 THEN 'unsettled' WHEN upset >= 0.38 THEN 'normal' ELSE 'solid' END AS upset_label
FROM (SELECT *, round(least(1, greatest(0, 0.42 * pct + 0.28 * dark + 0.18 * share_b + 0.12 * least(1, greatest(0, (probability * odds - 0.8) / 0.7)))), 9) AS prio
FROM (SELECT *, round(least(1, greatest(0, 0.7 * d + 0.18 * least(1, greatest(0, (odds - 10) / 40)) + 0.12 * least(1, greatest(0, (probability * odds - 0.8) / 0.7)))), 9) AS dark
FROM (SELECT *, least(1, greatest(0, 0.34 * upset + 0.26 * mix + 0.22 * share_b + 0.18 * least(1, greatest(0, 1 - probability / greatest(best, 1e-12))))) AS d
FROM (SELECT *, round(1 - max(share_a) OVER g, 9) AS upset, max(probability) OVER g AS best,
             0.34 * CAST(a >= 4 AS INT) + 0.24 * CAST(b >= 4 AS INT) + 0.16 * CAST(c >= 4 AS INT) + 0.16 * CAST(a <> 1 AS INT) + 0.1 * CAST(1 IN (b, c) AS INT) AS mix,
             (rank() OVER (PARTITION BY contest_id ORDER BY probability) + (count(*) OVER (PARTITION BY contest_id, probability) - 1) / 2.0) / count(*) OVER g AS pct
      FROM p WINDOW g AS (PARTITION BY contest_id)))))
""", p=PRICED))
def longshot_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longshot score with odds, ticket priority, hint and the contest's upset label."""
    df = priced(spark, sf_dir)
    df = df.withColumns({"upset": F.round(1 - F.max("share_a").over(relative.group()), 9), "best": F.max("probability").over(relative.group()), "value": F.col("probability") * F.col("odds")})
    base = t.longshot(F.col("upset"), F.col("share_b"), F.col("probability"), F.col("best"))
    df = df.withColumn("dark", F.round(t.longshot_with_odds(base, F.col("odds"), F.col("value")), 9))
    df = df.withColumn("prio", F.round(t.priority("probability", F.col("dark"), F.col("share_b"), F.col("value")), 9))
    return df.select("contest_id", "a", "b", "c", F.col("dark").alias("longshot"), F.col("prio").alias("priority"), t.hint(F.col("dark"), F.col("prio"), F.col("probability")).alias("hint"), t.upset_label(F.col("upset")).alias("upset_label"))


@query(on_tickets("""
SELECT contest_id, nth, label AS hit_label, CASE WHEN nth <= 3 AND label = 'high' THEN 'buy' WHEN nth <= 3 AND label = 'middle' THEN 'consider' ELSE 'skip' END AS decision,
       CASE WHEN nth <= 3 AND label = 'high' THEN 300 WHEN nth <= 3 AND label = 'middle' THEN 100 ELSE 0 END AS amount
FROM (SELECT contest_id, nth, CASE WHEN hit >= 0.5 THEN 'high' WHEN hit >= 0.35 THEN 'middle' ELSE 'low' END AS label
      FROM (SELECT contest_id, nth, round(least(1, 20 * sum(CASE WHEN nth <= 3 THEN probability ELSE 0 END) OVER (PARTITION BY contest_id) - 0.2), 9) AS hit FROM p)) WHERE nth <= 10
""", p=PRICED))
def buy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buy, consider or skip the ten best tickets by the mass of the best three."""
    df = priced(spark, sf_dir)
    three = F.sum(F.when(F.col("nth") <= 3, F.col("probability")).otherwise(0.0)).over(relative.group())
    df = df.withColumn("hit", F.round(F.least(F.lit(1.0), 20 * three - 0.2), 9)).where("nth <= 10")
    return df.select("contest_id", "nth", *[c.alias(n) for n, c in t.buy_decision(F.col("hit"), F.col("nth")).items()])


Q = f"SELECT contest_id, a, b, c, q, row_number() OVER ({G} ORDER BY round(q, 12) DESC, a, b, c) AS nth FROM (SELECT *, probability / sum(probability) OVER ({G}) AS q FROM t)"


def _clip(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


TOP12 = f"""
SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'middle' ELSE 'low' END AS label
FROM (SELECT *, round(round({_clip(f"0.45 * {_clip('(m12 - 0.1) / 0.45')} + 0.2 * {_clip('(m5 - 0.04) / 0.25')} + 0.15 * {_clip('(q1 - q2) / 0.06')} + 0.1 * {_clip('(q12 - q13) / 0.01')} + 0.1 * {_clip('conc / 0.25')}")} * 100, 9), 1) AS score
      FROM (SELECT contest_id, sum(CASE WHEN nth <= 12 THEN q ELSE 0 END) AS m12, sum(CASE WHEN nth <= 5 THEN q ELSE 0 END) AS m5, max(CASE WHEN nth = 1 THEN q END) AS q1, max(CASE WHEN nth = 2 THEN q END) AS q2,
                   max(CASE WHEN nth = 12 THEN q END) AS q12, max(CASE WHEN nth = 13 THEN q END) AS q13, 1 + sum(greatest(q, 1e-12) * ln(greatest(q, 1e-12))) / ln(count(*)) AS conc FROM q GROUP BY contest_id))
"""


@query(on_tickets("SELECT contest_id, score AS top12_score, label AS top12_label, CASE label WHEN 'high' THEN 5 WHEN 'middle' THEN 8 ELSE 0 END AS tickets, round(m12, 6) AS top12_mass, round(m5, 6) AS top5_mass, round(q1 - q2, 6) AS gap12, round(q12 - q13, 6) AS margin12, round(conc, 6) AS concentration FROM f", q=Q, f=TOP12))
def confidence_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.top12_confidence(ticket_frame(spark, sf_dir))
    return out.select("contest_id", "top12_score", "top12_label", "tickets", *[F.round(c, 6).alias(c) for c in ("top12_mass", "top5_mass", "gap12", "margin12", "concentration")])


#: Of the three best tickets of each contest masses and gaps (T3F), how alike they are (T3G), and the score and tightness from both (T3).
T3F = "SELECT contest_id, sum(CASE WHEN nth <= 3 THEN q ELSE 0 END) AS m3, max(CASE WHEN nth = 1 THEN q END) AS q1, max(CASE WHEN nth = 2 THEN q END) AS q2, max(CASE WHEN nth = 3 THEN q END) AS q3, max(CASE WHEN nth = 4 THEN q END) AS q4, -sum(greatest(q, 1e-12) * ln(greatest(q, 1e-12))) / ln(count(*)) AS ent FROM q GROUP BY contest_id"
T3G = "SELECT contest_id, count(DISTINCT a) AS firsts, count(DISTINCT b) AS seconds, count(DISTINCT (a, b)) AS pairs, max(slots) AS slots FROM (SELECT * FROM q WHERE nth <= 3) JOIN (SELECT contest_id, count(DISTINCT s) AS slots FROM (SELECT contest_id, a AS s FROM q WHERE nth <= 3 UNION ALL SELECT contest_id, b FROM q WHERE nth <= 3 UNION ALL SELECT contest_id, c FROM q WHERE nth <= 3) GROUP BY contest_id) USING (contest_id) GROUP BY contest_id"
T3 = f"""
SELECT *, (4 - firsts) / 3.0 AS first_share, (4 - pairs) / 3.0 AS pair_share, {_clip(f"0.35 * (4 - firsts) / 3.0 + 0.35 * (4 - pairs) / 3.0 + 0.15 * (1 - {_clip('(slots - 3) / 3.0')}) + 0.15 * (1 - {_clip('(seconds - 1) / 2.0')})")} AS tightness
FROM (SELECT f.*, g.firsts, g.seconds, g.pairs, g.slots, round(round({_clip(f"0.35 * {_clip('(m3 - 0.03) / 0.16')} + 0.2 * {_clip('(q1 - 0.01) / 0.08')} + 0.15 * {_clip('(q1 - q2) / 0.035')} + 0.15 * {_clip('(q3 - q4) / 0.012')} + 0.15 * {_clip('(1 - ent) / 0.25')}")} * 100, 9), 1) AS score FROM f JOIN g USING (contest_id))
"""


@query(on_tickets("SELECT contest_id, score AS top3_score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'middle' ELSE 'low' END AS top3_label, firsts, seconds, slots, round(first_share, 6) AS first_share, round(pair_share, 6) AS pair_share, round(tightness, 6) AS tightness, round(m3, 6) AS top3_mass FROM t3", q=Q, f=T3F, g=T3G, t3=T3))
def confidence_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.top3_confidence(ticket_frame(spark, sf_dir))
    return out.select("contest_id", "top3_score", "top3_label", "firsts", "seconds", "slots", *[F.round(c, 6).alias(c) for c in ("first_share", "pair_share", "tightness", "top3_mass")])


@query(on_tickets(f"""
SELECT contest_id, score AS first_score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'middle' ELSE 'low' END AS first_label, first_slot, round(p, 6) AS first_probability, round(p - p2, 6) AS first_gap, round(share3, 6) AS share3
FROM (SELECT *, round(round({_clip(f"0.45 * {_clip('(p - 1 / 6.0) / 0.45')} + 0.25 * {_clip('(p - p2) / 0.25')} + 0.15 * share3 + 0.15 * {_clip('(1 - ent) / 0.45')}")} * 100, 9), 1) AS score
      FROM (SELECT f.contest_id, first_slot, p, p2, ent, (SELECT 1) * s.n / 3.0 AS share3 FROM f JOIN s ON f.contest_id = s.contest_id AND f.first_slot = s.slot))
""", q=Q, m=f"SELECT contest_id, a, m, row_number() OVER ({G} ORDER BY round(m, 12) DESC, a) AS n FROM (SELECT contest_id, a, sum(q) AS m FROM q GROUP BY contest_id, a)", f="SELECT contest_id, max(CASE WHEN n = 1 THEN a END) AS first_slot, max(CASE WHEN n = 1 THEN m END) AS p, max(CASE WHEN n = 2 THEN m END) AS p2, -sum(m * ln(greatest(m, 1e-12))) / ln(6.0) AS ent FROM m GROUP BY contest_id", s="SELECT contest_id, a AS slot, sum(CASE WHEN nth <= 3 THEN 1 ELSE 0 END) AS n FROM q GROUP BY contest_id, a"))
def confidence_first_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.first_slot_confidence(ticket_frame(spark, sf_dir))
    return out.select("contest_id", "first_score", "first_label", "first_slot", *[F.round(c, 6).alias(c) for c in ("first_probability", "first_gap", "share3")])


BANDED = "SELECT t.*, label AS confidence, CASE WHEN nth <= 1 THEN 'top1' WHEN nth <= 3 THEN 'top2_3' WHEN nth <= 6 THEN 'top4_6' WHEN nth <= 12 THEN 'top7_12' ELSE 'outside' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY probability DESC, a, b, c) AS nth FROM t) AS t JOIN f USING (contest_id)"
TABLE = "SELECT *, least(2.0, greatest(0.25, 1 + (raw_factor - 1) * n / (n + 300))) AS factor FROM (SELECT *, CASE WHEN predicted > 0 THEN observed / predicted ELSE 1 END AS raw_factor FROM (SELECT confidence, band, count(*) AS n, count(DISTINCT contest_id) AS contests, avg(probability) AS predicted, avg(CAST(is_actual AS INT)) AS observed FROM b GROUP BY confidence, band))"


@query(on_tickets("SELECT confidence, band, n, contests, round(predicted, 9) AS predicted, round(observed, 9) AS observed, round(raw_factor, 6) AS raw_factor, round(factor, 6) AS factor FROM a", q=Q, f=TOP12, b=BANDED, a=TABLE))
def adjustment_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confidence.fit_adjustment(ticket_frame(spark, sf_dir))
    return out.select("confidence", "band", "n", "contests", F.round("predicted", 9).alias("predicted"), F.round("observed", 9).alias("observed"), F.round("raw_factor", 6).alias("raw_factor"), F.round("factor", 6).alias("factor"))


@query(on_tickets("SELECT contest_id, a, b, c, round(x / sum(x) OVER (PARTITION BY contest_id), 9) AS adjusted FROM (SELECT b.*, least(1, greatest(0, probability * coalesce(factor, 1))) AS x FROM b LEFT JOIN a USING (confidence, band))", q=Q, f=TOP12, b=BANDED, a=TABLE))
def adjustment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = ticket_frame(spark, sf_dir)
    return confidence.apply_adjustment(tickets, confidence.fit_adjustment(tickets)).select("contest_id", "a", "b", "c", F.round("adjusted", 9).alias("adjusted"))
