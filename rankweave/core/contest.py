"""The contest view: contests, entrants, outcome and measures, on the given tables.

A contest is an order, an entrant one of its lines. Columns of the view:

contest_id, race_date, contest_no     the contest, its day and its place in the day
slot, position                        number of the entrant, place at the start
entity_id, machine_a, machine_b, site who, with what, where
outcome_rank                          1 is best
lead_time, trial_time                 lower is better; trial_time has nulls
style                                 how the contest was won
raw_score, payout                     a model's score and the payout per 100 staked
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.core.shared import spread

#: The same view in SQL, as the head of a query: select from v.
VIEW_SQL = """
l AS (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS slot
    FROM lineitem
),
v AS (
    SELECT l_orderkey AS contest_id,
           CAST(o_orderdate AS DATE) AS race_date,
           l_orderkey AS contest_no,
           slot,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, slot) AS position,
           l_suppkey AS entity_id,
           l_partkey % 50 AS machine_a,
           l_partkey % 77 AS machine_b,
           o_orderpriority AS site,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, slot) AS outcome_rank,
           l_discount AS lead_time,
           CASE WHEN l_returnflag <> 'N' THEN l_tax END AS trial_time,
           l_linestatus AS style,
           l_quantity / 50 AS raw_score,
           o_totalprice AS payout
    FROM l JOIN orders ON l_orderkey = o_orderkey
)
"""


def contest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle on the contest, in as many parts as the lines need: the join, the three numberings and later windows over the contest share it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = spread(lines, lines.count(), "l_orderkey")  # the count is in the files' footers
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    contest = Window.partitionBy("l_orderkey")
    slots = contest.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    numbered = lines.withColumn("slot", F.row_number().over(slots))
    numbered = numbered.withColumns({"position": F.row_number().over(contest.orderBy("l_shipdate", "slot")), "outcome_rank": F.row_number().over(contest.orderBy(F.desc("l_extendedprice"), "slot"))})
    return numbered.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("contest_id"),
        F.col("o_orderdate").cast("date").alias("race_date"),
        F.col("l_orderkey").alias("contest_no"),
        "slot",
        "position",
        F.col("l_suppkey").alias("entity_id"),
        (F.col("l_partkey") % 50).alias("machine_a"),
        (F.col("l_partkey") % 77).alias("machine_b"),
        F.col("o_orderpriority").alias("site"),
        "outcome_rank",
        F.col("l_discount").alias("lead_time"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("trial_time"),
        F.col("l_linestatus").alias("style"),
        (F.col("l_quantity") / 50).alias("raw_score"),
        F.col("o_totalprice").alias("payout"),
    )
