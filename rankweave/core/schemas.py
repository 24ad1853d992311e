"""Schemas of the two record tables; never inferred."""

from pyspark.sql import types as T


def _schema(**kinds: str) -> T.StructType:
    of = {"str": T.StringType(), "date": T.DateType(), "int": T.LongType(), "float": T.DoubleType()}
    return T.StructType([T.StructField(name, of[kind]) for name, kind in kinds.items()])


ENTRY = _schema(contest_id="str", race_date="date", site="str", contest_no="int", title="str", slot="int", entity_id="int", entity_name="str", age="int", weight="float", grade="str", win_rate="float", place_rate="float", machine_a="int", machine_a_rate="float", machine_b="int", machine_b_rate="float", meet_results="str")
RESULT = _schema(contest_id="str", race_date="date", site="str", contest_no="int", slot="int", outcome_rank="int", outcome_status="str", entity_id="int", entity_name="str", machine_a="int", machine_b="int", trial_time="float", position="int", lead_time="float", clock="float", weather="str", wind_direction="str", wind_speed="int", wave="int", style="str", payout="float")
