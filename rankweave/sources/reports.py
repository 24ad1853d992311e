"""Daily text reports to tables: lines are rows, and what a line says is carried on by windows over its file.

A file is small (a day's contests), so a window over a file is a small task,
however many files there are.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions import dates, text

# The layout of the reports.
SECTION = r"^\s*(\d{2})[BK]BGN\s*$"
CONTEST_NO = r"^\s*(\d{1,3})R\s"
DISTANCE = r"H\d+m"
WIND, WAVE = "風", "波"
GRADE = r"[AB]\d"
PAYOUT = r"^\s*(?:３連単|3連単)\s+([1-6]-[1-6]-[1-6])\s+(\d+)\b"
STYLE = r"決まり手\s+(\S+)"
CLOCK_LABELS = ("レースタイム", "ﾚｰｽﾀｲﾑ")
STYLES = ("まくり差し", "まくり", "恵まれ", "逃げ", "差し", "抜き")  # longest first
SITE = r"^\s*([^\d\s]{1,6})\s*(?:［成績］|\[成績\]|競艇場|競走場|ボートレース)"
DEADLINE = r"^\s*(\d{1,3})R.*予定(?:時刻)?\s*(\d{1,2}):(\d{2})"


def decoded(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """(file, content) of text files in an old encoding, bytes that don't belong to it left out."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(encoding, "ignore"))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decode("content").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line): wide spaces, digits and marks made plain."""
    return files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).withColumn("plain", text.narrow(F.translate("line", "Ｒ Ｈ ｍ", "R H m")))


def _got(pattern: str, group: int = 1, of: str = "plain") -> Column:
    return F.nullif(F.regexp_extract(of, pattern, group), F.lit(""))


def is_header() -> Column:
    """A contest's first line: its number and, further on, a distance."""
    return F.col("plain").rlike(CONTEST_NO) & F.col("plain").rlike(DISTANCE)


def _after(x: Column, mark: str) -> Column:
    """What follows the first mark; null where it doesn't occur."""
    at = F.instr(x, F.lit(mark))
    return F.when(at > 0, F.substr(x, at + len(mark)))


def _before(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, 1)


def conditions() -> Column:
    """(weather, wind_direction, wind_speed, wave) of a header line, null where it names no wind and wave."""
    behind = F.regexp_replace("plain", r"^.*?" + DISTANCE, "")
    wind = F.split(F.trim(_before(_after(behind, WIND), WAVE)), r"\s+")
    number = lambda x, unit: F.regexp_extract(x, r"(\d+)" + unit, 1).try_cast("long")
    speed, direction = number(F.element_at(wind, -1), "m"), F.array_join(F.slice(wind, 1, F.greatest(F.size(wind) - 1, F.lit(0))), " ")
    fields = F.struct(text.collapse(_before(behind, WIND)).alias("weather"), text.collapse(direction).alias("wind_direction"), speed.alias("wind_speed"), number(_after(behind, WAVE), "cm").alias("wave"))
    return F.when(is_header() & behind.contains(WIND) & behind.contains(WAVE), fields)


def with_result_fields(rows: DataFrame, where: Column) -> DataFrame:
    """rows with `row`, (token, slot, entity_id, name, machine_a, machine_b, tail) of a result line, null for other lines.

    Three words stand before the name: outcome, slot and a number of four
    digits or more. The name ends where two whole numbers follow each other; what is
    behind them is the tail. Words and the name's end are columns of their own,
    so a line is split once.
    """
    words, at = F.col("__words"), F.col("__end")
    word = lambda k: F.try_element_at(words, k if isinstance(k, Column) else F.lit(k))
    whole = F.transform(words, lambda w: w.rlike(r"^\d+$"))
    both = F.zip_with(F.slice(whole, 5, F.greatest(F.size(words), F.lit(1))), F.slice(whole, 6, F.greatest(F.size(words), F.lit(1))), lambda x, y: F.coalesce(x & y, F.lit(False)))
    rest = lambda start, n: F.slice(words, start, F.greatest(n, F.lit(0)))
    fields = F.struct(
        word(1).alias("token"), word(2).try_cast("long").alias("slot"), word(3).try_cast("long").alias("entity_id"), F.array_join(rest(4, at - 4), "").alias("name"),
        word(at).try_cast("long").alias("machine_a"), word(at + 1).try_cast("long").alias("machine_b"), F.array_join(rest(at + 2, F.size(words) - at - 1), " ").alias("tail"),
    )
    shaped = word(1).rlike(r"^[0-9A-Z]{1,2}$") & word(2).rlike(r"^[1-6]$") & word(3).rlike(r"^\d{4,}$")
    split = F.filter(F.split("plain", r"\s+"), lambda w: w != "")
    rows = rows.withColumn("__words", F.when(where, split)).withColumn("__end", F.when(shaped, F.array_position(both, F.lit(True)) + 4).cast("int"))
    return rows.withColumn("row", F.when(at > 4, fields)).drop("__words", "__end")


def entry_fields() -> Column:
    """(slot, entity_id, name, age, weight, grade, numbers, tail) of a programme line, null for other lines.

    The grade divides the line: who it is before it, eight numbers and the
    meet's results behind it. Decimals have two digits, which tells numbers
    apart that stand without a space.
    """
    number = r"\d+\.\d\d|\d+"
    grade = F.regexp_extract("plain", r"\d(" + GRADE + r")\s", 1)
    head, behind = F.regexp_extract("plain", r"^(.*?\d)" + GRADE + r"\s", 1), F.regexp_extract("plain", r"\d" + GRADE + r"\s(.*)$", 1)
    who = F.regexp_extract(head, r"^\s*[1-6]\s+\d{4,}(.*)$", 1)
    ages = F.regexp_extract_all(who, F.lit(r"(\d+)"), F.lit(1))
    numbers = F.regexp_extract_all(behind, F.lit(f"({number})"), F.lit(1))
    fields = F.struct(
        F.regexp_extract(head, r"^\s*([1-6])\s", 1).try_cast("long").alias("slot"), F.regexp_extract(head, r"^\s*[1-6]\s+(\d{4,})", 1).try_cast("long").alias("entity_id"), F.regexp_extract(who, r"^(\D+)", 1).alias("name"),
        F.try_element_at(ages, F.lit(1)).try_cast("long").alias("age"), F.try_element_at(ages, F.lit(2)).try_cast("double").alias("weight"), grade.alias("grade"),
        numbers.alias("numbers"), F.trim(F.regexp_replace(behind, rf"^\s*(?:(?:{number})\s*){{8}}", "")).alias("tail"),
    )
    return F.when((grade != "") & (who != "") & (F.size(ages) >= 2) & (F.size(numbers) >= 8), fields)


def carried(rows: DataFrame) -> DataFrame:
    """Lines with section, site, day and contest number of the last line before that had one, and dashes since the header."""
    seen = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    day = dates.text_date(F.col("line"))
    site = text.without_spaces(_got(SITE, of="line"))
    # the first site and day of the head count for lines before them
    facts = {"section": _got(SECTION), "site": site, "race_date": day, "contest_no": F.when(is_header(), _got(CONTEST_NO)).try_cast("int"), "header_line": F.when(is_header(), F.col("line_no"))}
    rows = rows.withColumns({f"_{k}": v for k, v in facts.items()})
    rows = rows.withColumns({k: F.last(f"_{k}", ignorenulls=True).over(seen) for k in facts})
    rows = rows.withColumns({k: F.coalesce(k, F.first(f"_{k}", ignorenulls=True).over(whole)) for k in ("site", "race_date")})
    since = Window.partitionBy("file", "header_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    dashes = F.count_if(F.col("plain").startswith("-")).over(since)
    key = F.concat_ws("_", F.col("race_date").cast("string"), F.coalesce("section", "site"), F.lpad(F.col("contest_no").cast("string"), 2, "0"))
    return rows.withColumns({"dashes": dashes, "contest_id": F.when(F.col("contest_no").isNotNull() & F.col("race_date").isNotNull(), key)}).drop(*[f"_{k}" for k in facts])


def _contest() -> list[Column]:
    """What tells contests apart: a contest_id keeps two digits of the number."""
    return [F.col("race_date"), F.coalesce("section", "site"), F.col("contest_no")]


def _first_six(rows: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("file", "header_line").orderBy("line_no"))
    return rows.withColumn("nth", nth).where("nth <= 6").drop("nth")


def payouts(rows: DataFrame) -> DataFrame:
    """(contest_id, race_date, site, contest_no, ticket, payout) of the ordered bet, the first of each contest."""
    found = carried(rows).where(F.col("plain").rlike(PAYOUT) & F.col("contest_id").isNotNull())
    first = F.row_number().over(Window.partitionBy(*_contest()).orderBy("file", "line_no"))
    return found.withColumn("n", first).where("n = 1").select("contest_id", "race_date", "site", "contest_no", _got(PAYOUT).alias("ticket"), _got(PAYOUT, 2).try_cast("double").alias("payout"))


def results(rows: DataFrame) -> DataFrame:
    """One row for each entrant with outcome, measures, the contest's weather, style and payout.

    A line is parsed once, into a struct by its sort. What a contest's other
    lines say is carried in one struct, and only entrant and payout lines go on.
    """
    since = Window.partitionBy("file", "header_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    plain = F.col("plain")
    # the last column of the table's head is the clock; the contest's style stands behind its label
    table_head = _got(rf"(?:{'|'.join(CLOCK_LABELS)})\s*({'|'.join(STYLES)})")
    style = text.collapse(F.coalesce(_got(STYLE), table_head))
    at = carried(rows).where("contest_no is not null")
    at = at.withColumns({"sky": conditions(), "style": style, "paid": _got(PAYOUT, 2).try_cast("double")})
    at = with_result_fields(at, (F.col("dashes") >= 1) & F.col("paid").isNull())
    at = at.withColumns({c: F.last(c, ignorenulls=True).over(since) for c in ("sky", "style")}).where("row is not null or paid is not null")
    contest = Window.partitionBy(*_contest()).orderBy("file", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.withColumn("payout", F.first("paid", ignorenulls=True).over(contest))
    found = _first_six(at.where("row is not null"))
    token, tail = text.rank_token(F.col("row.token")), text.tail_fields(F.col("row.tail"))
    return found.select(
        "contest_id", "race_date", "site", F.col("contest_no").cast("long").alias("contest_no"), "row.slot", token["rank"].cast("long").alias("outcome_rank"), token["status"].alias("outcome_status"),
        "row.entity_id", text.without_spaces(F.col("row.name")).alias("entity_name"), "row.machine_a", "row.machine_b", tail["trial"].alias("trial_time"),
        tail["position"].cast("long").alias("position"), tail["lead"].alias("lead_time"), tail["clock"].alias("clock"), "sky.weather", "sky.wind_direction", "sky.wind_speed", "sky.wave", "style", "payout",
    )


ENTRY_NUMBERS = ("win_rate", "place_rate", "site_win_rate", "site_place_rate", "machine_a", "machine_a_rate", "machine_b", "machine_b_rate")


def entries(rows: DataFrame) -> DataFrame:
    """One row for each entrant of a programme."""
    at = carried(rows).withColumn("row", entry_fields())
    found = _first_six(at.where("dashes >= 2 and contest_id is not null and row is not null"))
    number = lambda k, name: F.element_at("row.numbers", k).try_cast("long" if name in ("machine_a", "machine_b") else "double").alias(name)
    results_so_far = F.nullif(F.trim(text.trailing_digit(F.col("row.tail"))["head"]), F.lit(""))
    return found.select(
        "contest_id", "race_date", "site", F.col("contest_no").cast("long").alias("contest_no"), "row.slot", "row.entity_id", text.without_spaces(F.col("row.name")).alias("entity_name"), "row.age", "row.weight", "row.grade",
        *[number(k, name) for k, name in enumerate(ENTRY_NUMBERS, 1)], results_so_far.alias("meet_results"),
    )


def schedule(rows: DataFrame) -> DataFrame:
    """(file, section, contest_no, hour, minute) of the deadlines of programmes."""
    seen = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("section", F.last(_got(SECTION), ignorenulls=True).over(seen))
    found = at.where(F.col("section").isNotNull() & F.col("plain").rlike(DEADLINE))
    number = lambda g: _got(DEADLINE, g).try_cast("int")
    last = F.row_number().over(Window.partitionBy("file", "section", "contest_no").orderBy(F.desc("line_no")))
    out = found.select("file", "line_no", "section", number(1).alias("contest_no"), number(2).alias("hour"), number(3).alias("minute"))
    return out.withColumn("n", last).where("n = 1").select("file", "section", "contest_no", "hour", "minute")
