"""Exact duplicates by salted combining of whole texts.

Three combining steps, and each one groups by the whole text beside its digest:

1. inside every task, by the map side of the first aggregation;
2. per (digest, salt), so that a group with a third of all rows is spread over
   `salts` reducers;
3. over the salt winners, of which a group has at most `salts`.

Equal texts are those that are identical; null counts as the empty text, which
is a text like others. The row with the largest id stays; a null id is smaller
than any other. Of rows that repeat the id and the text, one stays. An empty
table gives an empty result. Other columns may have any name: they are not
read by `exact_groups` and are carried in one struct by `keep_last`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.scratch import text_of, written

SALTS = 64  # the salts of a group fit the bits of a long


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text: the id that stays, the group's size and a bit for each salt that has rows."""
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    bit = F.expr("shiftleft(1L, salt)")
    return salted.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(bit).alias("salts"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for every row of df.

    The digest only routes rows. Where two texts share one, their rows are
    joined to the groups by the text itself.
    """
    rows = _rows(df, id_col, text_col, digest)
    groups = written(
        _groups(rows).select("digest", "keep_id", "group_size", "salts").withColumn("texts", F.count("*").over(Window.partitionBy("digest"))),
        "exact-groups",
    )
    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col("salts"), s) == 1)
    plain = groups.where("texts = 1").select("digest", "keep_id", "group_size", F.explode(present).alias("salt"))
    hexed = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("text", 256)
    slim = rows.select("id", "digest", "salt", hexed.alias("text_sha256"))
    found = slim.join(plain, ["digest", "salt"]).withColumn("nth", F.row_number().over(Window.partitionBy("digest", "salt", "id").orderBy("keep_id")))
    columns = ["id", "keep_id", "group_size", "nth", "text_sha256"]
    found = found.select(columns)
    if groups.where("texts > 1").head(1):
        shared = groups.where("texts > 1").select("digest").distinct()
        some = rows.join(shared, "digest", "left_semi")
        by_text = some.join(_groups(some).drop("salts"), ["digest", "text"])
        by_text = by_text.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "text", "id").orderBy("keep_id")))
        found = found.unionByName(by_text.withColumn("text_sha256", F.sha2("text", 256)).select(columns))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_last(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """df without the rows whose text stays with another row; columns as in df, a null text kept as it was."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col], F.col(text_col).isNull().alias("__null"))
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), digest(text_of(text_col)).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).alias("salt"), row.alias("row"))
    best = F.struct(F.col("id"), F.xxhash64(F.to_json("row")))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max_by("row", best).alias("row"), F.max("id").alias("id"))
    last = salted.groupBy("digest", "text").agg(F.max_by("row", best).alias("row"))
    text = F.when(~F.col("row.__null"), F.col("text")).alias(text_col)
    return last.select([text if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
