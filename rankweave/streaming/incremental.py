"""A history table that is built chunk by chunk in time order, from tails of rows that each key family carries on.

A chunk's rows are put behind the rows that their keys have carried, the
windows of `operators.history` run over both, and the carried rows leave again:
the features are those of one run over all rows, however the rows are cut. Per
key a family carries as many rows as its longest window and the number of rows
seen so far, so state has a bound for each key and doesn't grow with time. A row
is carried once, with a bit for each family: what is carried for another family
is older than all that a family's windows reach.

Families of few keys come first, in one shuffle by time of rows that are narrow
yet; those that share a key follow, and tell in the same shuffle which rows
their keys carry on. Everything of a step lies in folders of its version, which
is the chunk's number: rows/version=n has the chunk's rows, and with them older
ones that are still carried; state/version=n has what families of few keys
carry. State is written last and without it a version doesn't count: a step that
was lost is run again and writes the same rows. A version that counts isn't run
again, so a stream may hand a chunk over twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rankweave.core.shared import dealt
from rankweave.operators.history import Feature, rolling_history, rolling_together


class Family(NamedTuple):
    """Rolling features of one key; block: see rolling_history, for few keys of very many rows."""

    keys: tuple[str, ...]
    features: tuple[Feature, ...]
    block: int | None = None

    @property
    def longest(self) -> int:
        return max(f.window for f in self.features)


class Build:
    """The build in a shared folder. The order must be total, and its first column a day."""

    def __init__(self, spark: SparkSession, folder: str, families: Sequence[Family], order: Sequence[str], counted: str | None = None, strict: bool = True):
        """counted: name of a column for how many rows the first family's key has had before.

        strict: whether a chunk must begin on a later day than all before it.
        """
        self.spark, self.folder, self.families, self.order, self.counted, self.strict = spark, folder.rstrip("/"), list(families), list(order), counted, strict
        columns = [*(k for f in families for k in f.keys), *order, *(x.source for f in families for x in f.features)]
        self.carried = list(dict.fromkeys([*columns, *([counted] if counted else [])]))

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def last_version(self) -> int:
        """The last version whose state is complete, -1 before the first; versions are numbered without a gap."""
        n = -1
        while self._exists(f"{self.folder}/state/version={n + 1}/_SUCCESS"):
            n += 1
        return n

    def _mask(self, few: bool) -> int:
        """A bit for each family, of few keys or of others."""
        return sum(1 << i for i, f in enumerate(self.families) if (f.block is not None) == few)

    def _state(self, version: int, few: bool) -> DataFrame:
        """Rows that were carried, __families with the bits of those that they are carried for."""
        df = self.spark.read.parquet(f"{self.folder}/{'state' if few else 'rows'}/version={version}")
        return df.where(F.col("__families").bitwiseAND(F.lit(self._mask(few))) != 0).select(*self.carried, "__families")

    def advance(self, chunk: DataFrame, version: int | None = None) -> None:
        """Add a chunk of later rows: its features become version's rows, its ends the new state."""
        last = self.last_version()
        version = last + 1 if version is None else version
        if version <= last:
            return
        if version > last + 1:
            raise ValueError(f"version {version} can't follow {last}")
        if last >= 0 and self.strict:
            self._check_order(chunk, last)
        few = [f for f in self.families if f.block is not None]
        rows = chunk
        if few:
            both = self._behind(rows, last, True)
            bare = self._behind(chunk.select(*dict.fromkeys([c for f in few for c in f.keys] + self.order)), last, True)  # what blocks are counted on
            both = rolling_together(self._counted(both, True), [(f.keys, f.features) for f in few], self.order, sum(f.block for f in few), bare)
            rows = both.where(F.col("__families").isNull()).drop("__families")
        shared = self._shared()
        both = (self._behind(rows, last, False) if shared else rows.withColumn("__families", F.lit(None).cast("int"))).withColumn("__next", F.lit(0))
        both = both.withColumn("__older", F.col("__families").isNotNull())
        size = chunk.count() + (self._state(last, False).count() if last >= 0 else 0)
        for key, members in shared:
            # of families that share a key rows and carried ones meet in one shuffle, and which of them are carried on is told there
            both = dealt(both, 2 * size, key)  # rows get wide
            for i in sorted(members, key=lambda i: len(self.families[i].features)):  # those of most features last: later sorts carry what earlier ones found
                family, mine = self.families[i], self._mine(i)
                both = both if i else self._counted(both, False)
                both = rolling_history(both, family.keys, self.order, family.features)
                own = Window.partitionBy(*family.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
                behind = F.count(F.when(mine, 1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.count(F.when(mine, 1)).over(own)
                both = both.withColumn("__next", F.col("__next") + F.when(mine & (behind < family.longest), 1 << i).otherwise(0))
        out = {x.out for f in self.families if f.block is None for x in f.features}
        rows = both.where(~F.col("__older") | (F.col("__next") != 0)).select(*[F.when(~F.col("__older"), F.col(c)).alias(c) if c in out else c for c in both.columns if c not in ("__families", "__next")], F.col("__next").alias("__families"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/version={version}")
        self._write_state(last, version)

    def _mine(self, i: int) -> Column:
        """Of new rows and those carried: what is carried for the family, or new."""
        return F.col("__families").isNull() | (F.col("__families").bitwiseAND(F.lit(1 << i)) != 0)

    def _behind(self, rows: DataFrame, last: int, few: bool) -> DataFrame:
        """rows behind those that are carried; __families is null in rows."""
        rows = rows.withColumn("__families", F.lit(None).cast("int"))
        if last < 0:
            return rows
        state = self._state(last, few)
        return rows.unionByName(state.select(*[c for c in state.columns if c in rows.columns or c == self.counted]), allowMissingColumns=True)

    def _shared(self) -> list[tuple[str, list[int]]]:
        """Families without blocks, by a key that they share."""
        out: list[tuple[str, list[int]]] = []
        for i, family in enumerate(self.families):
            if family.block is not None:
                continue
            mine = next((members for key, members in out if key in family.keys), None)
            if mine is None:
                out.append((family.keys[0], mine := []))
            mine.append(i)
        return out

    def _counted(self, both: DataFrame, few: bool) -> DataFrame:
        """Of the rows carried before the last one knows how many there were."""
        if not self.counted or (self.families[0].block is not None) != few:
            return both
        upto = Window.partitionBy(*self.families[0].keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        is_new = F.col("__families").isNull()
        new = F.count(F.when(is_new, 1)).over(upto) - 1
        if self.counted not in both.columns:
            return both.withColumn(self.counted, new)
        before = F.coalesce(F.max(self.counted).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1, F.lit(0))
        return both.withColumn(self.counted, F.when(is_new, before + new).otherwise(F.col(self.counted)))

    def _check_order(self, chunk: DataFrame, last: int) -> None:
        day = self.order[0]
        first = chunk.agg(F.min(day)).head()[0]
        carried = self._read("rows", last).select(day).unionByName(self._read("state", last).select(day)).agg(F.max(day)).head()[0]
        if first is not None and carried is not None and first <= carried:
            raise ValueError(f"a chunk that begins on {first} can't follow rows of {carried}")

    def _read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}/version={version}")

    def _write_state(self, last: int, version: int) -> None:
        """The last rows of few keys, from the days that hold them; without such families no row, but the version counts from then on."""
        new = self._read("rows", version).where(~F.col("__older")).select(*self.carried, F.lit(None).cast("int").alias("__families"))
        few = [(i, f) for i, f in enumerate(self.families) if f.block is not None]
        both = new.unionByName(self._state(last, True)) if few and last >= 0 else new
        near, day = F.lit(False), F.col(self.order[0])
        found = both
        for i, family in few:
            names = {k: f"__k{i}_{j}" for j, k in enumerate(family.keys)}
            days = both.where(self._mine(i)).groupBy(*[F.col(k).alias(n) for k, n in names.items()], day.alias("__d")).agg(F.count("*").alias("__n"))
            later = F.sum("__n").over(Window.partitionBy(*names.values()).orderBy(F.desc("__d")).rowsBetween(Window.unboundedPreceding, -1))
            starts = days.withColumn("__later", F.coalesce(later, F.lit(0))).where(F.col("__later") < family.longest).groupBy(*names.values()).agg(F.min("__d").alias(f"__from{i}"))
            same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
            found = found.join(F.broadcast(starts), same, "left").drop(*names.values())
            near = near | F.coalesce(self._mine(i) & (day >= F.col(f"__from{i}")), F.lit(False))
        found = found.where(near).drop(*[f"__from{i}" for i, _ in few])
        carried = F.lit(0)
        for i, family in few:
            place = F.row_number().over(Window.partitionBy(*family.keys, self._mine(i)).orderBy(*[F.desc(c) for c in self.order]))
            carried = carried + F.when(self._mine(i) & (place <= family.longest), 1 << i).otherwise(0)
        state = found.withColumn("__carried", carried).where(F.col("__carried") != 0).select(*self.carried, F.col("__carried").alias("__families"))
        state.write.mode("overwrite").parquet(f"{self.folder}/state/version={version}")

    def rows(self) -> DataFrame:
        """All rows of the versions that count."""
        last = self.last_version()
        if last < 0:
            raise ValueError(f"nothing was built in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/rows").where((F.col("version") <= last) & ~F.col("__older")).drop("version", "__older", "__families")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Advance with every micro-batch of a stream of later and later rows, until all that is there now is read.

        What one trigger reads is bounded by the source (maxFilesPerTrigger).
        """
        return stream.writeStream.foreachBatch(lambda chunk, n: self.advance(chunk, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
