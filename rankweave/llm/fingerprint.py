"""Document fingerprints by randomised edit embedding.

A pointer walks over the characters of a text. At every step it writes what it
points at and then moves on or stays, as a random bit says that depends on the
step and the character only. All texts share the bits, so two texts that
differ by an insertion or a deletion fall into step again, and their edit
distance becomes a Hamming distance of what the walks write.

Of the written sequence a fixed random sample of steps is kept: `SAMPLES` in
each octave of steps, so that short and long texts are comparable where both
have written something. What is kept of a step is a hash of the `WINDOW`
characters at the pointer, four bits long. The fingerprint string is the
number of steps in hex, a colon and the samples in hex.

The likeness of two fingerprints is the share of agreeing samples, octaves
weighted by their steps, less what chance gives; steps that only one text has
count as differing.

`similar` finds texts whose fingerprints are alike: bands of sampled bits, drawn
from all steps below a level, name buckets; a text has bands of each level
between 0.8 of its end and its end. The members of a bucket are verified
against each other by all their samples. A pair at the limit 0.8 shares no
band with a probability of 0.001 if the edits are spread out, and of about
0.01 if they all stand at the worst place.

Null counts as the empty text, whose fingerprint has no samples; two of them
are alike (1), an empty and another text are not (0). Rows that share an id
are ordered by their text; null ids come first. The next row of a lone row is
the row itself. Other columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.jaccard import SMALL, block_links, block_units, class_facts
from rankweave.llm.scratch import discard, text_of, written

PERIOD = 1 << 12
SAMPLES, WINDOW, FIRST = 64, 3, 6  # the first octave is the steps below 2**FIRST
CHUNK_CHARS = 1 << 21
FEW = 40  # so many long texts are walked one by one
CHANCE = 1 / 16


@lru_cache(maxsize=1)
def _walk() -> np.ndarray:
    """Steps that a pointer takes on a character class, by class and step modulo the period."""
    bits = np.random.default_rng(20240229).integers(0, 2, (256, PERIOD), dtype=np.int8)
    bits[:, -1] = 1
    stay = np.empty((256, 2 * PERIOD), np.int32)
    until = np.full(256, 2 * PERIOD)
    twice = np.concatenate([bits, bits], 1)
    for j in range(2 * PERIOD - 1, -1, -1):
        until = np.where(twice[:, j] == 1, j, until)
        stay[:, j] = until - j + 1
    return np.minimum(stay[:, :PERIOD], 255).astype(np.uint8).ravel()


def octaves(steps: int) -> list[tuple[int, int]]:
    """Octaves of step numbers that begin below `steps`."""
    found = [(0, 1 << FIRST)] if steps else []
    while found and found[-1][1] < steps:
        found.append((found[-1][1], 2 * found[-1][1]))
    return found


@lru_cache(maxsize=64)
def _samples(low: int, high: int) -> np.ndarray:
    if high - low <= SAMPLES:
        return np.arange(low, high)
    return np.sort(np.random.default_rng([low, high]).choice(high - low, SAMPLES, replace=False)) + low


def _steps(end: int) -> np.ndarray:
    """The sampled steps of a walk that ended after `end` steps."""
    all_ = np.concatenate([_samples(*o) for o in octaves(end)]) if end else np.empty(0, np.int64)
    return all_[all_ < end]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _embed_batch(codes: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Steps and samples of texts that come by falling length, all not empty."""
    n = np.array([len(c) for c in codes])
    k, width = len(codes), int(n[0])
    chars = np.zeros((k, width + WINDOW - 1), np.uint32)
    for i, c in enumerate(codes):
        chars[i, : len(c)] = c
    mixed = chars * np.uint32(2654435761)
    kind = np.where(chars < 256, chars, (mixed >> np.uint32(24))).astype(np.int32)
    rolling = mixed[:, :width] >> np.uint32(7)
    for j in range(1, WINDOW):
        rolling = rolling * np.uint32(0x85EBCA6B) ^ mixed[:, j : width + j] >> np.uint32(5)
    symbol = ((rolling * np.uint32(0xC2B2AE35)) >> np.uint32(28)).astype(np.uint8)
    offset = kind[:, :width] * np.int32(PERIOD)
    walk, at = _walk(), np.zeros(k, np.int32)
    # step by step while many texts go on, then each of the few long ones by itself
    joint = int(n[FEW - 1]) if k >= FEW else 0
    path = np.empty((joint, k), np.int32)
    columns, mask = np.ascontiguousarray(offset[:, :joint].T), np.int32(PERIOD - 1)
    alive = np.searchsorted(-n, -np.arange(1, joint + 1), side="right")
    turns = np.flatnonzero(np.diff(alive, prepend=-1)).tolist() + [joint]
    for first, last in zip(turns, turns[1:], strict=False):
        a = int(alive[first])
        now, place, stay = at[:a], np.empty(a, np.int32), np.empty(a, np.uint8)
        for i in range(first, last):
            path[i, :a] = now
            np.bitwise_and(now, mask, out=place)
            np.add(place, columns[i, :a], out=place)
            walk.take(place, out=stay, mode="clip")
            np.add(now, stay, out=now)
    path = np.ascontiguousarray(path.T)
    table = walk.tobytes()
    out = []
    for d in range(k):
        end, own = int(at[d]), path[d, : n[d]]
        if n[d] > joint:
            rest = []
            for o in offset[d, joint : n[d]].tolist():
                rest.append(end)
                end += table[o + (end & (PERIOD - 1))]
            own = np.concatenate([own, np.array(rest, np.int32)])
        where = np.searchsorted(own, _steps(end), side="right") - 1
        out.append((end, symbol[d, where]))
    return out


def embed(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """Number of steps and sampled symbols of each text."""
    codes = [_codes(t) for t in texts]
    order = sorted((i for i, c in enumerate(codes) if len(c)), key=lambda i: -len(codes[i]))
    out: list[tuple[int, np.ndarray]] = [(0, np.empty(0, np.uint8))] * len(texts)
    start = 0
    while start < len(order):
        widest = len(codes[order[start]])
        stop = start + max(1, 2 * CHUNK_CHARS // widest)
        part = [i for i in order[start:stop] if 4 * len(codes[i]) >= widest]
        for i, found in zip(part, _embed_batch([codes[i] for i in part]), strict=True):
            out[i] = found
        start += len(part)
    return out


def written_out(found: tuple[int, np.ndarray]) -> str:
    end, symbols = found
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[symbols].tobytes().decode()
    return f"{end:x}:{digits}"


def read_back(fingerprint: str) -> tuple[int, np.ndarray]:
    end, _, digits = fingerprint.partition(":")
    return int(end, 16), np.array([int(d, 16) for d in digits], np.uint8)


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    """0 to 1 for two embedded texts."""
    (end_x, a), (end_y, b) = x, y
    if not end_x or not end_y:
        return float(end_x == end_y)
    if end_x == end_y and np.array_equal(a, b):
        return 1.0
    both, longest = min(len(a), len(b)), max(end_x, end_y)
    same = np.cumsum(np.r_[0, a[:both] == b[:both]])
    total, done = 0.0, 0
    for low, high in octaves(longest):
        steps = _samples(low, high)
        n = int((steps < longest).sum())
        if n:
            share = (same[min(done + n, both)] - same[min(done, both)]) / n
            total += (min(high, longest) - low) * max(0.0, (share - CHANCE) / (1 - CHANCE))
        done += n
    return min(1.0, total / longest)


ORDERED = ["part", "borrowed", "id", "text", "print", "class_id", "links"]


def _in_order(df: DataFrame, id_col: str, text_col: str, near: DataFrame | None = None) -> DataFrame:
    """Rows dealt by ranges of the id and sorted in them, each range followed by the first row of the next one.

    The ranges are cut at quantiles of the id; what the driver sees are the
    cuts and the smallest id of each range, as many as there are partitions.
    near: rows (id, print, class_id, links), put before the texts of their id.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", shares or [0.5], 10 * parts).alias("q")).head()["q"] if shares else None
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right").astype(np.int32))

    # a missing value would make the column float, and ids beyond 2**53 would lose digits: none gets there
    own_part = F.when(F.col("id").isNull(), 0).otherwise(part_of(F.coalesce("id", F.lit(0)))) if len(edges) else F.lit(0)
    rows = rows.withColumn("part", own_part)
    firsts = sorted((r["part"], r["nulls"], r["id"]) for r in rows.groupBy("part").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("nulls")).collect())
    if not firsts:
        return rows.withColumn("borrowed", F.lit(0)).selectExpr(*ORDERED[:4], "cast(null as binary) print", "0L class_id", "0L links")
    pairs = [(firsts[k - 1][0], None if nulls else first) for k, (_, nulls, first) in enumerate(firsts)]
    wanted = spark.createDataFrame(pairs, "to int, first long")
    lent = rows.drop("part").join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("first")))
    both = rows.withColumn("borrowed", F.lit(0)).unionByName(lent.select("id", "text", F.col("to").alias("part"), F.lit(1).alias("borrowed")))
    both = both.selectExpr(*ORDERED[:4], "cast(null as binary) print", "0L class_id", "0L links")
    if near is not None:
        both = both.unionByName(near.withColumn("part", own_part).selectExpr("part", "0 borrowed", "id", "'' text", "print", "class_id", "links"))
    return both.repartition(parts, "part").sortWithinPartitions("part", "borrowed", F.asc_nulls_first("id"), F.col("print").isNull(), "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: DataFrame | None = None) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of each text.

    The edited text has the last half of a text replaced by the beginning of
    the next one, by rising id. With near, the linked rows of `similar_prints`,
    class_id and links follow.
    """
    schema = f"`{id_col}` long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    linking = near is not None
    if linking:
        schema, names = schema + ", class_id long, links long", [*names, "class_id", "links"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (part, borrowed, id, text, linked); all but the last of a part have their next one behind them."""
        texts = [r[3] for r in rows]
        at = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
        found = embed(texts + edited)
        own, changed = found[: len(texts)], found[len(texts) :]
        columns = [
            pa.array([rows[i][2] for i in at], pa.int64()),
            pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([written_out(own[i]) for i in at], pa.string()),
            pa.array([written_out(c) for c in changed], pa.string()),
            pa.array([likeness(own[i], c) for i, c in zip(at, changed, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
        ]
        if linking:
            facts = [rows[i][4].get(packed(own[i]), (rows[i][2], 0)) for i in at]
            columns += [pa.array([f[k] for f in facts], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        linked_id, linked = None, {}  # the facts of the id that the rows have come to, by print
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for *row, own, class_id, links in zip(*(part.column(c).to_pylist() for c in ORDERED), strict=True):
                    if linked_id != row[:3]:
                        linked_id, linked = row[:3], {}
                    if own is not None:
                        linked[own] = (class_id, links)
                        continue
                    held.append((*row, linked))
                    size += len(row[3])
                    if size > CHUNK_CHARS and len(held) > 1:
                        yield solve(held)
                        held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield solve(held)

    return _in_order(df, id_col, text_col, near).select(*ORDERED).mapInArrow(run, schema)


BANDS, WIDTH, NARROW = 20, 8, 6  # bands of a level; a band takes WIDTH samples, NARROW where a level has under 128 steps
LEVEL = 1.118  # two texts of likeness 0.8 share two levels, or one where their ends differ by a tenth or more


@lru_cache(maxsize=1)
def _levels() -> np.ndarray:
    """Numbers of steps that bands are drawn from, rising."""
    return np.unique((LEVEL ** np.arange(1 + int(np.log(2.0**40) / np.log(LEVEL)))).astype(np.int64))


@lru_cache(maxsize=512)
def _bands(steps: int) -> np.ndarray:
    """For each band of a level the places of its samples, drawn as the likeness weighs them."""
    weights = []
    for low, high in octaves(steps):
        n = int((_samples(low, high) < steps).sum())
        weights += [(min(high, steps) - low) / max(n, 1)] * n  # a level that just enters an octave may have no sample of it
    share = np.array(weights) / sum(weights)
    rng, width = np.random.default_rng([7, steps]), min(len(share), NARROW if steps < 128 else WIDTH)
    drawn = np.unique([np.sort(rng.choice(len(share), width, replace=False, p=share)) for _ in range(BANDS)], axis=0)
    return np.pad(drawn, ((0, 0), (0, WIDTH - width)), mode="edge")


@lru_cache(maxsize=512)
def _places(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands of some levels, one behind the other, and the number of each."""
    levels = [int(t) for t in _levels()[first:last]]
    numbers = np.concatenate([np.uint64(1000 * t) + np.arange(len(_bands(t)), dtype=np.uint64) for t in levels])
    return np.concatenate([_bands(t) for t in levels]), numbers


def band_keys(found: tuple[int, np.ndarray], least: float = 0.8) -> np.ndarray:
    """Bucket keys of a text, from all levels that it may share with a text whose likeness is `least`; none if it is empty.

    A level's bands are drawn from all steps below it, so it doesn't matter
    where in the texts the edits are.
    """
    end, symbols = found
    if not end:
        return np.empty(0, np.int64)
    first, last = np.searchsorted(_levels(), [max(1, least * end), end], side="right")
    places, mixed = _places(int(first) - 1, int(last))
    for column in symbols.astype(np.uint64)[places].T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.astype(np.int64)


def packed(found: tuple[int, np.ndarray]) -> bytes:
    """A fingerprint in bytes: steps, number of samples, two samples a byte."""
    end, symbols = found
    even = np.pad(symbols, (0, len(symbols) % 2))
    return end.to_bytes(8, "little") + len(symbols).to_bytes(2, "little") + (even[::2] << 4 | even[1::2]).tobytes()


def unpacked(data: bytes) -> tuple[int, np.ndarray]:
    pairs = np.frombuffer(data, np.uint8, offset=10)
    return int.from_bytes(data[:8], "little"), np.stack([pairs >> 4, pairs & 15], 1).ravel()[: int.from_bytes(data[8:10], "little")]


def alike(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the fingerprints, as bytes, are alike."""
    a, b = ([unpacked(x.tobytes()) for x in side] for side in (left, right))
    ends_a, ends_b = np.array([e for e, _ in a]), np.array([e for e, _ in b])
    longest = np.maximum(ends_a[:, None], ends_b)
    width = max(len(s) for _, s in (*a, *b))
    table = lambda side, gap: np.stack([np.pad(s, (0, width - len(s)), constant_values=gap) for _, s in side])
    x, y = table(a, 254), table(b, 255)
    total, done = np.zeros(longest.shape), 0
    for low, high in octaves(int(longest.max())):
        steps = _samples(low, high)
        same = np.zeros(longest.shape, np.float32)
        for k in range(done, min(done + len(steps), width)):
            same += x[:, k][:, None] == y[:, k]
        n = np.searchsorted(steps, longest)
        share = same / np.maximum(n, 1)
        weight = np.clip(longest - low, 0, high - low)
        total += np.where(n > 0, weight * np.maximum(0, (share - CHANCE) / (1 - CHANCE)), 0)
        done += len(steps)
    return np.where(longest > 0, total / np.maximum(longest, 1), 1) >= least


def merge_buckets(members: DataFrame) -> DataFrame:
    """(node, leaf) of members (node, leaf, n): buckets that mostly lie in a larger one become a part of it.

    A node's home is its largest bucket. A bucket takes the name of the largest
    home among its members if at least half of them live there. Nodes that
    share a bucket still share one, and near copies, which share dozens of
    buckets, are compared once.
    """
    by_node, by_leaf = Window.partitionBy("node"), Window.partitionBy("leaf")
    homes = members.withColumn("home", F.max(F.struct("n", "leaf")).over(by_node)).withColumn("top", F.max("home").over(by_leaf))
    inside = F.sum((F.col("home") == F.col("top")).cast("long")).over(by_leaf)
    name = F.when(2 * F.col("inside") >= F.col("n"), F.col("top.leaf")).otherwise(F.col("leaf"))
    return homes.withColumn("inside", inside).select("node", name.alias("leaf")).distinct()


def similar_prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, small: int = SMALL) -> DataFrame:
    """(id, print, class_id, links) of each row: the packed fingerprint and what `similar` gives.

    Keys are dealt once; of buckets with the same members one is compared, and
    buckets that overlap are merged first.
    """

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(f) for f in embed(part.column(1).to_pylist())], pa.binary())], names=["id", "print"])

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = [np.unique(band_keys(unpacked(p), least)) for p in part.column(1).to_pylist()]
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), list(map(len, keys)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(keys), pa.int64())], names=["node", "bucket"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    prints = written(rows.mapInArrow(prints_of, "id long, print binary"), "fingerprint-prints")
    classes = prints.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    key = F.to_binary(F.lpad(F.hex("node"), 16, "0"), F.lit("hex")).alias("set_key")
    classes = written(classes, "fingerprint-classes").select("print", "least", "copies", "node", key)
    mix, same = F.xxhash64("node"), Window.partitionBy("bucket")
    counted = [F.count("*").over(same).alias("n"), F.sum(F.shiftright(mix, 30)).over(same).alias("x"), F.sum(F.shiftright(F.xxhash64(mix), 30)).over(same).alias("y")]
    shared = classes.select("node", "print").mapInArrow(keys_of, "node long, bucket long").select("node", *counted).where("n > 1")
    own = written(shared.select("node", F.xxhash64("n", "x", "y").alias("leaf"), "n").distinct(), "fingerprint-buckets")
    merged = written(merge_buckets(own), "fingerprint-merged")
    sizes = merged.groupBy("leaf").agg(F.count("*").alias("n"))
    leaves = written(merged.join(sizes, "leaf").select(key, "leaf", "n"), "fingerprint-leaves")
    lists = leaves.groupBy("set_key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    ready = lists.join(classes.select("set_key", "copies", F.col("print").alias("shingles")), "set_key")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = block_units(leaves, small).join(ready, "set_key").repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "set_key")
    partial = written(block_links(placed, lambda a, b: alike(a, b, least), np.uint8), "fingerprint-links")
    facts, joined = class_facts(classes, partial, "fingerprint")
    for used in (own, merged, leaves, partial, joined):
        discard(used)
    known = classes.select("set_key", "print").join(facts, "set_key").select("print", "class_id", "links")
    return prints.join(known, "print").select("id", "print", "class_id", "links")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, small: int = SMALL) -> DataFrame:
    """(id, class_id, links): texts joined by chains of fingerprints whose likeness is `least` or more.

    Equal fingerprints form a class; classes that share a bucket are compared
    in blocks, a pair in the first bucket that both are in. Empty texts are
    alike.
    """
    return similar_prints(df, id_col, text_col, least, small).select(F.col("id").alias(id_col), "class_id", "links")


def linked_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`fingerprints` with the class_id and links of `similar` behind."""
    near = similar_prints(df, id_col, text_col).where("links > 0").distinct()
    return fingerprints(df, id_col, text_col, near=written(near, "fingerprint-near"))
