"""Line deduplication: a sharded minimal perfect hash over repeated lines, probed by documents.

A line's key is the line without ASCII white space at its ends and with A to Z
lower-cased. Keys of at least `min_chars` code points that more than one
document holds lose their lines everywhere but in the document of smallest id.

1. Spark groups the 128-bit hashes of all keys (a task combines its own first,
   so a line that is in every third document is like any other) and keeps those
   held by two ids.
2. They are dealt into shards of about `shard_lines` by their hash. A task
   builds the minimal perfect hash of a shard: levels of bits, each set where
   exactly one of the keys left falls; the number of set bits before a key's
   own is its place. At their places stand fingerprints (the half of the hash
   that didn't choose the shard), counts of documents and ids of the first ones.
3. Documents are read once more, and their lines probe the shards' files, which
   workers map into memory (`shards`). No line is shuffled for that: a worker
   reads the pages that its lines touch.

A key that isn't in the index fails the comparison with the 64 bits of the
fingerprint, so a foreign line passes with a probability of 2**-64 for each
probe. Two keys count as one if 128 bits of SHA-256 agree.

A null text is empty: one empty line. A null id is an id, smaller than others;
rows that share an id are one document. Equal rows give equal rows. An empty
table gives an empty result. Lines of any length are hashed whole. Other
columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import shards
from rankweave.llm.scratch import text_of, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_LINES = 1 << 16
GAMMA = 2.0  # bits of a level for each key that is left
PROBE_ROWS = 256


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hash_of(line: Column, min_chars: int) -> Column:
    """16 bytes for a line's key, null where the key is too short to be dropped."""
    key = key_of(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.substring(F.sha2(key, 256), 1, 32)))


def _mixed(low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """A hash of the key for each level; both halves take part, so that keys that share one part some time."""
    x = low ^ (high * np.uint64(2 * level + 1)) ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def build(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct (low, high): edges of the levels in words, words of bits, bits set before each word, and the place of each key."""
    left = np.arange(len(low))
    edges, words = [0], []
    where = np.zeros(len(low), np.int64)
    while len(left):
        n_words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = (_mixed(low[left], high[left], len(words)) % np.uint64(64 * n_words)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * n_words) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        where[left[alone[at]]] = 64 * edges[-1] + at[alone[at]]
        edges.append(edges[-1] + n_words)
        left = left[~alone[at]]
    bits = np.concatenate(words) if words else np.empty(0, "<u8")
    before = np.cumsum(np.r_[0, np.bitwise_count(bits)])[:-1].astype(np.int64)
    return np.array(edges, np.int64), bits, before, _place(bits, before, where)


def _place(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word = at >> 6
    under = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(bits[word] & under).astype(np.int64)


def places(edges: np.ndarray, bits: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of each key of the set, some place or -1 for others."""
    out, left = np.full(len(low), -1, np.int64), np.arange(len(low))
    for level in range(len(edges) - 1):
        at = 64 * edges[level] + (_mixed(low[left], high[left], level) % np.uint64(64 * (edges[level + 1] - edges[level]))).astype(np.int64)
        hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        out[left[hit]] = _place(bits, before, at[hit])
        left = left[~hit]
        if not len(left):
            break
    return out


def _halves(hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binary values of 16 bytes as two columns of numbers."""
    flat = hashes.cast(pa.binary(16)) if hashes.type != pa.binary(16) else hashes
    pair = np.frombuffer(flat.buffers()[1], "<u8", count=2 * len(flat), offset=16 * flat.offset) if len(flat) else np.empty(0, "<u8")
    return pair[0::2], pair[1::2]


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(hash, keep, n): keys that at least two ids hold, the smallest of these and the number of rows that hold the key."""
    keys = F.array_distinct(F.transform(F.split(text_of(text_col), "\n", -1), lambda line: hash_of(line, min_chars)))
    held = df.select(F.struct(F.col(id_col).alias("id")).alias("holder"), F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("hash"))
    found = held.groupBy("hash").agg(F.min("holder").alias("keep"), F.max("holder").alias("last"), F.count("*").alias("n"))
    return found.where("keep <> last").select("hash", "keep.id", "n")


def index_lines(repeated: DataFrame, shard_lines: int = SHARD_LINES, folder: str | None = None) -> tuple[str, int]:
    """The shared folder of the index and the number of its shards, from (hash, id, n)."""
    spark = repeated.sparkSession
    rows = written(repeated.select("hash", "id", "n"), "repeated-lines")
    n_shards = max(1, -(-rows.count() // shard_lines))
    uri = shards.new_folder(spark, "line-index", folder)

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.filter(pa.compute.is_valid(table.column("hash"))).combine_chunks()
        hashes = table.column("hash")
        low, high = _halves(hashes.chunk(0) if hashes.num_chunks else pa.array([], pa.binary()))
        edges, bits, before, place = build(low, high)
        ids = table.column("id")
        known = np.asarray(pa.compute.is_valid(ids))
        keep = np.empty((2, len(low)), np.int64)
        keep[0, place] = known
        keep[1, place] = np.asarray(pa.compute.fill_null(ids, 0), np.int64)
        prints, counts = np.empty(len(low), np.uint64), np.empty(len(low), np.uint32)
        prints[place] = high
        counts[place] = np.minimum(np.asarray(table.column("n")), 2**32 - 1)
        shards.save(uri, f"lines-{shard}", edges, bits, before, prints, counts, keep)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(low)], pa.int64())})

    # one row without a hash for each shard, so that every shard has its files
    dealt = rows.select(_shard_of(F.col("hash"), n_shards).alias("shard"), "hash", F.col("id").cast("long").alias("id"), "n")
    every = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n"))
    stored = dealt.unionByName(every).repartitionById(n_shards, F.col("shard")).groupBy("shard").applyInArrow(store, "shard int, n long")
    stored.agg(F.sum("n")).collect()
    return uri, n_shards


def _shard_of(key: Column, n_shards: int) -> Column:
    """By the first six bytes of the hash, read as one number."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 6)), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


class Index:
    """Probes the shards of an index."""

    def __init__(self, uri: str, n_shards: int):
        self.uri, self.n_shards = uri, n_shards

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its count of rows (0: not in the index) and the id that keeps it as (known, id)."""
        counts, keep = np.zeros(len(low), np.int64), np.zeros((2, len(low)), np.int64)
        shard = ((low.byteswap() >> np.uint64(16)) % np.uint64(self.n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(order) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            levels, bits, before, prints, n, ids = shards.load(self.uri, f"lines-{shard[rows[0]]}", 6)
            if not len(prints):
                continue
            at = places(levels, bits, before, low[rows], high[rows])
            hit = (at >= 0) & (prints[at] == high[rows])
            counts[rows[hit]], keep[:, rows[hit]] = n[at[hit]], ids[:, at[hit]]
        return counts, keep


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, shard_lines: int = SHARD_LINES) -> DataFrame:
    """df with its text without repeated lines, and n_lines (before) and n_dropped; columns of these names are replaced.

    The id must be a whole number.
    """
    uri, n_shards = index_lines(repeated_lines(df, id_col, text_col, min_chars), shard_lines)
    others = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    lines = F.split(text_of(text_col), "\n", -1)
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    read = df.select(row, F.col(id_col).cast("long").alias("id"), lines.alias("lines"), F.transform(lines, lambda line: hash_of(line, min_chars)).alias("keys"))
    kinds = {f.name: f.dataType for f in read.schema.fields}
    schema = T.StructType([T.StructField("row", kinds["row"]), T.StructField("lines", kinds["lines"]), T.StructField("dropped", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(uri, n_shards)
        for whole in batches:
            for start in range(0, whole.num_rows, PROBE_ROWS):
                batch = whole.slice(start, PROBE_ROWS)
                keys, ids = batch.column("keys"), batch.column("id")
                flat, sizes = keys.flatten(), np.asarray(pa.compute.list_value_length(keys))
                asked = np.flatnonzero(np.asarray(pa.compute.is_valid(flat)))
                count, (known, first) = index.probe(*_halves(flat.take(pa.array(asked))))
                owner = np.repeat(np.arange(batch.num_rows), sizes)[asked]
                has_id, own = np.asarray(pa.compute.is_valid(ids))[owner], np.asarray(pa.compute.fill_null(ids, 0), np.int64)[owner]
                dropped = np.zeros(len(flat), bool)
                dropped[asked] = (count > 0) & ((has_id != known) | (own != first))
                mask = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(dropped))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lines"), mask], names=schema.names)

    probed = read.mapInArrow(run, schema)
    kept = F.array_join(F.filter("lines", lambda _, i: ~F.get("dropped", i)), "\n").alias(text_col)
    n_dropped = F.size(F.filter("dropped", lambda d: d)).cast("long").alias("n_dropped")
    out = [kept if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    return probed.select(*out, F.size("lines").cast("long").alias("n_lines"), n_dropped)
