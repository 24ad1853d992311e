"""Byte-level BPE encoding and decoding on padded numpy matrices.

Distinct pre-tokens are dealt into length buckets. A bucket is a matrix with a
row for each pre-token and padding behind it; in every round each row merges
its leftmost pair of minimum rank, found by a hashed lookup of all pairs, and
rows without a pair left leave the matrix (compaction). As every row loses one
symbol a round, the matrix loses a column.

A null text is encoded as the empty text: no ids. Ids are packed as
little-endian unsigned 32-bit integers, so that a very long text is one binary
value. Other columns pass through untouched under any name. Repeated rows are
encoded each for itself, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankweave.llm.pretoken import WordCache, blocks
from rankweave.llm.scratch import free_name

NONE = np.int32(2**31 - 1)  # rank of a pair that no merge joins
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
ROWS = 1 << 13


class PairTable:
    """(left, right) to a value, by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        size = 1 << max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], value[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(29)).astype(np.int64) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values, NONE where there is none; a negative symbol never matches."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NONE)
        out[(left < 0) | (right < 0)] = NONE
        more = np.flatnonzero(((seen != keys) & (seen != -1)).ravel())
        if len(more):
            flat, keys, at = out.reshape(-1), keys.ravel()[more], at.ravel()[more]
            while len(more):
                at = (at + 1) & self.mask
                seen = self.keys[at]
                hit = seen == keys
                flat[more[hit]] = self.values[at[hit]]
                on = ~hit & (seen != -1)
                more, keys, at = more[on], keys[on], at[on]
            out = flat.reshape(out.shape)
            out[(left < 0) | (right < 0)] = NONE
        return out


class Ranks:
    """A rank file: a line for each token, base64 bytes and rank; the rank is the id."""

    def __init__(self, content: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.token = {v: k for k, v in self.rank.items()}
        self.pattern = regex.compile(pattern)
        get = self.rank.get
        pairs = [(a, b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        left, right, value = np.array(pairs, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, value)
        self.byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        out, count = np.empty(len(data), np.int32), np.zeros(len(words), np.int64)
        order = np.argsort(sizes, kind="stable")
        edges = np.searchsorted(sizes[order], np.array(BUCKETS), side="right")
        low = 0
        for high in edges:
            for a in range(low, high, ROWS):
                self._bucket(order[a : min(a + ROWS, high)], data, starts, sizes, out, count)
            low = high
        for i in order[low:]:
            ids = self._long(data[starts[i] : starts[i] + sizes[i]])
            out[starts[i] : starts[i] + len(ids)], count[i] = ids, len(ids)
        kept = np.arange(len(data)) - np.repeat(starts, sizes) < np.repeat(count, sizes)
        return out[kept], count

    def _bucket(self, rows, data, starts, sizes, out, count) -> None:
        """Encode words of one bucket; their ids go to the places where their bytes were."""
        rows = rows[sizes[rows] > 0]
        if not len(rows):
            return
        width, n = int(sizes[rows].max()), sizes[rows].copy()
        column = np.arange(width)
        at = starts[rows][:, None] + column
        ids = np.where(column < n[:, None], data[np.minimum(at, len(data) - 1)], np.int32(-1))
        pair = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while True:
            k = len(rows)
            best = pair.argmin(1) if pair.shape[1] else np.zeros(k, np.int64)
            low = pair[np.arange(k), best] if pair.shape[1] else np.full(k, NONE)
            done = low == NONE
            if done.any():
                self._emit(rows[done], ids[done], n[done], starts, out, count)
                on = ~done
                rows, ids, n, pair, best, low = rows[on], ids[on], n[on], pair[on], best[on], low[on]
                k = len(rows)
                if not k:
                    return
            each, width = np.arange(k), ids.shape[1]
            ids[each, best] = low
            keep = np.ones(ids.shape, bool)
            keep[each, best + 1] = False
            ids = ids[keep].reshape(k, width - 1)
            keep = np.ones(pair.shape, bool)
            keep[each, best] = False
            pair = pair[keep].reshape(k, width - 2)
            n -= 1
            inner = np.flatnonzero(best > 0)
            if len(inner):
                b = best[inner]
                pair[inner, b - 1] = self.pairs.get(ids[inner, b - 1], ids[inner, b])
            inner = np.flatnonzero(best < width - 2)
            if len(inner):
                b = best[inner]
                pair[inner, b] = self.pairs.get(ids[inner, b], ids[inner, b + 1])

    @staticmethod
    def _emit(rows, ids, n, starts, out, count) -> None:
        count[rows] = n
        column = np.arange(ids.shape[1])
        inside = column < n[:, None]
        out[(starts[rows][:, None] + column)[inside]] = ids[inside]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The same merges for one very long pre-token, with a heap of pairs by rank and place."""
        ids, n = data.tolist(), len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs.get(data[:-1], data[1:])
        heap = [(int(r), i) for i, r in enumerate(ranks.tolist()) if r != NONE]
        heapq.heapify(heap)
        current = ranks.tolist() + [int(NONE)]

        def rerank(i: int) -> None:
            j = after[i]
            joined = self.rank.get(self.token[ids[i]] + self.token[ids[j]], int(NONE)) if j < n else int(NONE)
            current[i] = joined
            if joined != NONE:
                heapq.heappush(heap, (joined, i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or current[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            rerank(i)
            if before[i] >= 0:
                rerank(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)


@lru_cache(maxsize=2)
def ranks_of(content: bytes, pattern: str) -> Ranks:
    return Ranks(content, pattern)


def _slices(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """df without its text, with the packed ids in `out` and their number in n_tokens.

    The rank file is read on the driver and broadcast: its size is that of a
    vocabulary and doesn't grow with the data.
    """
    with open(ranks_path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    others = [f for f in df.schema.fields if f.name not in (text_col, out, "n_tokens")]
    schema = T.StructType([*others, T.StructField(out, T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks_of(content.value, pattern)
        cache = WordCache(vocabulary.encode_words)
        match = vocabulary.pattern.findall
        for batch in batches:
            at = batch.num_columns - 1
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [t or "" for t in part.column(at).to_pylist()]
                packed = []
                for a, b in _slices(texts):
                    cut = [list(blocks(t)) for t in texts[a:b]]
                    found = cache.look_up([match(x) for c in cut for x in c])
                    k = 0
                    for c in cut:
                        packed.append(b"".join(cache.values(f).astype("<u4").tobytes() for f in found[k : k + len(c)]))
                        k += len(c)
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                columns += [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*[df[f"`{f.name}`"] for f in others], df[f"`{text_col}`"].alias(free_name(df, "__text"))).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df without the packed ids, with the bytes they stand for in `out`; null ids give no bytes."""
    with open(ranks_path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    others = [f for f in df.schema.fields if f.name not in (ids_col, out)]
    schema = T.StructType([*others, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.value.splitlines())}
        for batch in batches:
            at = batch.num_columns - 1
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(at).to_pylist()]
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=schema.names)

    return df.select(*[df[f"`{f.name}`"] for f in others], df[f"`{ids_col}`"].alias(free_name(df, "__ids"))).mapInArrow(run, schema)
