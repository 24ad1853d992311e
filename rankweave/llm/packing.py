"""Best-fit packing of token sequences into bins of several permitted capacities.

Rows are dealt into shards by a hash of the row and its place in the input; a
shard has about `shard_rows` rows whatever the table's size, so that one task
never holds more than that, even of rows that are all alike.
In a shard the pieces are placed by falling length, each into the open bin
with the least room that still takes it. Where none does, a bin is opened at
the capacity of least expected cost per token: its cost over what it can be
filled with, the piece itself and the pieces still to come that fit beside it.
In the end each bin is downsized to the smallest capacity that takes its
contents.

A text longer than the largest capacity is cut into pieces of that capacity
and a remainder. Null, zero and negative lengths are pieces of length 0, which
take no room but stay in the result. Equal rows are packed each for itself. An
empty table gives an empty result. Columns of df other than the id may have
any name; they are not carried along. Ids of any type and size stay as they
are, null ones too. A row's shard depends on its place in the input, so other
partitions of the same rows give other bins, with the same rules.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
SHARD_ROWS = 16384


def bin_costs(capacities: Sequence[int], per_bin: float = 64.0, attention: float = 0.25) -> list[float]:
    """Cost of a bin: its positions, what every bin costs, and a share that grows with the square of the length."""
    longest = max(capacities)
    return [per_bin + c * (1 + attention * c / longest) for c in capacities]


def best_fit(lengths: np.ndarray, capacities: Sequence[int], costs: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it for each piece, and the final capacity of each bin.

    The pieces come by falling length and none is longer than the largest
    capacity.
    """
    caps, n = np.array(capacities), len(lengths)
    sums = np.r_[0, np.cumsum(lengths)]
    where, place = np.empty(n, np.int64), np.empty(n, np.int64)
    used: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, rising
    by_room: dict[int, list[int]] = {}
    # for each capacity the first later piece that fits beside a piece is found in the falling lengths
    rising = -lengths
    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[at]
        else:
            fits = np.flatnonzero(caps >= size)
            gap = caps[fits] - size
            first = np.maximum(np.searchsorted(rising, -gap, side="left"), i + 1)
            filled = size + np.minimum(gap, sums[n] - sums[np.minimum(first, n)])
            best = fits[np.argmin(np.array(costs)[fits] / np.maximum(filled, 1))]
            b, room = len(used), int(caps[best])
            used.append(0)
        where[i], place[i] = b, used[b]
        used[b] += size
        room -= size
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append(b)
    final = caps[np.searchsorted(caps, np.array(used, np.int64))] if used else np.empty(0, np.int64)
    return where, place, final


def pack(df: DataFrame, length: Column, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, costs: Sequence[float] | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, piece, piece_start, piece_length, bin, bin_capacity, bin_start), a row for each piece.

    `bin` is unique in the result: the shard times 2**32 and the bin's number in it.
    """
    caps = sorted(set(capacities))
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    costs = list(costs) if costs is not None else bin_costs(caps)
    rows = df.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    shards = max(1, math.ceil(df.count() / shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "length", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, T.LongType()) for c in ("piece", "piece_start", "piece_length", "bin", "bin_capacity", "bin_start")])
    top = caps[-1]

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("length", "descending"), ("id", "ascending")]))  # ids stay as they are, null ones last
        total = np.asarray(group.column("length"), np.int64)
        pieces = np.maximum(1, -(-total // top))
        row = np.repeat(np.arange(len(total)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(top, total[row] - nth * top)
        order = np.lexsort((nth, row, -size))
        where, place, final = best_fit(size[order], caps, costs)
        first = group.column("shard")[0].as_py() << 32
        row, nth = row[order], nth[order]
        columns = {"piece": nth, "piece_start": nth * top, "piece_length": size[order], "bin": first + where, "bin_capacity": final[where], "bin_start": place}
        return pa.Table.from_arrays([group.column("id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns.values())], names=schema.names)

    return rows.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(run, schema)
