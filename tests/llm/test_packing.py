import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import packing


def plain_best_fit(lengths, caps, costs):
    """Best fit with a plain list of bins; of equal rooms the bin filled last is taken."""
    bins, where, touched = [], [], []
    for i, size in enumerate(lengths):
        open_ = [(room, b) for b, room in enumerate(bins) if room >= size]
        if open_:
            room = min(r for r, _ in open_)
            b = max((b for r, b in open_ if r == room), key=lambda b: touched[b])
        else:
            best = None
            for c, cost in zip(caps, costs):
                if c >= size:
                    filled = size + min(c - size, sum(x for x in lengths[i + 1 :] if x <= c - size))
                    if best is None or cost / max(filled, 1) < best[0]:
                        best = (cost / max(filled, 1), c)
            bins.append(best[1])
            touched.append(0)
            b = len(bins) - 1
        bins[b] -= size
        touched[b] = i + 1
        where.append(b)
    return where


@pytest.mark.parametrize("seed", range(5))
def test_bins_are_those_of_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(0, 100, 200))[::-1].copy()
    caps = [16, 40, 100]
    costs = packing.bin_costs(caps, per_bin=4)
    where, place, final = packing.best_fit(lengths, caps, costs)
    used = np.bincount(where, lengths)
    plain = plain_best_fit(lengths.tolist(), caps, costs)
    assert len(set(plain)) == final.size
    assert sorted(np.bincount(plain, lengths)) == sorted(used)
    for b, capacity in enumerate(final):
        mine = np.flatnonzero(where == b)
        assert used[b] <= capacity and all(c < used[b] or c >= capacity for c in caps)
        ends = np.cumsum(lengths[mine])
        assert (place[mine] == ends - lengths[mine]).all()


def test_every_symbol_has_one_place(spark):
    rows = [(1, 250), (2, 100), (3, None), (4, 0), (None, 30), (5, 30), (5, 30), (6, -4)]
    df = spark.createDataFrame(rows, "doc_id long, piece long")
    found = packing.pack(df, F.col("piece"), capacities=(40, 100), shard_rows=3).collect()
    total = {}
    for r in found:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["piece_length"]
        assert r["bin_start"] + r["piece_length"] <= r["bin_capacity"]
    assert total == {1: 250, 2: 100, 3: 0, 4: 0, None: 30, 5: 60, 6: 0}
    assert [r["piece_length"] for r in sorted(found, key=lambda r: r["piece"]) if r["doc_id"] == 1] == [100, 100, 50]
    spans = sorted((r["bin"], r["bin_start"], r["piece_length"]) for r in found if r["piece_length"])
    assert all(b1 != b2 or s1 + n1 <= s2 for (b1, s1, n1), (b2, s2, _) in zip(spans, spans[1:]))


def test_empty_table_and_bad_capacities(spark):
    empty = spark.createDataFrame([], "doc_id long, n long")
    assert packing.pack(empty, F.col("n")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(empty, F.col("n"), capacities=())
