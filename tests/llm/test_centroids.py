"""Centroid clustering against whole-number loops and the SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from rankweave.llm import centroids
from rankweave.llm.queries import ORACLE, QUERIES


def plain(rows, k, rounds, dim, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centers = [v for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        found = [min((apart(v, c), n) for n, c in enumerate(centers)) for _, v in kept]
        if step < rounds:
            for n in range(len(centers)):
                own = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
                if own:
                    centers[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in found)
    return [(i, n, d, sum(e for e, m in found if m == n), total, tuple(centers[n])) for (i, _), (d, n) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("width,chunk,dim", [(2, 7, 5), (3, 1000, 4), (1, 2, 1), (8, 50, 5)])
def test_against_loops(spark, width, chunk, dim):
    rng = random.Random(dim)
    rows = [(i, [rng.choice([rng.gauss(0, 1), rng.gauss(0, 100), 0.5, -0.0]) for _ in range(dim)]) for i in range(120)]
    rows += [(None, [1.5] * dim), (3, [2.0] * dim), (3, [2.0] * dim), (900, None), (901, []), (902, [0.0] * (dim + 1)), (903, [None] * dim), (904, [math.nan] * dim), (905, [math.inf] * dim), (906, [-math.inf] + [0.0] * (dim - 1))]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found = centroids.cluster(df, k=6, rounds=3, dim=dim, width=width, chunk_rows=chunk).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted([(r["row"]["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in found], key=key) == sorted(plain(rows, 6, 3, dim), key=key)
    assert {r["row"]["cluster"] for r in found} == {"x"}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2])], "vec_id long, embedding array<float>")
    found = centroids.cluster(df, k=16, dim=2).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in found] == [(0, 0, 0), (0, 0, 0)]
    assert centroids.cluster(df.limit(0), dim=2).count() == 0
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2).collect()


def test_codes_give_back_the_numbers():
    numbers = np.random.default_rng(0).integers(-3, 3, (200, 7))
    codes, entries, starts = centroids.encode(numbers, 3)
    back = np.concatenate([entries[starts[b] : starts[b + 1]][codes[:, b]] for b in range(3)], axis=1)[:, :7]
    assert (back == numbers).all()


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    twin = con.execute(ORACLE["op13_centroids"])
    names = [d[0] for d in twin.description]
    assert sorted(twin.fetchall()) == sorted(tuple(r[n] for n in names) for r in QUERIES["op13_centroids"](spark, folder).collect())
