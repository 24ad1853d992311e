"""Exact centroid clustering of vectors over dictionaries of their subvectors.

Vectors become whole numbers, so that every sum and distance is exact. They are
cut into blocks of `width` dimensions. A task takes up to `chunk_rows` vectors
at a time and replaces each block by a code into the dictionary of the block's
distinct subvectors in this chunk, without loss. The coded chunks are written
once. In a round a task computes, for each dictionary entry, its squared
distance to the same block of every centroid, once however many vectors share
it, and adds up the entries of a vector by its codes. Sums of a cluster come
from counts of codes in the same way. From a chunk only sums leave, at most a
row for each cluster and dimension; they are added up in Spark and the driver
holds the centroids, k times dim numbers.

A dictionary belongs to a chunk and not to the table: distinct subvectors of a
table grow with it, those of a chunk have a bound, and no code needs a shuffle.
Equal vectors share codes, and none of them meets others in one task.

Vectors that are null, have another length, or hold a null or a number that
isn't finite don't take part and have no row in the result. A null id hashes as
the empty text; rows that share an id are vectors of their own, and where equal
ids tie as first centroids the smaller components come first. With fewer than
k vectors there are as many centroids as vectors. An empty table gives an empty
result. Numbers must stay within 2**27 either way, so that a distance fits a
long; one beyond raises an error. Other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.scratch import discard, written

LARGEST = 1 << 27
CHUNK_ROWS = 1 << 14
WIDTH = 2


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST / scale:.0f}")).cast("long"))

    return F.transform(vector, whole)


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def encode(numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (vectors by blocks), the dictionaries one behind the other, and where each begins."""
    n, dim = numbers.shape
    codes, entries, starts = np.empty((n, -(-dim // width)), np.uint32), [], [0]
    for b in range(codes.shape[1]):
        distinct, code = np.unique(numbers[:, b * width : (b + 1) * width], axis=0, return_inverse=True)
        codes[:, b] = code.ravel()
        entries.append(np.pad(distinct, ((0, 0), (0, width - distinct.shape[1]))))  # the last block may be narrower
        starts.append(starts[-1] + len(distinct))
    return codes, np.concatenate(entries), np.array(starts)


def nearest(codes: np.ndarray, entries: np.ndarray, starts: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number where several are, and the squared distance."""
    blocks, width = codes.shape[1], entries.shape[1]
    wide = np.zeros((len(centroids), blocks * width), np.int64)
    wide[:, : centroids.shape[1]] = centroids
    total = np.zeros((len(codes), len(centroids)), np.int64)
    for b in range(blocks):
        apart = entries[starts[b] : starts[b + 1], None, :] - wide[None, :, b * width : (b + 1) * width]
        total += (apart * apart).sum(2)[codes[:, b]]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(total)), cluster]


def sums_of(codes: np.ndarray, entries: np.ndarray, starts: np.ndarray, cluster: np.ndarray, k: int, dim: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors, from how often a cluster has a code."""
    width = entries.shape[1]
    out = np.zeros((k, codes.shape[1] * width), np.int64)
    for b in range(codes.shape[1]):
        size = starts[b + 1] - starts[b]
        held = np.bincount(cluster * size + codes[:, b], minlength=k * size).reshape(k, size)
        out[:, b * width : (b + 1) * width] = held @ entries[starts[b] : starts[b + 1]]
    return out[:, :dim]


_PARTS = "codes binary, entries binary, starts array<long>"


def _unpacked(batch: pa.RecordBatch, row: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.asarray(batch.column("starts")[row].values, np.int64)
    codes = np.frombuffer(batch.column("codes")[row].as_py(), "<u4").reshape(-1, len(starts) - 1).astype(np.int64)
    return codes, np.frombuffer(batch.column("entries")[row].as_py(), "<i8").reshape(-1, width), starts


def _coded(rows: DataFrame, width: int, chunk_rows: int) -> DataFrame:
    """(rows, codes, entries, starts), a row for each chunk, of (row, numbers)."""
    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("rows", T.ArrayType(kind)), *T._parse_datatype_string(_PARTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                numbers = np.asarray(part.column("numbers").flatten()).reshape(part.num_rows, -1)
                codes, entries, starts = encode(numbers, width)
                own = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column("row")]))
                yield pa.RecordBatch.from_arrays([own, pa.array([codes.astype("<u4").tobytes()]), pa.array([entries.astype("<i8").tobytes()]), pa.array([starts.tolist()], pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(row, cluster, distance, cluster_inertia, inertia, centroid): row is a struct of df's columns but the vector, centroid the final one's numbers.

    The first centroids are the k vectors whose id has the smallest SHA-256
    of "seed:id"; an empty cluster keeps its centroid.
    """
    others = [c for c in df.columns if c != vector_col]
    kept = df.where(usable(F.col(vector_col), dim))
    numbers = whole_numbers(F.col(vector_col), scale).alias("numbers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    centroids = np.array([r["numbers"] for r in kept.select(order.alias("order"), numbers).orderBy("order", "numbers").limit(k).collect()], np.int64).reshape(-1, dim)
    n_centroids = len(centroids)
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    chunks = written(_coded(kept.select(row, numbers), width, chunk_rows), "coded-vectors")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                parts = _unpacked(batch, r, width)
                found, _ = nearest(*parts, centroids)
                members = np.bincount(found, minlength=n_centroids)
                held = np.flatnonzero(members)
                sums = sums_of(*parts, found, n_centroids, dim)[held]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, dim + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dim), len(held)), pa.int32()), pa.array(np.c_[members[held], sums].ravel(), pa.int64())], names=["cluster", "at", "total"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found, distance = nearest(*_unpacked(batch, r, width), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("rows")[r].values, pa.array(found, pa.int32()), pa.array(distance, pa.int64())], names=["row", "cluster", "distance"])

    for _ in range(rounds if n_centroids else 0):
        sums = chunks.select("codes", "entries", "starts").mapInArrow(totals, "cluster int, at int, total long")
        found: dict[int, dict[int, int]] = {}
        for r in sums.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
            found.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
        centroids = np.array([[of[d] // of[-1] for d in range(dim)] if (of := found.get(c)) else old for c, old in enumerate(centroids.tolist())], np.int64)

    schema = T.StructType([T.StructField("row", chunks.schema["rows"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    result = written(chunks.mapInArrow(assigned, schema), "assigned-vectors")
    discard(chunks)
    inertia = {r["cluster"]: r["inertia"] for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    facts = [(c, int(of), int(sum(inertia.values())), centroids[c].tolist()) for c, of in sorted(inertia.items())]
    table = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return result.join(F.broadcast(table), "cluster").select("row", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def as_text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


def centroid_sql(table: str, k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """The same clustering in DuckDB's SQL, a set of steps for each round; for tables without repeated ids."""
    steps = [
        f"""q AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM {table}
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v
    FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM q ORDER BY h LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
    SELECT vec_id, any_value(q.v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
    FROM (SELECT vec_id, q.v, cluster, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM q CROSS JOIN c{r} c) q
    GROUP BY vec_id
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS v
    FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster
),
c{r + 1} AS (
    SELECT cluster, CAST(coalesce(m.v, c.v) AS BIGINT[]) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster)
)""")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""
    )


