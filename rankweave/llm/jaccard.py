"""Jaccard join of word n-gram sets by chosen paths.

A set of shingles is embedded as a row of MinHash values: at every coordinate
two sets have the same value with the probability of their similarity. A run
starts with all sets in one node. A node picks `BRANCHES` coordinates, the
same ones for all of its members, and every member goes on to the children
named by its values there. A node with no more than `small` members is a leaf:
its pairs are compared exactly, set against set. A larger one splits, unless a
child would keep most of it: then it is a crowd of near copies, which no
further coordinate tells apart, and is a leaf as well. So is what is still
large at the last level; the number of levels follows the logarithm of the
number of rows. Large leaves are compared in square blocks, bounded by members
and by shingles, each a unit of work of its own.

Two sets of similarity s stay together on a path with probability s a level,
so with two branches a pair at the threshold 0.8 survives a run with
probability above 0.937 at any depth; runs are repeated until the chance to
have lost it falls below 1 - recall.

Rows with equal sets form a class first, and classes are compared: copies cost
nothing. A pair that meets in several leaves is counted in the first of them,
which both sides know from their lists of leaves; blocks of a large leaf whose
members have all met in an earlier large one are left out.

Words are runs of non-space, lower-cased; a text of fewer than n words has one
shingle of all its words. Null, empty and blank texts have no shingle and no
link, not even to each other. Rows that repeat an id are rows for themselves. A
class whose rows all have a null id has a null class id. Extra columns are not
read. An empty table gives an empty result.

The plan is the same at every size: the texts of candidate classes are found by
a shuffled join on the id and a hash of the text, so rows without an id and rows
with equal texts are spread as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import components
from rankweave.llm.scratch import discard, text_of, written

BRANCHES = 2
SMALL, BLOCK, BLOCK_SHINGLES = 512, 2048, 1 << 21


def levels_for(rows: int, small: int = SMALL) -> int:
    """Levels that cut a node of all rows down to a leaf if each one keeps a quarter of it; four at least."""
    return max(4, math.ceil(math.log(max(rows, 1) / small, 4)))


def runs_for(recall: float, similarity: float, levels: int = 4, branches: int = BRANCHES) -> int:
    """Runs after which a pair of this similarity has met in a leaf with probability `recall`."""
    lost = 0.0
    for _ in range(levels):
        lost = (1 - similarity * (1 - lost)) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost))) if lost > 0 else 1


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word n-grams, rising."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """MinHash values, a row for each set that isn't empty."""
    keys = np.random.default_rng(5).integers(1, 2**63, (coordinates, 2), dtype=np.uint64) | np.uint64(1)
    flat = np.concatenate(sets)  # well mixed hashes, whose order by the upper half of a product is as good as random
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, mixed = np.empty((len(sets), coordinates), np.uint64), np.empty_like(flat)
    for c, (a, b) in enumerate(keys):
        np.bitwise_xor(flat, b, out=mixed)
        np.multiply(mixed, a, out=mixed)
        out[:, c] = np.minimum.reduceat(mixed, starts)
    return out


def _sketches(df: DataFrame, n: int, coordinates: int) -> DataFrame:
    """(id, mark, set_key, size, values); no key and no values where a text has no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingles(t, n) for t in part.column(2).to_pylist()]
                on = [s for s in sets if len(s)]
                values = iter(minhashes(on, coordinates).astype(np.int64) if on else ())
                keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
                rows = pa.array([next(values) if len(s) else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys, pa.array(list(map(len, sets)), pa.int32()), rows], names=["id", "mark", "set_key", "size", "values"])

    return df.select("id", "mark", "text").mapInArrow(run, "id long, mark long, set_key binary, size int, values array<long>")


def set_key(shingled: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingled.tobytes())


def _children(nodes: DataFrame, classes: DataFrame, level: int, levels: int) -> DataFrame:
    """(set_key, run, above, path): the children at this level of nodes (set_key, run, path)."""
    both = nodes.join(classes.select("set_key", "values"), "set_key") if level > 1 else nodes
    picks = both.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
    coordinate = ((F.col("run") * levels + (level - 1)) * BRANCHES + F.col("pick")).cast("int")
    value = F.element_at("values", coordinate + 1)
    return picks.select("set_key", "run", F.col("path").alias("above"), F.xxhash64("path", "run", coordinate, value).alias("path"))


def _leaves(classes: DataFrame, runs: int, levels: int, small: int) -> DataFrame:
    """(set_key, leaf, n): leaves of at least two classes, of leaves with the same members one."""
    start = classes.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("path", F.lit(0).cast("long"))
    mix = F.xxhash64("set_key")
    counted = [F.count("*").alias("n"), F.sum(F.shiftright(mix, 30)).alias("x"), F.sum(F.shiftright(F.xxhash64(mix), 30)).alias("y"), F.first("above").alias("above")]
    found, used = None, []
    parents = None  # large nodes of the level above (path, n, x, y) and their members

    def leaf_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
        once = nodes.groupBy("n", "x", "y").agg(F.min("path").alias("path"))
        return members.join(once, "path").select("set_key", F.col("path").alias("leaf"), "n")

    for level in range(1, levels + 1):
        grown = start if parents is None else parents[1].select("set_key", "run", "path")
        here = written(_children(grown, classes, level, levels), f"jaccard-members{level}")
        nodes = written(here.groupBy("path").agg(*counted).where("n > 1"), f"jaccard-nodes{level}")
        used += [here, nodes]
        if parents is not None:
            # crowds: a child keeps most of its parent
            most = nodes.groupBy("above").agg(F.max("n").alias("most")).withColumnRenamed("above", "path")
            crowds = written(parents[0].join(most, "path").where(F.col("most") > 0.5 * F.col("n")).drop("most"), "jaccard-crowds")
            used.append(crowds)
            found = found.unionByName(leaf_of(parents[1], crowds))
            gone = crowds.select(F.col("path").alias("above"))
            here, nodes = here.join(gone, "above", "left_anti"), nodes.join(gone, "above", "left_anti")
        last = level == levels
        done = leaf_of(here, nodes if last else nodes.where(F.col("n") <= small))
        found = done if found is None else found.unionByName(done)
        large = nodes.where(F.col("n") > small)
        if last or not large.head(1):
            break
        parents = (written(large.drop("above"), "jaccard-large"), written(here.join(large.select("path"), "path", "left_semi"), "jaccard-grown"))
        used += parents
    leaves = written(found, "jaccard-leaves")
    for frame in used:
        discard(frame)
    return leaves


def overlaps(sets: list[np.ndarray], others: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each set with each of the others, by products of blocks of shared shingles."""
    rows, columns = len(sets), len(others)
    flat, more = np.concatenate(sets), np.concatenate(others)
    row, col = np.repeat(np.arange(rows), list(map(len, sets))), np.repeat(np.arange(columns), list(map(len, others)))
    shared = np.intersect1d(flat, more)
    out = np.zeros((rows, columns), np.float32)
    if not len(shared):
        return out

    def placed(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, values)
        on = shared[np.minimum(at, len(shared) - 1)] == values
        return at[on], owner[on]

    (at_a, row), (at_b, col) = placed(flat, row), placed(more, col)
    # a shingle that one set has on each side adds to one cell only
    single = (np.bincount(at_a, minlength=len(shared)) == 1) & (np.bincount(at_b, minlength=len(shared)) == 1)
    if single.any():
        left, right = np.empty(len(shared), np.int64), np.empty(len(shared), np.int64)
        left[at_a], right[at_b] = row, col
        out += np.bincount(left[single] * columns + right[single], minlength=rows * columns).reshape(rows, columns)
    dense = np.cumsum(~single) - 1
    keep_a, keep_b = ~single[at_a], ~single[at_b]
    at_a, row, at_b, col = dense[at_a[keep_a]], row[keep_a], dense[at_b[keep_b]], col[keep_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, row, at_b, col = at_a[order_a], row[order_a], at_b[order_b], col[order_b]
    total = int((~single).sum())
    for low in range(0, total, width):
        w = min(width, total - low)
        in_a, in_b = (slice(*np.searchsorted(at, [low, low + w])) for at in (at_a, at_b))
        a, b = np.zeros((rows, w), np.float32), np.zeros((columns, w), np.float32)
        a[row[in_a], at_a[in_a] - low] = 1
        b[col[in_b], at_b[in_b] - low] = 1
        out += a @ b.T
    return out


def similar_sets(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have at least this Jaccard similarity."""
    a, b = np.array(list(map(len, left)), np.float32), np.array(list(map(len, right)), np.float32)
    both = overlaps(left, right)
    return both >= similarity * (a[:, None] + b - both) - 1e-4


def _compare(left: list[dict], right: list[dict] | None, leaf: int, alike) -> Iterator[tuple[bytes, int, bytes]]:
    """(set_key, links, root) of the members of a block: links that belong to this leaf, and a member of the same component."""
    others = left if right is None else right
    near = alike([r["set"] for r in left], [r["set"] for r in others])
    if right is None:
        np.fill_diagonal(near, False)
    on_a, on_b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(on_a):
        return
    near = near[np.ix_(on_a, on_b)]
    left, others = [left[i] for i in on_a], [others[i] for i in on_b]
    earlier = overlaps([r["leaves"][r["leaves"] < leaf] for r in left], [r["leaves"][r["leaves"] < leaf] for r in others]) > 0
    owned = near & ~earlier
    # labels spread over the links of the block until nothing changes
    label_a, label_b = np.arange(len(left)), np.arange(len(others)) if right is None else len(left) + np.arange(len(others))
    far = len(left) + len(others)
    while True:
        next_a = np.minimum(label_a, np.where(near, label_b, far).min(1))
        next_b = np.minimum(label_b, np.where(near, next_a[:, None], far).min(0))
        if right is None:
            next_a = next_b = np.minimum(next_a, next_b)
        if (next_a == label_a).all() and (next_b == label_b).all():
            break
        label_a, label_b = next_a, next_b
    keys = [r["set_key"] for r in left] + ([] if right is None else [r["set_key"] for r in others])
    copies_a, copies_b = np.array([r["copies"] for r in left]), np.array([r["copies"] for r in others])
    for r, n, label in zip(left, owned @ copies_b, label_a, strict=True):
        yield r["set_key"], int(n), keys[label]
    if right is not None:
        for r, n, label in zip(others, copies_a @ owned, label_b, strict=True):
            yield r["set_key"], int(n), keys[label]


def block_links(members: DataFrame, alike, kind=np.uint64) -> DataFrame:
    """(set_key, links, root): partial sums over the blocks, whose members come one behind the other.

    alike: two lists of arrays of this kind to a matrix of links.
    """

    def solve(key: tuple[int, int, int], rows: list[dict]) -> Iterator[tuple[bytes, int, bytes]]:
        leaf, i, j = key
        left = [r for r in rows if r["block"] == i]
        right = None if i == j else [r for r in rows if r["block"] == j]
        if left and (right is None or right):
            yield from _compare(left, right, leaf, alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            kinds = (pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["set_key", "links", "root"])

        key, rows, ready = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["leaf"], r["i"], r["j"])
                if now != key:
                    if len(rows) > 1:
                        ready += solve(key, rows)
                    key, rows = now, []
                    if len(ready) > 10_000:
                        yield out(ready)
                        ready = []
                rows.append({"set_key": r["set_key"], "copies": r["copies"], "block": r["block"], "leaves": np.array(r["leaves"], np.int64), "set": np.frombuffer(r["shingles"], kind)})
        if len(rows) > 1:
            ready += solve(key, rows)
        yield out(ready)

    return members.mapInArrow(run, "set_key binary, links long, root binary")


def block_units(leaves: DataFrame, small: int, sizes: DataFrame | None = None) -> DataFrame:
    """(set_key, leaf, block, i, j): every member with the pairs of blocks of its leaf that it takes part in.

    A member's home is its first large leaf. Members of a large leaf that share
    another home have met there; blocks of one such home are not compared with
    each other. sizes: (set_key, size), where the sets' sizes are to bound the
    blocks as well.
    """
    plain = leaves.where(F.col("n") <= small).select("set_key", "leaf", *(F.lit(0).alias(c) for c in ("block", "i", "j")))
    large = leaves.where(F.col("n") > small)
    homes = large.groupBy("set_key").agg(F.min("leaf").alias("home"))
    if sizes is not None:
        homes = homes.join(sizes.select("set_key", "size"), "set_key")
    large = large.join(homes, "set_key")
    weight = F.lit(0) if sizes is None else F.col("size") / BLOCK_SHINGLES
    groups = large.groupBy("leaf", "home").agg(F.count("*").alias("size"), F.sum(weight).alias("weight"))
    # homes with few members in a leaf are put together, so that the number of blocks follows the leaf's size
    groups = groups.withColumn("team", F.when((F.col("home") == F.col("leaf")) | (F.col("size") >= small), F.col("home")))
    teams = groups.groupBy("leaf", "team").agg(F.ceil(F.greatest(F.sum("size") / BLOCK, F.sum("weight"))).cast("int").alias("blocks"))
    listed = teams.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("team", "blocks"))).alias("teams"))
    cut = F.transform("teams", lambda t: F.transform(F.sequence(F.lit(0), t["blocks"] - 1), lambda b: F.struct(t["team"].alias("team"), b.alias("nth"))))
    listed = listed.select("leaf", F.flatten(cut).alias("blocks"))
    placed = large.join(groups.select("leaf", "home", "team"), ["leaf", "home"]).join(listed, "leaf")
    own = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda k: F.element_at("blocks", k + 1)["team"].eqNullSafe(F.col("team")))
    placed = placed.withColumn("own", own).withColumn("block", F.element_at("own", (F.pmod(F.xxhash64("set_key"), F.size("own")) + 1).cast("int")))
    apart = F.col("team").isNull() | (F.col("team") == F.col("leaf"))
    partners = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda k: apart | ~F.element_at("blocks", k + 1)["team"].eqNullSafe(F.col("team")))
    placed = placed.withColumn("other", F.explode(partners))
    placed = placed.select("set_key", "leaf", F.col("block"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return plain.unionByName(placed)


def class_facts(classes: DataFrame, partial: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(set_key, class_id, links, stays) of all classes (set_key, least, copies) from partial links, and the components behind it.

    Of the classes of a component one stays, that with the smallest id.
    """
    counted = partial.groupBy("set_key").agg(F.sum("links").alias("links"))
    joined = written(components(partial.select(F.col("set_key").alias("a"), F.col("root").alias("b"))), f"{name}-components")
    own = classes.select("set_key", "least", "copies").join(counted, "set_key", "left").join(joined.withColumnRenamed("node", "set_key"), "set_key", "left")
    own = own.withColumn("component", F.coalesce("component", "set_key"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "set_key"))
    least = own.groupBy("component").agg(first.alias("first"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    facts = own.join(least, "component").select("set_key", F.col("first.least").alias("class_id"), links, (F.col("set_key") == F.col("first.set_key")).alias("stays"))
    return written(facts, f"{name}-facts"), joined


def _solved(df: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float, small: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, set_key) and facts (set_key, class_id, links, stays, least, mark)."""
    levels = levels_for(df.count(), small)
    runs = runs_for(recall, similarity, levels)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    sketches = written(_sketches(rows, n, runs * levels * BRANCHES), "jaccard-sketches")
    # equal sets have equal values, so any of them will do; (least, mark) names a row that has the set
    facts_of = [F.min("id").alias("least"), F.coalesce(F.min_by("mark", "id"), F.min("mark")).alias("mark"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("values").alias("values")]
    classes = written(sketches.where("set_key is not null").groupBy("set_key").agg(*facts_of), "jaccard-classes")
    leaves = _leaves(classes, runs, levels, small)
    lists = leaves.groupBy("set_key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    wanted = lists.join(classes.select("set_key", "least", "mark", "copies"), "set_key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            found = [shingles(t, n).tobytes() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.binary())], names=[*batch.schema.names[:at], "shingles"])

    # a row's id and the hash of its text: neither rows without an id nor copies meet in one task
    key = ["known", "none", "mark"]
    named = lambda c: (F.coalesce(c, F.lit(0)).alias("known"), F.col(c).isNull().alias("none"), "mark")
    texts = rows.select(*named("id"), "text").join(wanted.select(*named("least"), "set_key", "copies", "leaves").hint("shuffle_hash"), key)
    # rows that repeat id and text are one
    once = texts.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("set_key", "copies", "leaves", "text")))
    ready = written(once.drop(*key).mapInArrow(sets, "set_key binary, copies long, leaves array<long>, shingles binary"), "jaccard-sets")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = block_units(leaves, small, classes).join(ready, "set_key")
    placed = units.repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "set_key")
    partial = written(block_links(placed, lambda a, b: similar_sets(a, b, similarity)), "jaccard-links")
    facts, joined = class_facts(classes, partial, "jaccard")
    named_facts = written(facts.join(classes.select("set_key", "least", "mark"), "set_key"), "jaccard-classes")
    for used in (leaves, ready, partial, joined, facts, classes):
        discard(used)
    return sketches.select("id", "mark", "set_key"), named_facts


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.999, small: int = SMALL) -> DataFrame:
    """(id, class_id, links): for every row the smallest id that chains of links lead to, and its number of links.

    A row's links are all other rows of similarity `similarity` or more.
    """
    rows, facts = _solved(df, id_col, text_col, n, similarity, recall, small)
    known = rows.select("id", "set_key").join(facts, "set_key").select("id", "class_id", "links")
    blank = rows.where("set_key is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return known.unionByName(blank).select(F.col("id").alias(id_col), "class_id", "links")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.999, small: int = SMALL) -> DataFrame:
    """df with one row of each class, that of the smallest id; columns as in df.

    Rows are known by id and text, so a repeated id takes no other text with it
    and rows without an id are compared like others. Texts without a shingle stay.
    """
    rows, facts = _solved(df, id_col, text_col, n, similarity, recall, small)
    every = rows.where("set_key is not null").groupBy("id", "mark", "set_key").agg(F.count("*").alias("rows"))
    own = facts.select("set_key", "stays", "least", F.col("mark").alias("first"))
    stays = F.col("stays") & F.col("id").eqNullSafe(F.col("least")) & (F.col("mark") == F.col("first"))
    judged = written(every.join(own, "set_key").select("id", "mark", stays.alias("stays"), "rows").where("not stays or rows > 1"), "jaccard-judged")
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_mark"))
    same = lambda right: named["own_id"].eqNullSafe(right["id"]) & (named["own_mark"] == right["mark"])
    rest = named.join(judged.hint("shuffle_hash"), same(judged), "left_anti")
    twice = judged.where("stays")
    if twice.head(1):  # rows that repeat id and text: the one of smallest hash stays, whatever the partitioning
        repeated = named.join(twice.hint("shuffle_hash"), same(twice), "left_semi")
        rest = rest.unionByName(repeated.groupBy("own_id", "own_mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row", "own_id", "own_mark"))
    return rest.select([F.col("row").getField(c).alias(c) for c in df.columns])
