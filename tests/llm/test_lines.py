"""Line dedup against a dictionary of lines, and the minimal perfect hash by itself."""

import hashlib
import random

import duckdb
import numpy as np

from rankweave.llm import line_dedup, shards
from rankweave.llm.queries import ORACLE, QUERIES

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(n_lines, n_dropped, kept text) of (id, text) rows; a null id comes first."""
    held = {}
    order = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(line.strip(SPACE).translate(LOWER), set()).add(order(i))
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(SPACE).translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if len(k) < 10 or len(held[k]) < 2 or min(held[k]) == order(i)]
        yield len(lines), len(lines) - len(kept), "\n".join(kept)


def test_lines_of_any_shape(spark):
    rng = random.Random(1)
    pool = ["", " ", "short", "exactly 10", "exactly10é", "A Longer Line", "a longer line ", "\ta longer line\r", " a longer line", "ÄÖÜ a longer line", "äöü a longer line", "x" * 5000, "😀" * 9, "😀" * 10, "\x0b\x0ctrimmed line\x0b"]
    rows = [(i if i % 11 else None, None if i % 13 == 0 else "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line of {i} {rng.random()}" for _ in range(rng.randrange(8)))) for i in range(200)]
    rows += [(5, "A Longer Line\nA Longer Line"), (5, "A Longer Line"), (2**53 + 1, "beyond doubles\nexactly 10"), (2**53, "beyond doubles"), (-4, "exactly 10\n\n")]
    df = spark.createDataFrame([(i, t, n, "k") for n, (i, t) in enumerate(rows)], "doc_id long, text string, nth int, `n_lines` string").withColumnRenamed("nth", "row").repartition(5)
    found = line_dedup.drop_lines(df, shard_lines=3).orderBy("row").collect()
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in found] == list(plain(rows))
    assert [r["doc_id"] for r in found] == [i for i, _ in rows]


def test_empty_table_and_no_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_lines(df).count() == 0
    one = spark.createDataFrame([(1, "a line by itself\na line by itself"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.drop_lines(one).orderBy("doc_id").collect()] == [(1, "a line by itself\na line by itself", 2, 0), (2, "", 1, 0)]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(ORACLE["op12_line_dedup"]).fetchall()}
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op12_line_dedup"](spark, folder).collect()}
    assert found == want and sum(r[1] for r in found.values()) > 0


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 63, 1000, 20000):
        keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest()[:16] for i in range(n)), "<u8")
        low, high = keys[0::2], keys[1::2]
        edges, bits, before, place = line_dedup.build(low, high)
        assert sorted(place.tolist()) == list(range(n))
        assert (line_dedup.places(edges, bits, before, low, high) == place).all()
    same = np.full(500, 7, np.uint64)  # keys that share a half still part
    edges, bits, before, place = line_dedup.build(same, np.arange(500, dtype=np.uint64))
    assert sorted(place.tolist()) == list(range(500))


def test_shards_on_another_file_system_are_copied(tmp_path, monkeypatch):
    from pyarrow import fs

    inner = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(shards, "_opened", lambda uri: (inner, uri))
    shards.save("", "x", np.arange(5), np.empty(0))
    shards.save("", "x", np.arange(5), np.empty(0))
    a, b = shards.load("", "x", 2)
    assert a.tolist() == [0, 1, 2, 3, 4] and not len(b)
    assert not list(tmp_path.glob("*.part"))
