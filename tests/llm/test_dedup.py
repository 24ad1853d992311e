"""Exact and near copies against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import exact_dedup, fingerprint, jaccard


def rows_with_copies():
    rows = [(i, f"text {i % 9}") for i in range(80)] + [(None, None), (None, ""), (500, ""), (501, "x" * 30_000), (502, "x" * 30_000), (3, "text 3"), (3, "text 3"), (None, "alone"), (None, "alone")]
    return rows


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.pmod(F.length(t), F.lit(3)).cast("string").cast("binary")], ids=["sha256", "weak"])
def test_groups_are_exact_even_where_digests_collide(spark, digest):
    rows = rows_with_copies()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int").repartition(5)
    found = exact_dedup.exact_groups(df, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    got = defaultdict(list)
    for r in found:
        got[r["text_sha256"]].append(r)
    assert set(got) == set(by_sha)
    for sha, ids in by_sha.items():
        keep = max((i for i in ids if i is not None), default=None)
        assert Counter(r["doc_id"] for r in got[sha]) == Counter(ids)
        assert all(r["keep_id"] == keep and r["group_size"] == len(ids) for r in got[sha])
        assert [r["doc_id"] for r in got[sha] if r["kept"]] == [keep]


def test_keep_last_keeps_whole_rows(spark):
    rows = [(*r, "en", i) for i, r in enumerate(rows_with_copies())]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt string, row long")
    kept = exact_dedup.keep_last(df)
    assert kept.columns == df.columns
    found = kept.collect()
    assert len(found) == len({t or "" for _, t, _, _ in rows})
    assert {tuple(r) for r in found} <= {tuple(r) for r in rows}
    assert exact_dedup.keep_last(df.limit(0)).collect() == [] and exact_dedup.exact_groups(df.limit(0)).collect() == []


def plain_join(rows, n=5, similarity=0.8):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (least.get(root(i)), d) if x is not None]
        least[root(i)] = min(known, default=None)
    return Counter((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_join_is_that_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base, line = [rnd.choice(words) for _ in range(60)], [rnd.choice(words) for _ in range(15)]
    rows = [(None, " "), (None, None), (1, ""), (2, "a b"), (3, "a b"), (3, "A  b"), (None, "x y z"), (None, "x y z"), (4, "\xa0")]
    for i in range(250):  # a crowd of near copies
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = rnd.choice(words)
        rows.append((10 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(line + [rnd.choice(words) for _ in range(45)])) for i in range(120)] + [(3000 + i, " ".join(base)) for i in range(10)]
    monkeypatch.setattr(jaccard, "BLOCK", 60)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, leaf int")
    found = jaccard.jaccard_join(df, small=30).collect()
    assert Counter(tuple(r) for r in found) == plain_join(rows)


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(empty).collect() == []


def test_runs_follow_the_recall():
    assert jaccard.runs_for(0.999, 0.8) > jaccard.runs_for(0.9, 0.8) >= 1


def test_fingerprints_of_texts_and_edited_texts(spark):
    rnd = random.Random(1)
    rows = [(i * 3, "".join(rnd.choice("abcdefg hijkl é漢") for _ in range(rnd.randrange(0, 900)))) for i in range(60)] + [(None, None), (7, "same text " * 30), (8, "same text " * 30), (7, "z"), (900, "y" * 20_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, part string").repartition(4)
    found = fingerprint.fingerprints(df).collect()
    assert len(found) == len(rows)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = Counter()
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        expected[i, len(t), t[: len(t) - half] + after[:half]] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in found) == expected
    prints = defaultdict(set)
    for r in found:
        prints[r["doc_id"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[8] < prints[7] and len(prints[7]) == 2


def test_likeness_follows_the_edits():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghij klmno") for _ in range(4000))
    other = "".join(rnd.choice("abcdefghij klmno") for _ in range(4000))
    few = text[:1000] + "x" + text[1001:2500] + text[2502:]
    many = "".join(rnd.choice("abcdef") if rnd.random() < 0.2 else c for c in text)
    a, b, c, d, e = fingerprint.embed([text, few, many, other, text])
    assert fingerprint.likeness(a, e) == 1 and fingerprint.read_back(fingerprint.written_out(a))[0] == a[0]
    assert fingerprint.likeness(a, b) > fingerprint.likeness(a, c) > fingerprint.likeness(a, d)
    assert fingerprint.likeness(a, d) < 0.1 < 0.7 < fingerprint.likeness(a, b)


def test_fingerprints_of_one_and_of_no_row(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()[0]
    assert one["edited"] == "abcabc" and one["near_next"] == 1.0
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_texts_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice("abcdefghij klmno") for _ in range(n))
    edited = lambda t, k: "".join(rnd.choice("xyz") if rnd.random() < k else c for c in t)
    base = make(1500)
    rows = [(i, edited(base, 0.004)) for i in range(40)] + [(100 + i, make(rnd.randrange(40, 2000))) for i in range(40)] + [(200, base), (201, base), (None, None), (202, ""), (203, "ab")]
    found = fingerprint.similar(spark.createDataFrame(rows, "doc_id long, text string"), small=16).collect()
    prints = fingerprint.embed([t or "" for _, t in rows])
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fingerprint.likeness(prints[i], prints[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    assert Counter(tuple(r) for r in found) == Counter((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))
    assert max(links) > 20


def test_banding_finds_short_texts_local_edits_and_ends_across_a_power_of_two():
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdefghij klmno") for _ in range(n))
    pairs = []
    for _ in range(200):
        t = make(rnd.randrange(12, 31))
        pairs.append((t, t[:-1] + "#"))
    for n in (480, 500, 515, 2030, 6000):
        for _ in range(60):
            t, k = make(n), int(n * rnd.uniform(0.05, 0.22))
            at = rnd.randrange(n - k)
            pairs += [(t, t[:at] + make(k) + t[at + k :]), (t, t[:at] + make(k) + t[at:]), (t, t[:at] + t[at + k :])]
    found = missed = across = 0
    for one, two in pairs:
        a, b = fingerprint.embed([one, two])
        if fingerprint.likeness(a, b) >= 0.8:
            across += a[0].bit_length() != b[0].bit_length()
            if set(fingerprint.band_keys(a)) & set(fingerprint.band_keys(b)):
                found += 1
            else:
                missed += 1
    assert found > 300 and across > 5
    assert missed <= 0.01 * (found + missed), (found, missed)
    assert all(len(fingerprint._bands(int(t))) for t in fingerprint._levels())


def test_merged_buckets_keep_nodes_that_share_one_together(spark):
    rng = random.Random(3)
    buckets = [set(rng.sample(range(40), rng.randint(2, 12))) for _ in range(60)] + [set(range(40, 70)) - {40 + k} for k in range(30)]
    rows = [(node, leaf, len(b)) for leaf, b in enumerate(buckets) for node in b]
    found = fingerprint.merge_buckets(spark.createDataFrame(rows, "node long, leaf long, n long")).collect()
    of = {}
    for r in found:
        of.setdefault(r["node"], set()).add(r["leaf"])
    assert all(of[a] & of[b] for bucket in buckets for a in bucket for b in bucket)
    assert max(len(of[node]) for node in range(40, 70)) == 1 and len(found) < len(rows)


def test_fingerprint_query_rows_have_their_links(spark):
    text = "the quick brown fox jumps over"
    rows = [(1, text), (2, text[:-1] + "#"), (7, "something else altogether, and longer"), (7, text), (None, text), (None, None), (3, "")]
    found = fingerprint.linked_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r["doc_id"], r["n_chars"], r["class_id"], r["links"]) for r in found)
    n = len(text)
    assert got == Counter([(1, n, 1, 3), (2, n, 1, 3), (7, 37, 7, 0), (7, n, 1, 3), (None, n, 1, 3), (None, 0, 3, 1), (3, 0, 3, 1)])


def plain_walk(text):
    """Steps and all written symbols of a text, a step at a time."""
    bits = np.random.default_rng(20240229).integers(0, 2, (256, fingerprint.PERIOD), dtype=np.int8)
    m = 0xFFFFFFFF
    mixed = [ord(c) * 2654435761 & m for c in text] + [0, 0]
    at, step, written = 0, 0, []
    while at < len(text):
        h = mixed[at] >> 7
        for j in (1, 2):
            h = h * 0x85EBCA6B & m ^ mixed[at + j] >> 5
        written.append((h * 0xC2B2AE35 & m) >> 28)
        kind = ord(text[at]) if ord(text[at]) < 256 else mixed[at] >> 24
        place = step % fingerprint.PERIOD
        at += bool(bits[kind, place]) or place == fingerprint.PERIOD - 1
        step += 1
    return step, written


def plain_samples(text):
    """{octave: [(step, symbol)]} of the sampled steps that the walk reached."""
    end, written = plain_walk(text)
    out, low, high = {}, 0, 64
    while low < end:
        chosen = range(low, high) if high - low <= 64 else sorted(np.random.default_rng([low, high]).choice(high - low, 64, replace=False) + low)
        out[low, high] = {int(k): written[k] for k in chosen if k < end}
        low, high = high, 2 * high
    return end, out


def plain_likeness(x, y):
    (end_x, a), (end_y, b) = plain_samples(x), plain_samples(y)
    if not end_x or not end_y:
        return float(end_x == end_y)
    longest, total = max(end_x, end_y), 0.0
    for low, high in a if end_x == longest else b:
        steps = (a if end_x == longest else b)[low, high]
        if steps:
            left, right = a.get((low, high), {}), b.get((low, high), {})
            same = sum(k in left and k in right and left[k] == right[k] for k in steps)
            total += (min(high, longest) - low) * max(0.0, (same / len(steps) - 1 / 16) / (15 / 16))
    return 1.0 if x == y else min(1.0, total / longest)


def test_fingerprints_are_those_of_a_plain_walk(spark):
    rnd = random.Random(12)
    make = lambda n: "".join(rnd.choice("abcdefg hijkl é漢\n") for _ in range(n))
    rows = [(i, make(rnd.choice([0, 1, 2, 5, 31, 32, 33, 60, 64, 200, 700, 3000]))) for i in range(60)] + [(100, "a" * 9000), (101, "a" * 9000)]
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = [t for _, t in rows]
    for (i, t), after in zip(rows, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        for text, name in ((t, "fingerprint"), (edited, "edited_fingerprint")):
            end, samples = plain_samples(text)
            assert found[i][name] == f"{end:x}:" + "".join(f"{v:x}" for octave in samples.values() for _, v in sorted(octave.items())), (i, name)
        assert found[i]["near_edited"] == pytest.approx(plain_likeness(t, edited), abs=1e-9)
        assert found[i]["near_next"] == pytest.approx(plain_likeness(t, after), abs=1e-9)
