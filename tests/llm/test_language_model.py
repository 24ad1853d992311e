"""The Kneser-Ney model against a version with dictionaries."""

import math
import os
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from rankweave.llm import language_model as lm
from rankweave.llm import shards

TEXTS = ["the cat sat on the mat", "The cat\x0bsat", "a b a b a b c", None, "", "the\xa0cat \x1c sat", "É é the"] + [f"w{i % 7} w{i % 5} the cat w{i % 3}" for i in range(60)]


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(train, order):
    """The textbook recursion over dictionaries of all n-grams of each length."""
    counts, grams = Counter(), {k: Counter() for k in range(1, order + 1)}
    for t in train:
        w = words(t)
        counts.update(w)
        line = ["\0begin"] * (order - 1) + w
        grams[order].update(tuple(line[i : i + order]) for i in range(len(w)))
    for k in range(order - 1, 0, -1):
        for g, n in grams[k + 1].items():
            grams[k][g[1:]] += n if g[1] == "\0begin" else 1
    d = {k: lm.discounts(*(sum(n == i for n in grams[k].values()) for i in (1, 2, 3, 4))) for k in grams}
    sums, given_back = defaultdict(int), defaultdict(float)
    for k in grams:
        for g, n in grams[k].items():
            sums[k, g[:-1]] += n
            given_back[k, g[:-1]] += d[k][min(n, 3) - 1]

    def p(*gram):
        k = len(gram)
        lower = p(*gram[1:]) if k > 1 else 1 / (len(counts) + 1)
        total = sums.get((k, gram[:-1]), 0)
        if not total:
            return lower
        n = grams[k].get(gram, 0)
        return (n - (d[k][min(n, 3) - 1] if n else 0)) / total + given_back[k, gram[:-1]] / total * lower

    return p, counts


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_the_dictionaries(spark, order):
    train = spark.createDataFrame([(t,) for t in TEXTS[:50]], "text string").repartition(3)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "zzz the yyy", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(2)
    model = lm.fit(train, order=order)
    p, counts = brute(TEXTS[:50], order)
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    found = {r["doc_id"]: r for r in lm.score(df, model).collect()}
    for i, t, _ in rows:
        w = words(t)
        line = ["\0begin"] * (order - 1) + w
        assert found[i]["n_tokens"] == len(w)
        assert found[i]["n_known"] == sum(counts[x] > 0 for x in w)
        assert found[i]["score"] == pytest.approx(sum(math.log10(p(*line[j : j + order])) for j in range(len(w))), rel=1e-12)
        assert found[i]["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w), rel=1e-12)
    for a in ("the", "\0begin", "never seen"):
        context = ["\0begin"] * (order - 2) + [a]
        assert sum(p(*context, b) for b in [*counts, "\0unknown"]) == pytest.approx(1)


def test_other_orders_are_refused(spark):
    with pytest.raises(ValueError, match="order"):
        lm.fit(spark.createDataFrame([], "text string"), order=4)


def test_longer_contexts_fit_training_text_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen = [lm.score(docs, lm.fit(docs, order=order)).agg({"score": "sum"}).head()[0] for order in (2, 3)]
    assert seen[1] > seen[0]


def test_packed_blocks_come_back_whole():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 4):
        columns = [rng.integers(0, 1 << 62, 500).astype(np.uint64) for _ in range(k)]
        sums = [rng.integers(0, 1 << 40, 500), np.zeros(500, np.int64)]
        found = lm._unpacked(lm._packed(columns, sums), k, 2)
        assert sorted(zip(*(c.tolist() for c in found), strict=True)) == sorted(zip(*(c.tolist() for c in [*columns, *sums]), strict=True))


def test_numbers_of_a_range(tmp_path):
    keys = np.unique(np.random.default_rng(6).integers(0, 1 << 61, 5000).astype(np.uint64)) | np.uint64(5 << 61)
    numbers = np.stack([np.arange(len(keys)), np.full(len(keys), 7)])
    lm._save_keys(str(tmp_path), "r", keys, 3)
    lm._save_numbers(str(tmp_path), "r-n", numbers)
    hit, at, size = lm._find(str(tmp_path), "r", keys[::2], 3)
    assert size == len(keys) and hit.tolist() == list(range(len(keys[::2])))
    assert (lm._numbers(str(tmp_path), "r-n", at) == numbers[0, ::2]).all() and set(lm._numbers(str(tmp_path), "r-n", at + size)) == {7}
    assert not len(lm._find(str(tmp_path), "r", keys ^ np.uint64(1 << 33), 3)[0])



def test_nothing_to_learn_from(spark):
    model = lm.fit(spark.createDataFrame([], "text string"))
    row = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["score"], row["base_score"]) == (3, 0, 0.0, 0.0)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_counts_over_255_are_whole(spark):
    model = lm.fit(spark.createDataFrame([("x " * 700,)], "text string"))
    numbers = lm.word_numbers(model.folder, model.word_bits, lm.word_hashes("x x x"))
    assert lm.Scorer(model).grams([numbers[:1], numbers[1:2], numbers[2:3]])[0].tolist() == [[698]]


def test_the_model_folder_may_be_a_uri(spark, tmp_path):
    model = lm.fit(spark.createDataFrame([("a",)], "text string"), model_dir=f"file://{tmp_path}/model")
    assert os.path.exists(f"{tmp_path}/model/1-0.0.npy")
    assert lm.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).head()["n_known"] == 2


def test_the_base_of_a_literal_table(spark):
    # N = 100 tokens, V = 20 types: an unknown token has 1 / (100 + 21)
    texts = [" ".join(f"w{k}" for k in range(19))] * 5
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert (model.train_tokens, model.vocabulary) == (100, 20)
    row = lm.score(spark.createDataFrame([(1, "x y w0")], "doc_id long, text string"), model).collect()[0]
    assert row["base_score"] == pytest.approx(2 * math.log10(1 / 121) + 2 * math.log10(6 / 121))


def test_an_absent_range_is_an_error(spark):
    model = lm.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    df = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    assert lm.score(df, model).count() == 1
    with pytest.raises(FileNotFoundError, match="is not here"):
        lm.Scorer(replace(model, folder="/nonexistent")).score([lm.word_hashes("a")])
    path = model.folder.removeprefix("file://")
    for name in os.listdir(path):
        if name.startswith("3-"):
            os.rename(f"{path}/{name}", f"{path}/gone-{name}")
    shards.load.cache_clear()
    with pytest.raises(FileNotFoundError, match="is not here"):
        lm.Scorer(model).score([lm.word_hashes("the cat")])


def test_the_number_of_ranges_changes_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    few, many = (lm.fit(df, range_bytes=b) for b in (1 << 20, 40))
    assert many.bits > few.bits
    rows = [sorted(map(tuple, lm.score(df, m).collect())) for m in (few, many)]
    assert [r[0] for r in rows[0]] == [r[0] for r in rows[1]]
    assert all(a[1:] == pytest.approx(b[1:]) for a, b in zip(*rows, strict=True))
