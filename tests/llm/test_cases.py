"""Clashing column names, ids beyond 2**53 beside null, and one id on many rows, through all operators."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankweave.llm import bpe, fingerprint, jaccard, language_model, packing, pii, token_count, toxicity

CLASHING = ("__text", "__id", "__mark", "__spans", "__ids", "row", "own_id", "mark", "positive")
BIG = 2**53 + 1


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two three four five six seven"), (2, None), (2, "mail me at a.b@c.org now"), (None, "one two three four five six seven"), (BIG, "x " * 400), (BIG, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.lit("-"), F.coalesce("text", F.lit("null"))) for c in CLASHING})


def same(df, clashing, texts_change=False):
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", *CLASHING))
    assert sorted(map(key, df.collect())) == sorted(map(key, clashing.collect()))


def test_columns_of_any_name_pass(spark, clashing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(clashing, path, pattern)
    same(ids, clashing)
    same(bpe.decode(ids, path), clashing)
    same(token_count.count_tokens(clashing, public_tokenizers.path("byte_bpe_50k.json"), pattern), clashing)
    same(language_model.score(clashing, language_model.fit(clashing)), clashing)
    marked = pii.mark(clashing, keep_text=True)
    same(pii.find(marked, pii.fit(marked)), clashing)
    same(pii.redact(marked, pii.fit(marked)), clashing)
    same(toxicity.score(clashing, toxicity.Model({}, 0.0, 0.5), out="toxic"), clashing)


def test_near_copies_keep_their_columns_and_one_of_repeated_rows(spark, clashing):
    twice = clashing.unionByName(clashing).repartition(7)
    kept = jaccard.keep_first(twice)
    assert kept.columns == clashing.columns
    rows = kept.where("text like 'one two%'").collect()
    assert len(rows) == 1 and rows[0]["__id"].startswith("__id-one")
    assert sorted(map(str, jaccard.keep_first(twice.repartition(3)).collect())) == sorted(map(str, kept.collect()))


def test_every_stage_takes_clashing_columns(spark, clashing, tmp_path):
    spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 40)], "doc_id long, quality int, t boolean").select("doc_id", "quality", F.col("t").cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == clashing.columns
            assert docs.where("`__id` not like '__id-%' or `__spans` not like '__spans-%'").count() == 0
    assert docs.count() > 0


def test_big_ids_beside_null(spark):
    ids = [BIG, None, BIG + 2, 1, 2, None]
    df = spark.createDataFrame([(i, f"text of number {n} " * 3) for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    packed = packing.pack(df, F.length("text"))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in packed.collect()) == sorted((i is None, i or 0) for i in ids)
    texts = spark.createDataFrame([(str(i),) for i in ids], "doc_id string")
    assert sorted(r["doc_id"] for r in packing.pack(texts, F.lit(3)).collect()) == sorted(map(str, ids))
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect() if r["doc_id"] is not None}
    assert {BIG, BIG + 2, 1, 2} == set(found)
    own = {r["doc_id"]: r["text"] for r in df.collect()}
    half = len(own[BIG]) // 2
    assert found[BIG]["edited"] == own[BIG][: len(own[BIG]) - half] + own[BIG + 2][:half]


def test_the_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda pos, unl, prior: held.append((len(pos), len(unl))) or toxicity.Model({}, 0.0, prior))
    rows = [(1, f"row {i} of one id") for i in range(3000)] + [(i, f"text {i}") for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(1, 200)], "doc_id long, toxic int")
    toxicity.fit(df, labels, positives=10, unlabelled=20)
    toxicity.fit(df, labels, positives=100, unlabelled=2000, most_bytes=200)
    assert held[0] == (10, 20)
    assert 0 < held[1][0] <= 40 and 0 < held[1][1] <= 40
