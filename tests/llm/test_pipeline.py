"""The pipeline, stage by stage on small tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from rankweave.llm import queries
from tests.llm.test_dedup import plain_join

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the generated tables are not here")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_keep_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(5, base), (3, base + " more"), (9, "other " * 30), (None, base), (None, None), (1, ""), (2, "")]
    kept = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SMALL)
    expected = Counter(rows) - Counter([(5, base), (None, base)])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == expected


def test_near_copies_judge_each_text_of_a_repeated_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(7, a), (7, b), (3, a + " more"), (None, c), (None, c + " x"), (4, b + " y"), (4, b), (8, a + " z"), (8, a + " z"), (1, "one two"), (1, "one two"), (None, "p q"), (None, "p q")]
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SMALL).collect())
    assert kept[3, a + " more"] == 1 and kept[1, "one two"] == 1 and kept[None, "p q"] == 1
    assert kept[4, b] + kept[4, b + " y"] == 1 and kept[None, c] + kept[None, c + " x"] == 1
    assert sum(kept.values()) == 5


def test_redaction_keeps_columns_and_length(spark):
    rows = [(1, "call +1 (555) 555-0100 now"), (2, None), (3, "clean")]
    found = {r["doc_id"]: r for r in corpus_pipeline.redact_personal_data(spark, docs(spark, rows), SMALL).collect()}
    assert found[1]["text"] == "call [PHONE] now" and found[1]["n_chars"] == len("call [PHONE] now")
    assert found[2]["text"] is None and found[3]["text"] == "clean"


@needs_tables
def test_whole_run(spark):
    at = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SMALL)
        assert after.columns == columns, name
        rows, kept = [(r["doc_id"], r["text"]) for r in at.collect()], [(r["doc_id"], r["text"]) for r in after.collect()]
        if name == "exact dedup":
            last = {}
            for i, t in rows:
                last[t] = max(i, last.get(t, i))
            assert Counter(kept) == Counter((i, t) for t, i in last.items())
        if name == "near copies":
            assert Counter(i for i, _ in kept) == Counter(c for c in {c for _, c, _ in plain_join(rows)})
        at = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in at.collect()}


@needs_tables
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_give_a_row_for_each_row(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    rows = found.count()
    if name.startswith(("op4", "op5")):
        assert rows
    else:
        table = "embeddings" if name.startswith("op13") else "documents"
        assert rows == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
