"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

Every stage reads all that the one before it kept, and all but the last give
the columns of documents. Null texts count as empty ones throughout: no stage
drops them but as copies of each other. A null doc_id is an id like others;
of rows that share an id each is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import exact_dedup, jaccard, packing, pii, toxicity
from rankweave.llm.scratch import documents, text_of, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.5 or more go; the classifier learns from labels outside fold 0."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="toxic_score").where("toxic_score < 0.5").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that chains of links join (word 5-grams, Jaccard 0.8) the row of the smallest doc_id stays."""
    return jaccard.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]; n_chars follows."""
    marked = written(pii.mark(docs, keep_text=True), "pipeline-marked")
    clean = pii.redact(marked, pii.fit(marked))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the texts in bins, in symbols of a byte-level model with an end behind each text."""
    return packing.pack(docs, F.octet_length(text_of("text")) + 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learning, sketches and best-fit packing have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
