"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import alignment, bpe, centroids, chat, exact_dedup, fingerprint, jaccard, language_model, line_dedup, packing, pii, token_count, toxicity
from rankweave.llm.scratch import documents, fold, text_of, written

QUERIES: dict = {}
ORACLE: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    ids = ids.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), "token_ids")
    return bpe.decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    counts = token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


ORACLE["op10_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a byte-level model: a symbol for each UTF-8 byte and one for the end."""
    return packing.pack(documents(spark, sf_dir), F.octet_length(text_of("text")) + 1)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = written(pii.mark(documents(spark, sf_dir).select("doc_id", "text")), "personal-data-marked")
    found = pii.find(marked, pii.fit(marked))
    of = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *of, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.linked_fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "links")


@query
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    model = language_model.fit(docs.where(~held_out))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# No message of the tables calls a tool: the SQL is for plain messages, calls are tested on literal ones.
ORACLE["op5_chat_formatting"] = """
SELECT conv_id,
       turn // 256 AS part,
       count(*) AS n_messages,
       CAST(0 AS BIGINT) AS n_calls,
       CAST(0 AS BIGINT) AS n_invalid,
       CAST(0 AS BIGINT) AS n_results,
       CAST(0 AS BIGINT) AS n_unlinked,
       '[' || string_agg(CAST(to_json({content: text, role: role}) AS VARCHAR), ',' ORDER BY turn, role, text) || ']' AS chat
FROM conversations
GROUP BY conv_id, turn // 256
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    groups = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = alignment.link_counts(groups.select("row", "place", "part", "parts", "n_a", "n_b", "n_groups", "pairs", "times", digest))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op12_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
keys AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
marked AS (
    SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped
    FROM keys
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked
GROUP BY doc_id
"""


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(centroids.as_text(F.col("centroid")), 256).alias("centroid_sha256"))


ORACLE["op13_centroids"] = centroids.centroid_sql("embeddings", k=16, rounds=3, dim=64, scale=64, seed=1)
