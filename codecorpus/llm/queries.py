"""The thin queries of the numbered operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import bpe, elias_fano, hard_negatives, hash_tree, jaccard, licences, nn_descent, pii, quality, runs, spaced_seeds, suffix_array, token_counts
from codecorpus.llm import common as c


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    shards = elias_fano.write(docs, c.new_folder(spark, "ids"), _tokenizer("byte_bpe_50k.json"), _pattern())
    return elias_fano.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(c.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_array.remove_repeats(c.table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(c.table(spark, sf_dir, "embeddings"), top=20, every=20)


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.leaks(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"), light=True)


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(c.table(spark, sf_dir, "documents"), 24)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(c.table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(c.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(c.table(spark, sf_dir, "documents"), 4, 85, 100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(c.table(spark, sf_dir, "embeddings"), label, every=100, positives=5, negatives=5, scale=256)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(c.table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), 4096)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same),
     n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.r <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_elias_fano, op2_pii_boosting, op3_suffix_array, op4_nn_descent, op5_spaced_seeds, op6_hash_tree, op7_licences, op8_bpe, op9_ngram_jaccard, op10_quality, op11_runs, op12_hard_negatives, op13_token_counts)}
ORACLE: dict[str, str] = {"op12_hard_negatives": OP12_SQL}
