"""A training corpus from `documents`, in five stages; each one's rows are written as Parquet and read again by the next.

Every stage but the last gives the columns of its input. Rows are judged one by one: null and repeated doc_ids, null,
empty and very long texts and extra columns of any name pass like others (a null text counts as the empty one), and an
empty table gives an empty one. A stage's own tables lie in the shared folder and go as soon as nothing reads them; the
few that its result reads stay until the folder is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import bpe, jaccard, pii, quality, spaced_seeds
from codecorpus.llm import common as c


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    c.tuned(spark)
    return quality.kept_documents(docs, c.table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similar 5-word shingle sets (0.8) connect, the one of the least doc_id; of repeated rows, one. Documents without words stay."""
    c.tuned(spark)
    return jaccard.firsts(docs, 5, 80, 100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    c.tuned(spark)
    return spaced_seeds.clean(docs, c.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows. Null texts stay null."""
    c.tuned(spark)
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and a digest of the decoded text; a null text has no ids."""
    import public_tokenizers

    c.tuned(spark)
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = c.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = c.kept(stage(spark, docs, sf_dir), name.split()[0])
        c.release(*last)
        last = [docs]
    return docs


ORACLE_SQL = None
