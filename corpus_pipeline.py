"""The corpus pipeline: documents to encoded, clean, deduplicated documents, one operator a stage.

1. toxicity: documents that the classifier rejects go.
2. simhash_dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays. SimHash
   fingerprints linked through BK-trees find them and are verified; an exact search finds those that are further apart in bits.
3. decontamination: documents that contain a benchmark item go.
4. secret_scans: secrets are replaced by marks in the text; every document stays.
5. bpe_coding: every text is encoded and decoded; the result has the digests of ids and decoded text.

Every stage reads whole texts, however long, and keeps all columns (the last one returns the digests). Null and empty texts
have the classifier's intercept as their score, are copies of each other (the one with the smallest id stays), contain no
item and no secret, and have no tokens; a null text stays null. Rows without a doc_id are documents whose id is larger
than any. Repeated rows are copies: one stays. Without labels, or with those of one class, the classifier scores all
alike. An empty table, or an empty benchmark, gives what it got. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_coding, decontamination, secret_scans, simhash_dedup, toxicity
from tidemark.llm.frames import table
from tidemark.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_duplicates(docs, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # After the stages before it an executor's heap is full, so Python holds less here than the operator does alone.
    return bpe_coding.bpe_digests(docs, vocabulary_path(), cache_words=1 << 16, rows=64)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe_coding", encode),
]

#: Model scores, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
