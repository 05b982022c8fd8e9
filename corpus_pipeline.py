"""From raw documents to token ids: quality, exact dedup, near dedup, source mix, BPE.

Each stage takes all rows that the one before kept, written as Parquet and read again; all but the last return the
columns of documents. The mix repeats a row as often as it takes it, so a doc_id can occur twice after it. The last
returns the ids with their number, their digest and that of the decoded text.

The near-dedup stage asks for five-word shingles at similarity 0.8 or more. Candidates meet by SimHash fingerprints of
these shingles with Golay keys, as op2 links them; those miss most pairs near 0.8 (README, with figures), so the rest
meet in bands of minima. Each candidate is verified by its exact shingle similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe, exact_dedup, mixing, quality, simhash
from leadloom.llm.common import stored
from leadloom.llm.queries import VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.train_quality(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, VOCABULARY, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained model, fingerprints, a seeded choice and BPE: no SQL twin; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage-{n}")
    return docs
