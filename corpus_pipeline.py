"""The training-data pipeline: documents -> toxicity -> exact copies -> near copies -> personal data -> packed sequences.

The simhash stage takes near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more, found by bit-sliced comparison of SimHash
fingerprints and checked on the complete sets. (The query op10 has a contract of its own: four words, four bits.)

Each stage takes (spark, docs, sf_dir) and gets what the one before it wrote. All but the last return the columns of documents.

Null texts: scored as empty by the first stage, one class with empty ones for exact copies, one group with empty and wordless ones for near copies, unchanged by
the personal data's, no tokens but the closing id when packed. Null and repeated ids are rows like any other; of equal rows one stays. Texts of any length are
taken whole. Other columns pass through, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, packing, pii, simhash, toxicity
from tidemark.llm.common import forget, materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs, pii.key_of(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the model, the fingerprints or the tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = materialise(out, f"stage-{name}")
            if k:
                forget(docs)
        docs = out
    return docs
