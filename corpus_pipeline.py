"""The corpus pipeline: five of the operators over `documents`, each stage on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import jaccard, mixing, packing, pii, quality, queries
from eventloom.runtime import checkpoint_dir

#: Words of a shingle and the similarity (in hundredths) from which two documents are copies.
SHINGLE, SIMILAR = 5, 80
#: Tokens of a packed sequence, and the share of tokens that mixing keeps.
SEQUENCE, KEEP = 2048, 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and are rejected; equal rows are judged alike; nulls in other columns do not matter.
    """
    return quality.judge(docs).where("kept").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without words stay.

    Rows of one id stay together, so of repeated rows all copies stay; a group none of whose rows has an id stays whole.
    """
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"), k=SHINGLE, num=SIMILAR)
    kept = groups.where("component_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are masked, terms that give them away generalised or removed.

    No row goes; a null text stays null, equal texts change alike.
    """
    return pii.sanitise(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their cells' calibrated probabilities.

    Null sources and languages are values of their own; texts without tokens are kept; rows of one id and cell are kept or dropped together.
    """
    return mixing.mix(docs, keep=KEEP).where("kept").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of SEQUENCE tokens.

    A null text is packed as an empty one; repeated rows get places of their own.
    """
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), limit=SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pii_sanitisation", pii_sanitisation),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Shingle sets, tokenizers and fitted patterns are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again.

    An empty table passes through all stages. Columns of any names beside doc_id, text, source and lang are carried along up to packing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
