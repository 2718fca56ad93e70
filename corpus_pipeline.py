"""A training corpus from the table of documents, stage by stage. Every stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitledger.llm import exact_dedup, mixing, packing, quality, simhash
from hitledger.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified on their language's labels.

    Null and empty texts fail the base rules; a null language is one of its own; whole texts count, however long; rows that repeat an id
    are judged each, with the id's labels; columns of any names pass through; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts: the largest doc_id, as in op2.

    A null text counts as empty; a row without an id stays only among such rows, all of them; rows that share an id and a text stay
    or go together; columns of any names pass through; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of texts that share 80 % of their five-word shingles: the smallest doc_id, as component ids in op1.

    Candidates come from six families of op1's fingerprints over the different words of texts. Null and empty texts are alike; rows of
    one doc_id stay or go together; rows without one go where a component has one; an empty table stays empty.
    """
    return simhash.keep_dissimilar(docs, least=0.8, shingle=5, families=6)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, weights and shares as in op7.

    A null source is one of its own, last in order; texts without words have size 0; rows that repeat an id and its text are taken
    together; ties are broken by a seeded hash; columns of any names pass through; an empty table stays empty.
    """
    members = F.array("source")
    return mixing.mixed_documents(docs, members, mixing.mix(docs, members))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the mixed documents in sequences of 4,096 tokens, as in op9.

    A null or empty text is its end id alone; longer texts are cut into pieces of 4,096; a document taken twice is packed twice, each
    copy with places of its own; an empty table gives no rows.
    """
    pieces = packing.tokenised_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(pieces).drop("part", "nth")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
          ("mixing", source_mix), ("best-fit packing", packed_sequences)]

#: Cutoffs, fingerprints and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the table of documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
