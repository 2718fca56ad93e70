"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitledger.llm import (exact_dedup, lexical, mixing, packing, quality, simhash, substrings, token_counts, token_files, toxicity, url_filter,
                           vector_codes, warc)
from hitledger.llm.common import small_table, written
from hitledger.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), scores)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    token_files.write_token_files(
        _table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, path, with_ids=False)


# Fixed values of the filter: list entries with their verdicts.
URL_RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"),
             url_filter.Rule("org/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(pages, URL_RULES)).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    by_source = small_table(
        spark, [(s, result.sizes[s], result.targets[s]) for s in result.sizes], "source string, source_size long, target double")
    rows = result.documents.withColumn("_source", F.col("members")[0])
    return rows.join(by_source, rows["_source"].eqNullSafe(by_source["source"])).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised_pieces(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(pieces).drop("part", "nth")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality.with_statistics(_table(spark, sf_dir, "documents")).drop("text", "source", "n_chars")
    statistics = written(counted, "quality")
    cutoffs = quality.calibrate(statistics, _table(spark, sf_dir, "labels"))
    return quality.with_verdict(statistics, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vector_codes.with_label_error(codes.rows).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(warc.capture(_table(spark, sf_dir, "pages")), path)
    found = warc.resolved(warc.read_pages(spark, path))
    whole = F.when(F.col("problem").isNull(), F.col("payload_bytes")).otherwise(F.raise_error("problem").cast("long"))
    return found.select("page_id", whole.alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
                        F.col("refers_page").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}
