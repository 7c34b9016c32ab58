"""Queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from embertrace.llm.common import load
from embertrace.llm.hmm import hmm_scores
from embertrace.llm.html_text import extract_text
from embertrace.llm.jaccard import jaccard_components
from embertrace.llm.mixing import mix_sources
from embertrace.llm.packing import pack
from embertrace.llm.prefix_trie import conversation_trie
from embertrace.llm.quality import COUNTS, RATIOS, quality_rules
from embertrace.llm.repeats import repeated_spans
from embertrace.llm.registry import ORACLES, QUERIES, llm_query
from embertrace.llm.token_counts import count_tokens
from embertrace.llm.token_files import token_file_digest
from embertrace.llm.topk import top_k
from embertrace.llm.turn_repair import repair_digest
from embertrace.llm.vector_links import vector_links

__all__ = ["ORACLES", "QUERIES"]


@llm_query()
def op1_mixing(spark, sf_dir):
    """Words that a mix at weights 5, 2, 1 takes of each document."""
    copies = mix_sources(load(spark, sf_dir, "documents"), keep=["doc_id"])
    return copies.groupBy("mix_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("mix_size").alias("size"),
        F.first("mix_source_size").alias("source_size"), F.first("mix_target").alias("target"),
        F.coalesce(F.sum(F.when(F.col("mix_taken"), F.col("mix_size"))), F.lit(0)).alias("taken"),
    ).drop("mix_row")


@llm_query()
def op9_quality(spark, sf_dir):
    """Counts, ratios and verdict of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", *COUNTS, "base_failed", "kept", *RATIOS)


@llm_query()
def op2_token_counts(spark, sf_dir):
    """Token counts of every document."""
    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@llm_query()
def op4_token_files(spark, sf_dir):
    """Every document's place, length and checksum, read back from the compressed shards."""
    return token_file_digest(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@llm_query()
def op6_packing(spark, sf_dir):
    """Every piece of every document with its sequence and offset."""
    pieces = pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@llm_query()
def op5_topk(spark, sf_dir):
    """The five best inner products of every fiftieth vector with all others."""
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@llm_query()
def op7_html_text(spark, sf_dir):
    """Main text of every page."""
    return extract_text(load(spark, sf_dir, "pages"))


@llm_query()
def op8_jaccard(spark, sf_dir):
    """Size of every document's shingle set and its component of near duplicates."""
    return jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@llm_query()
def op3_repeats(spark, sf_dir):
    """Documents with passages of 50 words or more that repeat, and where."""
    return repeated_spans(load(spark, sf_dir, "documents"))


@llm_query()
def op10_hmm(spark, sf_dir):
    """Baseline and hidden Markov scores of every document."""
    return hmm_scores(load(spark, sf_dir, "documents"))


@llm_query()
def op11_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie(load(spark, sf_dir, "conversations"))


@llm_query()
def op12_vector_links(spark, sf_dir):
    """Links, component and verdict of every vector."""
    return vector_links(load(spark, sf_dir, "embeddings"))


@llm_query()
def op13_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired hash of every damaged conversation."""
    return repair_digest(load(spark, sf_dir, "conversations"))
