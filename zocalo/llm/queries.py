"""Runnable queries of this subpackage: name -> (function of session and folder, SQL that must agree or None)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zocalo.llm import cascade, conversations, hard_negatives, language, minhash, mixing, neighbours, packing, pii, quality, simhash, suffix_tree, tokens
from zocalo.llm.frames import table
from zocalo.llm.sql import CASCADE_SQL, MIXING_SQL

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Runner, str | None]] = {}


def over(name: str, operator: Callable[[DataFrame], DataFrame], source: str = "documents", sql: str | None = None) -> None:
    """Register ``operator`` over one whole table."""
    QUERIES[name] = (lambda spark, path: operator(table(spark, path, source)), sql)


BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

over("op1_pack_sequences", lambda docs: packing.pack(docs, BYTE_BPE))
over("op2_token_counts", lambda docs: tokens.count_tokens(docs, WORD_BPE))
over("op3_personal_data", pii.find_personal_data)
QUERIES["op4_quality_classifier"] = (lambda spark, path: quality.classify_quality(table(spark, path, "documents"), table(spark, path, "labels")), None)
over("op5_mix_sources", mixing.mix_report, sql=MIXING_SQL)
over("op6_nearest_vectors", neighbours.search, "embeddings")
over("op7_near_duplicates", simhash.near_duplicates)
over("op8_language_id", language.identify)
over("op9_suffix_tree_scores", suffix_tree.lm_scores)
over("op10_rule_cascade", cascade.rule_cascade, sql=CASCADE_SQL)
over("op11_hard_negatives", hard_negatives.hard_negatives, "embeddings")
over("op12_minhash_duplicates", minhash.near_duplicates)
over("op13_conversation_repair", conversations.repair, "conversations")
QUERIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
