"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from gridscore.llm import chat_format, conversation_repair, decontaminate, html_extract, kmeans_tree, language_id, line_dedup, merkle, packing, quality_classifier, quality_rules, simhash, suffix_dedup
from gridscore.llm.common import table

QUERIES = {
    "op1_chat_format": lambda spark, sf_dir: chat_format.digest(table(spark, sf_dir, "conversations")),
    "op2_language_id": lambda spark, sf_dir: language_id.digest(table(spark, sf_dir, "documents")),
    "op3_suffix_dedup": lambda spark, sf_dir: suffix_dedup.digest(table(spark, sf_dir, "documents")),
    "op4_line_dedup": lambda spark, sf_dir: line_dedup.digest(table(spark, sf_dir, "documents")),
    "op5_quality_classifier": lambda spark, sf_dir: quality_classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_quality_rules": lambda spark, sf_dir: quality_rules.digest(table(spark, sf_dir, "documents")),
    "op7_html_extract": lambda spark, sf_dir: html_extract.digest(table(spark, sf_dir, "pages")),
    "op8_packing": lambda spark, sf_dir: packing.digest(table(spark, sf_dir, "documents")),
    "op9_decontaminate": lambda spark, sf_dir: decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op10_simhash": lambda spark, sf_dir: simhash.digest(table(spark, sf_dir, "documents")),
    "op11_merkle": lambda spark, sf_dir: merkle.digest(table(spark, sf_dir, "documents")),
    "op12_kmeans_tree": lambda spark, sf_dir: kmeans_tree.digest(table(spark, sf_dir, "embeddings")),
    "op13_conversation_repair": lambda spark, sf_dir: conversation_repair.digest(table(spark, sf_dir, "conversations")),
}

ORACLES = {"op1_chat_format": chat_format.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op11_merkle": merkle.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
