"""The queries of this package and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.llm import (
    chat_format,
    chunk_reuse,
    count_vector_join,
    filter_audit,
    line_windows,
    link_graph,
    mix_queries,
    permutation_index,
    quality_queries,
    toxicity,
    walsh_clusters,
)
from palaver.llm.best_fit import pack, pieces
from palaver.llm.common import stored, table
from palaver.llm.token_counts import token_counts


def op3_chat_format(spark, sf_dir):
    messages = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    parts = chat_format.text_parts(F.col("text"))
    return chat_format.read_back(chat_format.format_conversations(messages.withColumn("parts", parts)))


def op4_best_fit_packing(spark, sf_dir):
    # Encoded once; counting and packing read the stored pieces.
    return pack(stored(pieces(table(spark, sf_dir, "documents")), "pieces"))


def op5_permutation_index(spark, sf_dir):
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op7_count_vector_join(spark, sf_dir):
    return count_vector_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_windows(spark, sf_dir):
    return line_windows.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_link_graph(spark, sf_dir):
    return link_graph.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_divergence": quality_queries.op1_quality_divergence,
    "op2_source_mix": mix_queries.op2_source_mix,
    "op3_chat_format": op3_chat_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_permutation_index": op5_permutation_index,
    "op6_token_counts": op6_token_counts,
    "op7_count_vector_join": op7_count_vector_join,
    "op8_line_windows": op8_line_windows,
    "op9_toxicity": op9_toxicity,
    "op10_link_graph": op10_link_graph,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_walsh_clusters": walsh_clusters.op12_walsh_clusters,
    "op13_chunk_reuse": chunk_reuse.op13_chunk_reuse,
}

# op4, op6 and op13 hang on tokenizers, op5 and op9 are approximate and learnt: tests
# hold them against the library, brute force and held-out labels.
ORACLES = {
    "op1_quality_divergence": quality_queries.ORACLE,
    "op2_source_mix": mix_queries.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op7_count_vector_join": count_vector_join.ORACLE,
    "op8_line_windows": line_windows.ORACLE,
    "op10_link_graph": link_graph.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_walsh_clusters": walsh_clusters.ORACLE,
}
