"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, kd_shards, line_dedup, mixing, ngram_join, nn_descent, pitman_yor, toxicity, wrappers

QUERIES = {
    "op1_html_extraction": wrappers.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_lm_scoring": pitman_yor.query,
    "op4_near_embeddings": nn_descent.query,
    "op5_line_dedup": line_dedup.query,
    "op6_kd_shards": kd_shards.query,
    "op7_ngram_join": ngram_join.query,
    "op8_toxicity": toxicity.query,
    "op9_mixing": mixing.query,
    "op10_bpe": bpe.query,
}
SQL = {
    "op4_near_embeddings": nn_descent.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
}
