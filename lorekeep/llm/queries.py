"""The queries of this subpackage and their SQL, by the names under which they are registered."""

from __future__ import annotations

from . import (
    embedding_dedup, line_dedup, phrase_mining, piece_encoding, pivot_search, pseudo_likelihood, quality_classifier, quality_rules, ranked_search, sharding, simhash_dedup, source_mixing, suffix_dedup,
)
from .common import table


def _on(f, *names):
    return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))


def queries() -> dict:
    return {
        "op1_line_dedup": _on(line_dedup.op1, "documents"),
        "op2_sharding": _on(sharding.op2, "documents"),
        "op3_quality_rules": _on(quality_rules.op3, "documents"),
        "op4_piece_encoding": _on(piece_encoding.op4, "documents"),
        "op5_embedding_dedup": _on(embedding_dedup.op5, "embeddings"),
        "op6_source_mixing": _on(source_mixing.op6, "documents"),
        "op7_quality_classifier": _on(quality_classifier.op7, "documents", "labels"),
        "op8_simhash_dedup": _on(simhash_dedup.op8, "documents"),
        "op9_suffix_dedup": _on(suffix_dedup.op9, "documents"),
        "op10_lm_scoring": _on(pseudo_likelihood.op10, "documents"),
        "op11_ranked_search": _on(ranked_search.op11, "documents", "benchmark"),
        "op12_phrase_mining": _on(phrase_mining.op12, "documents"),
        "op13_pivot_search": _on(pivot_search.op13, "embeddings"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL, "op3_quality_rules": quality_rules.OP3_SQL, "op5_embedding_dedup": embedding_dedup.OP5_SQL, "op6_source_mixing": source_mixing.OP6_SQL, "op9_suffix_dedup": suffix_dedup.OP9_SQL,
        "op11_ranked_search": ranked_search.OP11_SQL, "op12_phrase_mining": phrase_mining.OP12_SQL, "op13_pivot_search": pivot_search.OP13_SQL,
    }
