"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from sievework.llm import bpe, decontaminate, html_text, line_dedup, merkle, mixing, ngram_join, pii, prefix_trie, quality_rules, secret_scan, suffix_dedup, token_store

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_pii": pii.op3_pii,
    "op4_bpe": bpe.op4_bpe,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_html_text": html_text.op7_html_text,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_token_store": token_store.op9_token_store,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_mixing": mixing.op11_mixing,
    "op12_merkle": merkle.op12_merkle,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op11_mixing": mixing.OP11_SQL, "op12_merkle": merkle.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
