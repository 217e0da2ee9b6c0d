"""From raw documents to tokens: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievework.llm.bpe import bpe_stage
from sievework.llm.decontaminate import decontaminate_stage
from sievework.llm.line_dedup import line_stage
from sievework.llm.ngram_join import near_duplicate_stage
from sievework.llm.quality_rules import quality_stage
from sievework.llm.words import read
from sievework.session import staged

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of docs.
STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: The learned rules, edit distances and merges have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is staged in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
