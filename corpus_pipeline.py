"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The stages before the last return
the columns of docs. ORACLE_SQL is None: no stage but the joins around them can be written in SQL.
"""

from __future__ import annotations

from pixelfurrow.llm import byte_bpe, decontaminate, langid, ngram_join, suffix_dedup
from pixelfurrow.llm.common import written

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", ngram_join.stage),
    ("repeated_passages", suffix_dedup.stage),
    ("benchmark_leaks", decontaminate.stage),
    ("token_ids", byte_bpe.stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
