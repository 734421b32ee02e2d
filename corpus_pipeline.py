"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the
columns of documents. `run` writes each result to the shared folder and reads it back,
so that a lost executor costs one stage's tasks, not the whole job.
"""

from __future__ import annotations

from millrace.llm import contamination, line_dedup, near_dedup, packing, quality
from millrace.llm.queries import vocabulary
from millrace.session import scratch_path


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark, docs, sf_dir):
    """Lines that repeat an earlier one go; so do documents left without a word."""
    return line_dedup.clean(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Documents with a twentieth or more of their words from benchmark items go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark, docs, sf_dir):
    """Each piece of each document gets its sequence and its place there."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL can state the classifier and the tokenizer; tests use brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
