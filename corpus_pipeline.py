"""Text pipeline: toxicity, near duplicates, benchmark leaks, source mix, token store.

Every stage is written as Parquet and read again as the input of the next.
"""

from __future__ import annotations

import public_tokenizers

from gridloom.llm import decontam, mixing, omh_dedup, token_store, toxicity
from gridloom.llm._common import scratch


def drop_toxic(spark, docs, sf_dir):
    """Documents scored 0.5 or more go; an input without labels rejects nothing."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("g_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each class of near copies stays."""
    return omh_dedup.deduplicate(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Each document as often as its source's rate has it."""
    return mixing.mix(docs)


def store_tokens(spark, docs, sf_dir):
    """Ids of every document in a content-addressed store; digests read back from it."""
    return token_store.store_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
