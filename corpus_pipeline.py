"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

1. language ID, trained on the documents' own ``lang``: documents that the
   classifier puts in none of the learned languages go (null text, no letter, or
   far from every codeword); if no document has a ``lang``, all of them stay;
2. SimHash near-dedup: one document of each group stays, the one of least id
   (five-word shingles, Jaccard similarity 0.8 or more, verified; candidates by
   24 sketches of 64 bits);
3. benchmark decontamination: documents with a benchmark passage go;
4. mixing: documents are repeated or left out so that sources meet their targets,
   the one at a source's cut ending with the last word taken;
5. sharding: eight shards of near equal bytes.

An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, language_id, mixing, near_dedup, sharding
from tidemark.llm._base import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
