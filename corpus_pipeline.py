"""A training-data pipeline over ``documents``: each stage is one operator of the llm
subpackage, reads what its predecessor kept, and is written as Parquet for the next.

Nulls and odd rows: a null or empty text is never toxic, in no group of copies, leaks
nothing, and leaves at the mixture (it has no tokens to sample). Rows are told apart by id
and text together, so that an id with two texts is two documents and null ids take part;
rows that repeat both are copies, of which one stays. Empty tables pass through as empty
tables. Extra columns are kept with their values, whatever their names: an operator sees
only the columns that it reads, the others wait in one of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm.learning import labelled_sample
from scoreline.llm.op02_mixture import document_dimensions, mix_sources, word_count
from scoreline.llm.op04_decontaminate import find_leaks
from scoreline.llm.op07_toxicity import fit_grammar, score_toxicity
from scoreline.llm.op10_ngram_join import ngram_jaccard_join
from scoreline.llm.queries import FIT_ROWS, MIX_KEEP, token_ids
from scoreline.llm.storage import importable, saved

#: Documents with this toxicity or more are rejected.
TOXIC = 0.3


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the ``needed`` columns and all others in one, and what restores its columns."""
    others = [c for c in docs.columns if c not in needed]
    rows = docs.select(*needed, *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")] if others else []))
    return rows, lambda kept: kept.select(*(F.col(c) if c in needed else F.col("_others").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, learned from the labels of three of four folds of ids."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    grammar = fit_grammar(labelled_sample(docs, labels, "toxic", 4, 2, FIT_ROWS))
    rows, restore = apart(docs, "text")
    return restore(score_toxicity(rows, grammar).where(F.col("toxicity") < TOXIC))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on five-word shingles at similarity 0.8: of each group that links
    connect, the document with the smallest id stays (of one id's, that with the smaller hash)."""
    importable(spark)
    rows, restore = apart(docs, "doc_id", "text")
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    linked = ngram_jaccard_join(rows, id_col="_key", k=5, threshold=Fraction(4, 5))
    linked = linked.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    named = rows.select("_key", "doc_id").distinct().join(linked, "_key")
    stay = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).getField("_key").alias("_key")).select("_key")
    return restore(rows.join(stay, "_key", "left_semi").dropDuplicates(["_key"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    importable(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows, restore = apart(docs, "text")
    return restore(find_leaks(rows, items).where(F.size("leaks") == 0))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents are sampled by probabilities raked to the target shares."""
    rows, restore = apart(docs, "doc_id", "text", "source", "lang")
    return restore(mix_sources(rows, document_dimensions("mix_"), word_count(), MIX_KEEP).where("sampled"))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, start, n_tokens, ids_crc32 as read back from the shards."""
    return token_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixture", sample_mixture),
    ("token_shards", token_shards),
]

#: SQL expresses neither the learned grammar nor the shards; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
