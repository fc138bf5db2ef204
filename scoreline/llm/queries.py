"""The thin query of each operator over its whole table, and oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import fold, labelled_sample
from .op01_norm_topk import ORACLE_SQL as TOPK_SQL, integer_vectors, norm_topk
from .op02_mixture import document_dimensions, form_topic, mix_sources, oracle_sql as mixture_sql, word_count
from .op03_quality import fit_quality, score_quality
from .op04_decontaminate import find_leaks
from .op05_attention_lm import fit_language_model, score_texts
from .op06_token_shards import read_token_shards, write_token_shards
from .op07_toxicity import fit_grammar, score_toxicity
from .op08_language import fit_languages, identify_language
from .op09_secrets import find_secrets
from .op10_ngram_join import ngram_jaccard_join
from .op11_alignment import align_tokenizers
from .op12_token_counts import count_tokens
from .op13_merkle import merkle_manifest, oracle_sql as merkle_sql
from .storage import fresh_path, importable, saved

#: Labelled rows that a classifier is fitted on at most.
FIT_ROWS = 20_000
#: The same for the quality classifier, whose sample goes to one task.
QUALITY_ROWS = 8_000
#: Share of all tokens that the mixture keeps.
MIX_KEEP = 0.6
#: Tokens of a document beyond which it is over the limit.
TOKEN_LIMIT = 4096
#: Ends each document's token ids.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of each vector whose id 20 divides."""
    return norm_topk(integer_vectors(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (6 decimals), sampled."""
    # texts are read once, for their topic and number of tokens
    docs = saved(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", form_topic().alias("topic"), word_count().alias("words")), "counted")
    mixed = mix_sources(docs, document_dimensions(topic=F.col("topic")), F.col("words"), MIX_KEEP)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", 4, 2, QUALITY_ROWS))
    score = F.col("quality_score")
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks: doc_id, item_id,
    similarity (6 decimals), start_word, end_word, distance."""
    leaks = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.inline("leaks")).withColumn("similarity", F.round("similarity", 6))


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer file, which is part of each machine's Python installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_language_model(docs.where(fold("doc_id", 5) != 1), _tokenizer())
    return score_texts(docs, model).withColumn("held_out", fold("doc_id", 5) == 1)


def token_ids(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token shards and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_path(docs.sparkSession, "tokens")
    manifest = write_token_shards(docs, folder, _tokenizer(), END_ID)
    return read_token_shards(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards written."""
    return token_ids(_table(spark, sf_dir, "documents"))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), toxic_clauses."""
    docs = _table(spark, sf_dir, "documents")
    grammar = fit_grammar(labelled_sample(docs, _table(spark, sf_dir, "labels"), "toxic", 4, 2, FIT_ROWS))
    scored = score_toxicity(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "toxic_clauses")


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    model = fit_languages(docs.where("NOT held_out"))
    return identify_language(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, span_owners,
    span_repositories; a source is an owner, its documents of one language are a repository."""
    docs = _table(spark, sf_dir, "documents")
    return find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.9: doc_id, n_shingles, component_id."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align_tokenizers(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")).drop("groups")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > 4096)."""
    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), TOKEN_LIMIT)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, rank, leaf, subroot, root, proof_sha256, folded_root, verified; rows
    whose id's crc32 5 divides are tampered with."""
    return merkle_manifest(_table(spark, sf_dir, "documents"), tampered=F.col("doc_id").isNotNull() & (fold("doc_id", 5) == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_norm_bucketed_topk,
        op2_source_mixture,
        op3_quality_nbsvm,
        op4_benchmark_decontamination,
        op5_attention_lm,
        op6_token_shards,
        op7_toxicity_grammar,
        op8_language_codes,
        op9_secret_ownership,
        op10_ngram_jaccard_join,
        op11_tokenizer_alignment,
        op12_token_counts,
        op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_norm_bucketed_topk": TOPK_SQL, "op2_source_mixture": mixture_sql(MIX_KEEP), "op13_merkle_manifest": merkle_sql()}
