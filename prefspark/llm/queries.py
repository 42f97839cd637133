"""One query for each operator, over its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from prefspark.llm import (
    embedding_join,
    hard_negatives,
    language_id,
    lexical_search,
    line_quality,
    lm_scoring,
    mixing,
    near_dup,
    oracles,
    packing,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)
from prefspark.shared_storage import new_table_path

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus):
    """Column: crc32 of the doc_id as text, by ``modulus``; it sets rows aside for tests."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query()
def op1_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_remainder(4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "bits_per_byte")


@query()
def op2_best_fit_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op3_hash_ring_sharding(spark, sf_dir):
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query(line_quality.QUALITY_SQL)
def op10_line_quality(spark, sf_dir):
    return line_quality.quality(_table(spark, sf_dir, "documents"))


@query()
def op8_source_mixing(spark, sf_dir):
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


@query()
def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted")


@query()
def op7_token_counts(spark, sf_dir):
    """Totals after three batches: all documents; revised and deleted ones; that batch again.

    The second batch moves each eleventh doc_id to another source with its text doubled, and
    deletes each seventh of the others. Rows without a doc_id and repeated ones all count.
    """
    docs = _table(spark, sf_dir, "documents")
    versions = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json"), "utf8_bytes": None}
    ledger = token_counts.Ledger(spark, new_table_path(spark, "token-ledger"))
    ledger.commit(1, token_counts.count_tokens(docs, versions), unique=False)
    moved = docs.where("doc_id % 11 = 0").withColumn("source", F.lit("revised"))
    moved = moved.withColumn("text", F.concat("text", F.lit("\n"), "text"))
    deleted = docs.where("doc_id % 7 = 0 and doc_id % 11 <> 0")
    for _ in range(2):
        ledger.commit(2, token_counts.count_tokens(moved, versions), deleted, unique=False)
    return ledger.totals()


@query(oracles.EMBEDDING_JOIN)
def op5_embedding_join(spark, sf_dir):
    return embedding_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query(oracles.NEAR_DUPLICATES)
def op9_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


@query(oracles.SUBSTRING_DEDUP)
def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_words(_table(spark, sf_dir, "documents"))


@query()
def op13_lm_scoring(spark, sf_dir):
    scored = lm_scoring.score(_table(spark, sf_dir, "documents"), _remainder(10) != 0)
    held_out = F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out")
    numbers = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    return scored.select("doc_id", held_out, *numbers)


@query(oracles.LEXICAL_SEARCH)
def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query(oracles.HARD_NEGATIVES)
def op12_hard_negatives(spark, sf_dir):
    vectors, moved = _table(spark, sf_dir, "embeddings"), (F.col("label") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
