"""Pairing: the first positive output of a (prompt, concept) with one sampled negative.

"First" and "sampled" need an order that Spark tables do not have, so every operator takes
a unique integer column ``ord`` and refuses to run without it.

The sample comes in two modes. ``hash`` (the default) takes the negative with the smallest
``md5('seed|input|ord')``: a mergeable minimum, so a prompt may have any number of
negatives, and new files can be merged into what was picked before. ``exact`` takes the row that a seeded numpy generator would, which depends on
nothing but the number of negatives of the prompt.
"""

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prefspark.functions.text import prompt_text
from prefspark.operators.filters import long_enough
from prefspark.operators.joins import join_grouped
from prefspark.operators.ranking import seeded_hash, with_group_ordinal
from prefspark.operators.replay import first_of_shuffle
from prefspark.schema import TRIPLE_COLUMNS, require_columns

# Fixed values of the pairing.
POSITIVE, NEGATIVE = "positive", "negative"
MIN_LEN = 10
NEGATIVE_SEED = 44


def _ordered(triples: DataFrame) -> DataFrame:
    """The triples, failing the job that meets a row without its ``ord``."""
    require_columns(triples, (*TRIPLE_COLUMNS, "ord"), "triple table")
    refuse = F.raise_error(F.lit("ord must not be null")).cast(triples.schema["ord"].dataType)
    return triples.withColumn("ord", F.coalesce("ord", refuse))


def positives(triples: DataFrame) -> DataFrame:
    """Positive rows that can found a pair: prompt and concept are known."""
    return _ordered(triples).where(
        (F.col("category") == POSITIVE)
        & F.col("input").isNotNull()
        & F.col("output_concept").isNotNull()
    )


def negatives(triples: DataFrame) -> DataFrame:
    """The negative pool of each known prompt. The concept of a negative does not matter."""
    return _ordered(triples).where((F.col("category") == NEGATIVE) & F.col("input").isNotNull())


def first_positive(triples: DataFrame) -> DataFrame:
    """The first positive output per (input, output_concept), null if that one is null."""
    return (
        positives(triples)
        .groupBy("input", "output_concept")
        .agg(F.min(F.struct("ord", "output")).alias("first"))
        .select("input", "output_concept", F.col("first.output").alias("chosen"))
    )


def inputs_with_negative(triples: DataFrame) -> DataFrame:
    """Rows whose prompt has a negative."""
    pool = negatives(triples).select("input").distinct()
    return join_grouped(triples, pool, "input", "left_semi").select(*triples.columns)


def concepts_without_positive(triples: DataFrame) -> DataFrame:
    """(input, output_concept) groups that yield no pair because they have no positive."""
    groups = (
        _ordered(triples)
        .where(F.col("input").isNotNull() & F.col("output_concept").isNotNull())
        .groupBy("input", "output_concept")
        .agg(F.max(F.coalesce(F.col("category") == POSITIVE, F.lit(False))).alias("found"))
    )
    return groups.where(~F.col("found")).select("input", "output_concept")


def negative_ordinals(triples: DataFrame) -> DataFrame:
    """Each negative with its 0-based position in the pool of its prompt, and the pool size."""
    return with_group_ordinal(negatives(triples), ["input"], "ord", "ordinal", "pool_size")


def sample_negative_hash(triples: DataFrame, seed: int = NEGATIVE_SEED) -> DataFrame:
    """One negative output per prompt: the one with the smallest seeded hash."""
    candidate = F.struct(
        seeded_hash(seed, F.col("input"), F.col("ord")).alias("hash"), "ord", "output"
    )
    return (
        negatives(triples)
        .groupBy("input")
        .agg(F.min(candidate).alias("pick"))
        .select("input", F.col("pick.output").alias("rejected"))
    )


def drawn_positions(sizes: DataFrame, seed: int = NEGATIVE_SEED) -> DataFrame:
    """``(pool_size, drawn)`` for each distinct pool size.

    Sizes that differ add up to at most the rows of the table, so n rows have fewer than
    sqrt(2n) of them.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(drawn=[first_of_shuffle(int(n), seed) for n in batch["pool_size"]])

    return sizes.distinct().mapInPandas(draw, "pool_size long, drawn long")


def sample_negative_exact(triples: DataFrame, seed: int = NEGATIVE_SEED) -> DataFrame:
    """One negative output per prompt: the one the seeded generator draws."""
    sizes = negatives(triples).groupBy("input").agg(F.count(F.lit(1)).alias("pool_size"))
    drawn = drawn_positions(sizes.select("pool_size"), seed)
    # One row per distinct pool size, so Spark will mostly broadcast it. If not, adaptive
    # execution splits the pools of a common size.
    return (
        negative_ordinals(triples)
        .join(drawn, "pool_size")
        .where(F.col("ordinal") == F.col("drawn"))
        .select("input", F.col("output").alias("rejected"))
    )


def picks(triples: DataFrame, seed: int = NEGATIVE_SEED) -> DataFrame:
    """``(input, slot, pick, is_negative)``: what each group of triples contributes to pairs.

    A slot is a concept, whose pick is its first positive, or null for the pool of negatives,
    whose pick is the one with the smallest hash. Both are minima, so they share one aggregate,
    and ``merge_picks`` joins the picks of several tables to those of their union.
    """
    is_negative = F.col("category") == NEGATIVE
    usable = F.col("input").isNotNull() & (
        is_negative | ((F.col("category") == POSITIVE) & F.col("output_concept").isNotNull())
    )
    draw = F.when(is_negative, seeded_hash(seed, F.col("input"), F.col("ord")))
    candidates = _ordered(triples).where(usable).select(
        "input",
        F.when(~is_negative, F.col("output_concept")).alias("slot"),
        F.struct(draw.alias("hash"), "ord", "output").alias("pick"),
        is_negative.alias("is_negative"),
    )
    return merge_picks(candidates)


def merge_picks(parts: DataFrame) -> DataFrame:
    """The picks of a union from the picks of its parts, each slot's least one."""
    return parts.groupBy("input", "slot").agg(
        F.min("pick").alias("pick"), F.max("is_negative").alias("is_negative")
    )


def pairs_of_picks(picked: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """The pairs that picks make up.

    ``is_negative`` is aggregated rather than grouped by, which keeps the two filters above the
    aggregate: the two sides then have equal plans below it and Spark runs that part once.
    """
    chosen = picked.where(~F.col("is_negative")).select(
        "input", F.col("slot").alias("output_concept"), F.col("pick.output").alias("chosen")
    )
    rejected = picked.where("is_negative").select("input", F.col("pick.output").alias("rejected"))
    return _joined_pairs(chosen, rejected, min_len)


def build_pairs(
    triples: DataFrame,
    mode: str = "hash",
    seed: int = NEGATIVE_SEED,
    min_len: int = MIN_LEN,
) -> DataFrame:
    """``(input, output_concept, prompt, chosen, rejected)``, one row per surviving group.

    A group whose first positive or sampled negative is null or short yields no pair; there
    is no second choice. The sides are grouped differently from how they are joined, so
    Spark shuffles both for the join, and a prompt with very many concepts is split there
    by adaptive execution.
    """
    if mode == "hash":
        return pairs_of_picks(picks(triples, seed), min_len)
    if mode == "exact":
        return _joined_pairs(first_positive(triples), sample_negative_exact(triples, seed), min_len)
    raise ValueError(f"unknown sampling mode {mode!r}; choose hash or exact")


def _joined_pairs(chosen: DataFrame, rejected: DataFrame, min_len: int) -> DataFrame:
    pairs = chosen.join(rejected, "input").where(long_enough(min_len, "chosen", "rejected"))
    prompt = prompt_text(F.col("input"), F.col("output_concept"))
    pairs = pairs.select("input", "output_concept", prompt.alias("prompt"), "chosen", "rejected")
    # The fixed part of a prompt is longer than the default limit.
    return pairs.where(F.length("prompt") >= min_len) if min_len > MIN_LEN else pairs


def sort_pairs(pairs: DataFrame) -> DataFrame:
    """Output order: by prompt, then concept, in code-point order. Only worth it for writing.

    Split pairs are sorted by split first, the order in which a writer of splits wants them.
    """
    split = ["split"] if "split" in pairs.columns else []
    return pairs.orderBy(*split, "input", "output_concept")


def distinct_inputs(triples: DataFrame) -> DataFrame:
    """The number of different prompts; nulls do not count."""
    return triples.agg(F.countDistinct("input").alias("n_inputs"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named tables that have nothing to do with one another."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    whole = counts[0]
    for count in counts[1:]:
        whole = whole.unionByName(count)
    return whole


def observed_counts(
    start: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]], name: str = "start"
) -> DataFrame:
    """``(stage, n_rows)`` of a chain of steps, counted on the way of a single run."""
    seen, df = {name: Observation()}, start
    df = df.observe(seen[name], F.count(F.lit(1)).alias("n_rows"))
    for stage, step in steps.items():
        seen[stage] = Observation()
        df = step(df).observe(seen[stage], F.count(F.lit(1)).alias("n_rows"))
    df.write.format("noop").mode("overwrite").save()
    rows = [(stage, found.get["n_rows"]) for stage, found in seen.items()]
    return start.sparkSession.createDataFrame(rows, "stage string, n_rows long")
