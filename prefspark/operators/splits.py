"""Splits by concept: every concept, with all of its pairs, lies in exactly one split.

Concepts are put in a seeded order, then cut by fractions. The ``hash`` order (the default)
sorts them by ``md5('seed|concept')``. The other two permute the concepts as they first appear
in sorted pairs: ``permuted`` by an expression that maps each place on its own, ``exact`` by a
seeded numpy permutation, which one task holds. Where tables grow,
``extend_assignment`` keeps every concept where it is and deals only new ones.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.permutation import permuted
from prefspark.operators.ranking import seeded_hash, with_hash_rank, with_sorted_ordinal

# Fixed values of the split.
SPLIT_SEED = 42
TRAIN_FRACTION, VALID_FRACTION = 0.75, 0.10
SPLITS = ("train", "valid", "test")


def distinct_concepts(pairs: DataFrame) -> DataFrame:
    """The concepts of the pairs with the smallest prompt each appears with."""
    return pairs.groupBy("output_concept").agg(F.min("input").alias("first_input"))


def concept_rank(pairs: DataFrame, mode: str = "hash", seed: int = SPLIT_SEED) -> DataFrame:
    """``(output_concept, rank, n)``: place of each concept in the seeded order."""
    if mode == "hash":
        concepts = pairs.select("output_concept").distinct()
        ranked = with_hash_rank(concepts, "output_concept", seed)
        return ranked.select("output_concept", "rank", "n")
    if mode == "permuted":
        order = ["first_input", "output_concept"]
        appearing = with_sorted_ordinal(distinct_concepts(pairs), order, "appearance")
        n = appearing.count()
        rank = permuted(F.col("appearance"), n, seed)
        return appearing.select("output_concept", rank.alias("rank"), F.lit(n).cast("long").alias("n"))
    if mode == "exact":
        return _permuted_rank(distinct_concepts(pairs), seed)
    raise ValueError(f"unknown split mode {mode!r}; choose hash, permuted or exact")


def permutation(sizes: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """``(rank, appearance, n)`` of a seeded permutation, from a table with one row ``n``.

    The permutation is one sequential algorithm: one task holds it, 8 bytes for each concept.
    """

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch["n"]:
                order = np.random.default_rng(seed).permutation(int(n))
                for start in range(0, int(n), 1_000_000):
                    part = order[start : start + 1_000_000]
                    yield pd.DataFrame(
                        {"rank": start + np.arange(len(part)), "appearance": part, "n": n}
                    )

    return sizes.mapInPandas(permute, "rank long, appearance long, n long")


def _permuted_rank(concepts: DataFrame, seed: int) -> DataFrame:
    appearing = with_sorted_ordinal(concepts, ["first_input", "output_concept"], "appearance")
    order = permutation(appearing.agg(F.count(F.lit(1)).alias("n")), seed)
    return appearing.join(order, "appearance").select("output_concept", "rank", "n")


def _cut(rank: Column, n: Column, train: float, valid: float) -> Column:
    n_train, n_valid = _cut_sizes(n, train, valid)
    return (
        F.when(rank < n_train, "train").when(rank < n_train + n_valid, "valid").otherwise("test")
    )


def _cut_sizes(n: Column, train: float, valid: float) -> tuple[Column, Column]:
    # Products of doubles, cut off: the fractions of n that a split gets in full.
    return F.floor(F.lit(float(train)) * n), F.floor(F.lit(float(valid)) * n)


def split_concepts(
    pairs: DataFrame,
    mode: str = "hash",
    seed: int = SPLIT_SEED,
    train: float = TRAIN_FRACTION,
    valid: float = VALID_FRACTION,
) -> DataFrame:
    """``(output_concept, split)``: a first part trains, a second validates, the rest tests."""
    ranked = concept_rank(pairs, mode, seed)
    return ranked.select(
        "output_concept", _cut(F.col("rank"), F.col("n"), train, valid).alias("split")
    )


def _cut_points(concepts: DataFrame, seed: int, train: float, valid: float) -> DataFrame:
    """One row: the last (hash, concept) of the train part and of the train and valid parts."""
    ranked = with_hash_rank(concepts, "output_concept", seed)
    n_train, n_valid = _cut_sizes(F.col("n"), train, valid)
    place = F.struct("hash", "output_concept")
    last_train = F.max(F.when(F.col("rank") < n_train, place))
    last_valid = F.max(F.when(F.col("rank") < n_train + n_valid, place))
    return ranked.agg(F.struct(last_train.alias("train"), last_valid.alias("valid")).alias("cut"))


def split_pairs(
    pairs: DataFrame,
    mode: str = "hash",
    seed: int = SPLIT_SEED,
    train: float = TRAIN_FRACTION,
    valid: float = VALID_FRACTION,
) -> DataFrame:
    """The pairs with their ``split``.

    In hash mode a split is a range of hashes, so the pairs are compared with its two end
    points and need neither a join nor a shuffle, however many pairs a concept has. In exact
    mode they are joined with the concept table.
    """
    if mode != "hash":
        return pairs.join(split_concepts(pairs, mode, seed, train, valid), "output_concept")
    concepts = pairs.select("output_concept").distinct()
    cut = _cut_points(concepts, seed, train, valid).scalar()
    place = F.struct(
        seeded_hash(seed, F.col("output_concept")).alias("hash"), F.col("output_concept")
    )
    split = (
        F.when(place <= cut["train"], "train")
        .when(place <= cut["valid"], "valid")
        .otherwise("test")
    )
    return pairs.withColumn("split", split)


def extend_assignment(
    assigned: DataFrame,
    concepts: DataFrame,
    seed: int = SPLIT_SEED,
    train: float = TRAIN_FRACTION,
    valid: float = VALID_FRACTION,
) -> DataFrame:
    """``(output_concept, split)`` of the concepts that ``assigned`` does not have yet.

    No concept that is assigned moves. The new ones go, in their seeded order, to the splits
    that lack concepts: first to train, then to valid, the rest to test, each as many as bring
    it to its part of all concepts. With the same fractions from the start every split stays
    within one concept of its part; without any assigned concept the result is that of
    ``split_concepts``. Runs one small job, which counts the assigned concepts by split.
    """
    new = concepts.select("output_concept").where(F.col("output_concept").isNotNull()).distinct()
    new = new.join(assigned.select("output_concept"), "output_concept", "left_anti")
    have = {row["split"]: row["count"] for row in assigned.groupBy("split").count().collect()}
    ranked = with_hash_rank(new, "output_concept", seed)
    total = F.col("n") + sum(have.values())
    n_train, n_valid = _cut_sizes(total, train, valid)
    lack = [
        wanted - F.lit(have.get(split, 0))
        for split, wanted in zip(SPLITS, (n_train, n_valid, total - n_train - n_valid))
    ]
    # A part that is rounded down may shrink by one while the whole grows. What a split has
    # beyond its part is then missing elsewhere.
    beyond = sum(F.greatest(-x, F.lit(0)) for x in lack)
    to_train = F.greatest(lack[0], F.lit(0))
    less = F.least(beyond, to_train)
    to_valid = F.greatest(lack[1], F.lit(0))
    to_train, to_valid = to_train - less, to_valid - F.least(beyond - less, to_valid)
    split = (
        F.when(F.col("rank") < to_train, "train")
        .when(F.col("rank") < to_train + to_valid, "valid")
        .otherwise("test")
    )
    return ranked.select("output_concept", split.alias("split"))


def split_stats(pairs: DataFrame) -> DataFrame:
    """Pairs and concepts per split, and in total (split ``all``)."""
    return (
        pairs.rollup("split")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.countDistinct("output_concept").alias("n_concepts"),
            F.grouping("split").alias("is_total"),
        )
        .withColumn("split", F.when(F.col("is_total") == 1, "all").otherwise(F.col("split")))
        .drop("is_total")
    )


def split_leakage(split: DataFrame) -> DataFrame:
    """Concepts found in more than one split, with the number of splits. Empty when sound."""
    return (
        split.select("output_concept", "split")
        .distinct()
        .groupBy("output_concept")
        .agg(F.count(F.lit(1)).alias("n_splits"))
        .where(F.col("n_splits") > 1)
    )


def split_coverage(split: DataFrame, universe: DataFrame) -> DataFrame:
    """Concepts that only the splits or only the universe have. Empty when sound."""
    covered = split.select("output_concept").distinct()
    wanted = universe.select("output_concept").distinct()
    missing = wanted.exceptAll(covered).withColumn("problem", F.lit("missing"))
    unexpected = covered.exceptAll(wanted).withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def split_audit(split: DataFrame, universe: DataFrame) -> DataFrame:
    """Both audits in one aggregate: every concept with a problem, and its number of splits."""
    assigned = split.select("output_concept", "split", F.lit(False).alias("wanted")).distinct()
    wanted = universe.select(
        "output_concept", F.lit(None).cast("string").alias("split"), F.lit(True).alias("wanted")
    ).distinct()
    problem = (
        F.when(F.col("n_splits") > 1, "leaks")
        .when(F.col("n_splits") == 0, "missing")
        .when(~F.col("wanted"), "unexpected")
    )
    return (
        assigned.unionByName(wanted)
        .groupBy("output_concept")
        .agg(F.count("split").alias("n_splits"), F.max("wanted").alias("wanted"))
        .select("output_concept", "n_splits", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )
