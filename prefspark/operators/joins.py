"""Joins on a key of which one value may hold a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.schema import free_names


def join_grouped(
    df: DataFrame, grouped: DataFrame, key: str, how: str = "inner", null_key: bool = False
) -> DataFrame:
    """Join ``df`` with a table that was grouped by ``key``, so that hot keys can be split.

    With ``null_key`` rows without a key are joined with the group without one.

    A grouped table is partitioned by its key already, and adaptive execution cannot split
    a partition that runs through an aggregate into a join. Joining on a hash of the key as
    well makes Spark shuffle both sides for the join alone; what a hot key brings into one
    partition of ``df`` is then split, and its one row of ``grouped`` repeated.
    """
    left_hash, right_hash, right_key = free_names(
        [*df.columns, *grouped.columns], "_hash", "_hash2", "_key2"
    )
    left = df.withColumn(left_hash, F.xxhash64(key))
    right = grouped.withColumn(right_hash, F.xxhash64(key)).withColumnRenamed(key, right_key)
    same = F.col(key).eqNullSafe(F.col(right_key)) if null_key else F.col(key) == F.col(right_key)
    joined = left.join(right, same & (F.col(left_hash) == F.col(right_hash)), how)
    return joined.drop(left_hash, right_hash, right_key)
