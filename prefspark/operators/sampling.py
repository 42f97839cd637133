"""Seeded subsets and bounded prefixes of a table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefspark.operators.ranking import hash_bucket, seeded_hash, sum_before
from prefspark.schema import free_names

# The number of rows a prefix check looks at.
PREFIX_ROWS = 20

# Rows of a bucket whose hashes go to the driver.
FEW_ROWS = 10_000


def limit_sample(
    df: DataFrame, count: int | None, seed: int = 42, ids: Sequence[str] = ()
) -> DataFrame:
    """``count`` rows in a seeded random choice; all rows when count is null, 0 or too large.

    Rows are ordered by ``md5('seed|id…')``, nulls written as ``\\N``; rows whose ids are
    equal, and all rows without ``ids``, by the hash of the whole row. Rows that are equal in
    every column cannot be told apart: the one at the border is repeated as often as needed.
    The choice depends on neither the order nor the partitioning of the rows, and is not that
    of any shuffling library.

    There is one way for every count. Two small jobs find the hash of the last row, from the
    sizes of 65,536 buckets and from the hashes of one bucket; the result compares rows with it
    where they are read, and only rows that share it, but are not all wanted, are looked at
    again. The driver sees the sizes, and the hashes of a bucket of at most FEW_ROWS rows; those
    of a larger one are counted and put in order by Spark.
    """
    if count is None or count <= 0:
        return df
    whole = F.to_json(F.struct(*df.columns))
    parts = [_coded(c) for c in ids] if ids else [whole]
    place, row = free_names(df.columns, "_hash", "_row")
    keyed = df.withColumn(place, seeded_hash(seed, *parts))
    border = _border(keyed, place, count)
    if border is None:
        return df
    last, left, rows = border
    if left == rows:
        return keyed.where(F.col(place) <= last).drop(place)
    kept = keyed.where(F.col(place) < last).drop(place)
    tied = keyed.where(F.col(place) == last).drop(place)
    if ids:
        tied = tied.withColumn(row, seeded_hash(seed, whole))
        last, left, _ = _border(tied, row, left)
        kept = kept.unionByName(tied.where(F.col(row) < last).drop(row))
        tied = tied.where(F.col(row) == last).drop(row)
    return kept.unionByName(_repeated(tied, left))


def _coded(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\\N"))


def _border(keyed: DataFrame, column: str, target: int) -> tuple[str, int, int] | None:
    """Hash of the ``target``-th row, how many rows with it are wanted, and how many there are.

    None when there are fewer than ``target`` rows. Equal hashes are counted before they
    are shuffled, so repeated rows do not crowd a bucket.
    """
    bucket, before = hash_bucket(F.col(column)), 0
    sizes = keyed.groupBy(bucket.alias("place")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes = sizes.sort_by("place").to_pydict()
    for place, rows in zip(sizes["place"], sizes["n"]):
        if before + rows >= target:
            break
        before += rows
    else:
        return None
    inside = keyed.where(bucket == place)
    if rows <= FEW_ROWS:
        hashes = sorted(inside.select(column).toArrow().column(0).to_pylist())
        last = hashes[target - before - 1]
        return last, target - before - hashes.index(last), hashes.count(last)
    found = _reached(inside.groupBy(F.col(column).alias("_place")), target - before)
    return found["_place"], target - before - found["_before"], found["_rows"]


def _reached(places: GroupedData, target: int) -> Row:
    """The place in which the ``target``-th row lies, with its rows and those before it."""
    counts = places.agg(F.count(F.lit(1)).alias("_rows"))
    placed = counts.withColumn("_before", sum_before(W.orderBy("_place"), "_rows"))
    before = F.col("_before")
    return placed.where((before < target) & (before + F.col("_rows") >= target)).first()


def _repeated(equal: DataFrame, times: int) -> DataFrame:
    """``times`` copies of the one row that all rows of ``equal`` are."""
    one = equal.agg(F.first(F.struct(*equal.columns)).alias("_one"))
    # Exploded, since a plain column would be looked up anew for each of its fields.
    copies = equal.sparkSession.range(times).select(F.explode(F.array(one.scalar())).alias("_one"))
    return copies.select("_one.*")


def prefix(df: DataFrame, order: str, count: int = PREFIX_ROWS) -> DataFrame:
    """The first ``count`` rows by ``order``."""
    return df.orderBy(order).limit(count)
