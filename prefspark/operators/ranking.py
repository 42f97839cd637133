"""Ordinals that never bring a whole table, or a whole group, into one task.

A plain ``row_number`` window sorts each of its groups in a single task, and a window
without a partition sorts the table in one. The three operators here give the same
numbers from groups whose size is bounded.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefspark.schema import free_names
from prefspark.shared_storage import ensure_checkpoint_dir

BLOCK_BITS = 20
HASH_PREFIX = 4  # hex digits: 65,536 buckets
_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


def sum_before(window, column) -> Column:
    """Sum of ``column`` over the rows before this one."""
    rows = window.rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(rows), F.lit(0))


def with_group_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ordinal: str = "ordinal",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group by ``order``, and optionally the group size.

    ``order`` is a unique integer column and the keys are not null. Its values are cut into
    blocks of 2**20 consecutive numbers, so uniqueness bounds the rows of any
    (group, block). Blocks are counted with map-side combining, and their counts are summed
    up over two levels, so a group of any size is spread over as many tasks as it has blocks.
    """
    keys = list(keys)
    block, big, rows, big_rows, big_base, base, total, place = free_names(
        df.columns, "_block", "_super", "_rows", "_super_rows", "_super_base", "_base", "_size", "_within"
    )
    # The last 0 is never reached. It makes the number, and with it the blocks, a column
    # without nulls; a null test on one use of the block counts would have them made twice.
    refuse = F.raise_error(F.lit(f"{order} must not be null")).cast("long")
    number = F.coalesce(F.col(order).cast("long"), refuse, F.lit(0))
    numbered = df.withColumn(block, F.shiftright(number, BLOCK_BITS))
    blocks = (
        numbered.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias(rows))
        .withColumn(big, F.shiftright(block, BLOCK_BITS))
    )
    supers = blocks.groupBy(*keys, big).agg(F.sum(rows).alias(big_rows))
    over_supers = W.partitionBy(*keys).orderBy(big)
    supers = supers.select(
        *keys,
        big,
        sum_before(over_supers, big_rows).alias(big_base),
        F.sum(big_rows).over(W.partitionBy(*keys)).alias(total),
    )
    over_blocks = W.partitionBy(*keys, big).orderBy(block)
    bases = blocks.withColumn(base, sum_before(over_blocks, rows)).join(supers, [*keys, big])
    bases = bases.select(*keys, block, (F.col(big_base) + F.col(base)).alias(base), total)
    within = F.row_number().over(W.partitionBy(*keys, block).orderBy(order)) - 1
    numbered = numbered.withColumn(place, within)
    if size:
        ranked = numbered.join(bases, [*keys, block])
    else:
        # Most groups have one block, which starts at 0 and needs no row here.
        ranked = numbered.join(bases.where(F.col(base) > 0), [*keys, block], "left")
    position = F.coalesce(base, F.lit(0)) + F.col(place)
    extra = [F.col(total).alias(size)] if size else []
    return ranked.select(*df.columns, position.cast("long").alias(ordinal), *extra)


def with_hash_rank(
    df: DataFrame, key: str, seed: int, rank: str = "rank", size: str = "n"
) -> DataFrame:
    """0-based rank of each distinct string ``key`` by ``md5('seed|key')``, and their number.

    The keys must be distinct, so their hashes spread evenly over the prefix buckets: a
    bucket is sorted in one task, and what is broadcast is one row per bucket, 65,536 at
    most whatever the number of keys.
    """
    hashed, bucket, rows, base, total, place = free_names(
        df.columns, "_hash", "_bucket", "_rows", "_base", "_total", "_within"
    )
    keyed = df.withColumn(hashed, seeded_hash(seed, F.col(key))).withColumn(
        bucket, hash_bucket(F.col(hashed))
    )
    counts = keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias(rows))
    offsets = counts.select(
        bucket,
        sum_before(W.orderBy(bucket), rows).alias(base),
        F.sum(rows).over(W.partitionBy()).alias(total),
    )
    within = F.row_number().over(W.partitionBy(bucket).orderBy(hashed, key)) - 1
    ranked = keyed.withColumn(place, within).join(F.broadcast(offsets), bucket)
    return ranked.select(
        *df.columns,
        F.col(hashed).alias("hash"),
        (F.col(base) + F.col(place)).alias(rank),
        F.col(total).alias(size),
    )


def hash_bucket(hash_text: Column) -> Column:
    """The bucket of a hash.

    Never null, so a join on it adds no null test that Spark would push below ``df``, where
    it could keep apart two uses of one shuffle that are equal otherwise.
    """
    return F.coalesce(F.substring(hash_text, 1, HASH_PREFIX), F.lit(""))


def seeded_hash(seed: int, *parts: Column) -> Column:
    """``md5('seed|part|part…')`` as hex text, the same in every SQL engine."""
    pieces = [F.lit(str(seed))]
    for part in parts:
        pieces += [F.lit("|"), part.cast("string")]
    return F.md5(F.concat(*pieces))


def with_sorted_ordinal(
    df: DataFrame, order: Sequence[str], ordinal: str = "ordinal"
) -> DataFrame:
    """0-based position of each row of the whole table by ``order`` (a unique sort key).

    Runs a job: the table is range-partitioned and sorted, and checkpointed so that the
    partition of a row cannot change between counting the partitions and numbering the
    rows. The broadcast holds one row per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place, part, rows, base = free_names(df.columns, "_place", "_part", "_rows", "_base")
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id())
        .checkpoint()
    )
    placed = placed.withColumn(part, F.shiftright(place, _ROW_BITS))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(rows))
    offsets = counts.select(part, sum_before(W.orderBy(part), rows).alias(base))
    within = F.col(place).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), part).select(
        *df.columns, (F.col(base) + within).alias(ordinal)
    )
