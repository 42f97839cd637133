"""Counts of distinct values from stored sketches, one for each batch of files.

A sketch has a few kilobytes whatever it has seen, and the sketch of a union is the union of
sketches: a new batch is read on its own, and any choice of batches is counted without reading
one of their rows.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.sources.versions import Manifest, Versions

# Size of a sketch: 2**LOG_K registers. One standard error is about 1.04 / sqrt(2**LOG_K).
LOG_K = 14
_SKETCH = "batch string, n_rows bigint, sketch binary"


def standard_error(log_k: int = LOG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (log_k / 2)


def distinct_sketch(df: DataFrame, column: str, log_k: int = LOG_K) -> DataFrame:
    """``(n_rows, sketch)`` of a table: partial sketches are merged, nulls do not count."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(F.col(column).cast("string"), log_k).alias("sketch")
    )


def estimated(sketches: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and the estimated ``n_distinct`` of the union of sketches."""
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(union, F.lit(0)).alias("n_distinct")
    )


class DistinctSketches:
    """Sketches of the distinct values of a column, by batch, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, log_k: int = LOG_K):
        self.spark, self.versions, self.log_k = spark, Versions(spark, path), log_k

    def add(self, df: DataFrame, column: str, batch: str) -> Manifest:
        """Sketch a batch, which alone is read. A known batch is skipped."""
        before = self.versions.get()
        if batch in before.parts:
            return before
        folder = self.versions.new_folder()
        sketch = distinct_sketch(df, column, self.log_k).select(F.lit(batch).alias("batch"), "n_rows", "sketch")
        sketch.write.parquet(f"{self.versions.path}/{folder}")
        return self.versions.commit(before, {batch: folder})

    def sketches(self, batches: Sequence[str] | None = None) -> DataFrame:
        """``(batch, n_rows, sketch)`` of all batches, or of those named."""
        missing = sorted(set(batches or ()) - set(self.versions.get().parts))
        if missing:
            raise ValueError(f"no sketches of batches {missing}")
        return self.versions.read(_SKETCH, batches)

    def estimate(self, batches: Sequence[str] | None = None) -> DataFrame:
        """Distinct values of all batches together, or of those named."""
        return estimated(self.sketches(batches))
