"""Pair records and the reversal of their preference."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.messages import relabel_for_suppression, single_message


def pair_records(pairs: DataFrame, *keep: str) -> DataFrame:
    """Chat-shaped records: a user prompt with a chosen and a rejected assistant answer."""
    return pairs.select(
        *keep,
        single_message("user", F.col("prompt")).alias("prompt"),
        single_message("assistant", F.col("chosen")).alias("chosen"),
        single_message("assistant", F.col("rejected")).alias("rejected"),
    )


def reverse_preference(records: DataFrame, when: Column | None = None) -> DataFrame:
    """Swap chosen and rejected and ask for suppression in the prompt; keep other columns.

    All three columns are replaced at once, so each reads the values from before. ``when``
    limits the reversal to some rows.
    """
    swapped = {
        "prompt": relabel_for_suppression(F.col("prompt")),
        "chosen": F.col("rejected"),
        "rejected": F.col("chosen"),
    }
    if when is not None:
        swapped = {c: F.when(when, new).otherwise(F.col(c)) for c, new in swapped.items()}
    return records.withColumns(swapped)
