"""Row filters and projections of the triple and prompt tables."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import is_blank

# The concept ids that flow A leaves out, and its genre.
EXCLUDED_CONCEPT_IDS = tuple(range(10))
TEXT_GENRE = "text"


def number_or_null(text: Column) -> Column:
    """The text as a double, null where it is no number.

    A trailing type letter, which Spark's own cast takes as part of a number, is none.
    """
    return F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double"))


def exclude_concept_ids(
    df: DataFrame, column: str = "concept_id", excluded: Sequence[int] = EXCLUDED_CONCEPT_IDS
) -> DataFrame:
    """Drop rows whose id is one of ``excluded``. An id that is null or no number stays."""
    listed = number_or_null(F.col(column)).isin([float(i) for i in excluded])
    return df.where(~F.coalesce(listed, F.lit(False)))


def keep_genre(df: DataFrame, genre: str = TEXT_GENRE, column: str = "concept_genre") -> DataFrame:
    """Keep one genre. A null genre is dropped."""
    return df.where(F.col(column) == genre)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, duplicates included."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def long_enough(min_len: int, *columns: str) -> Column:
    """Every column is not null and has at least ``min_len`` code points."""
    keep = F.lit(True)
    for name in columns:
        keep = keep & F.col(name).isNotNull() & (F.length(name) >= min_len)
    return keep


def rename_to_canonical(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rename source columns to the canonical names they stand for (canonical -> source).

    All at once, so names may be swapped; two columns of one name are refused.
    """
    canonical = {source: name for name, source in columns.items()}
    names = [canonical.get(name, name) for name in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"renaming gives columns of the same name: {names}")
    return df.toDF(*names)


def split_blank(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with text, rows put aside because the text is null or only whitespace)."""
    blank = F.coalesce(is_blank(F.col(column)), F.lit(True))
    return df.where(~blank), df.where(blank)
