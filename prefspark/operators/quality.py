"""Checks of pair tables: columns by name, message lists by value, order keys by count."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.schema import PAIR_COLUMNS, require_columns

CANONICAL = {name: name for name in PAIR_COLUMNS}

# Reasons a message list is refused.
NO_MESSAGES = "must be a non-empty list of messages"
BAD_MESSAGE = "contains a message without role or content"


def messages_issue(messages: Column) -> Column:
    """Why a message list is refused; null for a good one."""
    complete = F.forall(
        messages, lambda m: m.isNotNull() & m["role"].isNotNull() & m["content"].isNotNull()
    )
    return F.when(F.coalesce(F.size(messages), F.lit(-1)) <= 0, NO_MESSAGES).when(
        ~complete, BAD_MESSAGE
    )


def validate_pairs(
    records: DataFrame, ids: Sequence[str], columns: Mapping[str, str] = CANONICAL
) -> DataFrame:
    """Every violation as ``(ids…, column, reason)``, from one pass over all rows."""
    require_columns(records, columns.values(), "pair table")
    issues = F.array(
        *[
            F.struct(F.lit(source).alias("column"), messages_issue(F.col(source)).alias("reason"))
            for source in columns.values()
        ]
    )
    found = F.filter(issues, lambda i: i["reason"].isNotNull())
    return records.select(*ids, F.inline(found))


def enforce_pairs(
    records: DataFrame, what: str = "pair table", columns: Mapping[str, str] = CANONICAL
) -> DataFrame:
    """The same rows, failing the job that reads them at the first refused message list.

    The check travels with the plan, so it covers every row without a pass of its own. Like
    any column, one that the job does not read is not computed and so not checked.
    """
    require_columns(records, columns.values(), what)
    checked = {}
    for source in columns.values():
        issue = messages_issue(F.col(source))
        text = F.concat(F.lit(f"{what}.{source} "), issue)
        failing = F.raise_error(text).cast(records.schema[source].dataType)
        checked[source] = F.when(issue.isNotNull(), failing).otherwise(F.col(source))
    return records.withColumns(checked)


def require_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Fail when the columns do not identify a row. Runs a job over these columns only."""
    repeated = df.groupBy(*columns).count().where(F.col("count") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"columns {list(columns)} do not identify the rows")
    return df
