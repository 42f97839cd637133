"""Operators on metric records: the step gate, key prefixes and log columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTERNAL_PREFIX = "external/"


def step_gate(df: DataFrame, interval: int, enabled: bool = True, step: str = "step") -> DataFrame:
    """Keep the steps at which an external check is due: multiples of the interval but 0."""
    if not enabled or interval <= 0:
        return df.limit(0)
    return df.where((F.col(step) != 0) & (F.col(step) % interval == 0))


def prefix_keys(metrics: Column, text: str = EXTERNAL_PREFIX) -> Column:
    return F.transform_keys(metrics, lambda key, _: F.concat(F.lit(text), key))


def utc_now_text() -> Column:
    """The time of the query as ISO-8601 text in UTC."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def log_records(records: DataFrame, experiment: str) -> DataFrame:
    """Records as they go into a metric log: with a UTC timestamp and the experiment first."""
    return records.select(
        utc_now_text().alias("timestamp"), F.lit(experiment).alias("experiment"), *records.columns
    )
