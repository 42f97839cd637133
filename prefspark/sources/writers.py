"""Writers: pair records per split, dataset exports, metric logs, reports."""

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.operators.metrics import log_records
from prefspark.operators.splits import SPLITS
from prefspark.schema import METRIC_RECORD
from prefspark.shared_storage import names_in, path_exists, write_text_once


def write_splits(records: DataFrame, path: str) -> dict[str, int]:
    """JSON lines, one folder per split, replacing what is there. Null fields are kept.

    Returns the number of records per split, counted while they are written. Records of any
    other split are refused, since nothing would count them.
    """
    counts = Observation()
    known = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("unknown split "), F.coalesce("split", F.lit("null"))))
    records = records.withColumn("split", F.when(known, F.col("split")).otherwise(refuse.cast("string")))
    counted = records.observe(
        counts, *[F.count_if(F.col("split") == name).alias(name) for name in SPLITS]
    )
    (
        counted.write.mode("overwrite")
        .option("ignoreNullFields", False)
        .partitionBy("split")
        .json(path)
    )
    return {name: counts.get[name] for name in SPLITS}


def write_pairs_csv(records: DataFrame, path: str) -> None:
    """CSV with the message lists, and whatever else is nested, as JSON text."""
    options = {"ignoreNullFields": "false"}
    nested = ("array", "struct", "map")
    text = [
        F.to_json(F.col(c), options).alias(c) if kind.startswith(nested) else F.col(c)
        for c, kind in records.dtypes
    ]
    writer = records.select(*text).write.mode("overwrite").option("header", True)
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.option("escape", '"').csv(path)


def export_split(df: DataFrame, path: str) -> int | None:
    """JSON lines of one source split, and their number.

    What exists already is left as it is, without running ``df``: the result is then None.
    """
    if path_exists(df.sparkSession, path):
        return None
    count = Observation()
    counted = df.observe(count, F.count(F.lit(1)).alias("n_rows"))
    counted.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return count.get["n_rows"]


def append_metrics(records: DataFrame, path: str, experiment: str) -> None:
    """Add records to an append-only JSON-lines log, stamped with time and experiment."""
    log_records(records, experiment).write.mode("append").json(path)


def append_metrics_once(records: DataFrame, path: str, experiment: str, batch: str) -> bool:
    """Add a batch of records to a log of batches, once: False if the log has it already.

    A batch is a folder and counts from the moment its commit record exists. What a failed
    attempt left is replaced by the next one, and ``read_metrics`` does not see it.
    """
    spark = records.sparkSession
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-', not {batch!r}")
    if path_exists(spark, _commit_record(path, batch)):
        return False
    count = Observation()
    counted = log_records(records, experiment).observe(count, F.count(F.lit(1)).alias("n_rows"))
    counted.write.mode("overwrite").json(_batch_folder(path, batch))
    return write_text_once(spark, _commit_record(path, batch), json.dumps(dict(count.get)))


def read_metrics(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> DataFrame:
    """The records of all committed batches of a log, or of those named, with their ``batch``."""
    committed = sorted(n.removesuffix(".json") for n in names_in(spark, f"{path}/commits") if n.endswith(".json"))
    missing = sorted(set(batches or ()) - set(committed))
    if missing:
        raise ValueError(f"{path} has no committed batches {missing}")
    folders = [_batch_folder(path, b) for b in committed if batches is None or b in batches]
    if not folders:
        return spark.createDataFrame([], METRIC_RECORD).withColumn("batch", F.lit(None).cast("string"))
    schema = T.StructType([*METRIC_RECORD.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).option("basePath", f"{path}/batches").json(folders)


def _batch_folder(path: str, batch: str) -> str:
    return f"{path}/batches/batch={batch}"


def _commit_record(path: str, batch: str) -> str:
    return f"{path}/commits/{batch}.json"


def write_report(metrics: DataFrame, samples: DataFrame, path: str) -> None:
    """Reports as two datasets below ``path``, one folder per ``step`` in each.

    Replaces the steps that are written and no others. The samples stay a table of their
    own: a report has as many as there are prompts.
    """
    for name, df in (("metrics", metrics), ("samples", samples)):
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("step")
            .json(f"{path}/{name}")
        )
