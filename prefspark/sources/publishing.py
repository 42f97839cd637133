"""Split records published as a whole: a failed run leaves what was published before in place."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prefspark.schema import PAIR
from prefspark.sources.versions import Versions
from prefspark.sources.writers import write_splits


def publish_splits(records: DataFrame, path: str) -> dict[str, int]:
    """Write the records of all splits and make them the newest version; returns their numbers.

    The records go to a folder of their own. Until the manifest is written, readers go on with
    the version before, also when the run fails half-way or an executor writes a part twice.
    """
    versions = Versions(records.sparkSession, path)
    before, folder = versions.get(), versions.new_folder()
    counts = write_splits(records, f"{versions.path}/{folder}")
    versions.commit(before, {split: f"{folder}/split={split}" for split in counts}, {"counts": counts})
    return counts


def published_counts(spark: SparkSession, path: str, number: int | None = None) -> dict[str, int]:
    """Records of each split of a version, from its manifest."""
    return dict(Versions(spark, path).get(number).notes.get("counts", {}))


def read_published(
    spark: SparkSession, path: str, split: str, schema: T.StructType | None = PAIR, number: int | None = None
) -> DataFrame:
    """One split of the newest version, or of an older one that is still there.

    A split without records is an empty table; one that nobody has published is an error.
    """
    manifest = Versions(spark, path).get(number)
    if split not in manifest.parts:
        raise ValueError(f"{path} has no split {split!r}; there are {sorted(manifest.parts)}")
    if not manifest.notes.get("counts", {}).get(split, 1):
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader
    return reader.json(f"{path.rstrip('/')}/{manifest.parts[split]}")
