"""Pairs and splits of tables that grow, kept as state that new files are merged into.

``PickState`` holds what each group of triples contributes to the pairs, in hash buckets of the
prompt. A batch of new files is reduced to its own picks, and only the buckets that it touches
are read, merged and written anew: the pairs are those of a full run over all files so far, at
the cost of the new ones and of those buckets. ``ConceptSplits`` holds the split of every
concept that was ever seen, so that none moves when others arrive. Both change as a whole
(``prefspark.sources.versions``) and take each batch once, however often it is handed in.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators import pairing, splits
from prefspark.operators.preference import pair_records
from prefspark.plans.flows import text_triples
from prefspark.schema import FILTERED_TRIPLE_COLUMNS, TRIPLE_COLUMNS
from prefspark.shared_storage import staged
from prefspark.sources.publishing import publish_splits
from prefspark.sources.readers import read_ordered
from prefspark.sources.versions import Manifest, Versions

_PICKS = (
    "input string, slot string, pick struct<hash: string, ord: bigint, output: string>, "
    "is_negative boolean"
)
_ASSIGNED = "output_concept string, split string"


class PickState:
    """The picks of all batches merged so far, below ``path``.

    The number of buckets is fixed by the first batch. As many as there are megabytes of picks
    in a few hundred keep a bucket small beside a batch; the driver sees bucket numbers only.
    """

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 256, seed: int = pairing.NEGATIVE_SEED
    ):
        self.spark, self.versions = spark, Versions(spark, path)
        notes = self.versions.get().notes
        self.buckets, self.seed = notes.get("buckets", buckets), notes.get("seed", seed)

    def merge(self, triples: DataFrame, batch: str, files: int = 0) -> Manifest:
        """Take in a batch of triples, whose ``ord`` no other batch has. A known batch is skipped."""
        before = self.versions.get()
        known = before.notes.get("batches", [])
        if batch in known:
            return before
        bucket = F.pmod(F.xxhash64("input"), F.lit(self.buckets)).cast("int").alias("bucket")
        new = pairing.picks(triples, self.seed).withColumn("pick", F.col("pick").cast(_pick_type()))
        new = staged(new.select("*", bucket), "picks")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        changed = {}
        if touched:
            old = self.versions.read(_PICKS, [_part(b) for b in touched])
            merged = pairing.merge_picks(old.unionByName(new.drop("bucket")))
            folder = self.versions.new_folder()
            # Adaptive execution splits a bucket that is large and joins small ones.
            rebalanced = merged.select("*", bucket).hint("rebalance", "bucket")
            rebalanced.write.partitionBy("bucket").parquet(f"{self.versions.path}/{folder}")
            changed = {_part(b): f"{folder}/bucket={b}" for b in touched}
        notes = {
            "batches": [*known, batch],
            "buckets": self.buckets,
            "seed": self.seed,
            "files": before.notes.get("files", 0) + files,
        }
        return self.versions.commit(before, changed, notes)

    def merge_files(self, paths: Sequence[str], batch: str, filtered: bool = False) -> Manifest:
        """Take in Parquet files of triples, in the order of a run over all paths so far."""
        before = self.versions.get()
        if batch in before.notes.get("batches", []):
            return before
        first = before.notes.get("files", 0)
        columns = FILTERED_TRIPLE_COLUMNS if filtered else TRIPLE_COLUMNS
        triples = read_ordered(self.spark, paths, columns, first)
        files = sum(len(self.spark.read.parquet(path).inputFiles()) for path in paths)
        return self.merge(text_triples(triples) if filtered else triples, batch, files)

    def picks(self, number: int | None = None) -> DataFrame:
        """The picks of the newest version, or of an older one."""
        return self.versions.read(_PICKS, number=number)

    def pairs(self, min_len: int = pairing.MIN_LEN, number: int | None = None) -> DataFrame:
        """The pairs of all batches so far."""
        return pairing.pairs_of_picks(self.picks(number), min_len)


def _part(bucket: int) -> str:
    return f"{bucket:05d}"


def _pick_type() -> str:
    return "struct<hash: string, ord: bigint, output: string>"


class ConceptSplits:
    """The split of every concept seen so far, below ``path``: a table that only grows."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        seed: int = splits.SPLIT_SEED,
        train: float = splits.TRAIN_FRACTION,
        valid: float = splits.VALID_FRACTION,
    ):
        self.versions, self.rule = Versions(spark, path), (seed, train, valid)

    def assignment(self, number: int | None = None) -> DataFrame:
        """``(output_concept, split)`` of all concepts of the newest version, or of an older one."""
        return self.versions.read(_ASSIGNED, number=number)

    def assign(self, concepts: DataFrame, batch: str) -> Manifest:
        """Give the concepts that are new a split, for good. A known batch is skipped."""
        before = self.versions.get()
        known = before.notes.get("batches", [])
        if batch in known:
            return before
        new = splits.extend_assignment(self.assignment(), concepts, *self.rule)
        folder = self.versions.new_folder()
        new.write.parquet(f"{self.versions.path}/{folder}")
        return self.versions.commit(before, {folder: folder}, {"batches": [*known, batch]})

    def compact(self) -> Manifest:
        """Bring the tables of all batches together in one, with the same rows."""
        before = self.versions.get()
        folder = self.versions.new_folder()
        self.assignment().write.parquet(f"{self.versions.path}/{folder}")
        changed = {**dict.fromkeys(before.parts), folder: folder}
        return self.versions.commit(before, changed, before.notes)

    def split_pairs(self, pairs: DataFrame) -> DataFrame:
        """The pairs of known concepts with their ``split``. A concept may have any number of them.

        The stored table is joined as it is read, so adaptive execution can split a hot concept.
        """
        return pairs.join(self.assignment(), "output_concept")


def prepare_batch(
    spark: SparkSession, paths: Sequence[str], out: str, batch: str, filtered: bool = False
) -> dict[str, int]:
    """Merge new files and publish the splits of all pairs so far below ``out``.

    Each step commits as a whole and takes a batch once, so a run that failed is run again with
    the same batch and goes on where it stopped. Returns the records of each split.
    """
    picked, concepts = PickState(spark, f"{out}/picks"), ConceptSplits(spark, f"{out}/concepts")
    picked.merge_files(paths, batch, filtered)
    pairs = staged(picked.pairs(), "pairs")
    concepts.assign(pairs, batch)
    return publish_splits(pair_records(concepts.split_pairs(pairs), "split"), f"{out}/splits")
