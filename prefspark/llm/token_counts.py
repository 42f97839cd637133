"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A ledger is a folder of written tables. Each batch adds what became of its documents
(``documents``) and, for each total that it touches, the signed change (``deltas``). A
change is the new count of a document less the one that the batches before had left, so
inserts add, deletes take away, and revised counts or moved documents do both. Totals are
sums of deltas; no earlier text or count is read again to get them.

A batch has a number. Its two tables are written to folders of that number, overwriting what
an earlier try has left there, and its content depends on earlier batches only; committing
it twice, or again after a failure half-way, leaves the same ledger. Batches are committed
in the order of their numbers.
"""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefspark.llm.common import slices, staged
from prefspark.llm.tokens import byte_bpe
from prefspark.shared_storage import path_exists

KEYS = ("source", "lang", "tokenizer")
STATE = (
    "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, batch long"
)
_COUNTS = "doc_id long, source string, lang string, tokenizer string, tokens long"


def count_tokens(docs, tokenizers):
    """(doc_id, source, lang, tokenizer, tokens): a row for each document and tokenizer.

    ``tokenizers`` maps versions to paths of byte-level BPE files; a path of None counts the
    UTF-8 bytes. A null text has no tokens.
    """

    def count(batches):
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            for version, path in tokenizers.items():
                if path is None:
                    tokens = [len(t.encode()) if t else 0 for t in texts]
                else:
                    tokens = [len(ids) // 4 for ids in byte_bpe(path).encode_all(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("source"),
                        part.column("lang"),
                        pa.array([version] * len(texts)),
                        pa.array(tokens, pa.int64()),
                    ],
                    names=["doc_id", *KEYS, "tokens"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), "source", "lang", "text")
    return texts.mapInArrow(count, _COUNTS)


def _refusing(counts):
    """``counts``, failing where a doc_id is null or comes with the same tokenizer twice."""
    guarded = counts.groupBy("doc_id", "tokenizer").agg(
        F.count("*").alias("_times"),
        *(F.first(c).alias(c) for c in ("source", "lang", "tokens")),
    )
    fault = F.raise_error(F.lit("a doc_id is null or occurs twice in a batch"))
    fine = F.col("doc_id").isNotNull() & (F.col("_times") == 1)
    return guarded.withColumn("doc_id", F.when(fine, F.col("doc_id")).otherwise(fault).cast("long"))


class Ledger:
    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, table, batch):
        return f"{self.path}/{table}/number={batch}"

    def _read(self, table, schema, before=None):
        """The rows of a table, of batches with smaller numbers only if ``before`` is given."""
        if not path_exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, number long").parquet(f"{self.path}/{table}")
        return (rows if before is None else rows.where(F.col("number") < before)).drop("number")

    def commit(self, batch, counts, deleted=None, unique=True):
        """Adds a batch: ``counts`` as of ``count_tokens`` replace a document's counts for the
        same tokenizer, ``deleted`` (doc_id) takes documents away for every tokenizer.

        Where ``unique``, a document whose doc_id is null or which comes with the same
        tokenizer twice in a batch is refused. Otherwise all rows count: those of one doc_id
        add up, and a batch that has the doc_id again, or deletes it, replaces all of them.
        Rows without a doc_id add up, too, and are new documents in every batch, since
        nothing tells which ones they would revise; they are never replaced or deleted.

        One that is in both tables is deleted first and stays with its new counts. Deleting
        what is not there does nothing. An empty batch is a batch.
        """
        rows = _refusing(counts) if unique else counts
        new = rows.groupBy("doc_id", *KEYS).agg(
            F.count("*").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
        )
        new = staged(new, "new-counts")
        ids = new.select("doc_id").where("doc_id is not null")
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col("doc_id").cast("long")).where("doc_id is not null"))
        old = self.documents(before=batch, ids=ids.distinct())
        revised = new.where("doc_id is not null").select(
            F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_by"), F.lit(True).alias("_revised")
        )
        same = (F.col("doc_id") == F.col("_id")) & F.col("tokenizer").eqNullSafe(F.col("_by"))
        old = old.join(revised.distinct(), same, "left").drop("_id", "_by")
        touched = F.col("_revised").isNotNull()
        if deleted is not None:
            ids = deleted.select("doc_id").where("doc_id is not null").distinct()
            old = old.join(ids.withColumn("_gone", F.lit(True)), "doc_id", "left")
            touched |= F.col("_gone").isNotNull()
        replaced = staged(old.where(touched).select("doc_id", *KEYS, "docs", "tokens", "_revised"), "replaced")
        gone = replaced.where("_revised is null").select("doc_id", "tokenizer").distinct()
        number = F.lit(batch).cast("long").alias("batch")
        state = new.unionByName(gone, allowMissingColumns=True).select("*", number)
        state.write.mode("overwrite").parquet(self._folder("documents", batch))
        taken = replaced.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        signed = new.select(*KEYS, "docs", "tokens").unionByName(taken)
        deltas = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(self._folder("deltas", batch))

    def documents(self, before=None, ids=None):
        """The counts of each document that is there after the batches, or those before one: a
        row for each doc_id, tokenizer, source and language, ``docs`` telling of how many.

        With ``ids`` (distinct doc_id) only of those: they are looked up before rows are put in
        order, so that a batch shuffles and sorts the rows of its own documents alone.
        """
        rows = self._read("documents", STATE, before)
        if ids is not None:
            rows = rows.join(ids, "doc_id", "left_semi")
        # Rows without a doc_id follow one another in no order; each is its own latest.
        apart = F.when(F.col("doc_id").isNull(), F.struct("source", "lang", "batch"))
        latest = F.rank().over(W.partitionBy("doc_id", "tokenizer", apart).orderBy(F.desc("batch")))
        current = rows.withColumn("_nth", latest).where("_nth = 1 and tokens is not null")
        current = current.withColumn("docs", F.coalesce("docs", F.lit(1).cast("long")))
        return current.drop("_nth", "batch")

    def totals(self):
        """(source, lang, tokenizer, docs, tokens) of all batches, without empty groups."""
        shape = "source string, lang string, tokenizer string, docs long, tokens long"
        sums = self._read("deltas", shape).groupBy(*KEYS).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
        )
        return sums.where("docs <> 0 or tokens <> 0")
