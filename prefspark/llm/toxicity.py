"""Toxicity scores by FTRL-proximal logistic regression over hashed words.

Features are the presence of words, of pairs of neighbours and of pairs with one word between
them, hashed to DIMENSIONS weights. The model is fitted on a bounded sample of labelled rows:
learning rates fall by coordinate, and the L1 term leaves few weights that are not zero, so
what is broadcast is small. Every whole text is then scored where it is read.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefspark.llm.common import slices

DIMENSIONS = 1 << 20
# Bounds of the sample that is fitted: about so many toxic rows, so many others for each of
# them, and texts of so many bytes.
SAMPLE_TOXIC = 6_000
CLEAN_PER_TOXIC = 3
SAMPLE_DOC_BYTES = 32_768

EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
ADDED = ("score", "predicted")

_TOKEN = re.compile(r"\w+")
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 20)
_CHUNK = 1 << 18


def word_codes(text):
    """A 32-bit code for each word of a text."""
    words = _TOKEN.findall(text.lower()) if text else ()
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))


def features(codes):
    """Hashed words, neighbours and skip pairs of a stretch of word codes."""
    first, second, third = (codes + np.uint64(1)) * _MIX[0], codes * _MIX[1], codes * _MIX[2]
    mixed = [first, first[:-1] ^ _turned(second[1:]), first[:-2] ^ _turned(third[2:])]
    return (np.concatenate([_turned(m) * _MIX[1] for m in mixed]) >> _SHIFT).astype(np.int32)


def _turned(numbers):
    return numbers ^ (numbers >> np.uint64(29))


@dataclass
class Model:
    """Weights that are not zero, by index, and the bias."""

    indices: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self):
        weights = np.zeros(DIMENSIONS, np.float32)
        weights[self.indices] = self.weights
        return weights


def train(examples, labels, seed=0):
    """FTRL-proximal over the examples (arrays of distinct indices), EPOCHS times in random order."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    toxic = sum(labels)
    prior = float(np.log((toxic + 0.5) / (len(labels) - toxic + 1.5)))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS if toxic else 0):
        for i in order.permutation(len(labels)):
            at = np.append(examples[i], DIMENSIONS)
            weights = _weights(z[at], n[at])
            gradient = 1 / (1 + np.exp(-np.clip(prior + weights.sum(), -30, 30))) - labels[i]
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * weights
            n[at] = grown
    final = _weights(z, n)
    kept = np.flatnonzero(final[:-1])
    return Model(kept.astype(np.int32), final[kept].astype(np.float32), prior + float(final[-1]))


def _weights(z, n):
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def fit(docs, labels, label="toxic", sample_toxic=SAMPLE_TOXIC):
    """A model of ``label`` (0 or 1) in ``labels`` (doc_id, label) for ``docs`` (doc_id, text).

    Rows without a label or a doc_id teach nothing; of repeated labels the largest counts.
    The sample of a label holds the rows whose hashed doc_id falls below limit / rows; it is
    the only thing that is joined by broadcast or that meets in one task.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    counts = known.groupBy(label).agg(F.count("*").alias("n")).collect()
    rows = {r[label]: r["n"] for r in counts}
    toxic = min(sample_toxic, rows.get(1, 0))
    share = [CLEAN_PER_TOXIC * toxic / rows.get(0, 1), toxic / rows.get(1, 1)]
    limit = F.when(F.col(label) == 1, share[1]).otherwise(share[0])
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(uniform < limit).groupBy("doc_id").agg(F.max(label).alias("_label"))
    texts = docs.where(F.octet_length("text") <= SAMPLE_DOC_BYTES).select("doc_id", "text")
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_label")

    def extract(batches):
        for part in slices(batches, "text"):
            found = [np.unique(features(word_codes(t))) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_label"), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "label", "features"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, label int, features array<int>"
    rows = rows.withColumn("_label", F.col("_label").cast("int")).mapInArrow(extract, shape)

    def learn(pdf):
        pdf = pdf.sort_values("doc_id")
        model = train(pdf["features"].tolist(), pdf["label"].tolist())
        pdf = pdf.iloc[:1][["label"]].assign(bias=model.bias)
        pdf["indices"], pdf["weights"] = [model.indices], [model.weights]
        return pdf[["bias", "indices", "weights"]]

    shape = "bias double, indices array<int>, weights array<float>"
    learned = rows.groupBy(F.lit(0).alias("sample")).applyInPandas(learn, shape).collect()
    if not learned:
        return train([], [])
    row = learned[0]
    return Model(np.array(row["indices"], np.int32), np.array(row["weights"], np.float32), row["bias"])


def score(docs, model):
    """The columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (score at least 0.5).

    Null and empty texts have the score of the bias alone. Columns of ``docs`` with one of the
    two names are replaced. Only the text decides.
    """
    kept = docs.select(*(c for c in docs.columns if c not in ADDED))
    schema = StructType(list(kept.schema)).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        weights, bias = shared.value.dense(), shared.value.bias
        for part in slices(batches, "text"):
            logits = [bias + _logit(weights, t) for t in part.column("text").to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            added = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *added], names=[*part.schema.names, *ADDED]
            )

    return kept.mapInArrow(apply, schema)


def _logit(weights, text):
    """Sum of the weights of a text's features, each once. Long texts go through in chunks."""
    codes = word_codes(text)
    hit = []
    for low in range(0, len(codes), _CHUNK):
        found = features(codes[low : low + _CHUNK + 2])
        hit.append(np.unique(found[weights[found] != 0]))
    return float(weights[np.unique(np.concatenate(hit))].sum()) if hit else 0.0
