"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is counted on a bounded sample.
With the counts frozen, the code length of a text under a language is exact: for each byte
the longest known context either codes it, or codes an escape and hands it to the next
shorter context, down to a uniform code over the 256 bytes. Escapes are those of method C,
``distinct / (total + distinct)``; symbols of longer contexts are not excluded. The shortest
code wins.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefspark.llm.common import slices

# Bounds of the sample that a model is fitted on: about so many documents of a language, and
# so many bytes of each, which of longer ones are a stretch. Scoring has no such bounds.
SAMPLE_DOCS = 400
SAMPLE_DOC_BYTES = 65_536

ORDER = 4
UNKNOWN = "und"
ADDED = ("lang_pred", "score", "bits_per_byte")
_PAD = b"\n" * ORDER
_CHUNK = 1 << 19
_LETTER = regex.compile(r"\p{L}")


class Lookup:
    """Positions of integer keys, by open addressing over NumPy arrays."""

    def __init__(self, keys):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.places[at] < 0
            self.places[at[free]] = left[free]
            won = self.places[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys):
        """For each key its position, or -1."""
        at = self._home(keys)
        place = self.places[at]
        missed = np.flatnonzero((self.keys[at] != keys) & (place >= 0))
        at = at[missed]
        while len(missed):
            at = (at + 1) & self.mask
            found = self.places[at]
            wrong = (self.keys[at] != keys[missed]) & (found >= 0)
            place[missed[~wrong]] = found[~wrong]
            missed, at = missed[wrong], at[wrong]
        return place


class SortedLookup:
    """The same for sorted keys, without tables of its own: slower, for the driver."""

    def __init__(self, keys):
        self.keys = keys

    def find(self, keys):
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    """Code lengths in bits, a column for each language.

    ``grams[k]`` are the contexts of k bytes with their symbol that any language has seen,
    ``costs[k]`` what coding the symbol there takes, escapes included. ``contexts[k]`` and
    ``escapes[k]`` are the same for an escape from a known context.
    """

    languages: list
    grams: list = field(default_factory=list)
    costs: list = field(default_factory=list)
    contexts: list = field(default_factory=list)
    escapes: list = field(default_factory=list)

    def tables(self):
        """Lookups for the arrays; built where the model is used, not sent."""
        grams, contexts = self.__dict__.setdefault("_tables", ([], []))
        for order in range(len(grams), len(self.grams)):
            grams.append(Lookup(self.grams[order]))
            contexts.append(Lookup(self.contexts[order]))
        return grams, contexts

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def cost(self, windows, order):
        """Bits of the last byte of each window in each language, by contexts of ``order``."""
        if order < 0:
            return np.full((len(windows), len(self.languages)), 8.0)
        grams, contexts = self.tables()
        windows = windows & np.uint64((1 << 8 * (order + 1)) - 1)
        place = grams[order].find(windows)
        bits = self.costs[order][place]
        missed = np.flatnonzero(place < 0)
        if len(missed):
            left = windows[missed]
            known = contexts[order].find(left >> np.uint64(8))
            escape = self.escapes[order][known]
            escape[known < 0] = 0
            bits[missed] = escape + self.cost(left, order - 1)
        return bits

    def code_lengths(self, texts):
        """Bits of each text (bytes) in each language, in one pass over bounded chunks."""
        total = np.zeros((len(texts), len(self.languages)))
        ends = np.cumsum([len(t) + ORDER for t in texts])
        joined = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
        for low in range(0, len(joined), _CHUNK):
            high = min(low + _CHUNK, len(joined))
            back = min(low, ORDER)
            windows = _windows(joined[low - back : high])[back:]
            first, last = np.searchsorted(ends, [low, high - 1], side="right")
            starts = np.maximum(np.r_[0, ends[first:last]] - low, 0)
            bits = self.cost(windows, ORDER)
            for text, begin in zip(range(first, last + 1), starts):
                text_low = int(ends[text]) - len(texts[text]) - low
                bits[begin : max(begin, min(text_low, len(bits)))] = 0  # the padding
            total[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        return total


def _windows(data):
    """Each byte with the ORDER bytes before it, as one number; zeros before the start."""
    wide = data.astype(np.uint64)
    windows = wide.copy()
    for back in range(1, ORDER + 1):
        windows[back:] |= wide[:-back] << np.uint64(8 * back)
    return windows


def _count_grams(batches):
    """For each language and order the windows of a batch with their counts."""
    for part in slices(batches, "text"):
        columns = part.to_pydict()
        for lang in dict.fromkeys(columns["lang"]):
            texts = [t for t, own in zip(columns["text"], columns["lang"]) if own == lang]
            joined = b"".join(_PAD + t.encode() for t in texts)
            lengths = [len(t.encode()) for t in texts]
            own = np.ones(len(joined), bool)
            ends = np.cumsum(np.array(lengths) + ORDER)
            own[(ends - lengths - np.arange(1, ORDER + 1)[:, None]).ravel()] = False
            windows = _windows(np.frombuffer(joined, np.uint8))[own]
            for order in range(ORDER + 1):
                mask = np.uint64((1 << 8 * (order + 1)) - 1)
                grams, counts = np.unique(windows & mask, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": [lang] * len(grams),
                        "context_bytes": np.full(len(grams), order, np.int32),
                        "gram": grams.astype(np.int64),
                        "n": counts.astype(np.int64),
                    }
                )


def fit(docs, sample_docs=SAMPLE_DOCS, sample_doc_bytes=SAMPLE_DOC_BYTES):
    """A model of the languages that ``docs`` (doc_id, text, lang) name.

    Rows without a text, a letter or a language teach nothing. The sample of a language is
    those rows whose hashed doc_id falls below ``sample_docs`` / its rows. Of a text of more
    than ``sample_doc_bytes`` a stretch is taken that the doc_id chooses, so that languages of
    long texts are learned like any other. What is counted, collected and broadcast is bounded
    by the sample.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    rows = {r["lang"]: r["n"] for r in counts.collect()}
    if not rows:
        return Model([])
    share = F.create_map(*(F.lit(x) for lang, n in rows.items() for x in (lang, sample_docs / n)))
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A character has four bytes at most.
    chars = max(1, sample_doc_bytes // 4)
    start = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.length("text") - chars, F.lit(1))) + 1
    stretch = F.substring(F.col("text"), start.cast("int"), F.lit(chars))
    text = F.when(F.octet_length("text") <= sample_doc_bytes, F.col("text")).otherwise(stretch)
    sample = labelled.where(uniform < share[F.col("lang")]).select("lang", text.alias("text"))
    languages = sorted(rows)
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    counted = (
        sample.mapInArrow(_count_grams, "lang string, context_bytes int, gram long, n long")
        .groupBy(number.cast("int").alias("lang"), "context_bytes", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    # Numbers for the languages, not a text in each row: the driver holds all rows at once.
    columns = {c: counted.column(c).to_numpy() for c in ("context_bytes", "gram", "n")}
    codes = counted.column("lang").to_numpy()
    return compile_model(pd.DataFrame({"lang": pd.Categorical.from_codes(codes, languages), **columns}))


def compile_model(counted):
    """Turns counts (lang, context_bytes, gram, n) into code lengths, shortest contexts first."""
    model = Model(sorted(counted["lang"].unique()))
    model.__dict__["_tables"] = tables = [], []
    for order in range(ORDER + 1 if model.languages else 0):
        level = counted[counted["context_bytes"] == order]
        grams = np.unique(level["gram"].to_numpy(np.uint64))
        contexts = np.unique(grams >> np.uint64(8))
        lower = model.cost(grams, order - 1)
        costs = np.empty((len(grams), len(model.languages)), np.float32)
        escapes = np.zeros((len(contexts), len(model.languages)), np.float32)
        for i, lang in enumerate(model.languages):
            own = level[level["lang"] == lang]
            place = np.searchsorted(grams, own["gram"].to_numpy(np.uint64))
            n = np.zeros(len(grams))
            n[place] = own["n"].to_numpy()
            context = np.searchsorted(contexts, grams >> np.uint64(8))
            total = np.bincount(context, n, len(contexts))
            distinct = np.bincount(context, n > 0, len(contexts))
            seen = total > 0
            escapes[seen, i] = np.log2((total + distinct)[seen] / distinct[seen])
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log2((total + distinct)[context]) - np.log2(n)
            costs[:, i] = np.where(n > 0, direct, escapes[context, i] + lower[:, i])
        model.grams.append(grams)
        model.costs.append(costs)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
        tables[0].append(SortedLookup(grams))
        tables[1].append(SortedLookup(contexts))
    del model.__dict__["_tables"]  # workers build faster ones
    return model


def identify(docs, model):
    """The columns of ``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    ``lang_pred`` is the language with the shortest code for the whole text, the first by
    name among equals; it is ``und``, with score 0 and no bits_per_byte, where the text is
    null or has no letter, or where the model knows no language. ``score`` is the share of
    that language in the probability that all languages give to the text. Columns of ``docs``
    with one of the three names are replaced. Only the text decides.
    """
    kept = docs.select(*(c for c in docs.columns if c not in ADDED))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(kept.schema))
    for name, kind in zip(ADDED, ("string", "double", "double")):
        schema.add(name, kind)

    def score(batches):
        model = shared.value
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            scored = [bool(model.languages and t and _LETTER.search(t)) for t in texts]
            raw = [t.encode() for t, use in zip(texts, scored) if use]
            found = iter(_decide(model, raw) if raw else ())
            rows = [next(found) if use else (UNKNOWN, 0.0, None) for use in scored]
            kinds = (pa.string(), pa.float64(), pa.float64())
            added = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *added], names=[*part.schema.names, *ADDED]
            )

    return kept.mapInArrow(score, schema)


def _decide(model, raw):
    bits = model.code_lengths(raw)
    best = bits.argmin(axis=1)
    least = bits.min(axis=1)
    share = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
    per_byte = least / [len(t) for t in raw]
    return [
        (model.languages[b], float(s), float(p)) for b, s, p in zip(best, share, per_byte)
    ]
