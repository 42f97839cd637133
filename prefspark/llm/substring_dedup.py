"""Removal of repeated passages by automata over confirmed phrases.

A window is WINDOW consecutive words. Every word of a window is removed if the same window
also starts in a document with a smaller doc_id.

1. Documents with the same words as one with a smaller doc_id go as a whole; only the first of
   them takes part in what follows.
2. Each window has an anchor, the smallest hash of its runs of ANCHOR_WORDS words, so equal
   windows have equal anchors. A document has few different anchors; those that occur in two
   documents are the places to look at.
3. The windows of these places are counted by hash: the ones that recur are confirmed, and the
   document they occur in first is known. Consecutive ones form the passages of a document.
4. Documents are dealt into blocks. Each gets the passages that hold a confirmed window of one
   of its documents. They stream past the documents of the block, compiled into one
   Aho-Corasick automaton after the other: every SEED_STEP-th run of SEED_WORDS words of a
   passage is a phrase, so each window holds a whole one. Where a phrase is found, the words
   to its left and right are compared with the passage, and runs of a window or more are
   removed.

In 3 windows are told apart by 64-bit hashes, in 4 by their words, so nothing is removed that
does not recur. Only texts with a recurring anchor are shuffled as texts.
"""

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from prefspark.llm.common import WORD, set_aside, slices, staged

WINDOW = 50
ANCHOR_WORDS = 12
SEED_WORDS = 25
SEED_STEP = WINDOW - SEED_WORDS + 1
# Documents of a block, and characters of them, on average; a task holds one block.
BLOCK_DOCS = 256
BLOCK_CHARS = 16_000_000
# Words of passages in one automaton; a block compiles as many as it needs, one at a time.
AUTOMATON_WORDS = 400_000
# Windows of a passage; longer ones are cut into stretches that overlap by WINDOW - 1 words. An
# automaton has a letter for each of its words, and there are some 1,100,000 letters.
STRETCH_WINDOWS = 1_000
# Windows of a block that are sorted at once.
SORTED_WINDOWS = 2_000_000
_LAST_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_PROFILE = (
    "id long, missing boolean, text_key long, n_words long, words1 long, words2 long, "
    "kept_sha256 string, anchors array<long>"
)
_RESULT = "id long, text_key long, n_removed long, kept_sha256 string, text string"
_UNKNOWN = "\x01"
_FIRST_LETTER, _SURROGATES, _SURROGATES_END = 0x100, 0xD800, 0xE000


def words_of(text):
    """The words of a text as bytes; bytes split at exactly the white space of the rule."""
    return text.encode().split() if text else []


def _mixed(numbers):
    numbers = (numbers ^ (numbers >> np.uint64(32))) * np.uint64(_BASE)
    return numbers ^ (numbers >> np.uint64(29))


def _powers(base, count):
    return np.r_[np.uint64(1), np.multiply.accumulate(np.full(max(count, 1), base, np.uint64))]


def gram_hashes(words, size):
    """A hash for each run of ``size`` words."""
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    sums = np.r_[np.uint64(0), np.cumsum(codes * _powers(_BASE, len(codes))[: len(codes)])]
    back = _powers(pow(_BASE, -1, 1 << 64), len(codes))[: max(0, len(codes) - size + 1)]
    return _mixed((sums[size:] - sums[:-size])[: len(back)] * back)


def _sliding_min(numbers, span):
    size = 1
    while 2 * size <= span:
        numbers, size = np.minimum(numbers[:-size], numbers[size:]), 2 * size
    rest = span - size
    return np.minimum(numbers[: len(numbers) - rest], numbers[rest:]) if rest else numbers


def window_anchors(words):
    """The anchor of each window."""
    if len(words) < WINDOW:
        return np.array([], np.int64)
    found = _sliding_min(gram_hashes(words, ANCHOR_WORDS), WINDOW - ANCHOR_WORDS + 1)
    return found.view(np.int64)


def _sha256(words):
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _batch(columns, kinds):
    arrays = [pa.array(columns[name], kind) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


_LONG, _LONGS = pa.int64(), pa.list_(pa.int64())


def _profile(batches):
    kinds = {f.split()[0]: _LONG for f in _PROFILE.split(", ")}
    kinds |= {"missing": pa.bool_(), "kept_sha256": pa.string(), "anchors": _LONGS}
    for part in slices(batches, "text"):
        columns = part.to_pydict()
        out = {name: [] for name in kinds} | {k: columns[k] for k in ("id", "missing", "text_key")}
        for text in columns["text"]:
            words = words_of(text)
            joined = b" ".join(words)
            key = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64)
            out["n_words"].append(len(words))
            out["words1"].append(key[0])
            out["words2"].append(key[1])
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["anchors"].append(np.unique(window_anchors(words)))
        yield _batch(out, kinds)


def _spans(block, found):
    """For each window of some documents (id, windows) of a block the least and largest id."""
    windows = np.concatenate([w for _, w in found]) if found else []
    if not len(windows):
        return
    ids = np.repeat(np.array([n for n, _ in found], np.int64), [len(w) for _, w in found])
    order = np.lexsort((ids, windows))
    windows, ids = windows[order], ids[order]
    starts = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]])
    lasts = np.r_[starts[1:], len(ids)] - 1
    columns = [windows[starts], np.full(len(starts), block, np.int32), ids[starts], ids[lasts]]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["window", "block", "low", "high"])


def _recurring_windows(batches):
    """(window, block, low, high): the hashes of the windows of a block that have an anchor
    listed for their document, with the least and largest id. Rows come sorted by block."""
    block, found, held = None, [], 0
    for part in slices(batches, "text"):
        columns = part.to_pydict()
        names = ("block", "id", "text", "anchors")
        for own, number, text, anchors in zip(*map(columns.get, names)):
            if own != block or held > SORTED_WINDOWS:
                yield from _spans(block, found)
                block, found, held = own, [], 0
            words = words_of(text)
            at = np.isin(window_anchors(words), anchors)
            windows = np.unique(gram_hashes(words, WINDOW)[at]).view(np.int64)
            found.append((number, windows))
            held += len(windows)
    yield from _spans(block, found)


def _passages(batches):
    """The longest runs of a document in which every window is listed, cut into stretches."""
    kinds = {"first": _LONG, "start": _LONG, "text": pa.string(), "windows": _LONGS}
    for part in slices(batches, "text"):
        columns = part.to_pydict()
        out = {name: [] for name in kinds}
        for number, text, windows in zip(columns["id"], columns["text"], columns["windows"]):
            words = words_of(text)
            if len(words) < WINDOW:
                continue
            hashes = gram_hashes(words, WINDOW).view(np.int64)
            at = np.isin(hashes, windows)
            edges = np.flatnonzero(np.diff(np.r_[False, at, False].astype(np.int8)))
            runs = edges.reshape(-1, 2).tolist()
            for low, end in ((a, b) for start, b in runs for a in range(start, b, STRETCH_WINDOWS)):
                high = min(end, low + STRETCH_WINDOWS)
                out["first"].append(number)
                out["start"].append(low)
                out["text"].append(b" ".join(words[low : high + WINDOW - 1]).decode())
                out["windows"].append(np.unique(hashes[low:high]))
        yield _batch(out, kinds)


class Automaton:
    """Finds where documents repeat passages (first, words).

    Words are single letters inside, so an automaton has a node for each word of a phrase.
    """

    def __init__(self, passages):
        self.letters, self.passages = {}, []
        phrases = {}
        for first, words in passages:
            text = "".join(map(self._letter, words))
            for at in range(0, len(text) - SEED_WORDS + 1, SEED_STEP):
                phrases.setdefault(text[at : at + SEED_WORDS], []).append((len(self.passages), at))
            self.passages.append((first, text))
        self.found = ahocorasick.Automaton()
        for phrase, places in phrases.items():
            self.found.add_word(phrase, places)
        self.found.make_automaton()

    def _letter(self, word):
        code = _FIRST_LETTER + len(self.letters)
        code += (_SURROGATES_END - _SURROGATES) * (code >= _SURROGATES)
        return self.letters.setdefault(word, chr(code))

    def mark(self, number, words, repeated):
        """Sets ``repeated`` for the windows of document ``number`` that a passage of a smaller
        one has. A phrase whose windows are all set is not followed up."""
        text = "".join([self.letters.get(w, _UNKNOWN) for w in words])
        ends = {}
        for last, places in self.found.iter(text):
            at = last - SEED_WORDS + 1
            for place, offset in places:
                if ends.get((place, at - offset), -1) > at:
                    continue
                low, high = max(0, at - SEED_STEP + 1), min(at + 1, len(repeated))
                if repeated[low:high].all():
                    break
                first, passage = self.passages[place]
                if first < number:
                    left = _common_back(text, at, passage, offset)
                    right = _common(text, at, passage, offset)
                    ends[place, at - offset] = at + right
                    if left + right >= WINDOW:
                        repeated[at - left : at + right - WINDOW + 1] = True


def _common(text, a, other, b):
    """How far two strings agree from a and b on."""
    size, step = 0, 64
    while True:
        one, two = text[a + size : a + size + step], other[b + size : b + size + step]
        if one != two or not one:
            break
        size += len(one)
        step *= 2
    for x, y in zip(one, two):
        if x != y:
            break
        size += 1
    return size


def _common_back(text, a, other, b):
    """How far two strings agree before a and b."""
    size, step = 0, 64
    while True:
        low = min(a - size, b - size, step)
        one, two = text[a - size - low : a - size], other[b - size - low : b - size]
        if one != two or not one:
            break
        size += low
        step *= 2
    for x, y in zip(reversed(one), reversed(two)):
        if x != y:
            break
        size += 1
    return size


def _without(text, removed):
    """The text without the words marked and the white space after them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    edges = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8))).tolist()
    kept, at = [], 0
    for low, high in zip(edges[::2], edges[1::2]):
        kept.append(text[at : starts[low]])
        at = starts[high]
    return "".join([*kept, text[at:]])


def _clean(with_text):
    """Streams sorted rows: of each block first its documents, then its passages. Held are the
    documents of one block and the passages of one automaton."""
    kinds = {f.split()[0]: _LONG for f in _RESULT.split(", ")}
    kinds |= {"kept_sha256": pa.string(), "text": pa.string()}

    def mark(documents, passages):
        automaton = Automaton(passages)
        for number, _, text, repeated in documents:
            if not repeated.all():
                automaton.mark(number, words_of(text), repeated)

    def results(documents):
        out = {name: [] for name in kinds}
        for number, text_key, text, repeated in documents:
            if not repeated.any():
                continue
            words = words_of(text)
            starts = np.zeros(len(words) + 1, np.int32)
            np.add.at(starts, np.flatnonzero(repeated), 1)
            np.add.at(starts, np.flatnonzero(repeated) + WINDOW, -1)
            removed = np.cumsum(starts[:-1]) > 0
            out["id"].append(number)
            out["text_key"].append(text_key)
            out["n_removed"].append(int(removed.sum()))
            out["kept_sha256"].append(_sha256([w for w, r in zip(words, removed) if not r]))
            out["text"].append(_without(text, removed) if with_text else None)
        return _batch(out, kinds)

    def clean(batches):
        block, documents, passages, size = None, [], [], 0
        for part in slices(batches, "text"):
            columns = part.to_pydict()
            names = ("block", "role", "id", "text_key", "text")
            for own, role, number, text_key, text in zip(*map(columns.get, names)):
                if own != block:
                    if passages:
                        mark(documents, passages)
                        yield results(documents)
                    block, documents, passages, size = own, [], [], 0
                words = words_of(text)
                if role == 0:
                    repeated = np.zeros(max(0, len(words) - WINDOW + 1), bool)
                    documents.append((number, text_key, text, repeated))
                    continue
                if passages and size + len(words) > AUTOMATON_WORDS:
                    mark(documents, passages)
                    passages, size = [], 0
                passages.append((number, words))
                size += len(words)
        if passages:
            mark(documents, passages)
            yield results(documents)

    return clean


def _keyed(docs):
    """Columns that tell texts apart by doc_id and content; a null doc_id comes last."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("id")
    missing = F.col("doc_id").isNull().alias("missing")
    return docs.select(number, missing, F.xxhash64("text").alias("text_key"), "text")


def _changes(docs, with_text):
    """(profiles, changed): a row for each document, and what becomes of those that change."""
    texts = _keyed(docs)
    profiles = staged(texts.mapInArrow(_profile, _PROFILE), "word-profiles")
    same = ["words1", "words2"]
    least = profiles.where(F.col("n_words") >= WINDOW).groupBy(*same).agg(F.min("id").alias("least"))
    judged = profiles.join(least, same)
    copies = judged.where("id > least").select(
        "id",
        "text_key",
        F.col("n_words").alias("n_removed"),
        F.lit(_sha256([])).alias("kept_sha256"),
        F.lit("").alias("text"),
    )
    own = judged.where("id = least").select("id", "text_key", F.explode("anchors").alias("anchor"))
    span = own.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = own.join(span.where("low < high").select("anchor"), "anchor")
    places = staged(shared.groupBy("id", "text_key").agg(F.collect_set("anchor").alias("anchors")), "places")
    suspects = staged(texts.join(places, ["id", "text_key"]), "suspects")
    n_docs, n_chars = suspects.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n_docs / BLOCK_DOCS), math.ceil(n_chars / BLOCK_CHARS))
    block = F.pmod(F.xxhash64("id", "text_key"), F.lit(blocks)).cast("int").alias("block")
    dealt = suspects.select(block, "id", "text", "anchors").repartition("block").sortWithinPartitions("block")
    windows = dealt.mapInArrow(_recurring_windows, "window long, block int, low long, high long")
    windows = staged(windows, "windows")
    spans = windows.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sources = spans.where("low < high").groupBy(F.col("low").alias("id"))
    sources = sources.agg(F.collect_list("window").alias("windows"))
    passages = suspects.select("id", "text").join(sources, "id").mapInArrow(
        _passages, "first long, start long, text string, windows array<long>"
    )
    passages = staged(passages, "passages")
    # One place for each confirmed window, and one row for each block that has it: nothing
    # multiplies, however many passages or documents share a line.
    listed = passages.select("first", "start", F.explode("windows").alias("window"))
    listed = listed.groupBy("window").agg(F.min(F.struct("first", "start")).alias("_at"))
    needed = windows.join(listed.select("window", "_at.*"), "window").where("first < high")
    needed = needed.select("block", "first", "start").distinct()
    phrases = needed.join(passages.select("first", "start", "text"), ["first", "start"]).select(
        "block",
        F.lit(1).alias("role"),
        F.col("first").alias("id"),
        F.lit(None).cast("long").alias("text_key"),
        "text",
    )
    readers = suspects.select(block, F.lit(0).alias("role"), "id", "text_key", "text")
    together = phrases.unionByName(readers).repartition("block").sortWithinPartitions("block", "role")
    changed = together.mapInArrow(_clean(with_text), _RESULT)
    changed = changed.unionByName(copies).dropDuplicates(["id", "text_key"])
    return profiles, changed


def repeated_words(docs):
    """What removal does to each of ``docs`` (doc_id, text): doc_id, n_words, n_removed and
    kept_sha256, the SHA-256 of the words left, joined by single spaces.

    A null text has no words. A null doc_id counts as the largest one there is. Rows with the
    same doc_id remove nothing from one another; equal rows have equal results. Whole texts
    whose words recur are told by a 128-bit hash of the words, passages by their words. Documents of
    fewer than WINDOW words lose nothing; other columns are not read; an empty table gives no
    rows.
    """
    profiles, changed = _changes(docs, with_text=False)
    new = changed.select("id", "text_key", "n_removed", F.col("kept_sha256").alias("_new"))
    return profiles.join(new, ["id", "text_key"], "left").select(
        F.when(~F.col("missing"), F.col("id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_new", "kept_sha256").alias("kept_sha256"),
    )


def without_repeats(docs):
    """``docs`` with repeated passages cut from their texts, and ``n_chars``, where there is
    one, set to the new length. All documents stay, if without a word; others are unchanged."""
    docs, whole = set_aside(docs, "doc_id", "text", "n_chars")
    _, changed = _changes(docs, with_text=True)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    keyed = docs.withColumns({"id": number, "text_key": F.xxhash64("text")})
    new = changed.select("id", "text_key", F.col("text").alias("new_text"))
    joined = keyed.join(new, ["id", "text_key"], "left")
    if "n_chars" in docs.columns:
        length = F.length("new_text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return whole(joined.withColumn("text", F.coalesce("new_text", "text")))
