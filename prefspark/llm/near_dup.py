"""Near-duplicate documents by banded MinHash, odd sketches and a check on the full sets.

A document is the set of its word shingles. One pass over the texts makes a short profile of
each: MinHash samples folded into bands, and the same samples folded into an odd sketch, a
bitmap in which each sample flips one bit. Where two sets are alike, most flips cancel: the
population count of the XOR of two sketches tells how much they differ, most exactly for high
similarities. A second odd sketch has a flip for every shingle: its count is never more than
the shingles that only one of the sets has, so what it drops is dropped for certain; it tells
most about short documents. Documents with equal sets are one from then on.

Documents that share a band are candidates. They are not paired all with all: each is paired
with the one of its band that shares most bands with others, pairs whose sketches are too far
apart are dropped, and the rest is confirmed on the full sets. Only where a band still holds
different components after that are the others compared, within the join and by their
sketches. So no link between different components is left out, and a group of thousands of
copies costs a link for each.
"""

import functools
import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from prefspark.llm.common import slices, staged
from prefspark.llm.components import components

SHINGLE_WORDS = 5
BAND_ROWS = 5
# Chance that a pair at the limit shares no band.
MISS = 1e-6
SKETCH_BITS = 512
SET_SKETCH_BITS = 2048
# Standard deviations by which a sketch may be off before its pair is dropped.
SKETCH_SIGMAS = 6

_ODD = np.random.default_rng(9).integers(0, 1 << 63, 64 + 4096, np.uint64) | np.uint64(1)
_CHUNK = 1 << 16
_ARRAYS = ("bands", "sketch", "set_sketch")
_PROFILE = "doc_id long, n_shingles long, key1 long, key2 long, " + ", ".join(
    f"{name} array<long>" for name in _ARRAYS
)


def mixed(numbers):
    numbers = (numbers ^ (numbers >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return numbers ^ (numbers >> np.uint64(29))


def shingle_set(text, words=SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z counting as a-z.

    A text with fewer words has one, the whole; a text without any has none.
    """
    parts = text.encode().lower().split() if text else ()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(codes))
    if not span:
        return codes
    count = len(codes) - span + 1
    total = np.full(count, span, np.uint64)
    for i in range(span):
        total += codes[i : i + count] * _ODD[i]
    return np.unique(mixed(total))


class Settings:
    """Numbers of bands and samples for a similarity limit in percent."""

    def __init__(self, percent, shingle_words=SHINGLE_WORDS):
        limit = percent / 100
        self.percent, self.shingle_words = percent, shingle_words
        self.bands = math.ceil(math.log(MISS) / math.log1p(-(limit**BAND_ROWS)))
        self.samples = self.bands * BAND_ROWS
        spread = math.sqrt(self.samples * limit * (1 - limit))
        differing = 2 * (self.samples * (1 - limit) + SKETCH_SIGMAS * spread)
        flipped = SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS))
        self.most_flipped = math.ceil(flipped)


def min_hashes(sets, samples):
    """MinHash samples (rows) of non-empty sets (columns), in chunks that fit a cache."""
    found = np.empty((samples, len(sets)), np.uint64)
    sizes = np.array([len(s) for s in sets])
    low = 0
    while low < len(sets):
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), _CHUNK, side="right")))
        joined = np.concatenate(sets[low:high])
        starts = np.r_[0, np.cumsum(sizes[low : high - 1])]
        buffer = np.empty_like(joined)
        for i in range(samples):
            np.multiply(joined, _ODD[64 + i], out=buffer)
            found[i, low:high] = np.minimum.reduceat(buffer, starts)
        low = high
    return found


def bands_of(samples):
    """A 64-bit hash for each band (columns) of each set (rows)."""
    groups = samples.reshape(-1, BAND_ROWS, samples.shape[1])
    keys = np.arange(len(groups), dtype=np.uint64)[:, None] * _ODD[0]
    for i in range(BAND_ROWS):
        keys = mixed(keys + groups[:, i] * _ODD[i + 1])
    return keys.T.view(np.int64)


def odd_sketches(samples):
    """The parity bitmap of each set: every sample flips the bit that it is hashed to."""
    place = mixed(samples + np.arange(len(samples), dtype=np.uint64)[:, None] * _ODD[1])
    place = (place % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.zeros((samples.shape[1], SKETCH_BITS), np.uint8)
    rows = np.arange(samples.shape[1])
    for bits in place:
        flips[rows, bits] ^= 1
    return np.packbits(flips, axis=1, bitorder="little").view(np.int64)


def set_sketches(sets):
    """The parity bitmap of each set with a flip for every element."""
    flips = [np.bincount(s % np.uint64(SET_SKETCH_BITS), minlength=SET_SKETCH_BITS) & 1 for s in sets]
    return np.packbits(np.array(flips, np.uint8), axis=1, bitorder="little").view(np.int64)


def _profile(settings):
    def profile(batches):
        for part in slices(batches, "text"):
            sets = [shingle_set(t, settings.shingle_words) for t in part.column("text").to_pylist()]
            some = [s for s in sets if len(s)]
            digests = [xxhash.xxh3_128_digest(s) for s in sets]
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            place = np.cumsum([len(s) > 0 for s in sets]) - 1
            tables = ()
            if some:
                samples = min_hashes(some, settings.samples)
                tables = bands_of(samples), odd_sketches(samples), set_sketches(some)
            none = np.array([], np.int64)
            columns = [
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys[:, 0]),
                pa.array(keys[:, 1]),
                *(
                    pa.array([t[p] if len(s) else none for s, p in zip(sets, place)], pa.list_(pa.int64()))
                    for t in tables or [none] * len(_ARRAYS)
                ),
            ]
            names = [f.split()[0] for f in _PROFILE.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return profile


def _full_sets(settings):
    """Shingle sets of groups; a text that is not of its group's set only shares its doc_id."""

    def full(batches):
        for part in slices(batches, "text"):
            sets = [shingle_set(t, settings.shingle_words) for t in part.column("text").to_pylist()]
            keys = [np.frombuffer(xxhash.xxh3_128_digest(s), np.int64).tolist() for s in sets]
            wanted = zip(part.column("key1").to_pylist(), part.column("key2").to_pylist())
            own = [i for i, (k, w) in enumerate(zip(keys, wanted)) if tuple(k) == w]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("gid").take(pa.array(own, pa.int64())),
                    pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64())),
                ],
                names=["gid", "shingles"],
            )

    return full


def _flipped(one, other, bits):
    """Column: population count of the XOR of the first bits of two bitmaps."""
    words = [F.bit_count(F.get(one, i).bitwiseXOR(F.get(other, i))) for i in range(bits // 64)]
    return functools.reduce(operator.add, words)


class _Groups:
    """Groups of documents with equal sets, and what is asked of pairs of them."""

    def __init__(self, docs, profiles, settings):
        self.docs, self.settings = docs, settings
        grouped = profiles.where("n_shingles > 0 and doc_id is not null").groupBy("key1", "key2")
        grouped = grouped.agg(
            F.min("doc_id").alias("least"),
            F.first("n_shingles").alias("n"),
            *(F.first(name).alias(name) for name in _ARRAYS),
        )
        self.rows = staged(grouped.withColumn("gid", F.monotonically_increasing_id()), "sets")
        buckets = self.rows.select("gid", F.explode("bands").alias("bucket"))
        counts = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        self.shared = staged(buckets.join(counts, "bucket"), "bands")
        weights = self.shared.groupBy("gid").agg(F.sum("n").alias("weight"))
        central = F.max_by("gid", "weight").alias("central")
        self.centres = staged(
            self.shared.join(weights, "gid").groupBy("bucket").agg(central), "centres"
        )

    def _sketched(self, end):
        """The groups with what ``_alike`` asks for, as the end a or b of a pair."""
        columns = {"gid": end, "n": f"n_{end}"} | {c: f"{c}_{end}" for c in _ARRAYS[1:]}
        return self.rows.select(*(F.col(c).alias(name) for c, name in columns.items()))

    def _alike(self):
        """Column: whether the sizes and sketches of a pair leave the limit within reach."""
        percent = self.settings.percent
        sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        apart = (F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent)
        # A part of the bitmap, too, shows no more than the difference, and mostly enough.
        parts = [
            _flipped("set_sketch_a", "set_sketch_b", bits) <= apart
            for bits in (SET_SKETCH_BITS // 8, SET_SKETCH_BITS // 2, SET_SKETCH_BITS)
        ]
        flipped = _flipped("sketch_a", "sketch_b", SKETCH_BITS) <= self.settings.most_flipped
        return functools.reduce(operator.and_, [sized, parts[0], flipped, *parts[1:]])

    def first_pairs(self):
        """Each group of a bucket with the central one, if they may be alike."""
        paired = self.shared.join(self.centres, "bucket").where("gid <> central")
        pairs = paired.select(F.col("central").alias("a"), F.col("gid").alias("b")).distinct()
        pairs = pairs.join(self._sketched("a"), "a").join(self._sketched("b"), "b")
        return pairs.where(self._alike()).select("a", "b")

    def open_pairs(self, roots):
        """Groups of a bucket in different components that may be alike.

        One of them is not in the central one's component. Pairs with the central one are not
        among them; they have been looked at.
        """
        rooted = self.shared.join(roots, F.col("gid") == F.col("id"), "left")
        rooted = rooted.select("bucket", "gid", F.coalesce("root", "gid").alias("root"))
        span = rooted.groupBy("bucket").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
        )
        some = span.where("low <> high and n > 2").select("bucket").join(self.centres, "bucket")
        members = staged(rooted.join(some, "bucket"), "open-bands")
        centres = members.where("gid = central").select("bucket", F.col("root").alias("central_root"))
        rest = members.where("gid <> central").select("bucket", "gid", "root")
        others = rest.join(centres, "bucket").where("root <> central_root")
        others = others.select("bucket", F.col("gid").alias("a"), F.col("root").alias("root_a"))
        rest = rest.select("bucket", F.col("gid").alias("b"), F.col("root").alias("root_b"))
        others = others.join(self._sketched("a"), "a")
        rest = rest.join(self._sketched("b"), "b")
        same = (others["bucket"] == rest["bucket"]) & (F.col("root_a") != F.col("root_b"))
        across = others.join(rest.hint("merge"), same & self._alike())
        return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def confirmed(self, pairs):
        """The written pairs (a, b) whose full sets are as similar as asked."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
        wanted = self.rows.join(ends, "gid").select("gid", F.col("least").alias("doc_id"), "key1", "key2")
        texts = self.docs.select("doc_id", "text").join(wanted, "doc_id")
        sets = texts.mapInArrow(_full_sets(self.settings), "gid long, shingles array<long>")
        sets = staged(sets.dropDuplicates(["gid"]), "full-sets")
        for end in ("a", "b"):
            own = sets.select(F.col("gid").alias(end), F.col("shingles").alias(f"set_{end}"))
            pairs = pairs.join(own, end)
        shared = F.size(F.array_intersect("set_a", "set_b"))
        every = F.size("set_a") + F.size("set_b") - shared
        return pairs.where(100 * shared >= self.settings.percent * every).select("a", "b")


def near_duplicates(docs, percent=80, shingle_words=SHINGLE_WORDS):
    """Links of ``docs`` (doc_id, text) whose shingle sets are similar to ``percent``.

    Similar is ``100 * intersection >= percent * union``. Returns doc_id, n_shingles,
    component_id, the smallest doc_id that links lead to, and kept, whether it is that one;
    one row for each document, by a written table, so it can be used again.

    Documents without a word, null texts among them, and those without a doc_id are linked
    with nothing and kept; the component_id is their doc_id. Repeated rows are kept together;
    other columns are not read; an empty table gives no rows. Pairs at the limit are missed
    with a chance of MISS, more similar ones with less.
    """
    settings = Settings(percent, shingle_words)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profiles = staged(docs.mapInArrow(_profile(settings), _PROFILE), "profiles")
    groups = _Groups(docs, profiles, settings)
    links = staged(groups.confirmed(staged(groups.first_pairs(), "pairs")), "confirmed")
    roots = staged(components(links), "roots")
    more = staged(groups.open_pairs(roots), "open-pairs")
    if not more.isEmpty():
        roots = components(links.unionByName(groups.confirmed(more)))
    rooted = groups.rows.join(roots, F.col("gid") == F.col("id"), "left")
    rooted = rooted.select("key1", "key2", "least", F.coalesce("root", "gid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("key1", "key2", "component_id")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    joined = profiles.select("doc_id", "n_shingles", "key1", "key2").join(found, ["key1", "key2"], "left")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
