"""Hard negatives: for each anchor and positive, rows of other labels that score nearly as high.

Vectors become integers, and a score is an integer inner product. Rows are put in the order of
label and place on a Hilbert curve through all dimensions, and cut into blocks of BLOCK rows,
each one row of a Parquet table. Its zone map holds the smallest and the largest number of
every dimension and label. For an anchor a, interval arithmetic bounds the scores of a block

    sum of min(a_i low_i, a_i high_i)  <=  score  <=  sum of max(a_i low_i, a_i high_i)

and only blocks whose bounds meet what is asked are read:

* for the positives, blocks with the anchor's label that reach its fifth best score at home,
  that is, among the rows of its own block;
* for the windows of its positives, blocks with other labels whose bounds meet a window, above
  the third best score that the SEEDS blocks with the highest bounds have in that window.

What is left out can't be part of the result, so that is exact. How much is left out hangs on
the data: on vectors without clusters, in many dimensions, nearly every block can hold a hit.

Anchors are dealt to bundles of some BUNDLE rows, zone maps to chunks of some CHUNK blocks;
every bundle meets every chunk, and each (block, bundle) that is asked for is scored on its
own, so no task grows with the table. The curve's grid is set by means and deviations of all
rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefspark.llm.common import staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score as a percentage of the positive's.
LOW, HIGH = 50, 95
BLOCK = 1024
BUNDLE, CHUNK = 4096, 8192
# Blocks read first for an anchor's windows.
SEEDS = 2
# Bits of a place on the curve, at least, and bits of a dimension, at least.
CURVE_BITS, GRID_BITS = 48, 2
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1
_SLACK = 1e-9


def hilbert_keys(cells, bits):
    """Places on a Hilbert curve, as rows of bytes in order, of points of a grid.

    ``cells`` has a row for each point and numbers below ``2**bits``. Each level of the grid
    exchanges or mirrors the axes of the levels below it, for all points at once.
    """
    x, axes = cells.T.astype(np.uint64), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        below = np.uint64((1 << level) - 1)
        for axis in range(axes):
            far = x[axis] >> np.uint64(level) & np.uint64(1) == 1
            swap = np.where(far, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(far, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turned = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        odd = x[-1] >> np.uint64(level) & np.uint64(1) == 1
        turned ^= np.where(odd, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turned
    spread = [(x >> np.uint64(level) & np.uint64(1)).astype(np.uint8) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(spread).T, axis=1)


def _taking_part():
    """Column: whether a row takes part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column, width):
    """Rows of an Arrow list column as a matrix, zeros after short ones."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(lengths), width))
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


def _packed(rows):
    """A matrix of integers as bytes: 2 or 8 bytes a number."""
    small = not rows.size or np.abs(rows).max() < 1 << 15
    return rows.astype("<i2" if small else "<f8").tobytes()


def _unpacked(data, rows, width):
    kind = "<i2" if len(data) == 2 * rows * width else "<f8"
    return np.frombuffer(data, kind).reshape(rows, width).astype(float)


def _each_unpacked(column, width):
    parts = [_unpacked(x, 1, width) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros((0, width))


def _products(a, b):
    """Integer inner products, those beyond 64 bits as the nearest 64-bit number."""
    most = [np.abs(m).max() if m.size else 0.0 for m in (a, b)]
    if a.shape[1] * most[0] * most[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object) for m in (a, b)]
    return np.clip(whole[0].dot(whole[1].T), -_MOST, _MOST).astype(np.int64)


def _moments(width, scale):
    def moments(batches):
        n, sums, squares = 0, np.zeros(width), np.zeros(width)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = np.floor(scale * _matrix(batch.column("vector"), width))
                n, sums, squares = n + len(rows), sums + rows.sum(axis=0), squares + (rows**2).sum(axis=0)
        if n:
            columns = [pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(sums), pa.array(squares)]
            yield pa.RecordBatch.from_arrays(columns, names=["axis", "n", "total", "squares"])

    return moments


def _placed(width, scale, middle, spread, bits):
    """Adds the vector in integers and its place on the curve."""

    def place(batches):
        for batch in batches:
            rows = np.floor(scale * _matrix(batch.column("vector"), width))
            grid = np.floor(((rows - middle) / spread / 4 + 0.5) * (1 << bits))
            cells = np.clip(np.nan_to_num(grid), 0, (1 << bits) - 1)
            keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
            columns = [batch.column(c) for c in ("vec_id", "label", "anchor")]
            columns += [pa.array(keys, pa.binary()), pa.array([_packed(r[None]) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "anchor", "key", "packed"])

    return place


_BLOCKS = (
    "block long, low_label long, high_label long, lows binary, highs binary, "
    "ids array<long>, labels array<long>, anchors array<boolean>, packed binary"
)


def _cut(width, size):
    """Sorted rows in blocks, each with its zone map."""

    def cut(batches):
        block, held = TaskContext.get().partitionId() << 24, []

        def row(part):
            ids, labels, anchors = (part.column(c) for c in ("vec_id", "label", "anchor"))
            rows, lasting = _each_unpacked(part.column("packed"), width), np.asarray(labels)
            values = [block, lasting.min(), lasting.max(), rows.min(axis=0).astype("<f8").tobytes(),
                      rows.max(axis=0).astype("<f8").tobytes(), ids.to_pylist(), labels.to_pylist(),
                      anchors.to_pylist(), _packed(rows)]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2
            kinds += [pa.list_(pa.bool_()), pa.binary()]
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield row(pa.Table.from_batches(held).combine_chunks())
                    block, held = block + 1, []
        if any(b.num_rows for b in held):
            yield row(pa.Table.from_batches(held).combine_chunks())

    return cut


class _Candidates:
    """The rows of a block, by rising vec_id."""

    def __init__(self, row, width):
        ids = np.array(row["ids"], np.int64)
        self.block, self.place = row["block"], np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[self.place], np.array(row["labels"], np.int64)[self.place]
        self.rows = _unpacked(row["packed"], len(ids), width)[self.place]

    def best(self, scores, fit, count):
        """Places of the ``count`` highest scores that are fit, equal ones by vec_id."""
        places = np.flatnonzero(fit)
        return places[np.argsort(-scores[places], kind="stable")[:count]]


def _homes(width, positives, size):
    """The anchors of each block, with their last wanted score among the block's own rows."""

    def homes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, marked = _Candidates(row, width), np.array(row["anchors"], bool)
                rows, labels = _unpacked(row["packed"], len(marked), width), np.array(row["labels"])
                found = []
                for place in np.flatnonzero(marked):
                    scores = _products(rows[place : place + 1], own.rows)[0]
                    same = (own.labels == labels[place]) & (own.place != place)
                    best = scores[own.best(scores, same, positives)]
                    least = int(best[-1]) if len(best) == positives else None
                    number = row["block"] * size + int(place)
                    found.append((number, row["ids"][place], int(labels[place]), _packed(rows[place][None]), least))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else None
                if columns:
                    names = ["anchor", "anchor_id", "label", "packed", "least"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return homes


def _bounds(anchors, lows, highs):
    """(lowest, highest) score that each anchor (row) can have in each block (column)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    slack = _SLACK * (np.abs(anchors) @ np.maximum(np.abs(lows), np.abs(highs)).T)
    return up @ lows.T + down @ highs.T - slack, up @ highs.T + down @ lows.T + slack


_ASKED = "block long, bundle int, anchor long"


def _choose(width, seeds):
    """Which blocks each anchor has to read; ``seeds`` limits windows to the best few blocks.

    Bounds that overflow are no number, which leaves no block out.
    """

    def choose(anchors, zones):
        names = anchors.column_names
        lows, highs = (np.frombuffer(b"".join(zones.column(c).to_pylist()), "<f8").reshape(-1, width)
                       for c in ("lows", "highs"))
        blocks, first, last = (zones.column(c).to_numpy() for c in ("block", "low_label", "high_label"))
        numbers, labels = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy()
        bundle, found = anchors.column("bundle")[0].as_py() if len(anchors) else 0, []
        for at in range(0, len(anchors) if len(blocks) else 0, 256):
            part = anchors.slice(at, 256)
            label = labels[at : at + 256, None]
            with np.errstate(all="ignore"):
                lowest, highest = _bounds(_each_unpacked(part.column("packed"), width), lows, highs)
            if "least" in names:
                least = np.array([-np.inf if x is None else x for x in part.column("least").to_pylist()])
                ask = (first <= label) & (label <= last) & ~(highest < least[:, None])
            else:
                ask = np.zeros(highest.shape, bool)
                for row, windows in enumerate(part.column("windows").to_pylist()):
                    for window in windows:
                        ask[row] |= ~(highest[row] < window["low"]) & ~(lowest[row] > window["high"])
                ask &= ~((first == label) & (label == last))
                if seeds and len(blocks) > seeds:
                    rank = np.where(ask, -np.nan_to_num(highest, nan=np.inf), np.inf)
                    near = np.zeros(ask.shape, bool)
                    np.put_along_axis(near, np.argpartition(rank, seeds, axis=1)[:, :seeds], True, axis=1)
                    ask &= near
            row, column = np.nonzero(ask)
            found.append((blocks[column], numbers[at + row]))
        block, number = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        columns = [pa.array(block), pa.array(np.full(len(block), bundle, np.int32)), pa.array(number)]
        return pa.Table.from_arrays(columns, names=["block", "bundle", "anchor"])

    return choose


_HITS = "anchor long, window int, vec_id long, score long"


def _read(width, count, size):
    """Scores the anchors that ask for a block: the best of their label, or of each window."""

    def read(asking, blocks):
        if not len(asking) or not len(blocks):
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64())],
                                        names=["anchor", "window", "vec_id", "score"])
        own, hits = _Candidates(blocks.to_pylist()[0], width), []
        numbers, labels = asking.column("anchor").to_pylist(), asking.column("label").to_pylist()
        windows = asking.column("windows").to_pylist() if "windows" in asking.column_names else None
        for at in range(0, len(numbers), 512):
            scores = _products(_each_unpacked(asking.column("packed").slice(at, 512), width), own.rows)
            for row, (line, label) in enumerate(zip(scores, labels[at : at + 512]), at):
                same = own.labels == label
                if windows is None:
                    if numbers[row] // size == own.block:
                        same &= own.place != numbers[row] % size
                    hits += [(numbers[row], 0, own.ids[p], line[p]) for p in own.best(line, same, count)]
                    continue
                for w in windows[row]:
                    fit = ~same & (line >= w["low"]) & (line <= w["high"])
                    hits += [(numbers[row], w["window"], own.ids[p], line[p]) for p in own.best(line, fit, count)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*hits) if hits else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(map(list, columns), kinds)],
                                    names=["anchor", "window", "vec_id", "score"])

    return read


class _Search:
    """Blocks in the order of the curve, and who reads which of them."""

    def __init__(self, blocks, width, bundles):
        self.blocks, self.width, self.bundles = blocks, width, bundles
        self.chunks = math.ceil(blocks.count() / CHUNK)

    def hits(self, anchors, count, seeds=0):
        """Rows of _HITS that ``anchors`` (with ``least`` or ``windows``) find in what they read."""
        bundle = F.pmod(F.xxhash64("anchor"), F.lit(self.bundles)).cast("int")
        anchors = staged(anchors.withColumn("bundle", bundle), "negatives-anchors")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        zones = self.blocks.select("block", "low_label", "high_label", "lows", "highs")
        chunk = F.pmod(F.xxhash64("block"), F.lit(self.chunks)).cast("int")
        zones = zones.withColumn("chunk", chunk).withColumn("bundle", every(self.bundles))
        dealt = anchors.withColumn("chunk", every(self.chunks)).groupBy("bundle", "chunk")
        asked = dealt.cogroup(zones.groupBy("bundle", "chunk")).applyInArrow(_choose(self.width, seeds), _ASKED)
        asked = staged(asked, "negatives-asked")
        asking = asked.join(anchors.drop("bundle"), "anchor").groupBy("block", "bundle")
        wanted = asked.select("block", F.col("bundle").alias("by")).distinct()
        read = self.blocks.select("block", "ids", "labels", "packed").join(wanted, "block")
        return asking.cogroup(read.groupBy("block", "by")).applyInArrow(_read(self.width, count, BLOCK), _HITS)


def _best(hits, keys, count):
    """The ``count`` best hits of each key with their ``rank``."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def hard_negatives(vectors, anchors, positives=POSITIVES, negatives=NEGATIVES, low=LOW, high=HIGH, scale=SCALE):
    """Negatives for the rows of ``vectors`` (vec_id, embedding, label) where ``anchors`` holds.

    Each component x becomes ``floor(scale * x)``. An anchor's positives are its best
    ``positives`` other rows of the same label; for each, the best ``negatives`` rows of other
    labels whose score is between ``low`` and ``high`` percent of the positive's come back,
    ranked from 1. Higher scores come first, equal ones by smaller vec_id.

    Rows with a null vec_id, label or vector, or with a component that is null or not finite,
    take no part. Shorter vectors count as filled up with zeros. Rows with the same vec_id are
    rows of their own, an anchor's other rows among them. A positive with a negative score has
    no window. Scores beyond 64 bits count as the nearest 64-bit number. Other columns are not
    read; without rows or anchors the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.where(_taking_part()).select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("long"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    total, marked, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
    if not marked:
        return spark.createDataFrame([], _RESULT)
    width = max(width, 1)
    moments = rows.mapInArrow(_moments(width, scale), "axis long, n long, total double, squares double")
    sums = moments.groupBy("axis").agg(F.sum("n"), F.sum("total"), F.sum("squares")).orderBy("axis").collect()
    n, sums, squares = np.array([r[1:] for r in sums], float).T
    with np.errstate(all="ignore"):
        spread = np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0))
    middle, spread = np.nan_to_num(sums / n), np.where((spread > 0) & np.isfinite(spread), spread, 1.0)
    bits = max(GRID_BITS, math.ceil(CURVE_BITS / width))
    shape = "vec_id long, label long, anchor boolean, key binary, packed binary"
    placed = rows.mapInArrow(_placed(width, scale, middle, spread, bits), shape)
    order = ("label", "key", "vec_id")
    ordered = placed.repartitionByRange(math.ceil(total / BLOCK / 8), *order).sortWithinPartitions(*order)
    blocks = staged(ordered.mapInArrow(_cut(width, BLOCK), _BLOCKS), "negatives-blocks")
    search = _Search(blocks, width, math.ceil(marked / BUNDLE))
    shape = "anchor long, anchor_id long, label long, packed binary, least long"
    anchors = staged(blocks.mapInArrow(_homes(width, positives, BLOCK), shape), "negatives-homes")
    asking = anchors.drop("anchor_id")
    found = _best(search.hits(asking, positives), ["anchor"], positives)
    found = staged(found.drop("window").withColumnRenamed("rank", "window"), "negatives-positives")
    # In decimals, since a percentage of a long need not be one.
    share = "cast(score as decimal(38, 0)) * {}"
    window = F.struct(
        "window",
        F.expr(f"cast(({share.format(low)} + 99) div 100 as long)").alias("low"),
        F.expr(f"cast({share.format(high)} div 100 as long)").alias("high"),
    )
    windows = found.where("score >= 0").groupBy("anchor").agg(F.collect_list(window).alias("windows"))
    asking = staged(asking.drop("least").join(windows, "anchor"), "negatives-windows")
    first = _best(search.hits(asking, negatives, SEEDS), ["anchor", "window"], negatives)
    third = first.where(F.col("rank") == negatives).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached")
    )
    reached = lambda w: F.coalesce(F.greatest(w["low"], F.element_at("reached", w["window"])), w["low"])
    higher = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), reached(w).alias("low"), w["high"].alias("high")))
    asking = asking.join(third, "anchor", "left").withColumn("windows", higher).drop("reached")
    best = _best(search.hits(asking, negatives), ["anchor", "window"], negatives)
    best = best.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("anchor", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = best.join(pairs, ["anchor", "window"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return whole.select(*(c.split()[0] for c in _RESULT.split(", ")))
