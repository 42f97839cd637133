"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with a cosine of at least c are at most ``sqrt(2 - 2c)`` apart. Pivots taken from
the vectors part them into cells, each vector going to its nearest pivot; a cell is ordered by
the second nearest one and cut into blocks of at most BLOCK vectors, each one row of a Parquet
table with a ball around it. Vectors that are far from their pivot would blow up the ball of
its cell, so they make blocks of their own. Of two blocks only the vectors that are near enough
to the other one's ball are compared, by the triangle inequality.

Vectors are not copied to those that they are compared with. The blocks are dealt to as many
partitions as keep a few megabytes each, and a task reads two of them, as they lie on disk,
for every pair of partitions: what is written grows with the vectors alone, however few pairs
the balls spare, and a crowded cell is just more blocks. Equal vectors are joined once.

Products are bounded first, in single precision, by half of the dimensions along the axes on
which the pivots spread most: the rest adds no more than the product of its lengths. What
reaches the limit is compared whole, in double precision.

A task reports link counts and a spanning forest of its links, never all pairs. How much the
balls save hangs on the data: on vectors without clusters nearly all blocks are near enough,
and the time grows with the square of the vectors.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from prefspark.llm.common import staged
from prefspark.llm.components import components

COSINE = 0.9
BLOCK = 2048
MAX_PIVOTS = 2048
# Vectors that a task holds of each of its two partitions, about, and their bytes.
STREAM, STREAM_BYTES = 1 << 17, 1 << 25
# Bytes of a block's vectors, about.
BLOCK_BYTES = 1 << 20
# Vectors with a smaller cosine with their pivot are not near enough to one another to make a cell.
TIGHT = 0.7
# Products in a tile, along either side; candidates that are compared at once.
TILE, PAIRS = 256, 1 << 14
# The widest vectors that are turned to the axes of the pivots.
MAX_TURNED = 512
# Single precision finds candidates; what is this near to the limit is settled in double.
_SINGLE = 1e-4


def _fit():
    """Column: whether a vector can be linked."""
    vector = F.col("embedding").cast("array<double>")
    least, most = F.array_min(vector), F.array_max(vector)  # no number counts as the largest
    finite = ~F.exists(vector, lambda x: x.isNull()) & (least > -float("inf")) & (most < float("inf"))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & ((least < 0) | (most > 0)), F.lit(False))


def _unlinked(vectors):
    """The result for vectors that are linked with nothing."""
    return vectors.select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )


def _numbers(vectors):
    """The type in which vectors are stored: single precision only if they come in it."""
    return "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"


def _linkable(vectors):
    """Vectors that can be linked, with keys that equal ones share: vec_id, _key, _key2, vector.

    That is, those that are not null, not zero, of finite numbers, with a vec_id.
    """
    return vectors.where(_fit()).select(
        F.col("vec_id").cast("long"),
        F.xxhash64("embedding").alias("_key"),
        F.xxhash64(F.lit(1), "embedding").alias("_key2"),
        F.col("embedding").cast(f"array<{_numbers(vectors)}>").alias("vector"),
    )


def _matrix(column, width):
    """Rows of an Arrow list column as a matrix, zeros after short ones."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    rows = np.zeros((len(lengths), width), flat.dtype)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


def _units(rows):
    """Rows as unit vectors in double precision."""
    rows = rows.astype(float)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _meets_in(block, other):
    """Whether the pair of blocks is compared in ``block``: in half of its pairs, evenly."""
    return (block < other) == ((block + other) % 2 == 0)


def _pivots(linkable, rows, width, count):
    """Some ``count`` different vectors, or all if there are fewer, as unit vectors."""
    shares = 1 << 30
    share = min(shares, math.ceil((2 * count + 16) / rows * shares))
    some = linkable.where(F.pmod(F.xxhash64("vec_id", "_key"), F.lit(shares)) < share).limit(4 * count + 64)
    for table in (some, linkable.limit(1)):
        column = table.select("vector").toArrow().column("vector")
        if len(column):
            break
    chosen = np.unique(_units(_matrix(pa.concat_arrays(column.chunks), width)), axis=0)
    return np.random.default_rng(0).permutation(chosen)[:count]


_ASSIGNED = "_key long, _key2 long, vector array<{}>, least long, copies long, loose boolean, cell int, second int"


def _assign(pivots, width):
    """Vectors with their nearest two pivots; equal ones of a batch become one row."""

    def assign(batches):
        axes = pivots.value.astype(np.float32).T
        step = max(1, 4_000_000 // axes.shape[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, key, key2 = (batch.column(c).to_numpy() for c in ("vec_id", "_key", "_key2"))
            order = np.lexsort((ids, key2, key))
            new = (np.diff(key[order]) != 0) | (np.diff(key2[order]) != 0)
            first = np.flatnonzero(np.r_[True, new])
            batch = batch.take(pa.array(order[first]))
            copies = np.diff(np.r_[first, len(order)])
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                products = _units(_matrix(part.column("vector"), width)).astype(np.float32) @ axes
                cell = products.argmax(axis=1)
                loose = products.max(axis=1) < TIGHT
                products[np.arange(len(cell)), cell] = -2
                nearest = (pa.array(x.astype(np.int32)) for x in (cell, products.argmax(axis=1)))
                kept = [part.column(c) for c in ("_key", "_key2", "vector", "vec_id")]
                columns = [*kept, pa.array(copies[low : low + step]), pa.array(loose), *nearest]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ASSIGNED.split(", ")])

    return assign


_BLOCKS = (
    "block long, keys array<long>, keys2 array<long>, leasts array<long>, copies array<long>, "
    "vectors binary, weights binary, centre binary, radius double"
)


def _cut(width, size):
    """Sorted vectors in blocks, with the ball around each; loose vectors are of one cell."""

    def cut(batches):
        block, cell, held = TaskContext.get().partitionId() << 24, None, []

        def row():
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rows, copies = _matrix(part.column("vector"), width), part.column("copies").to_numpy()
            units = _units(rows)
            centre = units.mean(axis=0)
            radius = np.linalg.norm(units - centre, axis=1).max()
            lists = [part.column(c).to_pylist() for c in ("_key", "_key2", "least", "copies")]
            weights = copies.astype("<i8").tobytes() if (copies > 1).any() else None
            values = [block, *lists, rows.tobytes(), weights, centre.tobytes(), radius]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, *[pa.binary()] * 3, pa.float64()]
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            loose = batch.column("loose").to_numpy(zero_copy_only=False)
            cells = np.where(loose, -1, batch.column("cell").to_numpy())
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cells)]):
                while low < high:
                    room = size - sum(b.num_rows for b in held)
                    if held and (not room or cell != cells[low]):
                        yield row()
                        block, held, room = block + 1, [], size
                    cell = cells[low]
                    held.append(batch.slice(low, min(room, high - low)))
                    low += held[-1].num_rows
        if held:
            yield row()

    return cut


class _Turned:
    """Unit vectors as some coordinates on axes of their own, and the length of the rest.

    The product of two such codes is at least that of the vectors.
    """

    def __init__(self, pivots):
        width = pivots.shape[1]
        self.axes = np.linalg.eigh(pivots.T @ pivots)[1][:, ::-1] if width <= MAX_TURNED else None
        self.kept = width if width <= 16 else width // 2 - 1

    def codes(self, vectors):
        turned = vectors if self.axes is None else vectors @ self.axes
        rest = np.linalg.norm(turned[:, self.kept :], axis=1, keepdims=True)
        return np.concatenate([turned[:, : self.kept], rest], axis=1)


class _Block:
    """The vectors of a block, their codes, and the nodes of a task that they are."""

    def __init__(self, row, width, kind, size, node):
        self.number, self.radius = row["block"], row["radius"]
        self.rows = np.frombuffer(row["vectors"], kind).reshape(-1, width)
        n = len(self.rows)
        self.copies = np.frombuffer(row["weights"], "<i8") if row["weights"] else np.ones(n, np.int64)
        self.centre = np.frombuffer(row["centre"])
        self.ids, self.nodes = self.number * size + np.arange(n), node + np.arange(n)
        self.counts = np.zeros(n, np.int64)

    def measure(self, turned, others, limit):
        """Sets codes and near: which vectors (rows) can be linked with one in the balls of
        ``others`` (columns)."""
        units = _units(self.rows)
        self.codes = turned.codes(units).astype(np.float32)
        centres = np.array([b.centre for b in others])
        reach = np.array([b.radius for b in others]) + limit
        least = (1 + (centres**2).sum(axis=1) - reach * reach - _SINGLE) / 2
        self.near = units.astype(np.float32) @ centres.astype(np.float32).T >= least.astype(np.float32)


class _Links:
    """Link counts of blocks and a spanning forest of their links."""

    def __init__(self, cosine, nodes):
        self.cosine, self.limit, self.parents = cosine, math.sqrt(2 - 2 * cosine), np.arange(nodes)
        self.products = np.empty(TILE * TILE, np.float32)

    def tops(self, nodes):
        while (self.parents[nodes] != nodes).any():
            nodes = self.parents[nodes]
        return nodes

    def _unite(self, nodes, others):
        tops, across = self.tops(nodes), self.tops(others)
        apart = tops != across
        for a, b in set(zip(tops[apart].tolist(), across[apart].tolist())):
            while self.parents[a] != a:
                a = self.parents[a]
            while self.parents[b] != b:
                b = self.parents[b]
            self.parents[max(a, b)] = min(a, b)

    def _candidates(self, a, b, own):
        """Tiles of two tables of codes with what may be linked in each: (row, column, hits)."""
        for low in range(0, len(a), TILE):
            part = a[low : low + TILE]
            for at in range(low if own else 0, len(b), TILE):
                other = b[at : at + TILE]
                tile = self.products[: len(part) * len(other)].reshape(len(part), len(other))
                np.matmul(part, other.T, out=tile)
                if tile.max() >= self.cosine - _SINGLE:
                    hits = tile >= self.cosine - _SINGLE
                    yield low, at, np.triu(hits, 1) if own and low == at else hits

    def compare(self, a, b, near, near_too):
        """Add the links of two blocks, or of one with itself, each pair once.

        ``near`` and ``near_too`` are which vectors of either one can have any.
        """
        own = a is b
        if own:
            near = near_too = near | True
        rows, columns = np.flatnonzero(near), np.flatnonzero(near_too)
        few = []
        codes = (x.codes if len(some) == len(x.codes) else x.codes[some] for x, some in ((a, rows), (b, columns)))
        for low, at, hits in self._candidates(*codes, own):
            some = np.flatnonzero(hits.any(axis=1))
            hits = hits[some]
            if np.count_nonzero(hits) * 64 < self.products.size:
                row, column = np.nonzero(hits)
                few.append((rows[low + some[row]], columns[at + column]))
            else:
                self._many(a, b, rows[low + some], columns[at : at + TILE], hits)
        found = [np.concatenate(x) for x in zip(*few)]
        for at in range(0, len(found[0]) if few else 0, PAIRS):
            self._few(a, b, *(x[at : at + PAIRS] for x in found))

    def _few(self, a, b, rows, columns):
        products = np.einsum("ij,ij->i", _units(a.rows[rows]), _units(b.rows[columns]))
        rows, columns = (x[products >= self.cosine] for x in (rows, columns))
        np.add.at(a.counts, rows, b.copies[columns])
        np.add.at(b.counts, columns, a.copies[rows])
        self._unite(a.nodes[rows], b.nodes[columns])

    def _many(self, a, b, rows, columns, hits):
        linked = hits & (_units(a.rows[rows]) @ _units(b.rows[columns]).T >= self.cosine)
        a.counts[rows] += linked @ b.copies[columns]
        b.counts[columns] += a.copies[rows] @ linked
        none = len(rows)
        roots = np.arange(none)
        while True:
            across = np.where(linked, roots[:, None], none).min(axis=0, initial=none)
            found = np.minimum(roots, np.where(linked, across, none).min(axis=1, initial=none))
            if (found == roots).all():
                break
            roots = found
        has = across < none
        self._unite(a.nodes[rows], a.nodes[rows[roots]])
        self._unite(b.nodes[columns[has]], a.nodes[rows[across[has]]])


def _table(ids, counts, ends, others):
    """Rows (a, b, links): a count of links where b is null, else a link of the forest."""
    a = pa.array(np.r_[ids, ends])
    b = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(others)])
    links = pa.array(np.r_[counts, np.zeros(len(ends), np.int64)])
    return pa.RecordBatch.from_arrays([a, b, links], names=["a", "b", "links"])


def _join(turned, width, kind, size, cosine):
    """Compares the blocks on the left of a task with those on its right."""

    def join(batches):
        known, sides, nodes = {}, {"left": [], "right": []}, 0
        for batch in batches:
            for side, blocks in sides.items():
                for row in batch.column(side).to_pylist():
                    if row is None:
                        continue
                    number = row["block"]
                    if number not in known:
                        known[number] = _Block(row, width, kind, size, nodes)
                        nodes += len(known[number].rows)
                    blocks.append(known[number])
        left, right = (sorted(s, key=lambda b: b.number) for s in sides.values())
        if not left or not right:
            return
        links = _Links(cosine, nodes)
        # Both sides are either the same blocks or have none in common.
        for block in known.values():
            block.measure(turned.value, left if block in right else right, links.limit)
        numbers = [np.array([b.number for b in s]) for s in (left, right)]
        pairs = _meets_in(numbers[0][:, None], numbers[1]) | (numbers[0][:, None] == numbers[1])
        pairs &= np.array([b.near.any(axis=0) for b in left])
        pairs &= np.array([b.near.any(axis=0) for b in right]).T
        for i, j in np.argwhere(pairs):
            links.compare(left[i], right[j], left[i].near[:, j], right[j].near[:, i])
        ids, counts = (np.concatenate([getattr(b, x) for b in known.values()]) for x in ("ids", "counts"))
        hung = np.flatnonzero(links.parents != np.arange(nodes))
        yield _table(ids[counts > 0], counts[counts > 0], ids[hung], ids[links.tops(hung)])

    return join


def _pairs(blocks, parts):
    """(left, right): every pair of ``parts`` partitions of blocks as a task, which gets each of
    their blocks once, read where the shuffle wrote it."""
    dealt = blocks.select("block", "vectors", "weights", "centre", "radius").repartition(parts)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    left, right = (
        dealt.select(F.struct(*dealt.columns).alias(side), first.alias(f"{side}_first")) for side in ("left", "right")
    )
    every = left.hint("shuffle_replicate_nl").join(right, F.col("left_first") | F.col("right_first"))
    return every.select(F.when(F.col("right_first"), F.col("left")).alias("left"),
                        F.when(F.col("left_first"), F.col("right")).alias("right"))


def near_duplicates(vectors, cosine=COSINE):
    """Links of ``vectors`` (vec_id, embedding) with a cosine of at least ``cosine``.

    Returns vec_id, n_links, component_id and kept, one row for each vector. Equal vectors are
    linked. Vectors that are null, zero or hold a null or a number that is not finite are
    linked with nothing, and so are those without a vec_id, whose component_id is null; they
    are kept. Shorter vectors count as filled up with zeros. Rows with the same
    vec_id are different vectors; other columns are not read; an empty table gives no rows.
    """
    context = vectors.sparkSession.sparkContext
    linkable, numbers = _linkable(vectors), _numbers(vectors)
    rows, width = linkable.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not rows:
        return _unlinked(vectors)
    kind = np.dtype("<f4" if numbers == "float" else "<f8")
    size = min(BLOCK, max(64, BLOCK_BYTES // (width * kind.itemsize)))
    pivots = _pivots(linkable, rows, width, min(MAX_PIVOTS, math.ceil(2 * rows / size)))
    assigned = linkable.mapInArrow(_assign(context.broadcast(pivots), width), _ASSIGNED.format(numbers))
    order = ("loose", "cell", "second", "_key", "_key2")
    # Ranges of the order are whole groups, too: vectors move once.
    ranged = assigned.repartitionByRange(math.ceil(rows / size / 8), *order)
    grouped = ranged.groupBy(*order).agg(
        F.first("vector").alias("vector"), F.min("least").alias("least"), F.sum("copies").alias("copies")
    )
    blocks = staged(grouped.sortWithinPartitions(*order).mapInArrow(_cut(width, size), _BLOCKS), "vector-blocks")
    count, distinct = blocks.agg(F.count("*"), F.sum(F.size("copies"))).first()
    most = max(size, min(STREAM, STREAM_BYTES // (width * kind.itemsize)))
    parts = max(math.ceil(distinct / most), min(count, math.ceil(math.sqrt(count) / 2) + 3))
    join = _join(context.broadcast(_Turned(pivots)), width, kind, size, cosine)
    found = staged(_pairs(blocks, parts).mapInArrow(join, "a long, b long, links long"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("_gid")).agg(F.sum("links").alias("_links"))
    roots = components(found.where("b is not null").select("a", "b"))
    roots = roots.select(F.col("id").alias("_gid"), "root")
    listed = F.arrays_zip("keys", "keys2", "leasts", "copies")
    groups = blocks.select("block", F.posexplode(listed)).select(
        (F.col("block") * size + F.col("pos")).alias("_gid"),
        F.col("col.keys").alias("_key"),
        F.col("col.keys2").alias("_key2"),
        F.col("col.leasts").alias("least"),
        F.col("col.copies").alias("copies"),
    )
    first = groups.join(roots, "_gid").groupBy("root").agg(F.min("least").alias("_first"))
    first = roots.join(first, "root").select("_gid", "_first")
    # Where two pivots are as near, equal vectors may be of two groups, which say the same.
    n_links, component = F.coalesce("_links", F.lit(0)) + F.col("copies") - 1, F.coalesce("_first", "least")
    whole = groups.join(first, "_gid", "left").join(counts, "_gid", "left").groupBy("_key", "_key2").agg(
        F.max(n_links).alias("n_links"), F.min(component).alias("component_id")
    )
    linked = linkable.select("vec_id", "_key", "_key2").join(whole, ["_key", "_key2"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    return linked.unionByName(_unlinked(vectors.where(~_fit())))
