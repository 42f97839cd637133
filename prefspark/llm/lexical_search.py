"""Ranked lexical search: bundles of items visit the owners of their terms, one after the other.

Documents are cut into slices of some SLICE_ROWS, whose postings (row, impact) stand in one row
for each term of the items. The terms have OWNERS owners: the first one has the heaviest, that
is, rarest terms, and each about the same number of postings. A bundle carries, for the items
of a block and the documents of a slice, the sparse scores gathered so far. At each owner it is
cogrouped with the owner's postings of that slice, which add integer contributions to it; after
the last one, the best documents of each slice meet in the final selection.

Scores only grow, and what later owners can add to an item is bounded by its terms' weights and
largest impacts. A document leaves a bundle when it can no longer reach the score that as many
documents as are wanted have already, and new ones come in only while they can reach it. That
is exact: what leaves can't be among the best.

The terms of the items reach the scan of the documents as a filter of FILTER_BITS bits, whose
false hits the join with the terms drops. So nothing that is sent to every task grows with the
documents or the items, and a frequent term is spread over as many slices as the documents fill.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefspark.llm.common import slices, staged

TOP = 50
SLICE_ROWS = 4096
# Postings after which a slice is closed, however few documents it has.
SLICE_POSTINGS = 1 << 21
ITEM_BLOCK = 256
OWNERS = 4
FILTER_BITS = 1 << 23
# Fixed values of the score, in thousandths and hundredths.
WEIGHT, FULL, GROWTH, LENGTH, HALF, WHOLE = 1000, 1_000_000_000, 1000, 20, 50, 100

# Bytes of a term in UTF-8: digits, letters (in lower case) and all beyond ASCII; the rest parts.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text):
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_TERM_BYTES).split()


def _as_bytes(column):
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def _item_terms(batches):
    row = TaskContext.get().partitionId() << 33
    for batch in slices(batches, "text"):
        ids = batch.column("item_id").to_pylist()
        distinct = [sorted(set(terms_of(t))) for t in _as_bytes(batch.column("text"))]
        numbers = pa.array(range(row, row + len(ids)), pa.int64())
        columns = [numbers, pa.array(ids, batch.column("item_id").type), pa.array(distinct, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "terms"])
        row += len(ids)


def _filter(terms):
    """The terms as a bit table of fixed size: a term may be in ``terms`` if its bit is set."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    mask = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = terms.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(mask))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in words.collect():
        table[word] = bits
    return table.view(np.uint64)


_SLICES = (
    "slice long, documents long, terms_seen long, doc_ids array<long>, lengths array<long>, "
    "terms array<binary>, ends array<int>, rows binary, times binary"
)


class _Slice:
    """Documents on their way into one row."""

    def __init__(self, table, most):
        self.table, self.known, self.most = table, {}, most
        self.clear()

    def clear(self):
        self.documents, self.postings = [], 0

    def wanted(self, term):
        """Whether the term may be an item's. Answers are kept while there is room."""
        found = self.known.get(term)
        if found is None:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            bit = xxhash.xxh64_intdigest(term, seed=42)
            bit = (bit - (1 << 64) if bit >> 63 else bit) % (64 * len(self.table))
            found = self.known[term] = bool(int(self.table[bit // 64]) >> (bit % 64) & 1)
        return found

    def add(self, doc_id, text):
        terms = terms_of(text)
        times = {term: n for term, n in Counter(terms).items() if self.wanted(term)}
        self.documents.append((doc_id, len(terms), times))
        self.postings += len(times)

    def full(self):
        return len(self.documents) == self.most or self.postings >= SLICE_POSTINGS

    def batch(self, number):
        """Rows count by rising doc_id, null last, so that of equal scores the first rows win."""
        self.documents.sort(key=lambda d: (d[0] is None, d[0] or 0))
        lists = {}
        for row, (_, _, times) in enumerate(self.documents):
            for term, n in times.items():
                held = lists.setdefault(term, ([], []))
                held[0].append(row)
                held[1].append(n)
        joined = [np.concatenate([np.array(x[k], np.int64) for x in lists.values()] or [np.zeros(0)]) for k in (0, 1)]
        lengths = [d[1] for d in self.documents]
        values = [
            number, sum(n > 0 for n in lengths), sum(lengths), [d[0] for d in self.documents], lengths,
            list(lists), np.cumsum([len(x[0]) for x in lists.values()], dtype=int).tolist(),
            joined[0].astype("<u2").tobytes(), joined[1].astype("<u4").tobytes(),
        ]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        kinds += [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _SLICES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _index(table, most):
    def index(batches):
        number, held = TaskContext.get().partitionId() << 33, _Slice(table.value, most)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _as_bytes(batch.column("text"))):
                held.add(doc_id, text)
                if held.full():
                    yield held.batch(number)
                    held.clear()
                    number += 1
        if held.documents:
            yield held.batch(number)

    return index


def _rows(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1).to_pylist()[0]


def _postings(documents, terms_seen, lists):
    """Postings of each slice with their impacts; only numbers and largest ones without ``lists``."""

    def postings(batches):
        for row in _rows(batches):
            if not row["terms"]:
                continue
            rows, times = np.frombuffer(row["rows"], "<u2"), np.frombuffer(row["times"], "<u4").astype(np.int64)
            length = WHOLE - HALF + HALF * np.array(row["lengths"], np.int64) * documents // terms_seen
            impacts = FULL * times // (GROWTH * times + LENGTH * length[rows])
            starts = np.r_[0, row["ends"][:-1]].astype(int)
            columns = [pa.array(row["terms"], pa.binary())]
            if lists:
                parts = list(zip(starts, row["ends"]))
                columns += [pa.array([row["slice"]] * len(parts), pa.int64())]
                columns += [pa.array([x[a:b].astype(k).tobytes() for a, b in parts], pa.binary())
                            for x, k in ((rows, "<u2"), (impacts, "<u4"))]
                names = ["term", "slice", "rows", "impacts"]
            else:
                columns += [pa.array(np.diff(np.r_[0, row["ends"]])), pa.array(np.maximum.reduceat(impacts, starts))]
                names = ["term", "df", "top"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return postings


_BUNDLE = "slice long, block int, item long, rows binary, scores binary, best array<long>"
_LIMITS = "reached long, before long, after long"


def _visit(top, last):
    """An owner's turn: adds its contributions to the bundles of a slice and a block of items.

    ``reached`` is a score that ``top`` documents have, ``before`` and ``after`` are what an item
    can gain from this owner on, and from the ones after it.
    """

    def visit(bundles, postings):
        items, limits = {}, {}
        for row in bundles.to_pylist():
            scores = items[row["item"]] = np.zeros(SLICE_ROWS, np.int64)
            scores[np.frombuffer(row["rows"], "<u2")] = np.frombuffer(row["scores"], "<i8")
            limits[row["item"]] = (row["reached"], row["before"], row["after"])
        start = {item: scores > 0 for item, scores in items.items()}
        nothing = np.zeros(SLICE_ROWS, bool)
        for row in postings.to_pylist():
            rows = np.frombuffer(row["rows"], "<u2")
            gain = row["weight"] * np.frombuffer(row["impacts"], "<u4").astype(np.int64)
            for ask in row["asks"]:
                item = ask["item"]
                limits[item] = (ask["reached"], ask["before"], ask["after"])
                closed = ask["before"] < ask["reached"]
                if item not in items:
                    if closed:
                        continue
                    items[item] = np.zeros(SLICE_ROWS, np.int64)
                items[item][rows] += gain * start.get(item, nothing)[rows] if closed else gain
        group, found = (bundles if len(bundles) else postings).slice(0, 1).to_pylist(), []
        for item, scores in items.items():
            rows = np.flatnonzero(scores)
            scores, (reached, _, after) = scores[rows], limits[item]
            best = -np.sort(-scores)[:top]
            if len(best) == top:
                reached = max(reached, int(best[-1]))
            keep = scores + after >= reached
            rows, scores = rows[keep], scores[keep]
            if last:
                order = np.argsort(-scores, kind="stable")[:top]
                rows, scores = rows[order], scores[order]
            if len(rows):
                found.append((group[0]["slice"], group[0]["block"], item, rows.astype("<u2").tobytes(),
                              scores.astype("<i8").tobytes(), best.tolist()))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        names = [c.split()[0] for c in _BUNDLE.split(", ")]
        columns = list(zip(*found)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return visit


def _spread(batches):
    for row in _rows(batches):
        rows, scores = np.frombuffer(row["rows"], "<u2"), np.frombuffer(row["scores"], "<i8")
        columns = [pa.array(np.full(len(rows), row[c])) for c in ("item", "slice")]
        columns += [pa.array(rows.astype(np.int32)), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "slice", "row", "score"])


def _reached(scores, top):
    """(item, reached): the score of each item's document number ``top``, where it has so many."""
    order = W.partitionBy("item").orderBy(F.desc("score"))
    ranked = scores.select("item", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return ranked.where(F.col("rank") == top).select("item", F.col("score").alias("reached"))


def _owners(terms):
    """Column: the owner of a term, by its weight, so that owners have about as many postings.

    There are no more weights than 1000 ln(2 N + 2), so their sums fit anywhere.
    """
    mass = terms.dropDuplicates(["term"]).groupBy("weight").agg(F.sum("df").alias("df"))
    rows = mass.orderBy(F.desc("weight")).collect()
    total, seen, owner, cuts = sum(r["df"] for r in rows), 0, F.lit(0), 1
    for row in rows:
        if seen * OWNERS >= total * cuts and cuts < OWNERS:
            owner, cuts = owner + (F.col("weight") <= row["weight"]).cast("int"), seen * OWNERS // total + 1
        seen += row["df"]
    return owner


def search(docs, items, top=TOP):
    """The ``top`` documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Returns item_id, rank (from 1), doc_id and score: the highest scores above 0, equal ones by
    smaller doc_id, null last. A term is a run of letters, digits and characters beyond ASCII,
    A-Z in lower case. Its weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``, a document's
    length ``m = 50 + (50 n N) div L``, and each different term of the item adds
    ``weight * ((10**9 tf) div (1000 tf + 20 m))``.

    Null and empty texts have no terms: such documents are never found and not counted, such
    items find nothing. Rows with the same doc_id or item_id are documents and items of their
    own. Other columns are not read; without rows on either side the result is empty.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string"))
    asked = asked.mapInArrow(_item_terms, f"item long, item_id {kind}, terms array<binary>")
    asked = staged(asked, "search-items")
    blocks = -(-asked.count() // ITEM_BLOCK) or 1
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    item_terms = asked.select("item", block, F.explode("terms").alias("term"))
    table = docs.sparkSession.sparkContext.broadcast(_filter(item_terms))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index = staged(texts.mapInArrow(_index(table, SLICE_ROWS), _SLICES), "search-slices")
    documents, seen = index.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms_seen"))).first()
    held = index.select("slice", "lengths", "terms", "ends", "rows", "times")
    counted = held.mapInArrow(_postings(documents, seen, False), "term binary, df long, top long")
    counted = counted.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
    weight = F.floor(WEIGHT * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
    terms = item_terms.join(counted, "term").withColumn("weight", weight).where("weight > 0")
    terms = staged(terms, "search-terms")
    terms = terms.withColumn("owner", _owners(terms)).withColumn("gain", F.col("weight") * F.col("top"))
    lists = held.mapInArrow(_postings(documents, seen, True), "term binary, slice long, rows binary, impacts binary")
    bundles, reached = None, None
    for owner in range(OWNERS):
        later = [F.coalesce(F.sum(F.when(F.col("owner") >= o, F.col("gain"))), F.lit(0)) for o in (owner, owner + 1)]
        limits = terms.groupBy("item").agg(later[0].alias("before"), later[1].alias("after"))
        if reached is None:
            limits = limits.withColumn("reached", F.lit(0).cast("long"))
        else:
            limits = limits.join(reached, "item", "left").fillna(0, ["reached"])
        limits = staged(limits.select("item", "reached", "before", "after"), "search-limits")
        asks = terms.where(F.col("owner") == owner).join(limits, "item")
        asks = asks.groupBy("block", "term", "weight").agg(
            F.collect_list(F.struct("item", "reached", "before", "after")).alias("asks")
        )
        owned = lists.join(asks, "term").drop("term")
        if bundles is None:
            carried = docs.sparkSession.createDataFrame([], f"{_BUNDLE}, {_LIMITS}")
        else:
            carried = bundles.join(limits, "item")
        met = carried.drop("best").groupBy("slice", "block").cogroup(owned.groupBy("slice", "block"))
        bundles = staged(met.applyInArrow(_visit(top, owner == OWNERS - 1), _BUNDLE), "search-bundles")
        if owner < OWNERS - 1:
            reached = _reached(bundles.select("item", F.explode("best").alias("score")), top)
    found = bundles.select("item", "slice", "rows", "scores")
    found = found.mapInArrow(_spread, "item long, slice long, row int, score long")
    least = _reached(found, top)
    found = found.join(least, "item", "left").where("reached is null or score >= reached")
    numbered = index.select("slice", F.posexplode("doc_ids").alias("row", "doc_id"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.join(numbered, ["slice", "row"]).withColumn("rank", F.row_number().over(order))
    best = best.where(F.col("rank") <= top).join(asked.select("item", "item_id"), "item")
    return best.select("item_id", "rank", "doc_id", "score")
