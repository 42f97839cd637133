"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they are read; only a short row for each piece is shuffled.
Pieces are dealt at random into groups of some GROUP_PIECES, each of which is packed on its
own: groups have the same mix of lengths, and all but a few of a group's sequences are full,
so the split costs at most a few sequences in a group. No group grows with the input.
"""

import math
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from prefspark.llm.common import slices, staged
from prefspark.llm.tokens import byte_bpe

GROUP_PIECES = 65_536
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, under a segment tree of their counts.

    A leaf holds the bins with exactly that much room. ``tightest`` walks up from the wanted
    leaf to the first subtree on the right that has a bin, and down to its leftmost leaf:
    logarithmic in the capacity for each document.
    """

    def __init__(self, capacity):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.bins = [[] for _ in range(capacity + 1)]

    def add(self, room, number):
        self.bins[room].append(number)
        self._count(room, 1)

    def take(self, room):
        self._count(room, -1)
        return self.bins[room].pop()

    def tightest(self, need):
        """The smallest room of an open bin that is at least ``need``, or None."""
        node, counts = self.leaves + need, self.counts
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not counts[node]:
                    node += 1
        return node - self.leaves

    def _count(self, room, change):
        node = self.leaves + room
        while node:
            self.counts[node] += change
            node >>= 1


def best_fit(lengths, capacity):
    """(bin, offset) of each length, for lengths in decreasing order."""
    open_bins, used, placed = OpenBins(capacity), 0, []
    for length in lengths:
        room = open_bins.tightest(length)
        if room is None:
            number, room, used = used, capacity, used + 1
        else:
            number = open_bins.take(room)
        placed.append((number, capacity - room))
        if room > length:
            open_bins.add(room - length, number)
    return placed


def token_pieces(docs, tokenizer, capacity=1024, end_id=2, with_ids=False):
    """One row for each piece of each document: ``PIECE``, ``row`` and, if wanted, ``ids``.

    A document is its ids and ``end_id``. Longer ones are cut so that all pieces but the
    first are full. ``row`` numbers the pieces of the table; equal documents differ in it.
    """
    end = int(end_id).to_bytes(4, "little")
    schema = PIECE + ", row long" + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def tokenise(batches):
        from pyspark import TaskContext

        row, encode = TaskContext.get().partitionId() << 40, byte_bpe(tokenizer).encode_all
        for part in slices(batches, "text"):
            columns = part.to_pydict()
            out = {name: [] for name in names}
            for doc_id, ids in zip(columns["doc_id"], encode(columns["text"])):
                ids += end
                count = len(ids) // 4
                pieces = -(-count // capacity)
                first = count - (pieces - 1) * capacity
                for piece in range(pieces):
                    start = first + (piece - 1) * capacity if piece else 0
                    length = capacity if piece else first
                    cut = ids[4 * start : 4 * (start + length)]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(cut))
                    out["row"].append(row)
                    if with_ids:
                        out["ids"].append(pa.array(memoryview(cut).cast("I"), pa.int32()))
                    row += 1
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, schema)


def _batch(columns):
    kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
    arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def pack(pieces, capacity=1024):
    """Adds ``sequence_id`` and ``offset`` to pieces that are written tables, by best fit.

    Pieces need ``row`` and ``length``; other columns are kept. No piece is longer than the
    capacity. Sequence ids are unique, not consecutive.
    """
    groups = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")
    columns = [f for f in pieces.schema if f.name != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)

    def place(key, pdf):
        pdf = pdf.drop(columns="_group").sort_values(["length", "row"], ascending=[False, True])
        placed = best_fit(pdf["length"].tolist(), capacity)
        where = pd.DataFrame(placed, columns=["sequence_id", "offset"], index=pdf.index)
        where["sequence_id"] += key[0] << 32
        return pd.concat([pdf, where], axis=1)

    narrow = pieces.select(*(f.name for f in columns), group.alias("_group"))
    schema += ", sequence_id long, offset long"
    return narrow.groupBy("_group").applyInPandas(place, schema)


def pack_documents(docs, tokenizer, capacity=1024, end_id=2):
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null text counts as empty and still has its end token; equal documents are
    packed as often as they occur; a null doc_id is kept; an empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity).drop("row")


def sequences(docs, tokenizer, capacity=1024, end_id=2):
    """The packed sequences with their ids: sequence_id, ids array<int>.

    A sequence has at most ``capacity`` tokens, so collecting its pieces is bounded.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces")
    placed = pack(pieces, capacity).select("row", "sequence_id", "offset")
    parts = placed.join(pieces.select("row", "ids"), "row")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
