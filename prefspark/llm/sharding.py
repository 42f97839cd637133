"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into CELLS cells. Each shard has virtual nodes in some of them, and owns the
cells from each of these back to the previous virtual node. Every shard may hold its even
part of the rows, rounded. Rows over it leave their shard and go on clockwise, each to a
virtual node with room, first come, first served; so no more rows move than must.

Which rows go where is worked out from the number of rows in each cell: tables of some CELLS
rows, whatever the size of the input. The rows themselves are shuffled once, by cell.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefspark.llm.common import staged

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 64
# Rows that one task makes out of equal ones.
SPAN = 1 << 16


def cell_of(hashed):
    return F.shiftrightunsigned(hashed, 64 - CELL_BITS).cast("int")


def _before(column, window):
    """Sum of a column over the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def ring(spark, shards, virtual_nodes=VIRTUAL_NODES):
    """(cell, owner, node): who owns each cell; ``node`` is the shard whose node lies in it."""
    numbers = spark.range(shards * virtual_nodes)
    shard = (F.col("id") / virtual_nodes).cast("int")
    nodes = (
        numbers.select(shard.alias("node"), F.xxhash64(F.lit("node"), "id").alias("hash"))
        .groupBy(cell_of(F.col("hash")).alias("cell"))
        .agg(F.min("node").alias("node"))
    )
    onward = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, W.currentRow)
    anywhere = W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    next_node = F.last("node", ignorenulls=True).over(onward)
    first_node = F.first("node", ignorenulls=True).over(anywhere)
    return (
        spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
        .join(nodes, "cell", "left")
        .select("cell", F.coalesce(next_node, first_node).alias("owner"), "node")
    )


def quotas(owned, shards):
    """(owner, excess, room): the even part of each shard against the rows in its own cells.

    The parts that are one larger go to the shards with the most rows.
    """
    every = owned.sparkSession.range(shards).select(F.col("id").cast("int").alias("owner"))
    home = every.join(owned.groupBy("owner").agg(F.sum("rows").alias("home")), "owner", "left")
    home = home.select("owner", F.coalesce("home", F.lit(0)).alias("home"))
    rank = F.row_number().over(W.orderBy(F.desc("home"), "owner"))
    all_rows = F.sum("home").over(W.partitionBy())
    even = F.expr(f"all_rows div {shards}") + (F.col("rank") <= F.col("all_rows") % shards).cast("int")
    return home.withColumns({"rank": rank, "all_rows": all_rows}).select(
        "owner",
        "home",
        F.greatest(F.col("home") - even, F.lit(0)).alias("excess"),
        F.greatest(even - F.col("home"), F.lit(0)).alias("room"),
    )


def _share(part, done, whole):
    """``part * done / whole`` rounded down, exact for any longs."""
    wide = "cast({} as decimal(19, 0))"
    return f"({wide.format(part)} * {wide.format(done)}) div {whole}"


def flows(owned, shards):
    """For each cell the rows that leave it (``out``) and the room of its node (``room``).

    A shard's excess is spread over its cells by their rows, its room over its nodes.
    """
    limits = quotas(owned, shards)
    by_owner = W.partitionBy("owner").orderBy("cell")
    leaving = owned.join(limits, "owner").withColumn("_done", _before("rows", by_owner))
    out = F.expr(f"{_share('excess', '_done + rows', 'home')} - {_share('excess', '_done', 'home')}")
    leaving = leaving.select(
        "cell", "owner", "rows", F.when(F.col("home") > 0, out).otherwise(0).alias("out")
    )
    by_node = W.partitionBy("node").orderBy("cell")
    nodes = owned.where("node is not null").select(
        "cell",
        F.col("node").alias("owner"),
        F.row_number().over(by_node).alias("_nth"),
        F.count("*").over(W.partitionBy("node")).alias("_nodes"),
    )
    room = F.expr(f"{_share('room', '_nth', '_nodes')} - {_share('room', '_nth - 1', '_nodes')}")
    rooms = nodes.join(limits, "owner").select(
        "cell", F.col("owner").alias("node"), room.alias("room")
    )
    joined = leaving.join(rooms, "cell", "left")
    return joined.withColumn("room", F.coalesce("room", F.lit(0)))


def _taken_rooms(cells):
    """(lap, cell, node, taken): where the rows that go clockwise find room, in ring order.

    On the first lap a queue builds up and is served by the rooms it passes; what is left at
    the end of the ring goes on from its start and takes the rooms still free.
    """
    along = W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    back = W.orderBy("cell")
    lap = cells.withColumns({"_in": F.sum("out").over(along), "_rooms": F.sum("room").over(along)})
    lowest = F.least(F.lit(0), F.min(F.col("_in") - F.col("_rooms")).over(along))
    lap = lap.withColumn("_served", F.col("_rooms") + lowest)
    lap = lap.withColumns(
        {
            "_taken": F.col("_served") - F.lag("_served", 1, 0).over(back),
            "_queue": F.sum("out").over(W.partitionBy()) - F.max("_served").over(W.partitionBy()),
        }
    )
    lap = lap.withColumn("_free", F.sum(F.col("room") - F.col("_taken")).over(along))
    lap = lap.withColumn("_later", F.least("_queue", "_free"))
    lap = lap.withColumn("_again", F.col("_later") - F.lag("_later", 1, 0).over(back))
    first = lap.select(F.lit(1).alias("lap"), "cell", "node", F.col("_taken").alias("taken"))
    second = lap.select(F.lit(2).alias("lap"), "cell", "node", F.col("_again").alias("taken"))
    return first.unionByName(second).where("taken > 0")


def moves(cells):
    """(cell, low, high, shard): rows number low to high - 1 leaving the cell go to the shard.

    The k-th row to leave, in ring order, takes the k-th place taken. The two numberings are
    laid over one another, not joined.
    """
    leaving = cells.where("out > 0").withColumn("_from", _before("out", W.orderBy("cell")))
    rooms = _taken_rooms(cells).withColumn("_from", _before("taken", W.orderBy("lap", "cell")))
    nowhere = F.lit(None).cast("int").alias("shard")
    marks = leaving.select("_from", "cell", F.col("_from").alias("_start"), nowhere)
    marks = marks.unionByName(
        rooms.select("_from", F.col("node").alias("shard")), allowMissingColumns=True
    )
    marks = marks.groupBy("_from").agg(
        F.max("cell").alias("cell"), F.max("_start").alias("_start"), F.max("shard").alias("shard")
    )
    so_far = W.orderBy("_from").rowsBetween(W.unboundedPreceding, W.currentRow)
    current = [F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("cell", "_start", "shard")]
    total = leaving.agg(F.sum("out").alias("_total"))
    ends = F.lead("_from").over(W.orderBy("_from")).alias("_next")
    laid = marks.select("_from", ends, *current, total.scalar().alias("_total"))
    return laid.select(
        "cell",
        (F.col("_from") - F.col("_start")).alias("low"),
        (F.coalesce("_next", "_total") - F.col("_start")).alias("high"),
        "shard",
    )


def placement(counts, shards, virtual_nodes=VIRTUAL_NODES):
    """(cell, low, high, shard, slot): where rows number low to high - 1 of a cell go.

    ``counts`` is (cell, rows). ``slot`` is the place of the first of them in its shard.
    """
    spark = counts.sparkSession
    owned = ring(spark, shards, virtual_nodes).join(counts, "cell", "left")
    owned = staged(owned.withColumn("rows", F.coalesce("rows", F.lit(0))), "ring")
    cells = staged(flows(owned, shards), "ring-flows")
    stay = F.col("rows") - F.col("out")
    staying = cells.select(
        "cell", F.lit(0).alias("low"), stay.alias("high"), F.col("owner").alias("shard")
    )
    going = moves(cells).join(cells.select("cell", stay.alias("_stay")), "cell")
    going = going.select(
        "cell",
        (F.col("low") + F.col("_stay")).alias("low"),
        (F.col("high") + F.col("_stay")).alias("high"),
        "shard",
    )
    parts = staying.unionByName(going).where("high > low")
    slot = _before(F.col("high") - F.col("low"), W.partitionBy("shard").orderBy("cell", "low"))
    return parts.withColumn("slot", slot)


def shard(docs, shards, virtual_nodes=VIRTUAL_NODES):
    """Places ``docs`` (doc_id, text) on ``shards`` shards; row counts differ by one at most.

    Returns doc_id, size, text_crc32, shard and slot, the place in the shard, gapless from 0.
    The size is the UTF-8 bytes of the text, none for null, plus 16. The hash of doc_id sets
    the place on the ring, that of size and text where doc_id is null. Repeated rows are all
    placed; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        own.alias("_own"),
    )
    hashed = F.coalesce("_own", F.xxhash64("size", "text_crc32"))
    rows = rows.select("doc_id", "size", "text_crc32", hashed.alias("_hash"))
    rows = rows.withColumn("cell", cell_of(F.col("_hash")))
    counts = rows.groupBy("cell").agg(F.count("*").alias("rows"))
    parts = placement(counts, shards, virtual_nodes)
    listed = F.collect_list(F.struct("low", "high", "shard", "slot")).alias("_parts")
    by_cell = staged(parts.groupBy("cell").agg(listed), "ring-parts")
    # Rows that are equal in these can stand for one another: they are counted, and get numbers
    # by the range, so that however many there are, a cell puts one row of them in order.
    same = ["_hash", "doc_id", "size", "text_crc32"]
    equal = rows.groupBy("cell", *same).agg(F.count("*").alias("_copies"))
    equal = equal.withColumn("_from", _before("_copies", W.partitionBy("cell").orderBy(*same)))
    equal = equal.withColumn("_to", F.col("_from") + F.col("_copies"))
    meets = lambda part: (part["low"] < F.col("_to")) & (part["high"] > F.col("_from"))
    placed = equal.join(by_cell, "cell").withColumn("_part", F.explode(F.filter("_parts", meets)))
    placed = placed.select(
        *same[1:],
        "_part.shard",
        (F.col("_part.slot") - F.col("_part.low")).alias("_shift"),
        F.greatest("_from", "_part.low").alias("_from"),
        F.least("_to", "_part.high").alias("_to"),
    )
    few = F.col("_to") - F.col("_from") <= SPAN
    spans = F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(SPAN).cast("long")))
    many = placed.where(~few).withColumn("_from", spans)
    many = many.withColumn("_to", F.least("_to", F.col("_from") + SPAN)).repartition("shard", "_shift", "_from")
    number = F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))
    every = placed.where(few).unionByName(many).withColumn("_nth", number)
    slot = (F.col("_shift") + F.col("_nth")).alias("slot")
    return every.select("doc_id", "size", "text_crc32", "shard", slot)
