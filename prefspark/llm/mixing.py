"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, its documents one after the other, are packed into blocks of a fixed
length. Each slot of each output shard draws a source, so the source counts of a shard are
one multinomial draw. Draws beyond a source's quota go to the sources that fell short of
theirs, so the totals are the targets, to a block. The j-th slot that a source gets takes
block ``p(j)`` of the source, where p runs through all its blocks in pseudorandom order before
any comes again. Slots and blocks are joined by the index of the block.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefspark.llm.common import set_aside, split_words, staged

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 8
# Weights of the sources in the order of their names, repeating; fixed values.
WEIGHTS = (1, 2, 3)
# No source is taken more often than this.
MAX_EPOCHS = 3
# What is numbered within a source is numbered within so many buckets of it.
BUCKETS = 4096
# Slots find the interval that their number lies in by way of so many cells.
CELLS = 1024


def _before(column, window):
    """Sum of a column over the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def targets(sizes, weights=WEIGHTS, max_epochs=MAX_EPOCHS):
    """(_sid, _source, source_size, target) for (_source, source_size), a row for each source.

    Weights follow the code-point order of the names, the null source last. All words are
    shared by weight; a source stops at ``max_epochs`` times its size, and what it leaves is
    shared by weight among the others. With the sources in the order in which they stop, the
    ones that do are the longest prefix in which each one's even share is above its stop.
    """
    name = W.orderBy(F.col("_source.missing"), F.col("_source.name"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weight = F.element_at(cycle, (F.col("_sid") - 1) % len(weights) + 1)
    named = sizes.withColumn("_sid", F.row_number().over(name))
    weighed = named.select("_sid", "_source", "source_size", weight.alias("_weight"))
    stop = (F.lit(float(max_epochs)) * F.col("source_size")).alias("_stop")
    stops = weighed.select("*", stop)
    order = W.orderBy(F.col("_stop") / F.col("_weight"), "_sid")
    every = W.partitionBy()
    shared = stops.select(
        "*",
        (F.sum("source_size").over(every) - _before("_stop", order)).alias("_left"),
        (F.sum("_weight").over(every) - _before("_weight", order)).alias("_weights"),
        F.row_number().over(order).alias("_place"),
    )
    level = F.col("_left") / F.col("_weights")
    stopped = F.col("_weight") * level >= F.col("_stop")
    first_free = F.min(F.when(~stopped, F.col("_place"))).over(every)
    free_level = F.max(F.when(F.col("_place") == first_free, level)).over(every)
    target = F.when(
        F.coalesce(F.col("_place") < first_free, F.lit(True)), F.col("_stop")
    ).otherwise(F.col("_weight") * free_level)
    return shared.withColumn("target", target).select("_sid", "_source", "source_size", "target")


def _numbered(df, keys, bucket, order):
    """Adds ``_nth``: the number of the row from 0 in its group ``keys``, by bucket and order."""
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_rows"))
    earlier = _before("_rows", W.partitionBy(*keys).orderBy(bucket))
    bases = counts.select(*keys, bucket, earlier.alias("_base"))
    inside = F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)) - 1
    joined = df.withColumn("_inside", inside).join(bases.hint("merge"), [*keys, bucket])
    return joined.withColumn("_nth", F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def _located(points, value, intervals, width):
    """Joins each point with the interval (_low, _high) that its ``value`` lies in."""
    cell = lambda bound: F.floor(bound / width).cast("long")
    cells = F.sequence(cell(F.col("_low")), cell(F.col("_high")))
    spread = intervals.where("_high > _low").withColumn("_cell", F.explode(cells))
    inside = (F.col("_low") <= F.col(value)) & (F.col(value) < F.col("_high"))
    placed = points.withColumn("_cell", cell(F.col(value)))
    return placed.join(spread, "_cell").where(inside).drop("_cell")


def sized(docs, source="source"):
    """A short row for each of ``docs``: its size, its source and a hash that orders it there."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.struct(
        F.col(source).isNull().alias("missing"), F.coalesce(F.col(source), F.lit("")).alias("name")
    )
    return docs.select(
        "_row",
        "doc_id",
        F.size(split_words(text)).cast("long").alias("size"),
        name.alias("_source"),
        F.xxhash64("doc_id", F.crc32(text)).alias("_hash"),
    )


def goals(documents, block_words, weights, max_epochs):
    """``targets`` of the sources, with their blocks and their ``_quota`` of slots.

    The quota is the target in blocks, rounded, and at most ``max_epochs`` times all blocks.
    ``_low`` to ``_high`` is the part of the unit interval in which a draw goes to the source.
    """
    sizes = documents.groupBy("_source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.least(
        F.round(F.try_divide(F.col("target") * F.col("_blocks"), "source_size")),
        max_epochs * F.col("_blocks"),
    )
    upto = W.orderBy("_sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    high = F.try_divide(F.sum("target").over(upto), F.sum("target").over(W.partitionBy()))
    found = targets(sizes, weights, max_epochs).withColumn("_blocks", blocks)
    found = found.withColumn("_quota", F.coalesce(quota, F.lit(0)).cast("long"))
    found = found.withColumn("_high", high)
    # Draws are below 1: the last source takes what rounding leaves, and so does no other.
    low = F.lag("_high", 1, 0.0).over(W.orderBy("_sid"))
    last = F.col("_sid") == F.max("_sid").over(W.partitionBy())
    return found.select(
        "_sid", "_source", "source_size", "target", "_blocks", "_quota",
        low.alias("_low"), F.when(last, F.lit(2.0)).otherwise(F.col("_high")).alias("_high"),
    )


def slots(goal, seed=SEED, shard_slots=SHARD_SLOTS):
    """(shard, slot, _sid, nth): the source of each slot and the number of the slot in it.

    ``goal`` is a written table of ``goals``. Each slot draws on its own. A source's draws are
    numbered in a pseudorandom order of the slots; those beyond its quota, spread over all
    shards by that, fill the quotas of the sources that drew too few.
    """
    total = goal.agg(F.sum("_quota")).first()[0] or 0
    number = goal.sparkSession.range(total).select(
        "id",
        F.xxhash64(F.lit(seed), F.lit("order"), "id").alias("_hash"),
        (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("_u"),
    )
    parts = goal.select("_sid", "_low", "_high")
    drawn = _located(number, "_u", parts, 1 / CELLS).select("id", "_hash", "_sid")
    drawn = drawn.withColumn("_bucket", F.shiftrightunsigned("_hash", 48))
    drawn = staged(_numbered(drawn, ["_sid"], "_bucket", ["_hash", "id"]), "draws")
    got = drawn.groupBy("_sid").agg(F.count("*").alias("_got"))
    got = goal.select("_sid", "_quota").join(got, "_sid", "left")
    got = got.select("_sid", "_quota", F.coalesce("_got", F.lit(0)).alias("_got"))
    over = F.greatest(F.col("_got") - F.col("_quota"), F.lit(0))
    short = F.greatest(F.col("_quota") - F.col("_got"), F.lit(0))
    order = W.orderBy("_sid")
    got = staged(
        got.select(
            "*",
            _before(over, order).alias("_over"),
            _before(short, order).alias("_low"),
            short.alias("_lack"),
        ),
        "quotas",
    )
    whole = drawn.join(got.select("_sid", "_quota", "_over"), "_sid")
    own = whole.where("_nth < _quota").select("id", "_sid", F.col("_nth").alias("nth"))
    surplus = (F.col("_over") + F.col("_nth") - F.col("_quota")).alias("_surplus")
    moved = whole.where("_nth >= _quota").select("id", surplus)
    lacking = got.select(
        F.col("_sid"), "_got", "_low", (F.col("_low") + F.col("_lack")).alias("_high")
    )
    width = max(1, (got.agg(F.sum("_lack")).first()[0] or 0) // CELLS)
    nth = F.col("_got") + F.col("_surplus") - F.col("_low")
    moved = _located(moved, "_surplus", lacking, width).select("id", "_sid", nth.alias("nth"))
    shard = F.expr(f"id div {shard_slots}").alias("shard")
    return own.unionByName(moved).select(shard, (F.col("id") % shard_slots).alias("slot"), "_sid", "nth")


def permutation(goal, seed=SEED):
    """(_sid, index, place): each block of each source and its place in a pseudorandom order."""
    spans = F.sequence(F.lit(0).cast("long"), F.expr(f"(_blocks - 1) div {1 << 16}"))
    low = F.col("_part") * (1 << 16)
    high = F.least(low + (1 << 16), F.col("_blocks")) - 1
    blocks = (
        goal.where("_blocks > 0")
        .select("_sid", "_blocks", F.explode(spans).alias("_part"))
        .repartition("_sid", "_part")
        .select("_sid", F.explode(F.sequence(low, high)).alias("index"))
    )
    hashed = blocks.withColumn("_hash", F.xxhash64(F.lit(seed), "_sid", "index"))
    hashed = hashed.withColumn("_bucket", F.shiftrightunsigned("_hash", 52))
    placed = _numbered(hashed, ["_sid"], "_bucket", ["_hash", "index"])
    return placed.select("_sid", "index", F.col("_nth").alias("place"))


def block_parts(documents, goal, block_words):
    """(_row, _sid, index, low, words): the words of a document that each block holds.

    ``low`` is where they start in the document.
    """
    own = documents.join(goal.select("_sid", "_source"), "_source").where("size > 0")
    own = own.withColumn("_bucket", F.shiftrightunsigned("_hash", 52))
    sums = own.groupBy("_sid", "_bucket").agg(F.sum("size").alias("_words"))
    bases = sums.select(
        "_sid", "_bucket", _before("_words", W.partitionBy("_sid").orderBy("_bucket")).alias("_base")
    )
    order = W.partitionBy("_sid", "_bucket").orderBy("_hash", "doc_id", "_row")
    # Sorted by source and bucket already: no side of the documents' size is broadcast.
    own = own.withColumn("_inside", _before("size", order)).join(bases.hint("merge"), ["_sid", "_bucket"])
    start = F.col("_base") + F.col("_inside")
    first, last = F.expr(f"_start div {block_words}"), F.expr(f"(_start + size - 1) div {block_words}")
    own = own.select("_row", "_sid", "size", start.alias("_start"))
    own = own.select("*", F.explode(F.sequence(first, last)).alias("index"))
    low = F.greatest(F.col("index") * block_words - F.col("_start"), F.lit(0))
    high = F.least((F.col("index") + 1) * block_words - F.col("_start"), F.col("size"))
    return own.select("_row", "_sid", "index", low.alias("low"), (high - low).alias("words"))


def mix(docs, source="source", block_words=BLOCK_WORDS, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED):
    """The mixture of ``docs``: (documents, goal, taken), written tables and a DataFrame.

    ``docs`` need doc_id, text, the source column and ``_row``, a number of their own.
    ``documents`` are ``sized``, ``goal`` is ``goals``, and ``taken`` has a row for each part
    of a document in a block that is taken: _row, low, words and ``times``, how often.
    A null text has no words and is not taken; rows without a source are a source of their
    own; repeated rows count each; an empty table gives empty tables.
    """
    documents = staged(sized(docs, source), "mix-documents")
    goal = staged(goals(documents, block_words, weights, max_epochs), "mix-goals")
    place = (F.col("nth") % F.col("_blocks")).alias("place")
    drawn = slots(goal, seed).join(goal.select("_sid", "_blocks"), "_sid")
    times = drawn.groupBy("_sid", place).agg(F.count("*").alias("times"))
    # The planner doesn't see how many rows an exploded sequence has, and would broadcast them.
    blocks = permutation(goal, seed).join(times.hint("merge"), ["_sid", "place"])
    parts = block_parts(documents, goal, block_words)
    taken = parts.join(blocks.hint("merge"), ["_sid", "index"])
    taken = taken.select("_row", "low", "words", "times")
    return documents, goal, taken


def numbered(docs):
    """``docs`` with ``_row``; to be written before it is used twice."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def taken_words(docs, source="source", **options):
    """For each of ``docs``: doc_id, size, source_size, target and ``taken`` words of it."""
    documents, goal, taken = mix(numbered(docs), source, **options)
    sums = taken.groupBy("_row").agg(F.sum(F.col("words") * F.col("times")).alias("_taken"))
    own = goal.select("_source", "source_size", "target")
    return documents.join(own, "_source").join(sums.hint("merge"), "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs, source="source", **options):
    """The mixture as rows with the columns of ``docs``: a row for each part of a document
    that is taken, as often as it is. Whole documents keep their text; of others the words
    are joined by single spaces, and ``n_chars`` is set to the length where there is one.
    """
    docs, whole = set_aside(docs, "doc_id", "text", "n_chars", source)
    rows = staged(numbered(docs), "mix-texts")
    _, _, taken = mix(rows, source, **options)
    parts = taken.groupBy("_row").agg(F.collect_list(F.struct("low", "words", "times")).alias("_parts"))
    split = rows.join(parts.hint("merge"), "_row").withColumn("_words", split_words(F.col("text")))
    split = split.withColumn("_part", F.explode("_parts"))
    joined = F.array_join(F.slice("_words", F.col("_part.low") + 1, F.col("_part.words")), " ")
    text = F.when(F.col("_part.words") == F.size("_words"), F.col("text")).otherwise(joined)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_part.times")))
    out = split.select("*", text.alias("_text")).select(
        *(F.col(f"`{c}`") for c in docs.columns), "_text", again.alias("_time")
    )
    out = out.withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole(out)
