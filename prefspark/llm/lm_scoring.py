"""Language-model scores by context-tree weighting over bytes, trained on a part of the corpus.

A text is scored as its tokens: lower-cased (A-Z) words, joined by single spaces, and one end
byte. Each byte is eight binary decisions, numbered as in a heap (1 for the first bit, 2 and 3
for the second, …), and each decision has a context tree of its own, over the last 0 to DEPTH
bytes. With n0 zeros and n1 ones seen at a node, the Krichevsky-Trofimov block probability is

    E = G(n0 + 1/2) G(n1 + 1/2) / (pi G(n0 + n1 + 1))        (G: the gamma function)

and context-tree weighting gives W = E at depth DEPTH, else W = E/2 + (product of W below)/2.
Counts are frozen after training, so the next bit of a text is predicted by what that rule
implies: a node stops with probability E/2W and then predicts ``(n1 + 1/2) / (n0 + n1 + 1)``;
otherwise the node below it, one byte deeper, is asked.

How it runs: documents are cut into pieces and gathered into blocks of some BLOCK_BYTES. Each
block counts its own runs of DEPTH + 1 bytes, Spark adds them up over all documents, the trees
are summed from the deepest level to the root, one aggregate a level, and the predictions are
handed down again, one join a level. Runs that only texts outside the training part have are
nodes without counts, which change no weight. A block then asks for the runs and words that it
holds and adds up its own texts. The model is a table that grows with the corpus and is never
gathered anywhere; only the FREQUENT runs seen most often go to every task, which need not ask
for them.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefspark.llm.common import slices, staged

DEPTH = 5
BLOCK_BYTES = 16_000_000
# Runs that are sent to every task, at most: 16 bytes each.
FREQUENT = 1 << 19
# Fixed value: what is added to each token's count in the base score.
ADDED = 0.1
# Stands after the last word of a text; no word holds it.
END = b"\n"
# Runs of bytes looked up at once, and answers that are sorted by block at once.
_STEP, _HELD = 1 << 21, 1 << 20

_BLOCKS = (
    "block long, data binary, size long, starts array<int>, rows array<long>, doc_ids array<long>, "
    "learned array<boolean>"
)


class _Block:
    """Pieces of texts on their way into one row, each behind the DEPTH bytes before it."""

    def __init__(self, depth):
        self.depth, self.parts, self.size = depth, [], 0
        self.starts, self.rows, self.doc_ids, self.learned = [], [], [], []

    def add(self, before, piece, row, doc_id, learned):
        self.parts += (before, piece)
        self.starts.append(self.size + self.depth)
        self.size += self.depth + len(piece)
        self.rows.append(row)
        self.doc_ids.append(doc_id)
        self.learned.append(learned)

    def batch(self, number):
        data = pa.compress(b"".join(self.parts), "zstd", asbytes=True)
        columns = [[number], [data], [self.size], [self.starts], [self.rows], [self.doc_ids], [self.learned]]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.list_(pa.bool_())]
        names = ["block", "data", "size", "starts", "rows", "doc_ids", "learned"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _token_texts(texts):
    """Lower-cased words joined by single spaces, as binary, for an Arrow column of texts."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lowered))
    return pc.binary_join(words, " ").cast(pa.binary())


def _pieces(text, limit):
    """The text with its end byte in pieces of at most ``limit`` bytes, cut behind spaces.

    A longer word stays whole.
    """
    low = 0
    while len(text) - low > limit:
        cut = text.rfind(b" ", low, low + limit) + 1 or text.find(b" ", low + limit) + 1
        if not cut:
            break
        yield low, text[low:cut]
        low = cut
    yield low, text[low:] + END


def _gather(depth, limit):
    def gather(batches):
        first = TaskContext.get().partitionId() << 33
        row, number, block = first, first, _Block(depth)
        for batch in slices(batches, "text"):
            texts = _token_texts(batch.column("text")).to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for text, doc_id, learned in zip(texts, ids, batch.column("learned").to_pylist()):
                for low, piece in _pieces(text, limit):
                    if block.size and block.size + len(piece) > limit:
                        yield block.batch(number)
                        number, block = number + 1, _Block(depth)
                    before = (END * depth + text[max(0, low - depth) : low])[-depth:] if depth else b""
                    block.add(before, piece, row, doc_id, learned)
                row += 1
        if block.size:
            yield block.batch(number)

    return gather


class _Read:
    """One block: its bytes, and which piece each byte and each token belongs to."""

    def __init__(self, row, depth, step=_STEP):
        self.number, self.depth, self.step = row["block"], depth, step
        self.data = np.frombuffer(pa.decompress(row["data"], row["size"], "zstd", asbytes=True), np.uint8)
        self.starts = np.array(row["starts"], np.int64)
        self.ends = np.r_[self.starts[1:] - depth, len(self.data)]
        self.learned = np.array(row["learned"], bool)

    def stretches(self):
        """(first piece, last piece + 1) of parts of some ``step`` bytes; a long piece alone.

        A run and the number of its piece in a stretch fit in 64 bits together.
        """
        low, most = 0, 1 << self.spare
        while low < len(self.starts):
            high = int(np.searchsorted(self.starts, self.starts[low] + self.step))
            high = min(high, low + most)
            yield low, high
            low = high

    @property
    def spare(self):
        """Bits that a run of depth + 1 bytes leaves of 64."""
        return 64 - 8 * (self.depth + 1)

    def runs(self, low, high):
        """The runs of depth + 1 bytes that end in pieces low to high, and the pieces' lengths."""
        begin, end = self.starts[low] - self.depth, self.ends[high - 1]
        data = self.data[begin:end]
        runs = data[: len(data) - self.depth].astype(np.uint64)
        for ahead in range(1, self.depth + 1):
            runs <<= np.uint64(8)
            runs |= data[ahead : len(data) - self.depth + ahead]
        if self.depth and high > low + 1:
            # What ends in the bytes before a piece is none of its runs.
            own, starts = np.ones(len(runs), bool), self.starts[low + 1 : high] - self.starts[low]
            for back in range(1, self.depth + 1):
                own[starts - back] = False
            runs = runs[own]
        return runs, self.ends[low:high] - self.starts[low:high]

    def counted(self):
        """(run, times in learned texts), sorted, of all runs of the block."""
        found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in self.stretches():
            runs, lengths = self.runs(low, high)
            learned = np.repeat(self.learned[low:high].astype(np.uint64), lengths)
            marked = np.sort(runs << np.uint64(1) | learned)
            runs, starts = _distinct(marked >> np.uint64(1))
            found.append(runs.astype(np.int64))
            times.append(np.add.reduceat((marked & np.uint64(1)).astype(np.int64), starts))
        return _added(np.concatenate(found), np.concatenate(times))

    def scores(self, known, values):
        """The sum of the values of each piece's runs; ``known`` is sorted and has them all."""
        found = np.zeros(len(self.starts))
        for low, high in self.stretches():
            runs, lengths = self.runs(low, high)
            spare = np.uint64(self.spare)
            pieces = np.repeat(np.arange(high - low, dtype=np.uint64), lengths)
            # Sorted with their pieces, equal runs are looked up once, and in order.
            marked = np.sort(runs << spare | pieces)
            runs, starts = _distinct(marked >> spare)
            each = np.repeat(values[np.searchsorted(known, runs.astype(np.int64))], np.diff(np.r_[starts, len(marked)]))
            pieces = (marked & np.uint64((1 << self.spare) - 1)).astype(np.int64)
            found[low:high] = np.bincount(pieces, each, minlength=high - low)
        return found

    def tokens(self):
        """(distinct tokens, place of each token among them, its piece); the end is a newline."""
        data = self.data.copy()
        pieces = [data[a:b].tobytes() for a, b in zip(self.starts, self.ends)]
        # A space before the end byte makes it a token of its own.
        spaced = [p[:-1].rstrip(b" ") + b" \n" if p.endswith(END) else p.rstrip(b" ") for p in pieces]
        spaced = [p.lstrip(b" ") for p in spaced]
        words = pc.split_pattern(pa.array(spaced, pa.large_binary()), b" ")
        lengths = pc.list_value_length(words).to_numpy()
        coded = pc.dictionary_encode(words.flatten())
        return coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(pieces)), lengths)


def _distinct(values):
    """The different values of a sorted array that is not empty, and where each begins."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], starts


def _added(keys, numbers):
    """Distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    return keys[starts], np.add.reduceat(numbers, starts) if len(keys) else numbers


def _rows(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1).to_pylist()[0]


def _count_runs(depth, step):
    def count(batches):
        for row in _rows(batches):
            runs, times = _Read(row, depth, step).counted()
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(times)], names=["run", "n"])

    return count


def _count_tokens(depth):
    def count(batches):
        for row in _rows(batches):
            block = _Read(row, depth)
            words, place, piece = block.tokens()
            times = np.bincount(place, block.learned[piece], minlength=len(words)).astype(np.int64)
            columns = [pa.array(np.full(len(words), block.number)), pa.array(np.arange(len(words))),
                       words.cast(pa.binary()), pa.array(times)]
            whole = pa.RecordBatch.from_arrays(columns, names=["block", "place", "token", "n"])
            for low in range(0, len(words), 100_000):
                yield whole.slice(low, 100_000)

    return count


def _ask_runs(depth, frequent):
    def ask(batches):
        known, _ = frequent.value
        for row in _rows(batches):
            runs, _ = _Read(row, depth).counted()
            runs = runs[~_among(runs, known)[0]]
            block = pa.array(np.full(len(runs), row["block"]))
            yield pa.RecordBatch.from_arrays([block, pa.array(runs)], names=["block", "run"])

    return ask


def _among(values, known):
    """(which of the values a sorted array has, their places there)."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values, place


_PACKED = "block long, of_token boolean, keys binary, numbers binary, times long, kinds long"


def _pack(key, number, of_token, most):
    """Rows (block, key, number) of a task, sorted by block, in one row for each block.

    A task sorts ``most`` rows or a batch more at once.

    Of tokens, a row without a block adds up how often they are learned, and how many are in
    the first of their blocks.
    """

    def packed(held):
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("block", key, number)]
        order = np.argsort(columns[0], kind="stable")
        blocks, keys, numbers = (c[order] for c in columns)
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
        rows = [
            (int(blocks[a]), of_token, keys[a:b].astype("<i8").tobytes(), numbers[a:b].astype("<f8").tobytes(), None, None)
            for a, b in zip(cuts, cuts[1:])
        ]
        if of_token:
            times = sum(pc.sum(b.column("n")).as_py() for b in held)
            rows.append((None, True, b"", b"", times, sum(pc.sum(b.column("first")).as_py() for b in held)))
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size >= most:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return pack


# Terms of Stirling's series for the logarithm of the gamma function: B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8


def _log_gamma(x):
    """Natural logarithm of the gamma function of an array of positive numbers."""
    below = np.zeros_like(x)
    for step in range(_SHIFT):
        below += np.log(x + step)
    y = x + _SHIFT
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - below


def _flat(column):
    """(row of each item, the items) of an Arrow list column."""
    lengths = pc.list_value_length(column).to_numpy()
    return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy()


def _lists(rows, items, total):
    """An Arrow list column of ``total`` rows from items in the order of their rows."""
    ends = np.cumsum(np.bincount(rows, minlength=total))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(items))


def _parts(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, _CONTEXTS):
            yield batch.slice(low, _CONTEXTS)


# Contexts worked on at once, each with room for the 256 numbers of its decisions.
_CONTEXTS = 4096


def _decisions(byte):
    """The eight (node, bit) of an array of bytes, one after the other."""
    for k in range(8):
        yield (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1


_LEVEL = "context long, nodes array<int>, n0 array<long>, n1 array<long>, weight array<double>, stop array<double>"


def _level(context, there, n0, n1, below):
    """Rows of a level from tables of (context, node); ``below`` is None for the deepest."""
    at = np.nonzero(there)
    n0, n1 = n0[at], n1[at]
    own = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - np.log(np.pi) - _log_gamma(n0 + n1 + 1.0)
    own = np.where(n0 + n1 == 0, 0.0, own)
    weight, stop = own, np.ones_like(own)
    if below is not None:
        weight = np.logaddexp(own, below[at]) - np.log(2)
        stop = np.exp(own - np.log(2) - weight)
    items = (at[1].astype(np.int32), n0.astype(np.int64), n1.astype(np.int64), weight, stop)
    columns = [context, *(_lists(at[0], x, len(context)) for x in items)]
    return pa.RecordBatch.from_arrays(columns, names=["context", "nodes", "n0", "n1", "weight", "stop"])


def _table(key, values, rows):
    return np.bincount(key, values, minlength=rows * 256).reshape(rows, 256)


def _deepest(batches):
    """Decisions of each context from the bytes that follow it and how often they do."""
    for part in _parts(batches):
        rows = part.num_rows
        (row, byte), (_, n) = _flat(part.column("bytes")), _flat(part.column("ns"))
        there, counts = np.zeros((rows, 256)), np.zeros((2, rows, 256))
        for node, bit in _decisions(byte):
            key = row * 256 + node
            there += _table(key, None, rows)
            for value in (0, 1):
                counts[value] += _table(key, n * (bit == value), rows)
        yield _level(part.column("context"), there > 0, *counts, None)


def _above(batches):
    """Sums over the contexts that are one byte longer."""
    for part in _parts(batches):
        row, node = _flat(part.column("nodes"))
        key, rows = row * 256 + node, part.num_rows
        sums = [_table(key, _flat(part.column(c))[1], rows) for c in ("n0", "n1", "weight")]
        yield _level(part.column("context"), _table(key, None, rows) > 0, *sums)


_MIXED = "context long, nodes array<int>, q0 array<double>, q1 array<double>, left array<double>"


def _mix(batches):
    """What the contexts above foretell, and this one in so far as those don't stop."""
    for part in _parts(batches):
        row, node = _flat(part.column("nodes"))
        up_row, up_node = _flat(part.column("up_nodes"))
        above = np.zeros((3, part.num_rows, 256))
        for known, name in zip(above, ("up_q0", "up_q1", "up_left")):
            known[up_row, up_node] = _flat(part.column(name))[1]
        q0, q1, left = above[:, row, node]
        n0, n1, stop = (_flat(part.column(c))[1] for c in ("n0", "n1", "stop"))
        share = left * stop / (n0 + n1 + 1)
        items = (node, q0 + share * (n0 + 0.5), q1 + share * (n1 + 0.5), left * (1 - stop))
        columns = [part.column("context"), *(_lists(row, x, part.num_rows) for x in items)]
        yield pa.RecordBatch.from_arrays(columns, names=["context", "nodes", "q0", "q1", "left"])


def _foretell(batches):
    """log10 of the chance of each byte that follows a context, keyed by the run of both."""
    for part in _parts(batches):
        row, node = _flat(part.column("nodes"))
        chances = np.ones((2, part.num_rows, 256))
        for value, name in enumerate(("q0", "q1")):
            chances[value, row, node] = _flat(part.column(name))[1]
        row, byte = _flat(part.column("bytes"))
        value = sum(np.log10(chances[bit, row, node]) for node, bit in _decisions(byte))
        run = part.column("context").to_numpy()[row] << 8 | byte
        n = _flat(part.column("ns"))[1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (run, n, value)], names=["run", "n", "value"])


def _up(depth):
    """Column: the context without its oldest byte, ``depth`` bytes long."""
    return F.col("context").bitwiseAND(F.lit((1 << 8 * depth) - 1))


def trees(contexts, depth):
    """The context trees, a table for each depth from 0, a row for each context.

    A row lists the decisions seen in its context (at most 255), with their counts.
    """
    levels = [staged(contexts.mapInArrow(_deepest, _LEVEL), "lm-level")]
    for d in range(depth - 1, -1, -1):
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("nodes", "n0", "n1", "weight")]
        above = levels[0].groupBy(_up(d).alias("context")).agg(*joined)
        levels.insert(0, staged(above.mapInArrow(_above, _LEVEL), "lm-level"))
    return levels


def predictions(levels):
    """The chances of the next bit, 0 or 1, for all decisions of the deepest contexts."""
    start = F.col("nodes").alias("up_nodes")
    zero, one = (F.array_repeat(F.lit(v), F.size("nodes")) for v in (0.0, 1.0))
    here = levels[0].select("*", start, zero.alias("up_q0"), zero.alias("up_q1"), one.alias("up_left"))
    mixed = here.mapInArrow(_mix, _MIXED)
    for d, level in enumerate(levels[1:]):
        above = mixed.select(*(F.col(c).alias(f"up_{c}") for c in mixed.columns))
        here = level.drop("weight").withColumn("up_context", _up(d)).join(above, "up_context")
        mixed = here.mapInArrow(_mix, _MIXED)
    return mixed


def run_scores(runs, depth):
    """(run, n, value): log10 of the chance of a run's last byte after the bytes before it."""
    byte = F.col("run").bitwiseAND(F.lit(255)).cast("int")
    contexts = runs.groupBy(F.shiftright("run", 8).alias("context")).agg(
        F.collect_list(F.struct(byte.alias("byte"), "n")).alias("all")
    )
    contexts = staged(contexts.select("context", F.col("all.byte").alias("bytes"), F.col("all.n").alias("ns")), "lm-contexts")
    chances = predictions(trees(contexts, depth))
    return contexts.join(chances, "context").mapInArrow(_foretell, "run long, n long, value double")


def _frequent(scores):
    """The runs seen most often, FREQUENT at most, with their scores: two sorted arrays."""
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = dict(scores.where("n > 0").groupBy(power).count().collect())
    least, rows = 1 << 62, 0
    for power in sorted(sizes, reverse=True):
        rows += sizes[power]
        if rows > FREQUENT:
            break
        least = 1 << power
    found = scores.where(F.col("n") >= least).select("run", "value").toArrow()
    order = np.argsort(found.column("run").to_numpy())
    return tuple(found.column(c).to_numpy()[order] for c in ("run", "value"))


_PIECE = "row long, doc_id long, learned boolean, n_bytes long, n_tokens long, n_known long, base double, score double"


def _add_up(depth, frequent, total, kinds):
    def add_up(blocks, answers):
        def numbers(of_token):
            some = answers.filter(pc.equal(answers.column("of_token"), of_token))
            joined = [b"".join(some.column(c).to_pylist()) for c in ("keys", "numbers")]
            return np.frombuffer(joined[0], "<i8"), np.frombuffer(joined[1], "<f8")

        for row in blocks.to_pylist():
            block, pieces = _Read(row, depth), len(row["rows"])
            runs, scores = (np.concatenate(x) for x in zip(frequent.value, numbers(False)))
            order = np.argsort(runs, kind="stable")
            runs, scores = runs[order], scores[order]
            score = block.scores(runs, scores)
            words, place, piece = block.tokens()
            times, (key, number) = np.zeros(len(words)), numbers(True)
            times[key] = number
            each = np.log10((times + ADDED) / (total + ADDED * (kinds + 1)))
            sums = [np.bincount(piece, w, minlength=pieces) for w in (None, times[place] > 0, each[place])]
            columns = [
                pa.array(row["rows"], pa.int64()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["learned"], pa.bool_()),
                pa.array(block.ends - block.starts),
                pa.array(sums[0].astype(np.int64)),
                pa.array(sums[1].astype(np.int64)),
                pa.array(sums[2]),
                pa.array(score),
            ]
            return pa.Table.from_arrays(columns, names=[c.split()[0] for c in _PIECE.split(", ")])

    return add_up


def score(docs, learned, depth=DEPTH):
    """Scores of all ``docs`` (doc_id, text) under a model of the rows where ``learned`` holds.

    Returns, one row for each row of ``docs``: doc_id, learned, n_bytes (of the tokens, spaces
    and end), n_tokens, n_known, train_tokens, base_score, score (log10 of the text's
    probability) and bits_per_byte. A token is a word or the end of a text; n_known counts
    those that learned texts have, base_score is their smoothed unigram score.

    A null text is an empty one, which has an end. A null ``learned`` is false. Rows with the
    same doc_id are texts of their own, equal texts get equal scores. Texts of any length are
    cut between words, each piece knowing the bytes before it. Other columns are not read. An
    empty table gives no rows; with nothing to learn from, each bit has a chance of one half.
    """
    if not 0 <= depth <= 6:
        raise ValueError("a run of depth + 1 bytes has to fit in 56 bits: depth is 0 to 6")
    learned = F.coalesce(learned, F.lit(False)).alias("learned")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), learned)
    blocks = staged(texts.mapInArrow(_gather(depth, BLOCK_BYTES), _BLOCKS), "lm-blocks")
    counted = blocks.mapInArrow(_count_runs(depth, _STEP), "run long, n long")
    runs = staged(counted.groupBy("run").agg(F.sum("n").alias("n")), "lm-runs")
    scores = staged(run_scores(runs, depth), "lm-scores")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(scores))
    asked = blocks.mapInArrow(_ask_runs(depth, frequent), "block long, run long").join(scores, "run")
    asked = asked.mapInArrow(_pack("run", "value", False, _HELD), _PACKED)
    shape = "block long, place long, token binary, n long"
    same = W.partitionBy("token")
    known = blocks.mapInArrow(_count_tokens(depth), shape).select(
        "block", "place", "n", F.sum("n").over(same).alias("times"), F.min("block").over(same).alias("_first")
    )
    known = known.where("times > 0").withColumn("first", (F.col("block") == F.col("_first")).cast("int"))
    known = known.select("block", "place", "n", "times", "first").mapInArrow(_pack("place", "times", True, _HELD), _PACKED)
    known = staged(known, "lm-tokens")
    total, kinds = known.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("times", "kinds"))).first()
    answers = asked.unionByName(known.where("block is not null")).select("block", "of_token", "keys", "numbers")
    pieces = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    pieces = pieces.applyInArrow(_add_up(depth, frequent, total, kinds), _PIECE)
    whole = pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("learned").alias("learned"),
        *(F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base", "score")),
    )
    return whole.select(
        "doc_id",
        "learned",
        "n_bytes",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (-F.col("score") / F.col("n_bytes") / F.log10(F.lit(2.0))).alias("bits_per_byte"),
    )
