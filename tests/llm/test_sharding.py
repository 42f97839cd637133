"""The ring's laws, and the flows against a row-by-row walk around the ring."""

import random
import zlib
from collections import Counter

import pytest

from prefspark.llm import sharding as S


def place(docs, rows, shards):
    return S.shard(docs(rows).withColumnRenamed("source", "shard"), shards).collect()


def laws(rows, found, shards):
    expected = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    key = lambda r: (r["doc_id"], r["size"], r["text_crc32"])
    assert sorted(map(key, found), key=repr) == sorted(expected, key=repr)
    counts = Counter(r["shard"] for r in found)
    assert set(counts) <= set(range(shards))
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))


def test_even_shards_with_odd_rows(docs):
    rows = [(i, "text " * (i % 7)) for i in range(503)] + [(None, "a"), (None, None), (7, "again"), (7, "again")]
    laws(rows, place(docs, rows, 9), 9)


def test_one_hot_key(docs):
    rows = [(1, "same")] * 200 + [(i, "x") for i in range(300)]
    laws(rows, place(docs, rows, 7), 7)


@pytest.mark.parametrize("span", [4, 1 << 16])
def test_hot_rows_without_an_id_are_dealt_in_spans(docs, monkeypatch, span):
    monkeypatch.setattr(S, "SPAN", span)
    rows = [(None, None)] * 150 + [(None, "same")] * 40 + [(5, "same")] * 30 + [(i, "x") for i in range(250)]
    laws(rows, place(docs, rows, 6), 6)


def test_few_rows_and_none(docs):
    rows = [(i, None) for i in range(3)]
    laws(rows, place(docs, rows, 5), 5)
    assert place(docs, [], 5) == []


def test_one_more_shard_moves_few(docs):
    rows = [(i, "x") for i in range(4000)]
    before = {r["doc_id"]: r["shard"] for r in place(docs, rows, 8)}
    after = {r["doc_id"]: r["shard"] for r in place(docs, rows, 9)}
    assert sum(before[i] != after[i] for i in before) < 4000 * 0.35


def test_moves_go_clockwise_to_the_next_room(spark):
    """Overflow is served first come, first served by the rooms that it passes."""
    random.seed(4)
    for case in range(4):
        cells = []
        for c in range(12):
            out = random.choice([0, 0, 1, 3])
            cells.append([c, out, 0, c % 3])
        for _ in range(sum(c[1] for c in cells)):
            random.choice(cells)[2] += 1
        queue, free, expected = [], [c[2] for c in cells], Counter()
        for lap in range(2):
            for i, (cell, out, _, node) in enumerate(cells):
                queue += [cell] * out if lap == 0 else []
                while queue and free[i]:
                    free[i] -= 1
                    expected[queue.pop(0), node] += 1
        table = spark.createDataFrame(cells, "cell int, out long, room long, node int")
        found = Counter()
        for r in S.moves(table).collect():
            found[r["cell"], r["shard"]] += r["high"] - r["low"]
        assert found == expected and not queue, case
