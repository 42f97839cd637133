"""The search against plain counting, with slices, blocks and owners of every size."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from prefspark.llm import lexical_search as S

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m, score = 100 - 50 + 50 * sum(c.values()) * n // total, 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        found += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(scored[:top], 1)]
    return sorted(found, key=repr)


def collected(spark, docs, items, top):
    found = S.search(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def some_texts(seed, n, words=60):
    """Zipf words, repeated texts, marks and capitals between them."""
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, words + 1)
    known = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(words)]
    texts = [
        "".join(f"{w}{s}" for w, s in zip(rng.choice(known, k, p=weights / weights.sum()), rng.choice(list(" ,.\n-"), k)))
        for k in rng.integers(0, 30, n)
    ]
    return [texts[i if i % 5 else 5] for i in range(n)]


SIZES = [(4096, 256, 4, 1 << 23, 5), (7, 3, 3, 64, 4), (16, 256, 1, 1 << 23, 3), (40, 5, 6, 1 << 10, 50)]


@pytest.mark.parametrize("slice_rows, item_block, owners, bits, top", SIZES)
def test_against_plain_counting(spark, monkeypatch, slice_rows, item_block, owners, bits, top):
    for name, value in (("SLICE_ROWS", slice_rows), ("ITEM_BLOCK", item_block), ("OWNERS", owners), ("FILTER_BITS", bits)):
        monkeypatch.setattr(S, name, value)
    texts = some_texts(top, 160)
    docs = list(zip(np.random.default_rng(0).permutation(160).tolist(), texts))
    items = list(enumerate(some_texts(top + 100, 11)))
    assert collected(spark, docs, items, top) == brute(docs, items, top)


def test_pruning_drops_documents_but_no_result(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 50)
    kept, staged = [], S.staged
    monkeypatch.setattr(S, "staged", lambda df, name: kept.append((name, staged(df, name))) or kept[-1][1])
    texts = some_texts(1, 400, words=200)
    docs, items = list(enumerate(texts)), [(0, texts[7]), (1, texts[8]), (2, "w0é w1")]
    assert collected(spark, docs, items, 3) == brute(docs, items, 3)
    carried = [sum(len(r["rows"]) // 2 for r in t.collect()) for name, t in kept if name == "search-bundles"]
    assert carried[-2] < 0.5 * 3 * 400


def test_odd_texts_and_ids(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "a b"), (4, "A b"), (4, "a B"), (5, "ÀB ab"), (6, "a " * 50_000), (7, "É1")]
    items = [(1, None), (2, ""), (3, "a A a b"), (3, "b"), (None, "é1 Éx"), (9, "É1"), (10, "unknown")]
    assert collected(spark, docs, items, 4) == brute(docs, items, 4) != []


def test_no_documents_no_items_and_clashing_columns(spark):
    assert collected(spark, [], [(1, "a")], 3) == [] == collected(spark, [(1, "a")], [], 3)
    docs, items = [(i, t) for i, t in enumerate(some_texts(2, 30))], [(1, "w1 w2"), (2, "w0é")]
    extra = ["*", "1 as item", "2 as slice", "3 as rank", "4 as score", "5 as term", "6 as item_id"]
    found = S.search(spark.createDataFrame(docs, DOC).selectExpr(*extra), spark.createDataFrame(items, ITEM).selectExpr(*extra[:-1], "7 as doc_id"), 3)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items, 3)
