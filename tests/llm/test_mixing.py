"""Targets against a plain water-filling, the mixture against its own slots and blocks."""

import random
from collections import Counter

import numpy as np

from prefspark.llm import mixing as M


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: M.WEIGHTS[i % len(M.WEIGHTS)] for i, s in enumerate(names)}
    free, left, target = set(names), sum(sizes.values()), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def table(docs, rows):
    return docs([(d, t, None, s) for d, t, s in rows]).withColumnRenamed("lang", "taken")


def some_rows(seed, sources=("b", "a", "é", "Z", None, "tiny")):
    random.seed(seed)
    rows = []
    for i in range(150):
        source = random.choice(sources[:5] + sources[:1] * 6)
        rows.append((i, " ".join(["w"] * random.randint(0, 90)), source))
    return rows + [(900, "one two", "tiny"), (901, None, "a"), (901, None, "a"), (None, "x y z", None), (902, "w " * 5000, "b")]


def test_targets_and_amounts(docs):
    rows = some_rows(1)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    goal = plain_targets(sizes)
    found = M.taken_words(table(docs, rows), block_words=8).collect()
    assert len(found) == len(rows)
    by_size = Counter()
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        by_size[r["target"], r["source_size"]] += r["taken"]
    for source, target in goal.items():
        taken = sum(n for (t, s), n in by_size.items() if abs(t - target) < 1e-6 and s == sizes[source])
        same = [s for s in goal if abs(goal[s] - target) < 1e-6 and sizes[s] == sizes[source]]
        assert abs(taken - len(same) * target) <= 8 * len(same), source
    again = M.taken_words(table(docs, rows).repartition(5), block_words=8).collect()
    key = lambda r: repr((r["doc_id"], r["size"], r["taken"]))
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_slots_fill_quotas_and_permutations_are_complete(spark, docs):
    rows = M.numbered(table(docs, some_rows(2)))
    documents = M.staged(M.sized(rows), "t")
    goal = M.staged(M.goals(documents, 4, M.WEIGHTS, 3), "t")
    slots = M.slots(goal, seed=3, shard_slots=50).toPandas()
    quota = {r["_sid"]: r["_quota"] for r in goal.collect()}
    for sid, own in slots.groupby("_sid"):
        assert sorted(own["nth"]) == list(range(quota[sid]))
    assert slots.groupby("shard").size().iloc[:-1].eq(50).all()
    assert (slots.groupby("shard")["_sid"].value_counts().unstack().std() > 0).any()
    order = M.permutation(goal, seed=3).toPandas()
    for sid, own in order.groupby("_sid"):
        assert sorted(own["index"]) == sorted(own["place"]) == list(range(len(own)))
        assert len(own) < 20 or (own["index"] != own["place"]).mean() > 0.8


def test_blocks_hold_every_word_once(docs):
    rows = M.staged(M.numbered(table(docs, some_rows(5))), "t")
    documents = M.staged(M.sized(rows), "t")
    goal = M.staged(M.goals(documents, 8, M.WEIGHTS, 3), "t")
    parts = M.block_parts(documents, goal, 8).toPandas()
    full = parts.groupby(["_sid", "index"])["words"].sum()
    for sid, own in full.groupby("_sid"):
        assert (own.sort_index().iloc[:-1] == 8).all() and own.max() <= 8
    by_doc = parts.groupby("_row")["words"].sum().to_dict()
    assert by_doc == {r["_row"]: r["size"] for r in documents.collect() if r["size"]}


def test_mixed_documents_are_pieces_of_texts(docs):
    rows = some_rows(7)
    source = table(docs, rows)
    taken = {}
    for r in M.taken_words(source, block_words=16).where("doc_id is not null").collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    mixed = M.mixed_documents(source, block_words=16)
    assert mixed.columns == source.columns
    got = Counter()
    texts = {d: " ".join((t or "").split()) for d, t, _ in rows}
    for r in mixed.where("doc_id is not null").collect():
        assert " ".join(r["text"].split()) in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(r["text"].split())
    assert got == {d: n for d, n in taken.items() if n}


def test_nothing_to_mix(docs):
    assert M.taken_words(table(docs, [])).count() == 0
    only_empty = M.taken_words(table(docs, [(1, None, "a"), (2, " ", "b")])).collect()
    assert [r["taken"] for r in only_empty] == [0, 0]
    assert M.mixed_documents(table(docs, [])).count() == 0


def test_counts_of_shards_are_those_of_multinomial_draws(spark):
    """Over many shards the counts of a source spread as its share of each draw says."""
    shares, slots_each, shards = (0.1, 0.2, 0.3, 0.4), 100, 400
    total = slots_each * shards
    rows, low = [], 0.0
    for sid, share in enumerate(shares):
        high = 2.0 if sid == 3 else low + share
        rows.append((sid, (False, f"s{sid}"), total, share * total, total, round(share * total), low, high))
        low = high
    shape = "_sid int, _source struct<missing: boolean, name: string>, source_size long, target double, _blocks long, _quota long, _low double, _high double"
    found = M.slots(M.staged(spark.createDataFrame(rows, shape), "t"), seed=11, shard_slots=slots_each).toPandas()
    counts = found.groupby(["shard", "_sid"]).size().unstack(fill_value=0).to_numpy()
    assert counts.shape == (shards, 4) and (counts.sum(axis=1) == slots_each).all()
    expected = np.array(shares) * slots_each
    assert np.allclose(counts.sum(axis=0), np.array(shares) * total, atol=1)
    # Variances n p (1 - p) and covariances -n p q, as far as 400 shards tell.
    covariance = np.cov(counts.T)
    exact = slots_each * (np.diag(shares) - np.outer(shares, shares))
    assert np.allclose(covariance, exact, rtol=0.3, atol=1.5), covariance
    statistic = ((counts - expected) ** 2 / expected).sum()
    freedom = 3 * shards
    assert abs(statistic - freedom) < 5 * (2 * freedom) ** 0.5
