"""Near-duplicates against all pairs of exact sets; sketches against what they estimate."""

import random

import numpy as np
import pytest

from prefspark.llm import near_dup as N


def plain_set(text, words=5):
    parts = (text or "").encode().lower().split()
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def brute(rows, percent):
    sets = [plain_set(t) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    n, found = len(rows), []
    links = [[j for j in range(n) if rows[i][0] is not None and rows[j][0] is not None and linked(sets[i], sets[j])] for i in range(n)]
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = doc_id if doc_id is None else min(rows[j][0] for j in seen)
        found.append((doc_id, len(sets[i]), component, doc_id is None or doc_id == component))
    return sorted(found, key=repr)


def some_rows(seed):
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 5000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(random.choice([4, 6, 9, 30, 80, 200]))]
        for _ in range(random.randint(1, 9)):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                copy[random.randrange(len(copy))] = word()
            if random.random() < 0.3:
                base = copy  # chains: ends need not be alike
            rows.append(" ".join(copy))
    random.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "One two"), (504, "one  TWO"), (505, "É one"), (506, "é one")]
    return rows + [(7, rows[7][1]), (None, rows[3][1]), (None, None), (600, "same " * 3000), (601, "same " * 40)]


@pytest.mark.parametrize("percent, seed", [(85, 1), (80, 2)])
def test_against_all_pairs(docs, percent, seed):
    rows = some_rows(seed)
    table = docs(rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "gid")
    found = N.near_duplicates(table, percent)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, percent)


def test_pairs_that_the_first_of_a_bucket_does_not_link(docs, monkeypatch):
    """A document in the middle: both ends link to it, not to one another."""
    base = [f"w{i}" for i in range(60)]
    one, two = list(base), list(base)
    one[10] = "x"
    two[40] = "y"
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(base))]
    assert sorted(map(tuple, N.near_duplicates(docs(rows), 80).collect())) == brute(rows, 80)


def test_sketches_and_bands():
    rng = np.random.default_rng(5)
    settings = N.Settings(85)
    assert 1 - (1 - 0.85**N.BAND_ROWS) ** settings.bands > 1 - N.MISS
    for shared, own in ((850, 75), (950, 25)):  # similarities of 0.85 and 0.95
        common = N.mixed(rng.integers(0, 1 << 62, shared, np.uint64))
        sets = []
        for _ in range(40):
            more = N.mixed(rng.integers(0, 1 << 62, own, np.uint64))
            sets.append(np.unique(np.concatenate([common, more])))
        samples = N.min_hashes(sets, settings.samples)
        bits = np.unpackbits(N.odd_sketches(samples).view(np.uint8), axis=1)
        flipped = [(bits[i] ^ bits[i + 1]).sum() for i in range(39)]
        assert max(flipped) <= settings.most_flipped
        estimate = -N.SKETCH_BITS / 2 * np.log(1 - 2 * np.array(flipped) / N.SKETCH_BITS)
        similar = 1 - estimate.mean() / (2 * settings.samples)
        assert abs(similar - shared / (shared + 2 * own)) < 0.04
        bands = N.bands_of(samples)
        assert all((bands[i] == bands[i + 1]).any() for i in range(39))
    far = [np.unique(N.mixed(rng.integers(0, 1 << 62, 1000, np.uint64))) for _ in range(20)]
    bits = np.unpackbits(N.odd_sketches(N.min_hashes(far, settings.samples)).view(np.uint8), axis=1)
    assert min((bits[i] ^ bits[i + 1]).sum() for i in range(19)) > settings.most_flipped


def test_no_documents(docs):
    assert N.near_duplicates(docs([]), 85).count() == 0
