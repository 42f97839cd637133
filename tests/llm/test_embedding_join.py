"""The range join and its components against all pairs, in cells of every size."""

import numpy as np
import pyarrow as pa
import pytest

from prefspark.llm import embedding_join as E
from prefspark.llm.components import components

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, cosine):
    units = [None if v is None else np.array(v, float) / np.linalg.norm(v) for v in vectors]
    n = len(ids)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
              and units[i] @ units[j] >= cosine] for i in range(n)]
    least = list(ids)
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least[i] = min(ids[j] for j in seen)
    return {i: (len(l), c, i == c) for i, l, c in zip(ids, links, least)}


def some_vectors(seed):
    """Lone vectors, tight groups, chains along an arc, equal and scaled copies."""
    rng = np.random.default_rng(seed)
    vectors = list(rng.normal(size=(60, 8)))
    for _ in range(6):
        centre = rng.normal(size=8)
        vectors += [centre + rng.normal(size=8) * rng.choice([0.01, 0.2, 0.35]) for _ in range(15)]
    vectors += [np.r_[np.cos(a), np.sin(a), np.zeros(6)] for a in np.linspace(0, 3, 25)]
    vectors += [vectors[0], vectors[0], 3 * vectors[1], vectors[70]]
    return [v.astype(np.float32) for v in vectors]


@pytest.mark.parametrize("block, stream, pivots", [(16, 1 << 17, 2048), (7, 40, 2048), (1024, 64, 2048), (16, 50, 3)])
def test_against_all_pairs(spark, monkeypatch, block, stream, pivots):
    for name, value in (("BLOCK", block), ("STREAM", stream), ("MAX_PIVOTS", pivots)):
        monkeypatch.setattr(E, name, value)
    vectors = some_vectors(block)
    order = np.random.default_rng(1).permutation(len(vectors)).tolist()
    rows = [(i, vectors[k].tolist(), 0) for i, k in enumerate(order)]
    found = E.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    expected = brute(list(range(len(order))), [vectors[k] for k in order], 0.9)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == expected


def test_vectors_that_link_with_nothing(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]),
        (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as kept")
    found = sorted((tuple(r) for r in E.near_duplicates(table).collect()), key=repr)
    linked = [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 3, 7, False)]
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)] + [(None, 0, None, True)]
    assert found == sorted(linked + alone, key=repr)


@pytest.mark.parametrize("kind, tile, turned", [("float", 512, 512), ("double", 8, 512), ("double", 5, 0)])
def test_more_dimensions_than_are_bounded_first(spark, monkeypatch, kind, tile, turned):
    for name, value in (("BLOCK", 40), ("TILE", tile), ("MAX_TURNED", turned)):
        monkeypatch.setattr(E, name, value)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(60, 40)) * np.linspace(3, 0.1, 40)
    vectors = [c + rng.normal(size=40) * s for c in centres for s in (0, 0.1, 0.2, 0.3)]
    vectors += [centres[0] + rng.normal(size=40) * 0.01 for _ in range(90)]
    vectors = [v.astype(np.float32) if kind == "float" else v * 1e200 for v in vectors]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = E.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    expected = brute(list(range(len(rows))), [v.astype(float) / np.abs(v).max() for v in vectors], 0.9)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == expected


def test_equal_vectors_of_different_cells(spark, monkeypatch, conf):
    conf(execution__arrow__maxRecordsPerBatch="5")
    steady = E._assign

    def unsteady(pivots, width):
        assign = steady(pivots, width)

        def other(batches):
            for number, batch in enumerate(assign(batches)):
                place = batch.schema.get_field_index("second")
                second = pa.array([number % 3] * len(batch), pa.int32())
                yield batch.set_column(place, "second", second)

        return other

    monkeypatch.setattr(E, "_assign", unsteady)
    vectors = [np.array(v) for v in np.eye(6)] * 20 + [3 * v for v in np.eye(6)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    found = E.near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(found) == len(rows)
    expected = brute(list(range(len(rows))), vectors, 0.9)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == expected


def test_vectors_without_clusters_are_not_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    vectors = np.random.default_rng(5).normal(size=(4000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")

    def written():
        context = spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty()
        no_quantiles = context._gateway.new_array(context._jvm.double, 0)
        every = context._jvm.java.util.ArrayList()
        found = context._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, every)
        stages = [found.apply(i) for i in range(found.size())]
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in stages}

    before = written()
    assert E.near_duplicates(table).count() == len(vectors)
    moved = sum(n for stage, n in written().items() if stage not in before)
    assert moved < 6 * vectors.nbytes


def test_no_vectors(spark):
    assert E.near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_components_of_random_links(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 300, (220, 2)).tolist() + [[i, i + 1] for i in range(400, 460)] + [[5, 5], [900, 901]]
    roots = list(range(1000))
    for _ in range(1000):
        for a, b in pairs:
            roots[a] = roots[b] = min(roots[a], roots[b])
        if all(roots[a] == roots[b] for a, b in pairs):
            break
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(found) == {x for p in pairs for x in p}
    groups = {}
    for i, root in found.items():
        groups.setdefault(root, set()).add(roots[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({roots[i] for i in found})
