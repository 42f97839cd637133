import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prefspark.operators import splits


def pairs_of(spark, concepts):
    rows = [(f"p{i % 3}", c) for i, c in enumerate(concepts)]
    return spark.createDataFrame(rows, "input string, output_concept string")


# Permutations of n concepts under seed 42, and sizes of the first two splits.
PERMUTATIONS = {
    4: [3, 2, 1, 0],
    10: [5, 6, 0, 7, 3, 2, 4, 9, 1, 8],
    20: [15, 9, 14, 7, 12, 10, 6, 19, 3, 0, 16, 5, 11, 18, 2, 4, 17, 1, 13, 8],
}
SIZES = {4: (3, 0), 10: (7, 1), 20: (15, 2)}


@pytest.mark.parametrize("n", [4, 10, 20])
def test_permutation(spark, n):
    one = spark.createDataFrame([(n,)], "n long")
    rows = sorted(splits.permutation(one).collect(), key=lambda r: r["rank"])
    assert [r.appearance for r in rows] == PERMUTATIONS[n]


@pytest.mark.parametrize("n", [4, 10, 20])
def test_exact_order_starts_from_the_appearance_in_sorted_pairs(spark, n):
    # Concept c appears first under the prompt of its number.
    rows = [(f"p{i:02d}", f"c{(i * 7) % n:02d}") for i in range(n)] + [("p99", "c00")]
    pairs = spark.createDataFrame(rows, "input string, output_concept string")
    appearing = list(dict.fromkeys(c for _, c in sorted(rows)))
    expected = [appearing[i] for i in PERMUTATIONS[n]]
    ranked = splits.concept_rank(pairs, "exact").collect()
    assert [r.output_concept for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    got = splits.split_concepts(pairs, "exact").collect()
    train, valid = SIZES[n]
    names = ["train"] * train + ["valid"] * valid + ["test"] * (n - train - valid)
    assert {r.output_concept: r.split for r in got} == dict(zip(expected, names))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(min_size=1, max_size=6), min_size=1, max_size=40))
def test_hash_split_is_sound(spark, concepts):
    concepts = [c.encode("utf-8", "ignore").decode() or "c" for c in concepts]
    pairs = pairs_of(spark, concepts + concepts[:5])
    split = splits.split_pairs(pairs)
    assert split.count() == pairs.count()
    assert splits.split_leakage(split).isEmpty()
    assert splits.split_coverage(split, pairs).isEmpty()
    sizes = {r.split: r.n_concepts for r in splits.split_stats(split).collect()}
    n = len(set(concepts))
    assert sizes.get("train", 0) == int(0.75 * n)
    assert sizes.get("valid", 0) == int(0.10 * n)
    assert sizes["all"] == n


def test_cut_points_equal_the_concept_table(spark):
    pairs = pairs_of(spark, [f"c{i}" for i in range(333)] * 2)
    by_cut = {(r.output_concept, r.split) for r in splits.split_pairs(pairs).collect()}
    by_rank = {(r.output_concept, r.split) for r in splits.split_concepts(pairs).collect()}
    assert by_cut == by_rank


@pytest.mark.parametrize("mode", ["hash", "exact"])
def test_a_single_concept_tests(spark, mode):
    split = splits.split_pairs(pairs_of(spark, ["only"]), mode)
    assert [r.split for r in split.collect()] == ["test"]


def test_no_pairs_no_split(spark):
    assert splits.split_pairs(pairs_of(spark, ["c"]).limit(0)).count() == 0


def test_hash_split_leaves_the_pairs_where_they_are(spark, tmp_path):
    """The main plan is a scan and a projection; all shuffles are in the subquery."""
    path = str(tmp_path / "pairs")
    pairs_of(spark, [f"c{i}" for i in range(40)]).write.parquet(path)
    split = splits.split_pairs(spark.read.parquet(path))
    plan = split._jdf.queryExecution().sparkPlan()
    operators = []
    while plan.children().size():
        operators.append(plan.nodeName())
        assert plan.children().size() == 1
        plan = plan.children().head()
    assert operators == ["Project"] and plan.nodeName().startswith("Scan parquet")


def test_audits_find_a_leak_and_gaps(spark):
    split = spark.createDataFrame(
        [("a", "train"), ("a", "test"), ("b", "train"), ("x", "test")],
        "output_concept string, split string",
    )
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "output_concept string")
    assert [tuple(r) for r in splits.split_leakage(split).collect()] == [("a", 2)]
    found = {tuple(r) for r in splits.split_coverage(split, universe).collect()}
    assert found == {("c", "missing"), ("x", "unexpected")}


def test_stats_keep_a_null_split_apart_from_the_total(spark):
    split = spark.createDataFrame(
        [("a", "train"), ("b", None)], "output_concept string, split string"
    )
    got = {(r.split, r.n_pairs) for r in splits.split_stats(split).collect()}
    assert got == {("train", 1), (None, 1), ("all", 2)}


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        splits.split_pairs(pairs_of(spark, ["c"]), "best")
