import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefspark.operators import filters, pairing, replay
from prefspark.operators.joins import join_grouped
from prefspark.plans import flows

GOOD, OTHER, NO = "good answer one", "good answer two", "negative answer"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(params=["hash", "exact"])
def mode(request):
    return request.param


def test_ids_that_parse_to_an_excluded_number_are_dropped(spark):
    ids = ["3", "3.0", " 3 ", "1e0", "abc", None, "3d", "12", "0x3", ""]
    df = spark.createDataFrame([(i,) for i in ids], "concept_id string")
    kept = [r.concept_id for r in filters.exclude_concept_ids(df).collect()]
    assert kept == ["abc", None, "3d", "12", "0x3", ""]


def test_null_genre_is_dropped(spark):
    df = spark.createDataFrame([("text",), (None,), ("code",)], "concept_genre string")
    assert [r[0] for r in filters.keep_genre(df).collect()] == ["text"]


def test_null_prompt_or_concept_founds_no_pair(triples, mode):
    df = triples(
        (None, GOOD, "c", "positive"),
        (None, NO, "c", "negative"),
        ("a", GOOD, None, "positive"),
        ("a", NO, "c", "negative"),
    )
    assert pairing.build_pairs(df, mode).count() == 0


def test_negative_without_concept_counts(triples, mode):
    df = triples(("a", GOOD, "c", "positive"), ("a", NO, None, "negative"))
    assert rows(pairing.build_pairs(df, mode), "chosen", "rejected") == [(GOOD, NO)]


@pytest.mark.parametrize("first", [None, "short"])
def test_no_second_choice(triples, mode, first):
    df = triples(
        ("a", first, "c", "positive"), ("a", GOOD, "c", "positive"), ("a", NO, "c", "negative")
    )
    assert pairing.build_pairs(df, mode).count() == 0


@pytest.mark.parametrize("bad", [None, "short"])
def test_null_or_short_negative_drops_the_pair(triples, mode, bad):
    df = triples(("a", GOOD, "c", "positive"), ("a", bad, "c", "negative"))
    assert pairing.build_pairs(df, mode).count() == 0


def test_length_counts_code_points(triples, mode):
    df = triples(("a", "\U0001f600" * 10, "c", "positive"), ("a", NO, "c", "negative"))
    assert pairing.build_pairs(df, mode).count() == 1
    df = triples(("a", "\U0001f600" * 9, "c", "positive"), ("a", NO, "c", "negative"))
    assert pairing.build_pairs(df, mode).count() == 0


def test_concepts_of_a_prompt_share_the_rejected_text(triples, mode):
    pool = [("a", f"{NO} {i}", None, "negative") for i in range(7)]
    df = triples(("a", GOOD, "c", "positive"), ("a", OTHER, "d", "positive"), *pool)
    assert pairing.build_pairs(df, mode).select("rejected").distinct().count() == 1


def test_first_positive_follows_the_order_column(triples, mode):
    df = triples(
        ("a", GOOD, "c", "positive"), ("a", OTHER, "c", "positive"), ("a", NO, "c", "negative")
    )
    assert rows(pairing.build_pairs(df, mode), "chosen") == [(GOOD,)]
    turned = df.withColumn("ord", -F.col("ord"))
    assert rows(pairing.build_pairs(turned, mode), "chosen") == [(OTHER,)]


def test_other_categories_are_ignored(triples, mode):
    df = triples(("a", GOOD, "c", "other"), ("a", NO, "c", "negative"), ("a", NO, "c", None))
    assert pairing.build_pairs(df, mode).count() == 0


def test_prompt_keeps_its_parts_unstripped(triples):
    df = triples((" a\n", GOOD, "\tc ", "positive"), (" a\n", NO, "c", "negative"))
    prompt = pairing.build_pairs(df).first().prompt
    assert prompt == "### Instruction\n a\n\n\n### Steering Direction\n\tc "


def test_minimum_length_of_the_prompt(triples):
    df = triples(("a", GOOD * 9, "c", "positive"), ("a", NO * 9, "c", "negative"))
    length = len("### Instruction\na\n\n### Steering Direction\nc")
    assert pairing.build_pairs(df, min_len=length).count() == 1
    assert pairing.build_pairs(df, min_len=length + 1).count() == 0


def test_order_column_is_required(triples):
    with pytest.raises(ValueError, match="ord"):
        pairing.build_pairs(triples().drop("ord"))


def test_unknown_mode(triples):
    with pytest.raises(ValueError, match="mode"):
        pairing.build_pairs(triples(), "best")


# The position drawn from 1, 2, 3, … rows under seed 44.
DRAWN = [
    0, 1, 2, 3, 0, 0, 5, 5, 6, 2, 8, 5, 7, 5, 5, 5,
    14, 16, 16, 15, 15, 16, 22, 18, 19, 8, 8, 8, 8, 23, 21, 21,
]


def test_drawn_positions(spark):
    sizes = spark.range(1, 33).select(F.col("id").alias("pool_size"))
    drawn = {r.pool_size: r.drawn for r in pairing.drawn_positions(sizes).collect()}
    assert [drawn[n] for n in range(1, 33)] == DRAWN


@pytest.mark.parametrize("n", [1, 2, 33, 64, 1000, 12_345])
def test_drawn_position_is_that_of_pandas(n):
    frame = pd.DataFrame({"place": range(n)})
    drawn = frame.sample(n=1, random_state=pairing.NEGATIVE_SEED).place.iloc[0]
    assert replay.first_of_shuffle(n, pairing.NEGATIVE_SEED) == drawn


@pytest.mark.parametrize("steps", [1, 7, 64])
def test_drawn_position_does_not_hang_on_the_chunks(monkeypatch, steps):
    monkeypatch.setattr(replay, "STEPS", steps)
    for n in [*range(1, 70), 255, 256, 257, 1023, 1025]:
        for seed in (0, 44):
            whole = np.random.RandomState(seed).permutation(n)[0]
            assert replay.first_of_shuffle(n, seed) == whole, (n, seed)


def test_exact_sample_takes_the_drawn_row(triples):
    pool = [("a", f"{NO} {i}", None, "negative") for i in range(9)]
    df = triples(("a", GOOD, "c", "positive"), *pool)
    assert rows(pairing.build_pairs(df, "exact"), "rejected") == [(f"{NO} 6",)]


def test_pairing_refuses_a_row_without_its_order(spark):
    rows = [("a", GOOD, "c", "positive", 1), ("a", NO, None, "negative", None)]
    df = spark.createDataFrame(rows, "input string, output string, output_concept string, category string, ord long")
    for mode in ("hash", "exact"):
        with pytest.raises(Exception, match="must not be null"):
            pairing.build_pairs(df, mode).collect()


@pytest.fixture
def event_triples(spark):
    from checks import fixtures

    return fixtures.triples(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_result_does_not_depend_on_partitions_or_row_order(
    spark, conf, event_triples, mode, partitions
):
    expected = rows(pairing.build_pairs(event_triples, mode), "input", "output_concept",
                    "chosen", "rejected")
    conf(shuffle__partitions=partitions, adaptive__enabled=False)
    shuffled = event_triples.orderBy(F.rand(7)).repartition(3)
    got = rows(pairing.build_pairs(shuffled, mode), "input", "output_concept", "chosen",
               "rejected")
    assert got == expected


def test_exact_pairs_and_splits_equal_brute_force(event_triples):
    """Plain dictionaries filled in row order, and the generators themselves."""
    firsts, pools = {}, {}
    for r in sorted(event_triples.collect(), key=lambda r: r.ord):
        if r.category == "positive":
            firsts.setdefault((r.input, r.output_concept), r.output)
        elif r.category == "negative":
            pools.setdefault(r.input, []).append(r.output)
    picks = {
        who: pd.Series(pool).sample(1, random_state=44).iloc[0] for who, pool in pools.items()
    }
    expected = {
        key: (text, picks[key[0]]) for key, text in sorted(firsts.items()) if key[0] in picks
    }
    concepts = list({concept: None for _, concept in expected})
    place = {concepts[i]: p for p, i in enumerate(np.random.default_rng(42).permutation(95))}
    got = flows.flow_b(event_triples, "exact").collect()
    assert {(r.input, r.output_concept): (r.chosen, r.rejected) for r in got} == expected
    for r in got:
        p = place[r.output_concept]
        assert r.split == ("train" if p < 71 else "valid" if p < 80 else "test")


def test_pairs_are_sound(event_triples, mode):
    pairs = pairing.build_pairs(event_triples, mode)
    assert pairs.groupBy("input", "output_concept").count().where("count > 1").isEmpty()
    pool = pairing.negatives(event_triples).select("input", F.col("output").alias("rejected"))
    assert pairs.join(pool, ["input", "rejected"], "left_anti").isEmpty()


@pytest.mark.parametrize("flow", [flows.flow_b, flows.flow_a, pairing.build_pairs])
def test_hash_mode_reads_every_row_once(spark, tmp_path, rows_read, event_triples, flow):
    path = str(tmp_path / "triples")
    event_triples.write.parquet(path)
    table = spark.read.parquet(path)
    run = flow(table).collect if flow is pairing.build_pairs else lambda: flow(table)
    assert rows_read(run) == table.count()


def small_partitions(conf):
    """Treat tables of a few kilobytes the way large ones are treated."""
    conf(
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        adaptive__advisoryPartitionSizeInBytes="20k",
        adaptive__coalescePartitions__enabled="false",
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        shuffle__partitions="16",
    )


@pytest.mark.parametrize("how, n", [("inner", 12_000), ("left_semi", 12_000)])
def test_hot_key_is_split_when_joined_with_its_groups(spark, conf, how, n):
    small_partitions(conf)
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50))
        .alias("key"),
        F.md5(F.col("id").cast("string")).alias("text"),
    )
    grouped = df.groupBy("key").agg(F.count("*").alias("n"))
    joined = join_grouped(df, grouped, "key", how)
    counted = joined.groupBy(F.substring("text", 1, 1)).count()
    assert sum(r["count"] for r in counted.collect()) == n
    assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()


def test_hot_prompt_is_split_by_the_join(spark, conf):
    """A third of all pairs under one prompt: adaptive execution splits its partition."""
    small_partitions(conf)
    n = 12_000
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0
    prompt = F.when(hot, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50))
    concept = F.concat(F.lit("c"), "id")
    positive = ids.select(
        prompt.alias("input"), F.concat(F.lit("positive text "), "id").alias("output"),
        concept.alias("output_concept"), F.lit("positive").alias("category"),
        F.col("id").alias("ord"),
    )
    negative = positive.withColumn("category", F.lit("negative")).withColumn(
        "ord", F.col("ord") + n
    )
    pairs = pairing.build_pairs(positive.unionByName(negative))
    assert pairs.count() == n
    counted = pairs.groupBy(F.length("chosen")).count()
    counted.collect()
    assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
