import hashlib
from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefspark.operators import ranking, sampling


@pytest.mark.parametrize("bits", [1, 2, 5, 20])
def test_group_ordinal_equals_a_window(spark, monkeypatch, bits):
    monkeypatch.setattr(ranking, "BLOCK_BITS", bits)
    # One group holds a third of the rows; the order has gaps and negative numbers.
    df = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40))
        .alias("key"),
        (F.col("id") * F.col("id") - 5000).alias("ord"),
    )
    w = W.partitionBy("key")
    expected = df.select(
        "key", "ord", (F.row_number().over(w.orderBy("ord")) - 1).cast("long").alias("ordinal"),
        F.count("*").over(w).alias("n"),
    )
    got = ranking.with_group_ordinal(df, ["key"], "ord", "ordinal", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    bare = ranking.with_group_ordinal(df, ["key"], "ord", "ordinal").collect()
    assert sorted(map(tuple, bare)) == sorted(map(tuple, expected.drop("n").collect()))


def test_group_ordinal_refuses_a_null_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "key string, ord long")
    with pytest.raises(Exception, match="ord must not be null"):
        ranking.with_group_ordinal(df, ["key"], "ord").collect()


def test_hash_rank_equals_a_window(spark):
    df = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("key"))
    w = W.orderBy(F.md5(F.concat(F.lit("42|"), "key")), "key")
    expected = {r.key: r.rank for r in df.withColumn("rank", F.row_number().over(w) - 1).collect()}
    got = ranking.with_hash_rank(df, "key", 42).collect()
    assert {r.key: r["rank"] for r in got} == expected
    assert {r.n for r in got} == {5000}


@pytest.mark.parametrize("partitions", [1, 7])
def test_sorted_ordinal_numbers_the_whole_table(spark, conf, partitions):
    conf(shuffle__partitions=partitions)
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("a"), "id")
    got = ranking.with_sorted_ordinal(df, ["a", "id"]).collect()
    assert [r.ordinal for r in sorted(got, key=lambda r: r.a)] == list(range(3000))


@pytest.mark.parametrize("count", [None, 0, -1, 10, 11])
def test_sample_leaves_a_small_table_alone(spark, count):
    df = spark.range(10)
    assert sorted(r.id for r in sampling.limit_sample(df, count).collect()) == list(range(10))


def test_sample_takes_exactly_count_and_is_seeded(spark):
    df = spark.range(1000).withColumn("t", F.md5(F.col("id").cast("string")))
    first = {r.id for r in sampling.limit_sample(df, 100, 1, ["id"]).collect()}
    again = {r.id for r in sampling.limit_sample(df.repartition(7), 100, 1, ["id"]).collect()}
    other = {r.id for r in sampling.limit_sample(df, 100, 2, ["id"]).collect()}
    assert len(first) == len(other) == 100
    assert first == again and first != other


def test_sample_without_ids_hashes_the_row(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 3 + [("b",)], "t string")
    assert sampling.limit_sample(df, 4).count() == 4


@pytest.mark.parametrize("count", [1, 37, 999, 1000, 1500])
def test_sample_takes_the_smallest_hashes(spark, count):
    df = spark.range(1000).withColumn("t", F.lit("x"))
    found = sampling.limit_sample(df, count, 5, ["id"])
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())
    assert sorted(r.id for r in found.collect()) == sorted(order[:count])
    assert found.columns == df.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan


@pytest.mark.parametrize("count", [1, 4, 7, 12, 19, 40])
def test_sample_of_rows_with_equal_and_null_ids(spark, count):
    rows = [(None, i % 3) for i in range(10)] + [(1, i) for i in range(6)] + [(2, 0)] * 4
    df = spark.createDataFrame(rows, "id int, v int")
    found = [tuple(r) for r in sampling.limit_sample(df, count, 3, ["id"]).collect()]
    assert len(found) == min(count, len(rows))
    assert not Counter(found) - Counter(rows)
    code = {None: "\\N"}
    rank = {k: hashlib.md5(f"3|{code.get(k, k)}".encode()).hexdigest() for k in (None, 1, 2)}
    taken = sorted((rank[r[0]] for r in rows))[:count]
    assert sorted(rank[r[0]] for r in found) == taken
    again = sampling.limit_sample(df.repartition(3), count, 3, ["id"]).collect()
    assert Counter(found) == Counter(map(tuple, again))


def test_large_counts_are_no_limit(spark):
    assert sampling.limit_sample(spark.range(10), 1_000_000).count() == 10
    assert sampling.limit_sample(spark.range(200_000), 150_001).count() == 150_001
