"""Growing tables, versions, routing, permutations, positions, user aggregates and sketches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from checks.io_queries import FOLDERS, write_filed_triples
from prefspark.functions.permutation import bases, permuted
from prefspark.operators import pairing, routing, scoring, sketches, splits, user_aggregates
from prefspark.operators.preference import pair_records
from prefspark.plans.incremental import ConceptSplits, PickState, prepare_batch
from prefspark.shared_storage import names_in, read_text, write_text_once
from prefspark.sources import publishing, readers, writers
from prefspark.sources.versions import Versions

TRIPLE = "input string, output string, output_concept string, category string, ord long"


def some_triples(seed, n, first=0, inputs=12):
    """Triples with hot prompts, nulls of all kinds and short outputs."""
    rng = random.Random(seed)
    rows = []
    for ord in range(first, first + n):
        given = None if rng.random() < 0.05 else f"prompt {int(inputs * rng.random() ** 2)}"
        output = rng.choice([None, "short", f"a long enough output {ord}", f"another output, no. {ord}"])
        concept = None if rng.random() < 0.05 else f"c{rng.randrange(9)}"
        rows.append((given, output, concept, rng.choice(["positive", "negative", "other"]), ord))
    return rows


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- versions


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "table"))
    assert versions.get().number == 0 and versions.read("a long").count() == 0
    folders = {}
    for part, value in (("x", 1), ("y", 2)):
        folders[part] = versions.new_folder()
        spark.createDataFrame([(value,)], "a long").write.parquet(f"{versions.path}/{folders[part]}")
    first = versions.commit(versions.get(), {"x": folders["x"]}, {"note": "é"})
    # Written, but not committed: as if the run had ended here.
    assert as_set(versions.read("a long")) == [(1,)]
    second = versions.commit(first, {"y": folders["y"]})
    assert as_set(versions.read("a long")) == [(1,), (2,)]
    assert as_set(versions.read("a long", ["y"])) == [(2,)] and as_set(versions.read("a long", number=1)) == [(1,)]
    assert versions.get(1).notes == {"note": "é"} and versions.numbers() == [1, 2]
    with pytest.raises(RuntimeError, match="committed by another run"):
        versions.commit(first, {})
    with pytest.raises(ValueError, match="no version 7"):
        versions.get(7)
    versions.commit(second, {"x": None})
    assert as_set(versions.read("a long")) == [(2,)]
    assert versions.clean(keep=1) == [folders["x"].split("/")[1]]
    assert as_set(versions.read("a long")) == [(2,)] and versions.numbers() == [3]


def test_small_files_are_written_once(spark, tmp_path):
    path = str(tmp_path / "a" / "note.json")
    assert write_text_once(spark, path, "ü") and not write_text_once(spark, path, "v")
    assert read_text(spark, path) == "ü" and names_in(spark, str(tmp_path / "a")) == ["note.json"]
    assert names_in(spark, str(tmp_path / "nothing")) == []


# ---------------------------------------------------------------- incremental pairing


@pytest.mark.parametrize("seed, buckets, batches", [(1, 1, 2), (2, 5, 4), (3, 64, 3)])
def test_merged_batches_equal_a_full_run(spark, tmp_path, seed, buckets, batches):
    rows = some_triples(seed, 400)
    random.Random(seed).shuffle(rows)
    state = PickState(spark, str(tmp_path / "state"), buckets)
    size = len(rows) // batches + 1
    for i in range(batches):
        part = rows[i * size : (i + 1) * size]
        state.merge(spark.createDataFrame(part, TRIPLE), f"b{i}")
        so_far = spark.createDataFrame(rows[: (i + 1) * size], TRIPLE)
        assert as_set(state.pairs()) == as_set(pairing.build_pairs(so_far))
        assert as_set(state.picks()) == as_set(pairing.picks(so_far))
    # Handed in again, also by someone who knows neither buckets nor seed.
    again = PickState(spark, str(tmp_path / "state"), 3)
    assert again.buckets == buckets
    number = again.versions.get().number
    assert again.merge(spark.createDataFrame(rows[:size], TRIPLE), "b0").number == number == batches
    assert as_set(again.pairs(number=1)) == as_set(pairing.build_pairs(spark.createDataFrame(rows[:size], TRIPLE)))


def test_only_touched_buckets_are_read_and_written(spark, tmp_path, rows_read):
    state = PickState(spark, str(tmp_path / "state"), buckets=32)
    rows = [(f"p{i}", f"a long enough output {i}", "c", "positive", i) for i in range(640)]
    state.merge(spark.createDataFrame(rows, TRIPLE), "first")
    before = state.versions.get().parts
    one = spark.createDataFrame([("p7", "a new negative output", "c", "negative", 9_999)], TRIPLE)
    in_bucket = state.versions.read("input string").groupBy(F.input_file_name()).count()
    largest = in_bucket.agg(F.max("count")).first()[0]
    read = rows_read(lambda: state.merge(one, "second"))
    after = state.versions.get().parts
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    # The bucket, and the one staged pick of the batch, twice.
    assert read <= largest + 3
    assert state.pairs().count() == 1


def test_a_failed_merge_changes_nothing(spark, tmp_path):
    state = PickState(spark, str(tmp_path / "state"), buckets=4)
    rows = some_triples(5, 200)
    state.merge(spark.createDataFrame(rows, TRIPLE), "first")
    before = as_set(state.picks())
    bad = spark.createDataFrame([*some_triples(6, 20, 200)[:-1], ("p", "o", "c", "positive", None)], TRIPLE)
    with pytest.raises(Exception, match="ord must not be null"):
        state.merge(bad, "second")
    assert as_set(state.picks()) == before
    more = spark.createDataFrame(some_triples(6, 20, 200), TRIPLE)
    state.merge(more, "second")
    whole = spark.createDataFrame(rows + some_triples(6, 20, 200), TRIPLE)
    assert as_set(state.pairs()) == as_set(pairing.build_pairs(whole))
    assert state.merge(spark.createDataFrame([], TRIPLE), "empty").notes["batches"] == ["first", "second", "empty"]


# ---------------------------------------------------------------- stable splits


def concepts_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "output_concept string")


@pytest.mark.parametrize("seed", range(3))
def test_no_concept_moves_and_parts_stay_near(spark, tmp_path, seed):
    rng, table = random.Random(seed), ConceptSplits(spark, str(tmp_path / "splits"))
    known, placed = set(), {}
    for step in range(7):
        arriving = {f"k{rng.randrange(200)}" for _ in range(rng.choice([1, 2, 3, 40]))}
        known |= arriving
        # Known ones come again, too, and rows repeat.
        table.assign(concepts_of(spark, [*arriving, *list(known)[:5], *arriving, None]), f"b{step}")
        found = {r["output_concept"]: r["split"] for r in table.assignment().collect()}
        assert found.keys() == known
        assert all(found[c] == s for c, s in placed.items())
        placed, n = found, len(found)
        parts = {"train": int(0.75 * n), "valid": int(0.10 * n)}
        parts["test"] = n - sum(parts.values())
        counts = {s: list(found.values()).count(s) for s in splits.SPLITS}
        assert all(abs(counts[s] - parts[s]) <= 1 for s in splits.SPLITS), (n, counts)


def test_a_first_batch_is_split_as_without_growth(spark, tmp_path):
    names = concepts_of(spark, [f"k{i}" for i in range(57)])
    table = ConceptSplits(spark, str(tmp_path / "splits"))
    table.assign(names, "all")
    assert as_set(table.assignment()) == as_set(splits.split_concepts(names))
    number = table.versions.get().number
    assert table.assign(concepts_of(spark, ["other"]), "all").number == number
    table.assign(concepts_of(spark, ["other"]), "more")
    before = as_set(table.assignment())
    table.compact()
    assert as_set(table.assignment()) == before and len(table.versions.get().parts) == 1


def test_batches_of_files_to_published_splits(spark, tmp_path):
    rows, paths = some_triples(9, 600, inputs=40), []
    for i in range(3):
        part = spark.createDataFrame(rows[200 * i : 200 * (i + 1)], TRIPLE).drop("ord").coalesce(1)
        paths.append(str(tmp_path / f"file-{i}"))
        part.write.parquet(paths[-1])
    out = str(tmp_path / "out")
    counts = [prepare_batch(spark, paths[:1], out, "a"), prepare_batch(spark, paths[1:], out, "b")]
    assert counts[1] == prepare_batch(spark, paths[1:], out, "b") == publishing.published_counts(spark, f"{out}/splits")
    expected = pairing.build_pairs(readers.read_ordered(spark, paths, ["input", "output", "output_concept", "category"]))
    found = [
        tuple(r) for s in splits.SPLITS
        for r in publishing.read_published(spark, f"{out}/splits", s)
        .select(F.col("prompt")[0].content, F.col("chosen")[0].content, F.col("rejected")[0].content).collect()
    ]
    assert sorted(found, key=repr) == as_set(expected.select("prompt", "chosen", "rejected")) != []
    assert sum(counts[1].values()) == len(found) > sum(counts[0].values())


# ---------------------------------------------------------------- publishing


def pairs_of(spark, n, split="train"):
    rows = [(f"prompt {i}", f"chosen {i}", f"rejected {i}", split) for i in range(n)]
    return pair_records(spark.createDataFrame(rows, "prompt string, chosen string, rejected string, split string"), "split")


def test_a_failed_publication_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "published")
    with pytest.raises(ValueError, match="no split 'train'"):
        publishing.read_published(spark, path, "train")
    assert publishing.publish_splits(pairs_of(spark, 5), path) == {"train": 5, "valid": 0, "test": 0}
    # The second task fails after the first one has written its file.
    bad = pairs_of(spark, 3).unionByName(pairs_of(spark, 1, "unknown"))
    with pytest.raises(Exception, match="unknown split"):
        publishing.publish_splits(bad, path)
    assert publishing.read_published(spark, path, "train").count() == 5
    assert publishing.read_published(spark, path, "valid").count() == 0
    publishing.publish_splits(pairs_of(spark, 7), path)
    assert publishing.read_published(spark, path, "train").count() == 7
    assert publishing.read_published(spark, path, "train", number=1).count() == 5
    data = {"published_path": path, "train_split": "train"}
    assert readers.load_split(spark, data, "train").count() == 7
    assert readers.load_split(spark, {**data, "version": 1}, "train").count() == 5
    # What the failed run wrote goes, the two versions stay.
    assert len(Versions(spark, path).clean(keep=2)) == 1
    assert publishing.read_published(spark, path, "train", number=1).count() == 5


def test_a_batch_of_metrics_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    shape = "type string, step long, metrics map<string, double>"
    rows = spark.createDataFrame([("t", 1, {"loss": 0.5}), ("t", 2, {"loss": 0.25})], shape)
    assert writers.read_metrics(spark, path).count() == 0
    assert writers.append_metrics_once(rows, path, "run", "b1")
    assert not writers.append_metrics_once(rows, path, "run", "b1")
    # A batch that was written, but whose run ended before its commit record.
    rows.write.json(f"{path}/batches/batch=b2")
    assert writers.read_metrics(spark, path).count() == 2
    assert writers.append_metrics_once(rows.limit(1), path, "run", "b2")
    found = writers.read_metrics(spark, path)
    assert sorted((r["batch"], r["step"]) for r in found.collect()) == [("b1", 1), ("b1", 2), ("b2", 1)]
    assert writers.read_metrics(spark, path, ["b2"]).count() == 1
    for wrong in ("", "a/b", "a b"):
        with pytest.raises(ValueError, match="named by letters"):
            writers.append_metrics_once(rows, path, "run", wrong)
    with pytest.raises(ValueError, match="no committed batches"):
        writers.read_metrics(spark, path, ["b3"])


# ---------------------------------------------------------------- routing


def test_both_sides_of_a_route_come_from_one_scan(spark, tmp_path, rows_read):
    docs = [(i, None if i % 5 == 0 else " \n" if i % 5 == 1 else f"text {i}", "x" if i % 3 else "") for i in range(100)]
    source = str(tmp_path / "docs")
    spark.createDataFrame(docs, "id long, text string, route string").write.parquet(source)
    table, routed = spark.read.parquet(source), []
    read = rows_read(lambda: routed.append(routing.route(table, routing.blank_reasons("text", "route"), str(tmp_path / "out"))))
    assert read == 100
    routed = routed[0]
    good = [d for d in docs if d[1] and d[1].strip() and d[2]]
    assert as_set(routed.accepted) == sorted(good, key=repr) and routed.accepted.columns == table.columns
    assert routed.counts == {
        "accepted": len(good), "refused": 100 - len(good), "text is blank": 40, "route is blank": 34
    }
    assert {tuple(r["refusals"]) for r in routed.refused.collect()} == {
        ("text is blank",), ("route is blank",), ("text is blank", "route is blank")
    }
    assert routed.accepted.count() + routed.refused.count() == 100


def test_routes_without_rows_on_a_side(spark, tmp_path):
    table = spark.createDataFrame([(1,), (2,)], "a long")
    every = routing.route(table, {"no": F.lit(None).cast("boolean")}, str(tmp_path / "x"))
    assert (every.accepted.count(), every.refused.count()) == (2, 0) and every.refused.columns == ["a", "refusals"]
    none = routing.route(table, {"no": F.lit(True)}, str(tmp_path / "y"))
    assert (none.accepted.count(), none.refused.count()) == (0, 2)
    assert routing.route(table.limit(0), {}, str(tmp_path / "z")).counts == {"accepted": 0, "refused": 0}
    with pytest.raises(ValueError, match="already"):
        routing.route(table.withColumn("refusals", F.lit(1)), {}, str(tmp_path / "w"))


# ---------------------------------------------------------------- permutations and positions


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 16, 17, 97, 1000, 1001])
def test_permutation_is_one_to_one(spark, n):
    seeded = [permuted(F.col("id"), n, seed).alias(f"s{seed}") for seed in (1, 2)]
    rows = spark.range(n).select(*seeded).collect()
    for column in (0, 1):
        assert sorted(r[column] for r in rows) == list(range(n))
    if n > 10:
        moved = sum(r[0] != i for i, r in enumerate(rows))
        assert moved > n / 2 and [r[0] for r in rows] != [r[1] for r in rows]


def test_permutation_of_large_ranges_and_bad_values(spark):
    n = (1 << 61) + 12345
    a, b = bases(n)
    assert n <= a * b < n + a
    edge = spark.createDataFrame([(0,), (1,), (n - 1,), (n // 3,), (None,)], "id long")
    values = [r[0] for r in edge.select(permuted(F.col("id"), n)).collect()]
    assert values[-1] is None and len(set(values)) == 5 and all(0 <= v < n for v in values[:-1])
    for bad in (-1, 10):
        with pytest.raises(Exception, match="not from 0 to 9"):
            spark.range(1).select(permuted(F.lit(bad), 10)).collect()
    with pytest.raises(ValueError):
        permuted(F.col("id"), -1)
    plan = spark.range(100).select(permuted(F.col("id"), 100))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_positions_follow_files_and_rows(spark, tmp_path, conf):
    rows, path = [(i, f"t{i}") for i in range(1000)], str(tmp_path / "rows")
    spark.createDataFrame(rows, "_row long, _file string").repartitionByRange(7, "_row").sortWithinPartitions("_row").write.parquet(path)
    for size in ("128m", "2k"):
        conf(files__maxPartitionBytes=size)
        placed = readers.read_positions(spark, path)
        assert placed.columns == ["position", "_row", "_file"]
        assert as_set(placed) == sorted([(i, i, t) for i, t in rows], key=repr)
    shorter = str(tmp_path / "shorter")
    spark.range(10, 30).coalesce(1).write.parquet(shorter)
    zipped = scoring.zip_positions([readers.read_positions(spark, path), readers.read_positions(spark, shorter)])
    assert as_set(zipped) == sorted([(i, i, f"t{i}", i + 10) for i in range(20)], key=repr)
    with pytest.raises(ValueError, match="same name"):
        scoring.zip_positions([placed, placed])


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_positions_send_around_only_the_starts_of_files(spark, tmp_path, conf, threshold):
    conf(autoBroadcastJoinThreshold=threshold)
    path = str(tmp_path / "rows")
    spark.range(100).coalesce(1).write.parquet(path)
    plan = readers.read_positions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "BuildRight" in plan and "SortMergeJoin" not in plan


def test_filed_triples_take_one_task_each(spark):
    """A file's name starts with the number of the task that wrote it."""
    folders = write_filed_triples(spark, "/root/testdata/sf0.001")
    files = [[n for n in os.listdir(folder) if n.startswith("part-")] for folder in folders]
    assert [len(names) for names in files] == [1] * FOLDERS
    assert len({names[0].split("-")[1] for names in files}) == FOLDERS


# ---------------------------------------------------------------- user aggregates and sketches


def spread():
    """Made in a function, so that workers get it without this module."""

    class Spread:
        """Smallest and largest number, and how many."""

        def init(self):
            return (0, None, None)

        def update(self, state, rows):
            values = [v for v in rows.column("v").to_pylist() if v is not None]
            return self.merge(state, (rows.num_rows, min(values, default=None), max(values, default=None)))

        def merge(self, state, other):
            low = [x for x in (state[1], other[1]) if x is not None]
            high = [x for x in (state[2], other[2]) if x is not None]
            return (state[0] + other[0], min(low, default=None), max(high, default=None))

        def finish(self, state):
            return {"n": state[0], "spread": None if state[1] is None else state[2] - state[1]}

    return Spread()


@pytest.mark.parametrize("held, levels, parts", [(10_000, (1024, 32, 1), 5), (2, (3, 1), 9), (1, (1,), 1)])
def test_user_aggregate_equals_sql(spark, monkeypatch, held, levels, parts):
    monkeypatch.setattr(user_aggregates, "HELD_KEYS", held)
    rng = random.Random(held)
    rows = [
        (rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([1, 2]), None if rng.random() < 0.2 else rng.randrange(100))
        for _ in range(500)
    ] + [("alone", 1, None)]
    table = spark.createDataFrame(rows, "state string, shard int, v long").repartition(parts)
    shape = "n long, spread long"
    found = user_aggregates.aggregate(table, spread(), shape, ["v"], ["state", "shard"], levels)
    exact = [F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("spread")]
    assert as_set(found) == as_set(table.groupBy("state", "shard").agg(*exact))
    assert as_set(user_aggregates.aggregate(table, spread(), shape, ["v"], (), levels)) == as_set(table.agg(*exact))


def test_user_aggregate_of_nothing(spark):
    table = spark.createDataFrame([], "k string, v long")
    assert as_set(user_aggregates.aggregate(table, spread(), "n long, spread long", ["v"])) == [(0, None)]
    assert as_set(user_aggregates.aggregate(table, spread(), "n long, spread long", ["v"], ["k"])) == []
    with pytest.raises(ValueError, match="names of keys"):
        user_aggregates.aggregate(table, spread(), "k long", ["v"], ["k"])


def test_sketches_are_stored_once_and_joined(spark, tmp_path, rows_read):
    stored, path = sketches.DistinctSketches(spark, str(tmp_path / "sketches")), str(tmp_path / "rows")
    spark.range(60_000).selectExpr("id div 3 as v", "id % 2 as part").write.partitionBy("part").parquet(path)
    for part in (0, 1, 1):
        rows = spark.read.parquet(f"{path}/part={part}")
        read = rows_read(lambda: stored.add(rows, "v", f"part-{part}"))
        assert read in (30_000, 0)
    assert stored.versions.get().number == 2
    n_rows, n_distinct = stored.estimate().first()
    assert n_rows == 60_000 and abs(n_distinct / 20_000 - 1) < 4 * sketches.standard_error()
    # Counting reads sketches, not rows.
    assert rows_read(lambda: stored.estimate(["part-0"]).collect()) == 1
    with pytest.raises(ValueError, match="no sketches"):
        stored.estimate(["part-9"])
    empty = sketches.DistinctSketches(spark, str(tmp_path / "empty"))
    assert as_set(empty.estimate()) == [(0, 0)]
