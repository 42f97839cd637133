"""Readers, writers, quality checks and the flows around them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from prefspark import shared_storage
from prefspark.operators import metrics, preference, quality, scoring
from prefspark.operators.filters import rename_to_canonical
from prefspark.plans import flows
from prefspark.schema import PAIR, require_columns
from prefspark.sources import readers, writers


def record(prompt="### Steering Direction\nx", chosen="yes", rejected="no"):
    return (
        [("user", prompt)] if prompt is not None else None,
        [("assistant", chosen)],
        [("assistant", rejected)],
    )


@pytest.fixture
def records(spark):
    return lambda *rows: spark.createDataFrame(list(rows), PAIR)


# ---------------------------------------------------------------- reading


@pytest.mark.parametrize(
    "path, fmt, expected",
    [
        ("a.json", None, "json"),
        ("a.jsonl", None, "json"),
        ("x/a.csv", None, "csv"),
        ("a.parquet", None, "parquet"),
        ("a.txt", "csv", "csv"),
        ("a.json", "parquet", "parquet"),
    ],
)
def test_format_of(path, fmt, expected):
    assert readers.format_of(path, fmt) == expected


@pytest.mark.parametrize("path, fmt", [("a.txt", None), ("folder", None), ("a.json", "xml")])
def test_unknown_format(path, fmt):
    with pytest.raises(ValueError, match="format"):
        readers.format_of(path, fmt)


def test_order_of_files_and_rows(spark, conf, tmp_path):
    """File order, then row order, also when a file is split into several tasks."""
    conf(files__maxPartitionBytes="20k", files__openCostInBytes="0")
    paths = []
    for name, start in (("second", 0), ("first", 10_000)):
        path = str(tmp_path / name)
        rows = spark.range(start, start + 5000, 1, 1).select(
            F.col("id").cast("string").alias("input"),
            F.md5(F.col("id").cast("string")).alias("unread"),
        )
        rows.write.option("parquet.block.size", 16_384).parquet(path)
        paths.append(path)
    df = readers.read_ordered(spark, paths, ["input"])
    assert df.rdd.getNumPartitions() > 2
    ordered = [(r.source, int(r.input)) for r in df.orderBy("ord").collect()]
    assert ordered == [(0, i) for i in range(5000)] + [(1, i) for i in range(10_000, 15_000)]
    quality.require_unique(df, "ord")
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in scan and "unread" not in scan


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_only_the_list_of_files_is_sent_around(spark, tmp_path, conf, threshold):
    """Rows stay in the tasks that read them: neither broadcast nor brought together by file."""
    conf(autoBroadcastJoinThreshold=threshold)
    paths = [str(tmp_path / name) for name in ("a", "b", "c")]
    for path in paths:
        spark.range(100).withColumn("_file", F.lit("f")).coalesce(1).write.parquet(path)
    ordered = readers.read_ordered(spark, paths, ["id", "_file"])
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "BuildRight" in plan
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    rows = [(r.id, r._file, r.source, r.ord) for r in ordered.orderBy("ord").collect()]
    assert rows == [(str(i), "f", n, (n << 40) + i) for n in range(3) for i in range(100)]


def test_paths_with_special_characters_and_twice(spark, tmp_path):
    path = str(tmp_path / "a b%c")
    spark.createDataFrame([("x",), ("y",)], "input string").coalesce(1).write.parquet(path)
    df = readers.read_ordered(spark, [path, path], ["input"])
    assert [r.input for r in df.orderBy("ord").collect()] == ["x", "y", "x", "y"]


def test_numbered_ids_and_files(spark, tmp_path):
    paths = [str(tmp_path / "numbers"), str(tmp_path / "texts")]
    ids = spark.range(0, 4, 1, 2)
    ids.withColumnRenamed("id", "concept_id").write.parquet(paths[0])
    ids.select(F.concat(F.lit("c"), "id").alias("concept_id")).write.parquet(paths[1])
    df = readers.read_ordered(spark, paths, ["concept_id"])
    rows = df.orderBy("ord").collect()
    assert [r.concept_id for r in rows] == ["0", "1", "2", "3", "c0", "c1", "c2", "c3"]


def test_flow_a_reads_four_columns_and_pushes_the_genre(spark, tmp_path):
    from checks import fixtures

    path = str(tmp_path / "triples")
    triples = fixtures.triples(spark, "/root/testdata/sf0.001").drop("ord")
    triples.withColumn("unread", F.lit("x")).write.parquet(path)
    columns = [c for c in triples.columns]
    df = flows.text_triples(readers.read_ordered(spark, [path, path], columns))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "unread" not in plan
    assert plan.count("EqualTo(concept_genre,text)") == 2


def test_json_that_does_not_fit_fails(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"prompt": "not a list"}\n')
    with pytest.raises(Exception):
        readers.read_any(spark, str(path)).collect()


def test_inferred_schema(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"x\ny"\n')
    assert readers.read_any(spark, str(path), schema=None).first().b == "x\ny"


def test_csv_keeps_quotes_and_newlines(spark, records, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = records(record('say "hi",\nthen \\n go', "é☃", 'a,"b"'))
    writers.write_pairs_csv(rows, path)
    assert readers.read_any(spark, path).collect() == rows.collect()


def test_csv_columns_go_by_name(spark, records, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = records(record()).withColumn("extra", F.lit(1))
    writers.write_pairs_csv(rows.select("extra", "rejected", "prompt", "chosen"), path)
    assert readers.read_any(spark, path).collect() == records(record()).collect()
    short = str(tmp_path / "short.csv")
    writers.write_pairs_csv(rows.select("prompt"), short)
    with pytest.raises(ValueError, match=r"\['chosen', 'rejected'\]"):
        readers.read_any(spark, short)


def test_json_list_of_records(spark, records, tmp_path):
    message = [{"role": "user", "content": "x"}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"prompt": message, "chosen": message, "rejected": message}] * 2))
    assert readers.read_any(spark, str(path), multi_line=True).count() == 2


def test_parquet_split_without_a_column(spark, records, tmp_path):
    path = str(tmp_path / "p.parquet")
    records(record()).drop("chosen").write.parquet(path)
    with pytest.raises(ValueError, match=r"train is missing columns: \['chosen'\]"):
        flows.assemble_training_set(spark, {"train_path": path})


def test_reports_are_one_document_per_file(spark, tmp_path):
    for step in (1, 2):
        document = {
            "checkpoint": f"c{step}",
            "loaded_model": "m",
            "metrics": {"score": step / 2},
            "samples": [{"prompt": "p", "rendered_prompt": "r", "output": f"o{i}"} for i in (1, 2)],
        }
        (tmp_path / f"step-{step}.json").write_text(json.dumps(document, indent=2))
    rows = readers.read_reports(spark, str(tmp_path)).orderBy("checkpoint").collect()
    assert [(r.checkpoint, r.metrics["score"], len(r.samples)) for r in rows] == [
        ("c1", 0.5, 2), ("c2", 1.0, 2),
    ]


# ---------------------------------------------------------------- writing


def test_split_writer_keeps_text_keys_and_nulls(spark, records, tmp_path):
    path = str(tmp_path / "out")
    rows = records(record("naïve ☃", "yes", None)).withColumn("split", F.lit("train"))
    writers.write_splits(rows, path)
    assert writers.write_splits(rows, path) == {"train": 1, "valid": 0, "test": 0}  # replaces
    lines = [r.value for r in spark.read.text(f"{path}/split=train").collect()]
    assert len(lines) == 1 and "naïve ☃" in lines[0]
    parsed = json.loads(lines[0])
    assert list(parsed) == ["prompt", "chosen", "rejected"]
    assert parsed["rejected"] == [{"role": "assistant", "content": None}]


def test_export_leaves_what_is_there(spark, tmp_path):
    path = str(tmp_path / "export")
    assert writers.export_split(spark.range(3), path) == 3
    assert writers.export_split(spark.range(9), path) is None
    assert spark.read.json(path).count() == 3


def test_metric_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for step in (1, 2):
        rows = spark.createDataFrame([("trainer", step)], "type string, step long")
        writers.append_metrics(rows, path, "run")
    assert sorted(r.step for r in spark.read.json(path).collect()) == [1, 2]


# ---------------------------------------------------------------- quality


def test_missing_columns_are_all_named(records):
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        require_columns(records(record()), ["prompt", "a", "b"])


def test_renaming_may_swap_names_but_not_merge_them(spark):
    df = spark.createDataFrame([("p", "c")], "prompt string, chosen string")
    swapped = rename_to_canonical(df, {"prompt": "chosen", "chosen": "prompt"})
    assert swapped.first().asDict() == {"chosen": "p", "prompt": "c"}
    with pytest.raises(ValueError, match="same name"):
        rename_to_canonical(df, {"prompt": "chosen"})


def test_violations_beyond_the_first_twenty_rows(spark, records):
    df = records(*[record()] * 30, record(None)).coalesce(1).withColumn(
        "id", F.monotonically_increasing_id()
    )
    assert [(r.id, r["column"], r.reason) for r in quality.validate_pairs(df, ["id"]).collect()] == [
        (30, "prompt", quality.NO_MESSAGES)
    ]


@pytest.mark.parametrize(
    "value, reason",
    [
        ([], quality.NO_MESSAGES),
        (None, quality.NO_MESSAGES),
        ([("user", None)], quality.BAD_MESSAGE),
        ([("user", "a"), (None, "b")], quality.BAD_MESSAGE),
        ([("user", "a"), None], quality.BAD_MESSAGE),
        ([("user", "")], None),
    ],
)
def test_messages_issue(spark, value, reason):
    df = spark.createDataFrame([(value,)], "m array<struct<role string, content string>>")
    assert df.select(quality.messages_issue(F.col("m")).alias("v")).first().v == reason


def test_enforced_table_fails_when_read(records):
    quality.enforce_pairs(records(record()), "train").collect()
    bad = quality.enforce_pairs(records(record(), record(None)), "train")
    with pytest.raises(Exception, match="train.prompt must be a non-empty list"):
        bad.collect()


def test_enforcement_survives_column_pruning_of_what_is_read(records):
    bad = quality.enforce_pairs(records(record(None)), "train")
    with pytest.raises(Exception, match="train.prompt"):
        bad.select("prompt").collect()


def test_require_unique(spark):
    with pytest.raises(ValueError, match="identify"):
        quality.require_unique(spark.createDataFrame([(1,), (1,)], "ord long"), "ord")


# ---------------------------------------------------------------- reversal


def test_reversal_swaps_and_relabels(records):
    row = preference.reverse_preference(records(record()).withColumn("k", F.lit(1))).first()
    assert row.prompt[0].content == "### Suppressing Direction\nx"
    assert (row.chosen[0].content, row.rejected[0].content, row.k) == ("no", "yes", 1)


def test_reversing_twice_restores_the_answers(records):
    df = records(record())
    twice = preference.reverse_preference(preference.reverse_preference(df))
    assert twice.select("chosen", "rejected").collect() == df.select("chosen", "rejected").collect()


def test_reversal_of_some_rows(records):
    df = records(record(), record(chosen="other"))
    some = preference.reverse_preference(df, F.col("chosen")[0]["content"] == "other")
    assert [r.chosen[0].content for r in some.collect()] == ["yes", "no"]


# ---------------------------------------------------------------- scores and metrics


def test_scores(spark):
    df = spark.createDataFrame([("\U0001f600ab",), (" \n",), ("",), (None,)], "output string")
    row = scoring.score(df).first()
    assert (row.mean_output_characters, row.nonempty_fraction) == (1.25, 0.25)


def test_scores_of_nothing_are_zero(spark):
    row = scoring.score(spark.createDataFrame([], "output string")).first()
    assert (row.mean_output_characters, row.nonempty_fraction) == (0.0, 0.0)


def test_zip_stops_at_the_shortest(spark):
    df = spark.createDataFrame([(["p", "q"], ["P", "Q"], ["o"]), (["p"], [], ["o"])],
                               "a array<string>, b array<string>, c array<string>")
    zipped = df.select(
        scoring.zip_shortest(prompt=F.col("a"), rendered=F.col("b"), output=F.col("c")).alias("z")
    )
    assert [[tuple(s) for s in r.z] for r in zipped.collect()] == [[("p", "P", "o")], []]
    assert zipped.select("z.output").first().output == ["o"]


def test_report_metrics(spark):
    df = spark.createDataFrame([("abc",)], "output string")
    row = scoring.report(scoring.score(df), "c", "m").first()
    assert row.metrics == {"mean_output_characters": 3.0, "nonempty_fraction": 1.0}


def test_reports_of_a_run(spark, tmp_path):
    path = str(tmp_path / "report")
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "prompt_id long, prompt string")
    rendered = spark.createDataFrame(
        [(1, "A"), (2, "B"), (3, "C")], "prompt_id long, rendered_prompt string"
    )
    for step, text in ((10, "old"), (20, "four"), (10, "longer")):
        outputs = spark.createDataFrame([(2, text), (1, "")], "prompt_id long, output string")
        flows.report_run(prompts, rendered, outputs, path, f"checkpoint-{step}", "m", step)
    rows = spark.read.json(f"{path}/metrics").orderBy("step").collect()
    assert [(r.step, r.checkpoint, r.metrics.mean_output_characters) for r in rows] == [
        (10, "checkpoint-10", 3.0), (20, "checkpoint-20", 2.0),
    ]
    samples = spark.read.json(f"{path}/samples").where("step = 10").orderBy("prompt_id")
    got = [(r.prompt, r.rendered_prompt, r.output) for r in samples.collect()]
    assert got == [("a", "A", ""), ("b", "B", "longer")]


@pytest.mark.parametrize(
    "interval, enabled, kept",
    [(2, True, [2, 4]), (0, True, []), (-1, True, []), (2, False, []), (1, True, [1, 2, 3, 4])],
)
def test_step_gate(spark, interval, enabled, kept):
    df = spark.range(5).withColumnRenamed("id", "step")
    got = [r.step for r in metrics.step_gate(df, interval, enabled).collect()]
    assert sorted(got) == kept


# ---------------------------------------------------------------- flows


def test_split_sources(spark, records, tmp_path):
    path = str(tmp_path / "p.jsonl")
    records(record()).write.json(path)
    table = records(record(chosen="t")).withColumn("split", F.lit("train"))
    table.createOrReplaceTempView("pair_table")
    named = {"dataset_name": "pair_table", "train_split": "train"}
    both = {**named, "train_path": path}
    assert readers.load_split(spark, both, "train").first().chosen[0].content == "yes"
    assert readers.load_split(spark, named, "train").first().chosen[0].content == "t"
    assert readers.load_split(spark, named, "test") is None
    with pytest.raises(ValueError, match="train"):
        flows.assemble_training_set(spark, {"test_path": path})


def test_training_set_with_other_column_names(spark, records, tmp_path):
    columns = {"prompt": "q", "chosen": "good", "rejected": "bad"}
    path = str(tmp_path / "p.parquet")
    records(*[record(chosen=f"c{i}") for i in range(9)]).withColumnsRenamed(columns).write.parquet(
        path
    )
    data = {
        "train_path": path, "test_path": path, "columns": columns, "test_max_samples": 4,
        "train_max_samples": 2,
    }
    got = flows.assemble_training_set(spark, data, reverse=True)
    assert {name: df.count() for name, df in got.items()} == {"train": 9, "test": 4}
    assert got["train"].columns == ["prompt", "chosen", "rejected"]
    assert {r.rejected[0].content for r in got["train"].collect()} == {f"c{i}" for i in range(9)}


def test_prepare_writes_every_split(spark, tmp_path):
    from checks import fixtures

    path = str(tmp_path / "triples")
    fixtures.triples(spark, "/root/testdata/sf0.001").coalesce(1).drop("ord").write.parquet(path)
    out = str(tmp_path / "out")
    pairs, counts = flows.prepare(spark, [path], out, filtered=True)
    assert (pairs.count(), pairs.select("output_concept").distinct().count()) == (320, 85)
    assert {d for d in os.listdir(out) if d.startswith("split=")} == {
        "split=train", "split=valid", "split=test",
    }
    written = spark.read.json(out).groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r.split: r.n for r in written} == counts and sum(counts.values()) == 320


def test_prepare_in_output_order(spark, tmp_path):
    from checks import fixtures

    path = str(tmp_path / "triples")
    fixtures.triples(spark, "/root/testdata/sf0.001").coalesce(1).drop("ord").write.parquet(path)
    out = str(tmp_path / "out")
    pairs, _ = flows.prepare(spark, [path], out, filtered=False, mode="exact", ordered=True)
    prompts = [
        json.loads(line)["prompt"][0]["content"]
        for name in sorted(os.listdir(f"{out}/split=train")) if name.endswith(".json")
        for line in open(f"{out}/split=train/{name}", encoding="utf-8")
    ]
    train = pairs.where("split = 'train'").collect()
    expected = [r.prompt for r in sorted(train, key=lambda r: (r.input, r.output_concept))]
    assert prompts == expected and len(prompts) == 270


def test_row_wise_operators_run_on_a_stream(spark, records, tmp_path):
    path = str(tmp_path / "in")
    records(record()).write.json(path)
    stream = preference.reverse_preference(spark.readStream.schema(PAIR).json(path))
    run = stream.writeStream.format("memory").queryName("reversed_pairs").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    row = spark.table("reversed_pairs").first()
    assert (row.prompt[0].content, row.chosen[0].content) == (
        "### Suppressing Direction\nx", "no",
    )


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_csv_keeps_padded_empty_and_missing_text(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    rows = [(" lead", "a"), ("trail ", "b"), ("", "c"), (None, "d"), ("two\nlines", "e"), ('"q"', "f")]
    writers.write_pairs_csv(spark.createDataFrame(rows, "id string, v string"), path)
    schema = spark.createDataFrame([], "v string, id string").schema
    found = readers.read_any(spark, path, "csv", schema).collect()
    assert sorted([(r.v, r.id) for r in found]) == [(v, i) for i, v in rows]


def test_csv_files_with_different_headers_fail(spark, tmp_path):
    for name, text in (("1.csv", "a,b\n1,2\n"), ("2.csv", "b,a\n2,1\n")):
        (tmp_path / name).write_text(text)
    schema = spark.createDataFrame([], "a string, b string").schema
    with pytest.raises(Exception, match="CSV header"):
        readers.read_any(spark, str(tmp_path), "csv", schema).collect()


def test_records_of_an_unknown_split_are_refused(spark, tmp_path):
    records = spark.createDataFrame([("train", 1), ("dev", 2)], "split string, v int")
    with pytest.raises(Exception, match="unknown split dev"):
        writers.write_splits(records, str(tmp_path / "out"))
