"""Queries that write and read back, and those over metrics and outputs."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from checks.chat_queries import STEERED_PROMPTS, flat_records, flat_records_sql
from checks.pair_queries import PAIRS, TEXT_TRIPLES, pairs_sql, split_pairs_sql
from checks.registry import query
from prefspark.functions.models import thinking_flag
from prefspark.operators import metrics, pairing, scoring, splits
from prefspark.operators.preference import pair_records
from prefspark.plans import flows
from prefspark.schema import METRIC_RECORD, PAIR, REPORT
from prefspark.shared_storage import new_table_path
from prefspark.sources import readers, writers

# ---------------------------------------------------------------- pair records


@query(flat_records_sql(split_pairs_sql(PAIRS), "split, "))
def pairs_jsonl_roundtrip(spark, sf):
    pairs = splits.split_pairs(pairing.build_pairs(fx.triples(spark, sf)))
    path = new_table_path(spark, "jsonl")
    writers.write_splits(pair_records(pairs, "split"), path)
    schema = T.StructType([*PAIR.fields, T.StructField("split", T.StringType())])
    return flat_records(readers.read_any(spark, path, "json", schema), "split")


# The triples are written to as many folders, each a range of their order in a file.
FOLDERS = 8


def filed_triples_sql():
    """The triples as they are read back from the folders, with their new ``ord``."""
    return f"""(
      SELECT * EXCLUDE (ord, n), (ord // n) * 1099511627776 + ord % n AS ord
      FROM (SELECT r.*, (SELECT max(event_id) // {FOLDERS} + 1 FROM events) AS n
            FROM {fx.TRIPLES} r))"""


FILED_TRIPLES = filed_triples_sql()
FILED_TEXT_TRIPLES = TEXT_TRIPLES.replace(fx.TRIPLES, FILED_TRIPLES)


def write_filed_triples(spark, sf):
    """Triples in order, in one write to a fixed number of folders; returns the folders."""
    triples, path = fx.triples(spark, sf), new_table_path(spark, "triples")
    rows = triples.agg(F.max("ord")).first()[0] // FOLDERS + 1
    placed = triples.withColumn("folder", F.expr(f"int(ord div {rows})"))
    # By number and not by hash, which brings three of eight folders into one task.
    placed = placed.repartitionById(FOLDERS, F.col("folder")).sortWithinPartitions("folder", "ord")
    placed.drop("ord").write.partitionBy("folder").parquet(path)
    return [f"{path}/folder={i}" for i in range(FOLDERS)]


def _prepared(spark, sf, filtered):
    """The whole flow from files to files: triples written in order, prepared, read back."""
    path = new_table_path(spark, "prepare")
    flows.prepare(spark, write_filed_triples(spark, sf), path, filtered, ordered=True)
    schema = T.StructType([*PAIR.fields, T.StructField("split", T.StringType())])
    return flat_records(readers.read_any(spark, path, "json", schema), "split")


@query(flat_records_sql(split_pairs_sql(pairs_sql(FILED_TEXT_TRIPLES)), "split, "))
def prepare_a(spark, sf):
    return _prepared(spark, sf, filtered=True)


@query(flat_records_sql(split_pairs_sql(pairs_sql(FILED_TRIPLES)), "split, "))
def prepare_b(spark, sf):
    return _prepared(spark, sf, filtered=False)


DOC_PAIRS = pairs_sql(fx.DOC_TRIPLES)


@query(flat_records_sql(DOC_PAIRS, ""))
def csv_roundtrip(spark, sf):
    path = new_table_path(spark, "csv")
    pairs = pairing.build_pairs(fx.doc_triples(spark, sf))
    writers.write_pairs_csv(pair_records(pairs), path)
    return flat_records(readers.read_any(spark, path, "csv"))


@query(flat_records_sql(DOC_PAIRS, ""))
def pairs_parquet_roundtrip(spark, sf):
    path = new_table_path(spark, "pairs") + ".parquet"
    pair_records(pairing.build_pairs(fx.doc_triples(spark, sf))).write.parquet(path)
    return flat_records(readers.read_any(spark, path))


@query(f"SELECT category AS split, count(*) AS n_rows FROM {fx.TRIPLES} t GROUP BY ALL")
def export_counts(spark, sf):
    triples, path = fx.triples(spark, sf), new_table_path(spark, "export")
    counts = {}
    for split in ("positive", "negative", "other"):
        rows = triples.where(F.col("category") == split)
        writers.export_split(rows, f"{path}/{split}")
        counts[split] = spark.read.schema(triples.schema).json(f"{path}/{split}")
    return pairing.stage_counts(counts).withColumnRenamed("stage", "split")


# What a record looks like as JSON text, which is what an unkeyed sample is drawn by.
RECORD_JSON = r"""concat('{"prompt":[{"role":"user","content":"', replace(prompt, E'\n', '\n'),
  '"}],"chosen":[{"role":"assistant","content":"', chosen,
  '"}],"rejected":[{"role":"assistant","content":"', rejected, '"}]}')"""
ASSEMBLED = f"""(
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(concat('42|', {RECORD_JSON})))
              AS drawn
    FROM {split_pairs_sql(pairs_sql(TEXT_TRIPLES))} s)
  WHERE split = 'train' OR drawn <= CASE split WHEN 'valid' THEN 200 ELSE 300 END)"""


@query(flat_records_sql(ASSEMBLED, "split, ", reverse=True))
def assemble_training_set(spark, sf):
    path = new_table_path(spark, "training")
    pairs = flows.flow_a(fx.triples(spark, sf))
    writers.write_splits(pair_records(pairs, "split"), path)
    data = {
        "train_path": f"{path}/split=train",
        "validation_path": f"{path}/split=valid",
        "test_path": f"{path}/split=test",
        "format": "json",
        "validation_max_samples": 200,
        "test_max_samples": 300,
    }
    assembled = flows.assemble_training_set(spark, data, seed=42, reverse=True)
    names = {"train": "train", "validation": "valid", "test": "test"}
    parts = [
        flat_records(df.withColumn("split", F.lit(names[split])), "split")
        for split, df in assembled.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- metrics


@query("SELECT event_id AS step, value FROM events WHERE event_id <> 0 AND event_id % 40 = 0")
def step_gate(spark, sf):
    steps = fx.table(spark, sf, "events").select(F.col("event_id").alias("step"), "value")
    return metrics.step_gate(steps, 40)


@query("""
  SELECT event_id AS step, 'external/value' AS key, value FROM events
  UNION ALL
  SELECT event_id, 'external/user', CAST(user_id AS DOUBLE) FROM events""")
def prefix_metrics(spark, sf):
    values = F.create_map(
        F.lit("value"), F.col("value"), F.lit("user"), F.col("user_id").cast("double")
    )
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("step"), values.alias("m"))
    return rows.select("step", F.explode(metrics.prefix_keys(F.col("m"))))


def _records(spark, sf, kind):
    values = F.create_map(F.lit("loss"), F.col("value"))
    if kind == "external_validation":
        values = metrics.prefix_keys(values)
    return fx.table(spark, sf, "events").select(
        F.lit(kind).alias("type"), F.col("event_id").alias("step"), values.alias("metrics")
    )


@query("""
  SELECT 'run' AS experiment, 'trainer' AS type, event_id AS step, value AS loss,
         CAST(NULL AS DOUBLE) AS external_loss, true AS stamped FROM events
  UNION ALL
  SELECT 'run', 'external_validation', event_id, NULL, value, true
  FROM events WHERE event_id <> 0 AND event_id % 400 = 0""")
def metric_log(spark, sf):
    """Two appends to one log: the trainer's records, then the external checks that are due."""
    path = new_table_path(spark, "metrics")
    writers.append_metrics(_records(spark, sf, "trainer"), path, "run")
    due = metrics.step_gate(_records(spark, sf, "external_validation"), 400)
    writers.append_metrics(due, path, "run")
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$"
    return spark.read.schema(METRIC_RECORD).json(path).select(
        "experiment",
        "type",
        "step",
        F.col("metrics")["loss"].alias("loss"),
        F.col("metrics")["external/loss"].alias("external_loss"),
        F.col("timestamp").rlike(stamp).alias("stamped"),
    )


def _step_scores(spark, sf):
    """Scores of the events of each key, the key being the step."""
    step = F.get_json_object("props", "$.k").cast("long")
    return (
        fx.table(spark, sf, "events")
        .groupBy(step.alias("step"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("value").alias("top"))
    )


STEP_SCORES = """(
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS step,
         CAST(count(*) AS DOUBLE) AS n, max(value) AS top FROM events GROUP BY 1)"""


@query(f"""
  SELECT step, concat('checkpoint-', step) AS checkpoint, n, top, events.event_id AS sample
  FROM {STEP_SCORES} s
  JOIN events ON CAST(json_extract_string(props, '$.k') AS BIGINT) = step""")
def report_roundtrip(spark, sf):
    """Reports as metrics and samples, both partitioned by step and read back."""
    path = new_table_path(spark, "report")
    rows = _step_scores(spark, sf).select(
        "step",
        F.concat(F.lit("checkpoint-"), "step").alias("checkpoint"),
        F.create_map(F.lit("n"), "n", F.lit("top"), "top").alias("metrics"),
    )
    samples = fx.table(spark, sf, "events").select(
        F.get_json_object("props", "$.k").alias("step"),
        F.col("event_id").cast("string").alias("output"),
    )
    writers.write_report(rows, samples, path)
    schema = T.StructType([*REPORT.fields, T.StructField("step", T.LongType())])
    report = spark.read.schema(schema).json(f"{path}/metrics")
    outputs = spark.read.schema("output string, step long").json(f"{path}/samples")
    return report.join(outputs, "step").select(
        "step",
        "checkpoint",
        F.col("metrics")["n"].alias("n"),
        F.col("metrics")["top"].alias("top"),
        F.col("output").cast("long").alias("sample"),
    )


@query(f"SELECT concat('checkpoint-', step) AS checkpoint, n, top FROM {STEP_SCORES} s")
def report_documents(spark, sf):
    """One indented JSON document per step, read back from a folder of documents."""
    path = new_table_path(spark, "documents")
    document = F.struct(
        F.concat(F.lit("checkpoint-"), "step").alias("checkpoint"),
        F.create_map(F.lit("n"), "n", F.lit("top"), "top").alias("metrics"),
    )
    lines = _step_scores(spark, sf).select(
        F.to_json(document, {"pretty": "true"}).alias("value"), "step"
    )
    lines.write.partitionBy("step").text(path)
    return readers.read_reports(spark, path).select(
        "checkpoint", F.col("metrics")["n"].alias("n"), F.col("metrics")["top"].alias("top")
    )


# ---------------------------------------------------------------- outputs

OUTPUTS = r"""(SELECT doc_id AS prompt_id,
  CASE WHEN doc_id % 10 = 0 THEN E' \n\t' ELSE text END AS output FROM documents)"""


def _outputs(spark, sf):
    output = F.when(F.col("doc_id") % 10 == 0, " \n\t").otherwise(F.col("text"))
    docs = fx.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("prompt_id"), output.alias("output"))


@query(rf"""
  SELECT avg(length(output)) AS mean_output_characters,
         avg(CASE WHEN trim(output, E' \t\n') = '' THEN 0.0 ELSE 1.0 END)
           AS nonempty_fraction
  FROM {OUTPUTS} o""")
def score_outputs(spark, sf):
    return scoring.score(_outputs(spark, sf))


@query(f"""
  SELECT max(length(output)) AS longest, CAST(count(DISTINCT output) AS DOUBLE) / count(*)
         AS distinct_share
  FROM {OUTPUTS} o""")
def score_custom(spark, sf):
    own = {
        "longest": F.max(F.length("output")).cast("long"),
        "distinct_share": F.countDistinct("output") / F.count(F.lit(1)),
    }
    return scoring.score(_outputs(spark, sf), own)


@query(f"""
  SELECT r.doc_id AS prompt_id, r.question AS prompt, s.rendered AS rendered_prompt,
         concat('quality ', l.quality) AS output
  FROM {fx.REQUESTS} r JOIN {STEERED_PROMPTS} s ON r.doc_id = s.doc_id
  JOIN labels l ON r.doc_id = l.doc_id""")
def zip_samples(spark, sf):
    requests = fx.requests(spark, sf)
    prompts = requests.select(
        F.col("doc_id").alias("prompt_id"), F.col("question").alias("prompt")
    )
    thinking = thinking_flag(F.col("override"), F.col("configured"), F.col("model"))
    rendered = flows.steered_prompts(requests, F.col("system"), thinking).select(
        F.col("doc_id").alias("prompt_id"), F.col("rendered").alias("rendered_prompt")
    )
    outputs = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("prompt_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("output"),
    )
    return flows.score_run(prompts, rendered, outputs)[1]
