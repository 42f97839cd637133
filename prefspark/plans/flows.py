"""Flows: triples to split pair records, pair files to a training set, prompts to scores."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions import chat
from prefspark.functions.messages import build_messages
from prefspark.functions.models import supports_system_role
from prefspark.functions.text import steered_prompt_text
from prefspark.operators import scoring
from prefspark.operators.filters import exclude_concept_ids, keep_genre, rename_to_canonical
from prefspark.operators.pairing import MIN_LEN, build_pairs, sort_pairs
from prefspark.operators.preference import pair_records, reverse_preference
from prefspark.operators.quality import CANONICAL, enforce_pairs
from prefspark.operators.sampling import limit_sample
from prefspark.operators.splits import split_pairs
from prefspark.schema import FILTERED_TRIPLE_COLUMNS, TRIPLE_COLUMNS, free_names
from prefspark.shared_storage import staged
from prefspark.sources.readers import load_split, read_ordered
from prefspark.sources.writers import write_report, write_splits


def text_triples(triples: DataFrame) -> DataFrame:
    """The rows flow A works on: text genre without the excluded concept ids.

    The genre comes first: it is pushed into the Parquet scan, the id test is not.
    """
    return exclude_concept_ids(keep_genre(triples)).select(*TRIPLE_COLUMNS, "ord")


def flow_a(triples: DataFrame, mode: str = "hash", min_len: int = MIN_LEN) -> DataFrame:
    """Filtered triples to pairs with their split."""
    return flow_b(text_triples(triples), mode, min_len)


def flow_b(triples: DataFrame, mode: str = "hash", min_len: int = MIN_LEN) -> DataFrame:
    """All triples to pairs with their split.

    The pairs are staged, since they are used twice: for their concepts and for the result.
    """
    return split_pairs(staged(build_pairs(triples, mode=mode, min_len=min_len), "pairs"), mode)


def prepare(
    spark: SparkSession,
    paths: Sequence[str],
    out: str,
    filtered: bool,
    mode: str = "hash",
    ordered: bool = False,
) -> tuple[DataFrame, dict[str, int]]:
    """Parquet triples to JSON lines per split; returns the staged pairs and the counts.

    The pairs are used twice, for their concepts and for the output, so they are written to
    the shared folder once and both uses read them from there, also after a lost executor.
    ``ordered`` sorts the output by prompt and concept, which costs one more shuffle.
    """
    columns = FILTERED_TRIPLE_COLUMNS if filtered else TRIPLE_COLUMNS
    triples = read_ordered(spark, paths, columns)
    if filtered:
        triples = text_triples(triples)
    pairs = flow_b(triples, mode)
    counts = write_splits(pair_records(sort_pairs(pairs) if ordered else pairs, "split"), out)
    return pairs, counts


def assemble_split(
    records: DataFrame,
    what: str,
    columns: Mapping[str, str] = CANONICAL,
    max_rows: int | None = None,
    seed: int = 42,
    reverse: bool = False,
    ids: Sequence[str] = (),
) -> DataFrame:
    """One split as training reads it: checked, renamed, sampled, maybe reversed."""
    checked = rename_to_canonical(enforce_pairs(records, what, columns), columns)
    sampled = limit_sample(checked, max_rows, seed, ids)
    return reverse_preference(sampled) if reverse else sampled


def assemble_training_set(
    spark: SparkSession,
    data: Mapping,
    seed: int = 42,
    reverse: bool = False,
    ids: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The splits that ``data`` configures. Validation and test may be sampled, train is not."""
    columns = data.get("columns") or CANONICAL
    splits = {}
    for split in ("train", "validation", "test"):
        records = load_split(spark, data, split)
        if records is not None:
            max_rows = None if split == "train" else data.get(f"{split}_max_samples")
            splits[split] = assemble_split(records, split, columns, max_rows, seed, reverse, ids)
    if "train" not in splits:
        raise ValueError("set train_path, or dataset_name and train_split")
    return splits


def steered_prompts(
    requests: DataFrame,
    system: Column | None = None,
    thinking: Column | None = None,
    date_string: str = chat.DEFAULT_DATE,
) -> DataFrame:
    """``(question, direction, model, reverse, …)`` to generation-ready text.

    Adds ``rendered`` and ``error``. Works row by row: no shuffle.
    """
    system = F.lit(None).cast("string") if system is None else system
    user = steered_prompt_text(F.col("question"), F.col("direction"), F.col("reverse"))
    messages = build_messages(user, system, supports_system_role(F.col("model")))
    rendering = chat.render_for_model(messages, F.col("model"), thinking, date_string)
    (both,) = free_names([*requests.columns, "rendered", "error"], "_rendering")
    rendered = requests.withColumn(both, rendering)
    return rendered.withColumns(
        {"rendered": F.col(f"{both}.text"), "error": F.col(f"{both}.error")}
    ).drop(both)


def score_run(
    prompts: DataFrame,
    rendered: DataFrame,
    outputs: DataFrame,
    aggregates: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(one row of scores over all outputs, samples side by side)."""
    return scoring.score(outputs, aggregates), scoring.zip_samples(prompts, rendered, outputs)


def report_run(
    prompts: DataFrame,
    rendered: DataFrame,
    outputs: DataFrame,
    path: str,
    checkpoint: str,
    loaded_model: str,
    step: int,
    aggregates: Mapping[str, Column] | None = None,
) -> None:
    """Score the outputs of one checkpoint and write its report under its step."""
    scores, samples = score_run(prompts, rendered, outputs, aggregates)
    at_step = F.lit(step).cast("long")
    write_report(
        scoring.report(scores, checkpoint, loaded_model).withColumn("step", at_step),
        samples.withColumn("step", at_step),
        path,
    )
