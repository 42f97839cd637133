"""Scores over generated texts."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import is_blank


def default_scores(text: str = "output") -> dict[str, Column]:
    """Mean length in code points and share of texts that are not blank; 0 without texts."""
    value = F.coalesce(F.col(text), F.lit(""))
    not_blank = (~is_blank(value)).cast("double")
    return {
        "mean_output_characters": F.coalesce(F.avg(F.length(value)), F.lit(0.0)),
        "nonempty_fraction": F.coalesce(F.avg(not_blank), F.lit(0.0)),
    }


def score(
    df: DataFrame, aggregates: Mapping[str, Column] | None = None, text: str = "output"
) -> DataFrame:
    """One row of scores. ``aggregates`` maps names to the user's own aggregate columns.

    Built-in aggregates combine on the map side. A pandas aggregate over the whole table
    would bring it into one task; ``user_aggregates.aggregate`` merges states of parts instead.
    """
    aggregates = aggregates or default_scores(text)
    return df.agg(*[column.alias(name) for name, column in aggregates.items()])


def zip_samples(
    prompts: DataFrame, rendered: DataFrame, outputs: DataFrame, key: str = "prompt_id"
) -> DataFrame:
    """Prompt, rendered prompt and output side by side, for the keys that all three have."""
    return prompts.join(rendered, key).join(outputs, key)


def zip_positions(tables: Sequence[DataFrame], position: str = "position") -> DataFrame:
    """Tables side by side by the ``position`` of their rows, cut to the shortest one.

    For tables without a key, as ``readers.read_positions`` numbers them. No two of them may
    have a column of the same name.
    """
    names = [name for table in tables for name in table.columns if name != position]
    if len(set(names)) < len(names):
        raise ValueError(f"tables have columns of the same name: {names}")
    joined = tables[0]
    for table in tables[1:]:
        joined = joined.join(table, position)
    return joined


def report(scores: DataFrame, checkpoint: str, loaded_model: str) -> DataFrame:
    """The metrics row of a report: where the texts came from and a map of the scores."""
    pairs = []
    for name in scores.columns:
        pairs += [F.lit(name), F.col(name).cast("double")]
    return scores.select(
        F.lit(checkpoint).alias("checkpoint"),
        F.lit(loaded_model).alias("loaded_model"),
        F.create_map(*pairs).alias("metrics"),
    )


def zip_shortest(**arrays: Column) -> Column:
    """Named arrays side by side as one array of structs, as long as the shortest of them."""
    sizes = [F.size(a) for a in arrays.values()]
    shortest = F.array_min(F.array(*sizes))
    cut = [F.slice(a, F.lit(1), shortest).alias(name) for name, a in arrays.items()]
    return F.arrays_zip(*cut)
