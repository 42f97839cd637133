"""Rows sorted into accepted and refused ones in a single pass, with reasons and counts.

Where a check raises, one bad row ends the job, and where it filters, two outputs read the
table twice. ``route`` writes both outputs at once and counts them on the way.
"""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prefspark.functions.messages import PROMPT_ERRORS, normalise_prompt
from prefspark.functions.text import is_blank
from prefspark.operators.quality import BAD_MESSAGE, CANONICAL, NO_MESSAGES, messages_issue
from prefspark.schema import free_names, require_columns
from prefspark.sources.versions import Versions

ACCEPTED, REFUSED = "accepted", "refused"


@dataclass(frozen=True)
class Routed:
    """Both outputs; ``counts`` has the rows of each and how many each reason refused."""

    accepted: DataFrame
    refused: DataFrame
    counts: dict[str, int]


def route(
    df: DataFrame, reasons: Mapping[str, Column], path: str, why: str = "refusals"
) -> Routed:
    """Write rows of which a reason holds apart from the others, below ``path``.

    A reason is a name and a condition, which refuses a row where it is true; null is false. A
    refused row has all its columns and the names of its reasons in ``why``, in their order.
    Both outputs and the counts become current together (``prefspark.sources.versions``).
    """
    if why in df.columns:
        raise ValueError(f"the table has a column {why!r} already; name another one")
    if {ACCEPTED, REFUSED} & set(reasons):
        raise ValueError(f"{ACCEPTED!r} and {REFUSED!r} are no names for reasons")
    (place,) = free_names([*df.columns, why], "route")
    found = [F.when(holds, F.lit(name)) for name, holds in reasons.items()]
    listed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    routed = df.withColumn(why, listed)
    routed = routed.withColumn(place, F.when(F.size(why) == 0, ACCEPTED).otherwise(REFUSED))
    seen = Observation()
    counted = routed.observe(
        seen,
        *(F.count_if(F.col(place) == side).alias(side) for side in (ACCEPTED, REFUSED)),
        *(F.count_if(F.array_contains(why, name)).alias(name) for name in reasons),
    )
    versions = Versions(df.sparkSession, path)
    before, folder = versions.get(), versions.new_folder()
    counted.write.partitionBy(place).parquet(f"{versions.path}/{folder}")
    counts = dict(seen.get)
    parts = {side: f"{folder}/{place}={side}" if counts[side] else None for side in (ACCEPTED, REFUSED)}
    after = versions.commit(before, parts, {"counts": counts})
    schema = routed.drop(place).schema
    accepted, refused = (versions.read(schema, [s], after.number) for s in (ACCEPTED, REFUSED))
    return Routed(accepted.drop(why), refused, counts)


def pair_reasons(columns: Mapping[str, str] = CANONICAL) -> dict[str, Column]:
    """Why pair records are refused: what ``validate_pairs`` would list, by column."""
    return {
        f"{source} {issue}": messages_issue(F.col(source)) == issue
        for source in columns.values()
        for issue in (NO_MESSAGES, BAD_MESSAGE)
    }


def blank_reasons(*columns: str) -> dict[str, Column]:
    """Why texts are refused: those that are null or only white space."""
    return {f"{c} is blank": F.coalesce(is_blank(F.col(c)), F.lit(True)) for c in columns}


def route_pairs(records: DataFrame, path: str, columns: Mapping[str, str] = CANONICAL) -> Routed:
    """Pair records with sound message lists, and those put aside."""
    require_columns(records, columns.values(), "pair table")
    return route(records, pair_reasons(columns), path)


def route_prompts(
    prompts: DataFrame, path: str, column: str = "prompt", messages: str = "messages"
) -> Routed:
    """Prompts of mixed shape with their ``messages``, and those that have no such form."""
    (both,) = free_names([*prompts.columns, messages], "_normal")
    normal = prompts.withColumn(both, normalise_prompt(F.col(column)))
    normal = normal.withColumns(
        {messages: F.col(f"{both}.messages"), both: F.col(f"{both}.error")}
    )
    routed = route(normal, {e: F.col(both) == e for e in PROMPT_ERRORS}, path)
    return Routed(routed.accepted.drop(both), routed.refused.drop(both, messages), routed.counts)
