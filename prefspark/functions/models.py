"""Predicates on a model name."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _names(model: Column, family: str) -> Column:
    return F.contains(F.lower(model), F.lit(family))


def is_gemma_family(model: Column) -> Column:
    return F.coalesce(_names(model, "gemma"), F.lit(False))


def is_qwen_family(model: Column) -> Column:
    return F.coalesce(_names(model, "qwen"), F.lit(False))


def supports_system_role(model: Column) -> Column:
    """Every family takes a system message but one; an unknown model is taken to do so."""
    return ~is_gemma_family(model)


def thinking_flag(
    override: Column, configured: Column, model: Column, is_configured: Column | None = None
) -> Column:
    """Row override, else the configured value, else on for the Qwen family.

    ``is_configured`` tells a value set to null (which counts as off) from one that is
    not set at all; without it a null means not set.
    """
    if is_configured is not None:
        configured = F.when(is_configured, F.coalesce(configured, F.lit(False)))
    return F.coalesce(override, configured, is_qwen_family(model))
