"""What several corpus operators share: words, staged tables, bounded slices of batches."""

import re

import pyarrow.compute as pc
from pyspark.sql import functions as F

from prefspark.shared_storage import staged  # noqa: F401

# A word is a run of characters other than these, in Python and in Spark expressions alike.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Text that Python works on at once, in UTF-8 bytes. Batches are cut, documents never.
SLICE_BYTES = 2_000_000


def split_words(text):
    """Column: the words of a text, null counting as an empty text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def words_of(text):
    """The words of a Python string, as ``split_words`` gives them."""
    return WORD.findall(text) if text else []


def set_aside(docs, *used):
    """``docs`` with the columns that are not ``used`` under names that no operator has, and
    what turns such a table into one with the columns of ``docs`` again."""
    names = {c: f"other column {i}" for i, c in enumerate(docs.columns) if c not in used}

    def whole(table):
        return table.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))

    return docs.withColumnsRenamed(names), whole


def let(value, body):
    """Column ``body(value)`` in which ``value`` is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def slices(batches, text_field):
    """Cuts Arrow batches where the texts add up to SLICE_BYTES; a longer one stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_field)).fill_null(0).to_pylist()
        low, total = 0, 0
        for row, size in enumerate(sizes):
            if row > low and total + size > SLICE_BYTES:
                yield batch.slice(low, row - low)
                low, total = row, 0
            total += size
        if sizes:
            yield batch.slice(low)
