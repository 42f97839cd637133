"""Tables of several folders that change as a whole: numbered manifests name what is current.

A version writes new folders beside the ones in use and then one small manifest, which lists
the folder of every part. Readers take the newest manifest, so they see all of a version or
nothing of it: when a run fails half-way, what was current stays current and readable. Parts
that a version leaves alone are listed with the folder they already have, unread and unmoved.

One writer at a time: of two that commit the same number, the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prefspark.shared_storage import names_in, read_text, remove_path, write_text_once

_SUFFIX = ".json"


@dataclass(frozen=True)
class Manifest:
    """One version: its number, the folder of each part, and notes of the writer."""

    number: int
    parts: Mapping[str, str]
    notes: Mapping = field(default_factory=dict)


class Versions:
    """The versions of a table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        """The committed versions, the oldest first."""
        names = names_in(self.spark, f"{self.path}/manifests")
        return sorted(int(n.removesuffix(_SUFFIX)) for n in names if n.endswith(_SUFFIX))

    def get(self, number: int | None = None) -> Manifest:
        """A version, the newest one by default; before the first one, an empty version 0."""
        numbers = self.numbers()
        if number is None:
            number = numbers[-1] if numbers else 0
        if number == 0:
            return Manifest(0, {})
        if number not in numbers:
            raise ValueError(f"{self.path} has no version {number}; there are {numbers}")
        found = json.loads(read_text(self.spark, self._manifest(number)))
        return Manifest(number, found["parts"], found["notes"])

    def new_folder(self) -> str:
        """The name of a folder, relative to the table, that no other run uses."""
        return f"runs/{uuid.uuid4().hex}"

    def commit(
        self, before: Manifest, changed: Mapping[str, str | None], notes: Mapping | None = None
    ) -> Manifest:
        """Make ``changed`` parts current, with all others as they were in ``before``.

        A part that is changed to None is dropped.
        """
        parts = {p: f for p, f in {**before.parts, **changed}.items() if f is not None}
        after = Manifest(before.number + 1, parts, dict(notes or {}))
        text = json.dumps({"parts": after.parts, "notes": after.notes})
        if not write_text_once(self.spark, self._manifest(after.number), text):
            raise RuntimeError(f"version {after.number} of {self.path} was committed by another run")
        return after

    def read(self, schema: T.StructType | str, parts=None, number: int | None = None) -> DataFrame:
        """The Parquet rows of a version, or of some of its parts. No other part is opened."""
        current = self.get(number).parts
        wanted = current if parts is None else [p for p in current if p in set(parts)]
        folders = sorted({f"{self.path}/{current[p]}" for p in wanted})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def clean(self, keep: int = 2) -> list[str]:
        """Remove what only older versions than the last ``keep`` use, and what failed runs left.

        Returns the folders removed. Not to be run while a version is being written.
        """
        numbers = self.numbers()
        kept = numbers[-keep:] if keep else []
        used = {folder.split("/")[1] for n in kept for folder in self.get(n).parts.values()}
        gone = [name for name in names_in(self.spark, f"{self.path}/runs") if name not in used]
        for number in numbers:
            if number not in kept:
                remove_path(self.spark, self._manifest(number))
        for name in gone:
            remove_path(self.spark, f"{self.path}/runs/{name}")
        return gone

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}{_SUFFIX}"
