import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table of (doc_id, text[, lang[, source]]) rows."""

    def build(rows, schema=DOCS):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] else None) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus
