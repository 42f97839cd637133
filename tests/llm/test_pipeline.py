"""The stages one after the other, each against its rule, and the entry points without them."""

import os
import shutil
import subprocess
import sys
import zlib

import corpus_pipeline as P

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, tables = docs.columns, [docs]
    for name, stage in P.STAGES:
        stage(spark, tables[-1], SF_DIR).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
        assert name == P.STAGES[-1][0] or tables[-1].columns == names
    raw, identified, single, cut, mixed, packed = [t.toPandas() for t in tables]
    lettered = raw[raw["text"].map(lambda t: bool(t) and any(c.isalpha() for c in t))]
    assert sorted(identified["doc_id"]) == sorted(lettered["doc_id"])
    assert set(single["doc_id"]) <= set(identified["doc_id"]) and 0 < len(single) < len(identified)
    assert sorted(cut["doc_id"]) == sorted(single["doc_id"]) and cut["n_chars"].sum() < single["n_chars"].sum()
    assert set(mixed["doc_id"]) <= set(cut["doc_id"])
    words = lambda frame: sum(len(t.split()) for t in frame["text"])
    assert abs(words(mixed) / words(cut) - 1) < 0.1
    assert packed["length"].sum() >= words(mixed) and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert P.run(spark, SF_DIR).count() == len(packed)


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


CLASHES = (
    "lang_pred", "score", "bits_per_byte", "_row", "_text", "_words", "_part", "_parts", "_time", "_id", "_key",
    "row", "id", "text_key", "missing", "component_id", "first", "new_text", "other column 0", "_ROW",
)


def test_stages_keep_rows_apart_and_other_columns(spark, docs):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"), (1, words, "en", "a"), (2, words + " more", "en", "a"), (None, words, "en", None),
        (3, "another text of its own kind", "en", "b"), (3, "a different text, under the same id", "en", "b"),
        (None, "a text without an id", None, "b"), (None, "a text without an id", None, "b"),
        (4, None, "en", "a"), (5, "", "en", "a"), (6, "12 34 --", "en", "a"), (9, "long " * 40_000, "en", "b"),
    ]
    table = docs(rows)
    # Two of the names differ only in their case, which a file can't hold.
    table = table.selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in CLASHES[:-1]))
    kept = []
    for name, stage in P.STAGES[:-1]:
        table = stage(spark, table, SF_DIR)
        assert table.columns == [*docs(rows).columns, *CLASHES[:-1]], name
        path = P.new_table_path(spark, "clash")
        table.write.parquet(path)
        table = spark.read.parquet(path)
        found = table.collect()
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in found for c in CLASHES[:-1])
        kept.append(sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in found))
    identified, single = kept[0], kept[1]
    assert len(identified) == 9 and {r["lang"] for r in found} == {"en"}
    expected = [(0, "a text wi"), (1, "word0 wor"), (3, "a differe"), (3, "another t"), (9, "long long")]
    assert single == expected
    assert P.STAGES[-1][1](spark, table, SF_DIR).count() > 0


def test_noise_has_no_language(spark, docs):
    import random

    rng = random.Random(1)
    letters = [chr(c) for c in range(0x4E00, 0x9000)]
    noise = "".join(rng.choice(letters) for _ in range(500))
    rows = [(i, f"plain words that are said again and again, number {i}", "en") for i in range(40)]
    # Ids whose rows are not learned from.
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    rows += list(zip(held, (noise, "plain words again", "Ω."), ("en", "fr", "en")))
    found = {r["doc_id"]: r["lang"] for r in P.identify_languages(spark, docs(rows), SF_DIR).collect()}
    assert found == {**dict.fromkeys(range(40), "en"), held[1]: "en", held[2]: "en"}


def test_entry_points_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(REPO, copy, ignore=skip)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'flow_b' in names and 'pipeline' not in names; e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
