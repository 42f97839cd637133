"""From raw documents to packed sequences: five corpus operators, one after the other.

Each stage is written as Parquet, and the next one reads what it wrote. All but the last
return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from prefspark.llm import language_id, mixing, near_dup, packing, substring_dedup
from prefspark.llm.common import set_aside
from prefspark.shared_storage import new_table_path, staged

SIMILARITY_PERCENT = 80
# Bits that a text as it stands has to be shorter than its best code to count as noise. Few bytes
# are no evidence, so short texts are safe.
NOISE_BITS = 64.0
# Words of a block of the mixture: long enough to keep most documents whole or nearly so.
BLOCK_WORDS = 1024

# No SQL for scores, samples and packing; the stages are tested one by one.
ORACLE_SQL = None


def identify_languages(spark, docs, sf_dir):
    """Drops documents without a language and sets ``lang`` of the others to the one found.

    Without a language are texts that are null, empty or without a letter, and those whose
    shortest code is longer than the text itself by more than NOISE_BITS: every language that
    is learned foretells them worse than chance. Repeated rows are judged alike, texts of any length whole; other
    columns, of whatever name, stay as they are. Without rows with a known language, as in an
    empty table, no document has one.
    """
    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    texts, whole = set_aside(docs, "doc_id", "text", "lang")
    found = language_id.identify(texts, language_id.fit(learned))
    excess = (F.col("bits_per_byte") - 8) * F.octet_length("text")
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (excess <= NOISE_BITS)
    return whole(found.where(known).withColumn("lang", F.col("lang_pred")))


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id.

    Rows are told apart, so of repeated rows, of different texts with the same doc_id and of
    equal texts without one, each is judged on its own; a null doc_id comes last, and among
    equal ones any row may stay. Texts without a word are linked with nothing and all stay.
    Texts of any length are compared whole; an empty table stays empty.
    """
    named, whole = set_aside(docs, "doc_id", "text")
    rows = staged(named.withColumn("row", F.monotonically_increasing_id()), "corpus-rows")
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    found = near_dup.near_duplicates(texts, SIMILARITY_PERCENT)
    found = found.select(F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row").alias("first")
    grouped = rows.select("row", first).join(found, "row").groupBy("component_id")
    kept = grouped.agg(F.min("first").alias("first")).select("first.row")
    return whole(rows.join(kept, "row"))


def cut_repeated_passages(spark, docs, sf_dir):
    """Cuts passages of 50 words and more that an earlier document has, too.

    All documents stay, null and empty texts as they are. Rows with the same doc_id, repeated
    rows among them, cut nothing from one another; a null doc_id counts as the last one.
    """
    return substring_dedup.without_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    """Takes each source as often as its target weight asks for, in blocks.

    A document gives a row for each part of it that is taken, whole documents their text as it
    is. Rows without a source are a source; null and empty texts have nothing to take; repeated
    rows count each; long texts are taken in parts; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, block_words=BLOCK_WORDS)


def pack(spark, docs, sf_dir):
    """Packs what is left into sequences of 1024 tokens: a row for each piece.

    A null text is packed as an empty one, longer ones than a sequence in pieces, repeated rows
    each; other columns are not read.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_table_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
