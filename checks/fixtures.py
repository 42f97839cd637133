"""Tables in the shape the operators expect, derived from the given Parquet tables.

Every fixture exists twice: as a DataFrame and as a SQL subquery over the same tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as triples: users ask, the key in the properties is the concept."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("input"),
        F.concat(F.lit("event no. "), F.col("event_id").cast("string")).alias("output"),
        F.concat(F.lit("k"), k).alias("output_concept"),
        F.when(kind.isin("click", "purchase"), "positive")
        .when(kind == "error", "negative")
        .otherwise("other")
        .alias("category"),
        F.when(kind == "view", "code").otherwise("text").alias("concept_genre"),
        k.alias("concept_id"),
        F.col("event_id").alias("ord"),
    )


TRIPLES = """(
  SELECT concat('user ', user_id) AS input,
         concat('event no. ', event_id) AS output,
         concat('k', json_extract_string(props, '$.k')) AS output_concept,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'other' END AS category,
         CASE WHEN event_type = 'view' THEN 'code' ELSE 'text' END AS concept_genre,
         json_extract_string(props, '$.k') AS concept_id,
         event_id AS ord
  FROM events)"""


def doc_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as triples: real texts, few prompts with many outputs each."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("source").alias("input"),
        F.col("text").alias("output"),
        F.col("lang").alias("output_concept"),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("category"),
        F.col("doc_id").alias("ord"),
    )


DOC_TRIPLES = """(
  SELECT source AS input, text AS output, lang AS output_concept,
         CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS category,
         doc_id AS ord
  FROM documents JOIN labels USING (doc_id))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


TURNS = "(SELECT conv_id, turn, role, text AS content FROM conversations)"


def thinking_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with think tags in assistant turns and tool wrappers around some user turns."""
    text, kind = F.col("text"), (F.col("conv_id") + F.col("turn")) % 5
    tagged = (
        F.when(
            kind == 0, F.concat(F.lit("<think>\n"), text, F.lit("\n</think>\n\nAnswer "), "turn")
        )
        .when(kind == 1, F.concat(F.lit("<think>\n\n</think>\n\n"), text))
        .when(
            kind == 2,
            F.concat(F.lit("<think>a</think>b<think>\n\nc"), text, F.lit("\n\n</think>\n\nd")),
        )
        .when(kind == 3, F.concat(text, F.lit("\n</think>\nno opening")))
        .otherwise(text)
    )
    wrapped = F.concat(F.lit("<tool_response>\n"), text, F.lit("\n</tool_response>"))
    content = (
        F.when(F.col("role") == "assistant", tagged)
        .when((F.col("role") == "user") & (F.col("turn") % 3 == 2), wrapped)
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", content.alias("content")
    )


THINKING_TURNS = r"""(
  SELECT conv_id, turn, role,
    CASE WHEN role = 'assistant' THEN
      CASE (conv_id + turn) % 5
        WHEN 0 THEN concat(E'<think>\n', text, E'\n</think>\n\nAnswer ', turn)
        WHEN 1 THEN concat(E'<think>\n\n</think>\n\n', text)
        WHEN 2 THEN concat(E'<think>a</think>b<think>\n\nc', text, E'\n\n</think>\n\nd')
        WHEN 3 THEN concat(text, E'\n</think>\nno opening')
        ELSE text END
    WHEN role = 'user' AND turn % 3 = 2
      THEN concat(E'<tool_response>\n', text, E'\n</tool_response>')
    ELSE text END AS content
  FROM conversations)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steering requests: documents ask, their source steers, the id picks model and mode."""
    doc = F.col("doc_id")
    model = (
        F.when(doc % 5 == 0, "Qwen/Qwen3-4B")
        .when(doc % 5 == 1, "google/gemma-2-9b-it")
        .when(doc % 5 == 2, "meta-llama/Llama-3.2-3B-Instruct")
        .when(doc % 5 == 3, "local/GEMMA-copy")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("question"),
        F.concat(F.lit("\n"), "source", F.lit("  ")).alias("direction"),
        model.alias("model"),
        (doc % 2 == 0).alias("reverse"),
        F.when(doc % 3 == 0, F.lit("You are a helpful assistant."))
        .when(doc % 3 == 1, F.lit(""))
        .alias("system"),
        F.when(doc % 7 < 2, doc % 7 == 0).alias("override"),
        F.when(doc % 11 < 6, doc % 11 < 3).alias("configured"),
    )


REQUESTS = r"""(
  SELECT doc_id, concat(E' \t', text, E'\n') AS question,
         concat(E'\n', source, '  ') AS direction,
         CASE doc_id % 5 WHEN 0 THEN 'Qwen/Qwen3-4B' WHEN 1 THEN 'google/gemma-2-9b-it'
              WHEN 2 THEN 'meta-llama/Llama-3.2-3B-Instruct'
              WHEN 3 THEN 'local/GEMMA-copy' END AS model,
         doc_id % 2 = 0 AS reverse,
         CASE doc_id % 3 WHEN 0 THEN 'You are a helpful assistant.' WHEN 1 THEN '' END AS system,
         CASE WHEN doc_id % 7 < 2 THEN doc_id % 7 = 0 END AS override,
         CASE WHEN doc_id % 11 < 6 THEN doc_id % 11 < 3 END AS configured
  FROM documents)"""
