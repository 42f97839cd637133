"""Queries over triples: filters, pairing, sampling and splits."""

import numpy as np
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from prefspark.operators import filters, pairing, quality, sampling, splits
from prefspark.operators.ranking import with_sorted_ordinal
from prefspark.plans import flows
from prefspark.shared_storage import staged
from prefspark.sources import readers

# ---------------------------------------------------------------- SQL building blocks


def pairs_sql(triples=fx.TRIPLES, min_len=10, negatives=None):
    """Pairs as a subquery, written with windows over the whole groups."""
    negatives = negatives or f"""
      SELECT input, output AS rejected FROM {triples} t
      WHERE category = 'negative' AND input IS NOT NULL
      QUALIFY row_number() OVER (
        PARTITION BY input ORDER BY md5(concat('44|', input, '|', ord)), ord) = 1"""
    return rf"""(
      SELECT p.input, p.output_concept,
             concat(E'### Instruction\n', p.input, E'\n\n### Steering Direction\n',
                    p.output_concept) AS prompt,
             p.chosen, n.rejected
      FROM (SELECT input, output_concept, output AS chosen FROM {triples} t
            WHERE category = 'positive' AND input IS NOT NULL AND output_concept IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY input, output_concept ORDER BY ord) = 1) p
      JOIN ({negatives}) n ON p.input = n.input
      WHERE length(p.chosen) >= {min_len} AND length(n.rejected) >= {min_len})"""


TEXT_TRIPLES = f"""(SELECT * FROM {fx.TRIPLES} f WHERE concept_genre = 'text'
  AND NOT coalesce(TRY_CAST(concept_id AS DOUBLE) IN (0,1,2,3,4,5,6,7,8,9), false))"""


def rank_sql(pairs):
    return f"""(
      SELECT output_concept, n,
             row_number() OVER (
               ORDER BY md5(concat('42|', output_concept)), output_concept) - 1 AS rank
      FROM (SELECT output_concept, count(*) OVER () AS n
            FROM (SELECT DISTINCT output_concept FROM {pairs} p)))"""


def split_sql(ranked):
    return f"""(
      SELECT output_concept,
             CASE WHEN rank < floor(CAST(0.75 AS DOUBLE) * n) THEN 'train'
                  WHEN rank < floor(CAST(0.75 AS DOUBLE) * n) + floor(CAST(0.10 AS DOUBLE) * n)
                  THEN 'valid' ELSE 'test' END AS split
      FROM {ranked} r)"""


def split_pairs_sql(pairs, ranked=None):
    return f"""(SELECT p.*, s.split FROM {pairs} p
      JOIN {split_sql(ranked or rank_sql(pairs))} s ON p.output_concept = s.output_concept)"""


# The position drawn from pools of 1, 2, 3, … rows under seed 44.
DRAWN = (
    0, 1, 2, 3, 0, 0, 5, 5, 6, 2, 8, 5, 7, 5, 5, 5,
    14, 16, 16, 15, 15, 16, 22, 18, 19, 8, 8, 8, 8, 23, 21, 21,
)
EXACT_NEGATIVES = f"""
  SELECT input, output AS rejected FROM (
    SELECT *, row_number() OVER (PARTITION BY input ORDER BY ord) - 1 AS ordinal,
           count(*) OVER (PARTITION BY input) AS n
    FROM {fx.TRIPLES} t WHERE category = 'negative') r
  JOIN (VALUES {", ".join(f"({n}, {k})" for n, k in enumerate(DRAWN, 1))}) d(n, k)
    ON r.n = d.n AND r.ordinal = d.k"""


def _permutation_values():
    rows = []
    for n in (85, 90, 95, 100):  # the numbers of concepts in the test tables
        order = np.random.default_rng(42).permutation(n)
        rows += [f"({n}, {rank}, {place})" for rank, place in enumerate(order)]
    return ", ".join(rows)


EXACT_PAIRS = pairs_sql(negatives=EXACT_NEGATIVES)
EXACT_RANK = f"""(
  SELECT c.output_concept, v.rank, v.n FROM (
    SELECT output_concept, count(*) OVER () AS n,
           row_number() OVER (ORDER BY first_input, output_concept) - 1 AS place
    FROM (SELECT output_concept, min(input) AS first_input FROM {EXACT_PAIRS} p GROUP BY 1)) c
  JOIN (VALUES {_permutation_values()}) v(n, rank, place) ON c.n = v.n AND c.place = v.place)"""

PAIRS = pairs_sql()

# ---------------------------------------------------------------- scans and filters


@query("SELECT event_type, props FROM events")
def scan_triples(spark, sf):
    return readers.read_triples(spark, f"{sf}/events.parquet", ["event_type", "props"])


@query("""
  SELECT event_type, props, 0 AS source, event_id AS ord FROM events
  UNION ALL
  SELECT event_type, props, 1 AS source, 1099511627776 + event_id AS ord FROM events""")
def scan_ordered(spark, sf):
    path = f"{sf}/events.parquet"
    return readers.read_ordered(spark, [path, path], ["event_type", "props"])


ID_TEXTS = """(
  SELECT event_id, CASE event_id % 9
    WHEN 0 THEN k WHEN 1 THEN concat(k, '.0') WHEN 2 THEN concat(' ', k, ' ')
    WHEN 3 THEN concat(k, 'e0') WHEN 4 THEN concat(k, 'd') WHEN 5 THEN concat('id', k)
    WHEN 6 THEN '' WHEN 7 THEN concat(k, 'x') END AS concept_id
  FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events))"""


@query(f"""
  SELECT * FROM {ID_TEXTS} t
  WHERE NOT coalesce(TRY_CAST(concept_id AS DOUBLE) IN (0,1,2,3,4,5,6,7,8,9), false)""")
def filter_concept_id(spark, sf):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 9
    text = (
        F.when(kind == 0, k)
        .when(kind == 1, F.concat(k, F.lit(".0")))
        .when(kind == 2, F.concat(F.lit(" "), k, F.lit(" ")))
        .when(kind == 3, F.concat(k, F.lit("e0")))
        .when(kind == 4, F.concat(k, F.lit("d")))
        .when(kind == 5, F.concat(F.lit("id"), k))
        .when(kind == 6, "")
        .when(kind == 7, F.concat(k, F.lit("x")))
    )
    ids = fx.table(spark, sf, "events").select("event_id", text.alias("concept_id"))
    return filters.exclude_concept_ids(ids)


@query("""
  SELECT event_id, event_type AS concept_genre FROM events
  WHERE event_id % 7 <> 0 AND event_type = 'view'""")
def filter_genre(spark, sf):
    genre = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    rows = fx.table(spark, sf, "events").select("event_id", genre.alias("concept_genre"))
    return filters.keep_genre(rows, "view")


@query(f"""
  SELECT input, output, output_concept, category, ord, 0 AS part FROM {TEXT_TRIPLES} a
  UNION ALL
  SELECT input, output, output_concept, category, ord, 1 AS part FROM {TEXT_TRIPLES} b""")
def union_parts(spark, sf):
    part = flows.text_triples(fx.triples(spark, sf))
    return filters.union_parts([part.withColumn("part", F.lit(i)) for i in range(2)])


@query("SELECT doc_id, text AS prompt, source AS chosen, lang AS rejected FROM documents")
def rename_columns(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return filters.rename_to_canonical(
        docs, {"prompt": "text", "chosen": "source", "rejected": "lang"}
    )


LINES = r"""(
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(E' \t\n', E'\n ')
                      WHEN doc_id % 4 = 1 THEN NULL ELSE text END AS text FROM documents)"""


@query(rf"SELECT * FROM {LINES} d WHERE length(trim(text, E' \t\n')) > 0")
def nonempty_filter(spark, sf):
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, " \t\n\n ").when(kind > 1, F.col("text"))
    docs = fx.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return filters.split_blank(docs, "text")[0]


# ---------------------------------------------------------------- pairing


@query(f"SELECT * FROM {PAIRS} p")
def pairs_build(spark, sf):
    return pairing.build_pairs(fx.triples(spark, sf))


@query(f"SELECT * FROM {pairs_sql(fx.DOC_TRIPLES)} p")
def pairs_build_documents(spark, sf):
    return pairing.build_pairs(fx.doc_triples(spark, sf))


@query(f"SELECT * FROM {pairs_sql(min_len=14)} p")
def pairs_minlen(spark, sf):
    return pairing.build_pairs(fx.triples(spark, sf), min_len=14)


@query(f"SELECT * FROM {EXACT_PAIRS} p")
def pairs_build_exact(spark, sf):
    return pairing.build_pairs(fx.triples(spark, sf), mode="exact")


@query(f"""
  SELECT *, row_number() OVER (ORDER BY input, output_concept) - 1 AS place
  FROM (SELECT input, output_concept FROM {PAIRS} p)""")
def pairs_sorted(spark, sf):
    keys = pairing.build_pairs(fx.triples(spark, sf)).select("input", "output_concept")
    return with_sorted_ordinal(keys, ["input", "output_concept"], "place")


@query(f"""
  SELECT input, output_concept, arg_min(output, ord) AS chosen FROM {fx.TRIPLES} t
  WHERE category = 'positive' GROUP BY ALL""")
def first_positive(spark, sf):
    return pairing.first_positive(fx.triples(spark, sf))


@query(f"""
  SELECT * FROM {fx.TRIPLES} t
  WHERE input IN (SELECT input FROM {fx.TRIPLES} n WHERE category = 'negative')""")
def inputs_with_negative(spark, sf):
    return pairing.inputs_with_negative(fx.triples(spark, sf))


@query(f"""
  SELECT input, output_concept FROM {fx.TRIPLES} t GROUP BY ALL
  HAVING count(*) FILTER (category = 'positive') = 0""")
def concepts_without_positive(spark, sf):
    return pairing.concepts_without_positive(fx.triples(spark, sf))


@query(f"""
  SELECT input, ord, row_number() OVER (PARTITION BY input ORDER BY ord) - 1 AS ordinal,
         count(*) OVER (PARTITION BY input) AS pool_size
  FROM {fx.TRIPLES} t WHERE category = 'negative'""")
def negative_ordinals(spark, sf):
    ordinals = pairing.negative_ordinals(fx.triples(spark, sf))
    return ordinals.select("input", "ord", "ordinal", "pool_size")


@query(f"SELECT * FROM ({EXACT_NEGATIVES}) n")
def sample_negative_exact(spark, sf):
    return pairing.sample_negative_exact(fx.triples(spark, sf))


@query(f"""
  SELECT input, arg_min(output, md5(concat('44|', input, '|', ord))) AS rejected
  FROM {fx.TRIPLES} t WHERE category = 'negative' GROUP BY input""")
def sample_negative_hash(spark, sf):
    return pairing.sample_negative_hash(fx.triples(spark, sf))


@query(f"SELECT count(DISTINCT input) AS n_inputs FROM {fx.TRIPLES} t")
def distinct_inputs(spark, sf):
    return pairing.distinct_inputs(fx.triples(spark, sf))


@query(f"""
  SELECT 'triples' AS stage, count(*) AS n_rows FROM {fx.TRIPLES} t
  UNION ALL SELECT 'filtered', count(*) FROM {TEXT_TRIPLES} t
  UNION ALL SELECT 'pairs', count(*) FROM {pairs_sql(TEXT_TRIPLES)} p""")
def stage_counts(spark, sf):
    steps = {"filtered": flows.text_triples, "pairs": pairing.build_pairs}
    return pairing.observed_counts(fx.triples(spark, sf), steps, "triples")


# ---------------------------------------------------------------- splits


@query(f"SELECT output_concept, min(input) AS first_input FROM {PAIRS} p GROUP BY ALL")
def distinct_concepts(spark, sf):
    return splits.distinct_concepts(pairing.build_pairs(fx.triples(spark, sf)))


@query(f"SELECT output_concept, rank, n FROM {rank_sql(PAIRS)} r")
def concept_rank(spark, sf):
    return splits.concept_rank(pairing.build_pairs(fx.triples(spark, sf)))


@query(f"""
  SELECT output_concept, CAST(rank AS BIGINT) AS rank, CAST(n AS BIGINT) AS n
  FROM {EXACT_RANK} r""")
def concept_rank_exact(spark, sf):
    pairs = pairing.build_pairs(fx.triples(spark, sf), mode="exact")
    return splits.concept_rank(pairs, mode="exact")


@query(f"SELECT * FROM {split_sql(rank_sql(PAIRS))} s")
def split_concepts(spark, sf):
    return splits.split_concepts(pairing.build_pairs(fx.triples(spark, sf)))


@query(f"SELECT * FROM {split_pairs_sql(PAIRS)} s")
def split_pairs(spark, sf):
    return splits.split_pairs(staged(pairing.build_pairs(fx.triples(spark, sf)), "pairs"))


@query(f"SELECT * FROM {split_pairs_sql(EXACT_PAIRS, EXACT_RANK)} s")
def split_pairs_exact(spark, sf):
    return splits.split_pairs(
        pairing.build_pairs(fx.triples(spark, sf), mode="exact"), mode="exact"
    )


@query(f"""
  SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split,
         count(*) AS n_pairs, count(DISTINCT output_concept) AS n_concepts
  FROM {split_pairs_sql(PAIRS)} s GROUP BY ROLLUP (split)""")
def split_stats(spark, sf):
    return splits.split_stats(splits.split_pairs(pairing.build_pairs(fx.triples(spark, sf))))


# A split by prompt, not by concept, leaks: both audits have something to find.
LEAKY = f"""(SELECT output_concept, CASE WHEN length(input) % 2 = 0 THEN 'train' ELSE 'test' END
             AS split FROM {PAIRS} p)"""


def _leaky(spark, sf):
    pairs = pairing.build_pairs(fx.triples(spark, sf))
    even = F.length("input") % 2 == 0
    return pairs.select("output_concept", F.when(even, "train").otherwise("test").alias("split"))


@query(f"""
  SELECT output_concept, count(DISTINCT split) AS n_splits FROM {LEAKY} s
  GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leakage(spark, sf):
    return splits.split_leakage(_leaky(spark, sf))


@query(f"""
  SELECT output_concept, count(DISTINCT split) AS n_splits FROM {split_pairs_sql(PAIRS)} s
  GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leakage_none(spark, sf):
    pairs = pairing.build_pairs(fx.triples(spark, sf))
    return splits.split_leakage(splits.split_pairs(pairs))


TRIPLE_CONCEPTS = f"(SELECT DISTINCT output_concept FROM {fx.TRIPLES} t)"
TEXT_CONCEPTS = f"(SELECT DISTINCT output_concept FROM {pairs_sql(TEXT_TRIPLES)} p)"


@query(f"""
  SELECT output_concept, 'missing' AS problem
  FROM (SELECT * FROM {TRIPLE_CONCEPTS} a EXCEPT SELECT * FROM {TEXT_CONCEPTS} b)
  UNION ALL
  SELECT output_concept, 'unexpected' AS problem
  FROM (SELECT * FROM {TEXT_CONCEPTS} a EXCEPT SELECT * FROM {TRIPLE_CONCEPTS} b)""")
def split_coverage(spark, sf):
    triples = fx.triples(spark, sf)
    return splits.split_coverage(flows.flow_a(triples), triples)


@query(f"""
  SELECT coalesce(s.output_concept, u.output_concept) AS output_concept,
         coalesce(n, 0) AS n_splits,
         CASE WHEN n > 1 THEN 'leaks' WHEN n IS NULL THEN 'missing' ELSE 'unexpected' END
           AS problem
  FROM (SELECT output_concept, count(DISTINCT split) AS n FROM {LEAKY} l GROUP BY 1) s
  FULL JOIN {TEXT_CONCEPTS} u ON s.output_concept = u.output_concept
  WHERE n > 1 OR n IS NULL OR u.output_concept IS NULL""")
def split_audit(spark, sf):
    triples = fx.triples(spark, sf)
    return splits.split_audit(_leaky(spark, sf), flows.flow_a(triples))


# ---------------------------------------------------------------- samples and flows


@query("""
  SELECT doc_id, text FROM documents
  ORDER BY md5(concat('42|', doc_id)), doc_id LIMIT 500""")
def limit_sample(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return sampling.limit_sample(docs, 500, 42, ["doc_id"])


# Repeated keys, of which some are null; a sample of more than half of them.
KEYS = """(SELECT CASE WHEN event_id % 5 > 0 THEN event_id // 3 END AS k FROM events)"""
MOST = "(SELECT count(*) * 3 // 5 FROM events)"


def _keys(spark, sf):
    key = F.when(F.col("event_id") % 5 > 0, F.expr("event_id div 3"))
    return fx.table(spark, sf, "events").select(key.alias("k"))


@query(f"""
  SELECT 'keyed' AS way, k FROM {KEYS} a
  QUALIFY row_number() OVER (ORDER BY md5(concat('42|', coalesce(k::VARCHAR, '\\N')))) <= {MOST}
  UNION ALL
  SELECT 'whole row', k FROM {KEYS} b
  QUALIFY row_number() OVER (
    ORDER BY md5(concat('42|{{', '"k":' || k, '}}'))) <= {MOST}""")
def limit_sample_large(spark, sf):
    keys = _keys(spark, sf)
    count = keys.count() * 3 // 5
    ways = {"keyed": ["k"], "whole row": []}
    parts = [
        sampling.limit_sample(keys, count, 42, ids).withColumn("way", F.lit(way))
        for way, ids in ways.items()
    ]
    return parts[0].unionByName(parts[1])


@query(f"SELECT k FROM {KEYS} a")
def limit_sample_all(spark, sf):
    return sampling.limit_sample(_keys(spark, sf), 1 << 40, 42, ["k"])


@query(f"SELECT * FROM {split_pairs_sql(pairs_sql(TEXT_TRIPLES))} s")
def flow_a(spark, sf):
    return flows.flow_a(fx.triples(spark, sf))


@query(f"SELECT * FROM {split_pairs_sql(PAIRS)} s")
def flow_b(spark, sf):
    return flows.flow_b(fx.triples(spark, sf))


TEXT_NEGATIVES = EXACT_NEGATIVES.replace(fx.TRIPLES, TEXT_TRIPLES)
TEXT_PAIRS = pairs_sql(TEXT_TRIPLES, negatives=TEXT_NEGATIVES)


TEXT_RANK = EXACT_RANK.replace(EXACT_PAIRS, TEXT_PAIRS)


@query(f"SELECT * FROM {split_pairs_sql(TEXT_PAIRS, TEXT_RANK)} s")
def flow_a_exact(spark, sf):
    return flows.flow_a(fx.triples(spark, sf), mode="exact")


def broken_records(spark, sf):
    """Pair records of which some are refused, for a reason that depends on the event."""
    event, text = F.col("event_id"), F.col("event_type")
    good = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    no_role = F.array(F.struct(F.lit(None).cast("string").alias("role"), text.alias("content")))
    no_content = F.array(
        F.struct(F.lit("user").alias("role"), text.alias("content")),
        F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content")),
    )
    prompt = (
        F.when(event % 7 == 0, F.slice(good, 1, 0))
        .when(event % 7 == 2, no_content)
        .when(event % 7 == 3, no_role)
        .when(event % 7 > 3, good)
    )
    rejected = F.when(event % 11 > 0, good)
    return fx.table(spark, sf, "events").select(
        "event_id", prompt.alias("prompt"), good.alias("chosen"), rejected.alias("rejected")
    )


VIOLATIONS = """(
  SELECT event_id, 'prompt' AS "column",
         CASE WHEN event_id % 7 < 2 THEN 'must be a non-empty list of messages'
              ELSE 'contains a message without role or content' END AS reason
  FROM events WHERE event_id % 7 <= 3
  UNION ALL
  SELECT event_id, 'rejected', 'must be a non-empty list of messages'
  FROM events WHERE event_id % 11 = 0)"""


@query(f"SELECT * FROM {VIOLATIONS} v")
def validate_pairs(spark, sf):
    return quality.validate_pairs(broken_records(spark, sf), ["event_id"])


@query(f"""
  SELECT * FROM {VIOLATIONS} v
  WHERE event_id IN (SELECT event_id FROM events ORDER BY event_id LIMIT 20)""")
def validate_prefix(spark, sf):
    first = sampling.prefix(broken_records(spark, sf), "event_id")
    return quality.validate_pairs(first, ["event_id"])
