"""Queries over tables that grow, outputs that change as a whole, and positions without keys."""

from collections import Counter

import pyarrow.compute as pc
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.chat_queries import flat_records, flat_records_sql
from checks.io_queries import filed_triples_sql, write_filed_triples
from checks.pair_queries import PAIRS, VIOLATIONS, broken_records, pairs_sql, split_pairs_sql
from checks.registry import query
from prefspark.functions.permutation import ROUNDS, permuted
from prefspark.operators import pairing, routing, scoring, sketches, splits, user_aggregates
from prefspark.operators.preference import pair_records
from prefspark.plans import flows
from prefspark.plans.incremental import ConceptSplits, PickState, prepare_batch
from prefspark.schema import missing_columns
from prefspark.shared_storage import new_table_path
from prefspark.sources import publishing, readers, writers

BATCHES = 3

# ---------------------------------------------------------------- growing pairs and splits


@query(f"SELECT * FROM {PAIRS} p")
def pairs_incremental(spark, sf):
    """Pairs of events that come in batches, no batch being a range: as of all at once."""
    triples = fx.triples(spark, sf)
    state = PickState(spark, new_table_path(spark, "picks"), buckets=16)
    for batch in range(BATCHES):
        state.merge(triples.where(F.col("ord") % BATCHES == batch), f"batch-{batch}")
    return state.pairs()


# Many concepts, of which each batch brings some more.
CONCEPTS = """(
  SELECT concat(json_extract_string(props, '$.k'), '-', user_id % 40) AS output_concept,
         (event_id * 7) % 10 AS part FROM events)"""
# Parts of the events by batch: a first batch, one without anything new, and a larger one.
ARRIVALS = ((0, 1), (1,), (2, 3, 4, 5, 6, 7, 8, 9))


def _concepts(spark, sf):
    k = F.get_json_object("props", "$.k")
    return fx.table(spark, sf, "events").select(
        F.concat(k, F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("output_concept"),
        ((F.col("event_id") * 7) % 10).alias("part"),
    )


def stable_splits_sql(concepts):
    """CTEs a0, a1, …: (output_concept, split) after each batch of ``concepts`` (SQL texts)."""
    steps = ["a_ AS (SELECT '' AS output_concept, '' AS split WHERE false)"]
    for i, arriving in enumerate(concepts):
        before = f"a{i - 1}" if i else "a_"
        steps.append(f"""
h{i} AS (
  SELECT count(*) AS n, count(*) FILTER (split = 'train') AS train,
         count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test
  FROM {before}
), n{i} AS (
  SELECT output_concept, count(*) OVER () AS new,
         row_number() OVER (ORDER BY md5(concat('42|', output_concept)), output_concept) - 1 AS rank
  FROM (SELECT DISTINCT output_concept FROM ({arriving}) c
        WHERE output_concept NOT IN (SELECT output_concept FROM {before}))
), l{i} AS (
  SELECT output_concept, rank, floor(0.75::DOUBLE * (n + new)) - train AS t,
         floor(0.10::DOUBLE * (n + new)) - valid AS v,
         n + new - floor(0.75::DOUBLE * (n + new)) - floor(0.10::DOUBLE * (n + new)) - test AS e
  FROM n{i} CROSS JOIN h{i}
), q{i} AS (
  SELECT output_concept, rank, greatest(t, 0) AS t, greatest(v, 0) AS v,
         greatest(-t, 0) + greatest(-v, 0) + greatest(-e, 0) AS beyond FROM l{i}
), a{i} AS (
  SELECT * FROM {before} UNION ALL
  SELECT output_concept,
         CASE WHEN rank < t - least(beyond, t) THEN 'train'
              WHEN rank < t - least(beyond, t) + v - least(beyond - least(beyond, t), v)
              THEN 'valid' ELSE 'test' END
  FROM q{i})""")
    return "WITH " + ",".join(steps)


ARRIVING = [
    f"SELECT output_concept FROM {CONCEPTS} c WHERE part IN ({', '.join(map(str, parts))})"
    for parts in ARRIVALS
]


@query(f"""
  {stable_splits_sql(ARRIVING)}
  {" UNION ALL ".join(f"SELECT {i} AS batch, * FROM a{i}" for i in range(len(ARRIVALS)))}""")
def split_stable(spark, sf):
    """The split of every concept after each batch: those of before, and the new ones."""
    concepts, table = _concepts(spark, sf), ConceptSplits(spark, new_table_path(spark, "splits"))
    after = []
    for batch, parts in enumerate(ARRIVALS):
        table.assign(concepts.where(F.col("part").isin(*parts)), f"batch-{batch}")
        number = F.lit(batch).alias("batch")
        after.append(table.assignment(batch + 1).select(number, "output_concept", "split"))
    return after[0].unionByName(after[1]).unionByName(after[2])


GROWN = [pairs_sql(f"(SELECT * FROM {filed_triples_sql()} g WHERE ord >> 40 < {n})") for n in (3, 8)]


@query(
    stable_splits_sql([f"SELECT output_concept FROM {p} p" for p in GROWN])
    + flat_records_sql(f"(SELECT p.*, split FROM {GROWN[1]} p JOIN a1 USING (output_concept))", "split, ")
)
def prepare_batches(spark, sf):
    """Files that arrive in two batches, the second one twice, to published splits."""
    out, paths = new_table_path(spark, "growing"), write_filed_triples(spark, sf)
    for batch, files in (("first", paths[:3]), ("second", paths[3:]), ("second", paths[3:])):
        prepare_batch(spark, files, out, batch)
    parts = [
        flat_records(publishing.read_published(spark, f"{out}/splits", s).withColumn("split", F.lit(s)), "split")
        for s in splits.SPLITS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- outputs as a whole


@query(
    f"SELECT 1 AS version, * FROM ({flat_records_sql(split_pairs_sql(pairs_sql(min_len=14)), 'split, ')}) a"
    f" UNION ALL SELECT 2, * FROM ({flat_records_sql(split_pairs_sql(PAIRS), 'split, ')}) b"
)
def published_versions(spark, sf):
    """Two versions of published splits, both of them readable."""
    path = new_table_path(spark, "published")
    for min_len in (14, 10):
        pairs = flows.flow_b(fx.triples(spark, sf), min_len=min_len)
        publishing.publish_splits(pair_records(pairs, "split"), path)
    parts = [
        flat_records(
            publishing.read_published(spark, path, s, number=n).select(
                F.lit(n).alias("version"), F.lit(s).alias("split"), "*"
            ),
            "version",
            "split",
        )
        for n in (1, 2)
        for s in splits.SPLITS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("""
  SELECT 'run' AS experiment, batch, event_id AS step, value AS loss
  FROM (SELECT *, concat('part-', event_id % 3) AS batch FROM events)""")
def metric_log_once(spark, sf):
    """Three batches of records, each handed in twice."""
    path, rows = new_table_path(spark, "log"), fx.table(spark, sf, "events")
    for batch in (0, 1, 1, 2, 0, 2):
        records = rows.where(F.col("event_id") % 3 == batch).select(
            F.lit("trainer").alias("type"),
            F.col("event_id").alias("step"),
            F.create_map(F.lit("loss"), F.col("value")).alias("metrics"),
        )
        writers.append_metrics_once(records, path, "run", f"part-{batch}")
    log = writers.read_metrics(spark, path)
    return log.select("experiment", "batch", "step", F.col("metrics")["loss"].alias("loss"))


@query(f"""
  SELECT e.event_id, coalesce(string_agg(concat(v."column", ' ', v.reason), '; ' ORDER BY v."column")
           FILTER (v.reason IS NOT NULL), '')
         AS refusals
  FROM events e LEFT JOIN {VIOLATIONS} v ON e.event_id = v.event_id GROUP BY e.event_id""")
def route_pairs(spark, sf):
    """Accepted and refused pair records of one pass."""
    routed = routing.route_pairs(broken_records(spark, sf), new_table_path(spark, "routed"))
    refused = routed.refused.select("event_id", F.array_join("refusals", "; ").alias("refusals"))
    return routed.accepted.select("event_id", F.lit("").alias("refusals")).unionByName(refused)


ODD_PROMPTS = r"""(
  SELECT conv_id, turn, kind, CASE kind
    WHEN 0 THEN text
    WHEN 1 THEN concat('{"role":"user","content":', turn, '.50,"role":', to_json(role), '}')
    WHEN 2 THEN concat('[{"content":"a","role":"user","content":', to_json(text), '}]')
    WHEN 3 THEN concat('{"role":"user","content":"x"} ', turn)
    WHEN 4 THEN '[1, 2]'
    WHEN 5 THEN '{"role":"user"}'
    WHEN 6 THEN '[ ]' END AS prompt, text, role
  FROM (SELECT *, (conv_id + turn) % 8 AS kind FROM conversations))"""


def _odd_prompts(spark, sf):
    kind, body = (F.col("conv_id") + F.col("turn")) % 8, F.col("text")
    # A JSON string: the value of a field, without what is around it.
    quoted = lambda c: F.substring(
        F.to_json(F.struct(F.col(c).alias("v"))), F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6
    )
    turn = F.col("turn").cast("string")
    prompt = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit('{"role":"user","content":'), turn, F.lit('.50,"role":'), quoted("role"), F.lit("}")))
        .when(kind == 2, F.concat(F.lit('[{"content":"a","role":"user","content":'), quoted("text"), F.lit("}]")))
        .when(kind == 3, F.concat(F.lit('{"role":"user","content":"x"} '), turn))
        .when(kind == 4, "[1, 2]")
        .when(kind == 5, '{"role":"user"}')
        .when(kind == 6, "[ ]")
    )
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query(rf"""
  SELECT conv_id, turn,
         CASE WHEN kind IN (0, 2, 3) THEN 'user' WHEN kind = 1 THEN role END AS role,
         CASE kind WHEN 0 THEN text WHEN 1 THEN concat(turn, '.5') WHEN 2 THEN text
              WHEN 3 THEN prompt END AS content,
         CASE kind WHEN 4 THEN 'prompt list holds an item without role and content'
              WHEN 5 THEN 'prompt object lacks role or content'
              WHEN 6 THEN 'prompt list is empty' WHEN 7 THEN 'prompt is null' ELSE '' END AS refusals
  FROM {ODD_PROMPTS} p""")
def route_prompts(spark, sf):
    """Prompts with repeated keys, numbers and what is no message, in one pass."""
    routed = routing.route_prompts(_odd_prompts(spark, sf), new_table_path(spark, "routed"))
    first = F.get("messages", F.lit(0))
    accepted = routed.accepted.select(
        "conv_id", "turn", first["role"].alias("role"), first["content"].alias("content"), F.lit("").alias("refusals")
    )
    nothing = F.lit(None).cast("string")
    return accepted.unionByName(
        routed.refused.select(
            "conv_id", "turn", nothing.alias("role"), nothing.alias("content"), F.array_join("refusals", "; ").alias("refusals")
        )
    )


@query("""
  SELECT 'accepted' AS side, count(*) FILTER (doc_id % 4 > 1) AS n_rows FROM documents
  UNION ALL SELECT 'refused', count(*) FILTER (doc_id % 4 < 2) FROM documents
  UNION ALL SELECT 'text is blank', count(*) FILTER (doc_id % 4 < 2) FROM documents
  UNION ALL SELECT 'source is blank', count(*) FILTER (source IS NULL) FROM documents""")
def route_counts(spark, sf):
    """What the one pass has counted: rows of both sides and of each reason."""
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, " \t\n ").when(kind > 1, F.concat(F.lit("-"), "text"))
    docs = fx.table(spark, sf, "documents").withColumn("text", text)
    counts = routing.route(docs, routing.blank_reasons("text", "source"), new_table_path(spark, "routed")).counts
    return spark.createDataFrame(list(counts.items()), "side string, n_rows long")


# ---------------------------------------------------------------- positions and orders


def permuted_sql(value, n, seed=42):
    """Where ``value`` comes in the seeded order of 0 to n - 1, once around: SQL text."""
    first, second = f"(({value}) // bb)", f"(({value}) % bb)"
    for number in range(ROUNDS):
        digit, base, other = (first, "aa", second) if number % 2 == 0 else (second, "bb", first)
        hashed = f"('0x' || substr(md5('{seed}|{number}|' || {other}), 1, 8))::BIGINT"
        moved = f"(({digit} + {hashed}) % {base})"
        first, second = (moved, second) if number % 2 == 0 else (first, moved)
    return f"{first} * bb + {second}"


@query(f"""
  WITH RECURSIVE size AS (
    SELECT n, ceil(sqrt(n))::BIGINT AS aa, ceil(n / ceil(sqrt(n)))::BIGINT AS bb
    FROM (SELECT count(*) AS n FROM events)
  ), walk AS (
    SELECT event_id, {permuted_sql("event_id", "n")} AS place, n, aa, bb FROM events CROSS JOIN size
    UNION ALL
    SELECT event_id, {permuted_sql("place", "n")}, n, aa, bb FROM walk WHERE place >= n
  )
  SELECT event_id, place FROM walk WHERE place < n""")
def permuted_order(spark, sf):
    """The place of each event in a seeded order: an expression, no sort and no shuffle."""
    events = fx.table(spark, sf, "events")
    return events.select("event_id", permuted(F.col("event_id"), events.count()).alias("place"))


APPEARANCE = f"""(
  SELECT output_concept, row_number() OVER (ORDER BY first_input, output_concept) - 1 AS appearance,
         count(*) OVER () AS n
  FROM (SELECT output_concept, min(input) AS first_input FROM {PAIRS} p GROUP BY 1))"""


@query(f"""
  WITH RECURSIVE size AS (
    SELECT *, ceil(sqrt(n))::BIGINT AS aa, ceil(n / ceil(sqrt(n)))::BIGINT AS bb FROM {APPEARANCE} a
  ), walk AS (
    SELECT output_concept, {permuted_sql("appearance", "n")} AS rank, n, aa, bb FROM size
    UNION ALL
    SELECT output_concept, {permuted_sql("rank", "n")}, n, aa, bb FROM walk WHERE rank >= n
  )
  SELECT output_concept, rank, n FROM walk WHERE rank < n""")
def concept_rank_permuted(spark, sf):
    """The seeded order of concepts by a permutation of their places, not held in one task."""
    return splits.concept_rank(pairing.build_pairs(fx.triples(spark, sf)), "permuted")


@query("""
  SELECT d.position, d.text, e.label, l.toxic
  FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) d
  JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) e
    ON d.position = e.position
  JOIN (SELECT toxic, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels) l
    ON d.position = l.position""")
def zip_positions(spark, sf):
    """Three tables in files without a key, row by row, as long as the shortest one."""
    path, parts = new_table_path(spark, "zip"), []
    for name, key, column in (("documents", "doc_id", "text"), ("embeddings", "vec_id", "label"), ("labels", "doc_id", "toxic")):
        rows = fx.table(spark, sf, name).repartitionByRange(5, key).sortWithinPartitions(key)
        rows.select(column).write.parquet(f"{path}/{name}")
        parts.append(readers.read_positions(spark, f"{path}/{name}"))
    return scoring.zip_positions(parts)


# ---------------------------------------------------------------- scores and counts


class LengthMedian:
    """Median length and number of texts: a state of one count for each length."""

    def init(self):
        return Counter()

    def update(self, state, rows):
        lengths = pc.fill_null(pc.utf8_length(rows.column("output")), 0).to_pylist()
        return state + Counter(lengths)

    def merge(self, state, other):
        return state + other

    def finish(self, state):
        total, seen, middle = sum(state.values()), 0, []
        for length in sorted(state):
            seen += state[length]
            # The rows around the middle: one of them, or two whose mean counts.
            if not middle and 2 * seen >= total:
                middle.append(length)
            if 2 * seen > total:
                middle.append(length)
                break
        return {"n_texts": total, "median_length": (middle[0] + middle[-1]) / 2 if middle else None}


@query("""
  SELECT lang, count(*) AS n_texts, median(coalesce(length(text), 0))::DOUBLE AS median_length
  FROM documents GROUP BY lang
  UNION ALL SELECT 'all', count(*), median(coalesce(length(text), 0))::DOUBLE FROM documents""")
def score_user_state(spark, sf):
    """A user's own aggregate with a state, by language and over everything."""
    texts = fx.table(spark, sf, "documents").select("lang", F.col("text").alias("output"))
    shape = "n_texts long, median_length double"
    by_lang = user_aggregates.aggregate(texts, LengthMedian(), shape, ["output"], ["lang"])
    whole = user_aggregates.aggregate(texts, LengthMedian(), shape, ["output"])
    return by_lang.unionByName(whole.select(F.lit("all").alias("lang"), "n_texts", "median_length"))


@query("""
  SELECT batch, count(*) AS n_rows, true AS within_error FROM (
    SELECT concat('part-', event_id % 4) AS batch FROM events
    UNION ALL SELECT 'all' FROM events
    UNION ALL SELECT 'two' FROM events WHERE event_id % 4 IN (1, 2)) GROUP BY batch""")
def distinct_sketches(spark, sf):
    """Distinct users by batch and over batches from stored sketches, held against exact counts."""
    events = fx.table(spark, sf, "events").select("user_id", (F.col("event_id") % 4).alias("part"))
    stored = sketches.DistinctSketches(spark, new_table_path(spark, "sketches"))
    chosen = {"all": [0, 1, 2, 3], "two": [1, 2], **{f"part-{i}": [i] for i in range(4)}}
    for i in range(4):
        stored.add(events.where(F.col("part") == i), "user_id", f"part-{i}")
    rows = []
    for name, parts in chosen.items():
        guessed = stored.estimate([f"part-{i}" for i in parts])
        exact = events.where(F.col("part").isin(*parts)).agg(F.countDistinct("user_id").alias("exact"))
        error = F.abs(F.col("n_distinct") - F.col("exact")) / F.col("exact")
        within = (error <= 4 * sketches.standard_error()).alias("within_error")
        rows.append(guessed.join(exact, F.lit(True)).select(F.lit(name).alias("batch"), "n_rows", within))
    whole = rows[0]
    for row in rows[1:]:
        whole = whole.unionByName(row)
    return whole


# ---------------------------------------------------------------- configured tables


@query(flat_records_sql(f"(SELECT * FROM {split_pairs_sql(PAIRS)} s WHERE split = 'valid')", ""))
def load_split_table(spark, sf):
    """A split of a named table, where no path is set."""
    pairs = splits.split_pairs(pairing.build_pairs(fx.triples(spark, sf)))
    pair_records(pairs, "split").createOrReplaceTempView("checked_pairs")
    data = {"dataset_name": "checked_pairs", "validation_split": "valid"}
    return flat_records(readers.load_split(spark, data, "validation"))


TABLES = ("conversations", "documents", "events")
WANTED = ("event_id", "text", "role", "user_id")


@query("""
  SELECT 'conversations' AS name, unnest(['event_id', 'user_id']) AS missing, count(*) AS n_rows FROM conversations
  UNION ALL SELECT 'documents', unnest(['event_id', 'role', 'user_id']), count(*) FROM documents
  UNION ALL SELECT 'events', unnest(['text', 'role']), count(*) FROM events""")
def columns_missing(spark, sf):
    """Columns that tables lack, each with the rows that it would be needed for."""
    parts = []
    for name in TABLES:
        df = fx.table(spark, sf, name)
        lacking = F.array(*(F.lit(c) for c in missing_columns(df, WANTED)))
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("name"), F.explode(lacking).alias("missing"), "n_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
