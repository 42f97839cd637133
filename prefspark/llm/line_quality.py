"""Quality rules by the cross-document frequency of lines, in DataFrame functions only.

Each text is read once into a short profile: counts for the base rules, and a hash and a word
count for each normalised line. Lines are then counted by distinct documents for each host;
counting combines on the map side, so neither a hot host nor a hot line is gathered in one
task. Lines above the limit of their host are removed, and documents that lose too much
with them are rejected.
"""

from pyspark.sql import functions as F

from prefspark.llm.common import SPACES, let, split_words, staged

# A line is removed from a host's documents when more than this many of them hold it, and
# more than this share of them. A share above 0 spares what large hosts hold more often.
MAX_DOCS = 20
MAX_SHARE = 0.0
# A document is depleted when fewer than this percentage of its words are left.
MIN_PERCENT_LEFT = 30

# Base rules; fixed values.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_PERCENT_REPEATED = 50


def without(text, letters):
    return F.translate(text, letters, "")


def repeated_words(words):
    """Column: how many words stand in a 3-word window that occurs again in ``words``."""

    def windows(hashes):
        follow = lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))
        return F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - 2), follow)

    def some_twice(sorted_windows):
        same = lambda x, i: (i > 0) & (x == F.get(sorted_windows, i - 1))
        return F.exists(F.transform(sorted_windows, same), lambda twice: F.coalesce(twice, F.lit(False)))

    def covered(window_hashes):
        placed = F.transform(window_hashes, lambda x, i: F.struct(x.alias("hash"), i.alias("at")))
        return let(F.sort_array(placed), lambda pairs: union_length(F.sort_array(repeats(pairs))))

    def repeats(pairs):
        def again(pair, i):
            before, after = F.get(pairs, i - 1)["hash"], F.get(pairs, i + 1)["hash"]
            return pair["hash"].eqNullSafe(before) | pair["hash"].eqNullSafe(after)

        return F.transform(F.filter(pairs, again), lambda pair: pair["at"])

    def union_length(starts):
        def length(at):
            step = lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))
            return F.aggregate(F.transform(at, step), F.lit(0), lambda total, x: total + x)

        return let(starts, length)

    def of_windows(window_hashes):
        found = let(F.sort_array(window_hashes), some_twice)
        return F.when(found, covered(window_hashes)).otherwise(F.lit(0))

    def of_hashes(hashes):
        enough = F.size(hashes) >= 3
        return F.when(enough, let(windows(hashes), of_windows)).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


def line_profiles(lines):
    """Column: (hash of the normalised line, its words) of each line that has a word.

    Lines are equal when their words are, white space and case aside.
    """
    profile = lambda words: F.struct(
        F.xxhash64(F.array_join(words, " ")).alias("line"), F.size(words).alias("words")
    )
    return F.transform(lines, lambda line: let(split_words(F.lower(line)), profile))


def profiles(docs, host):
    """One short row for each document; ``_row`` tells repeated documents apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("null")).alias("_host"),
        F.col("doc_id"),
        text.alias("_text"),
        split_words(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda l: F.length(without(l, SPACES)) > 0).alias("_lines"),
    )
    return read.select(
        "_row",
        "_host",
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        line_profiles(F.col("_lines")).alias("_lines"),
    )


def frequent_lines(profiled, max_docs, max_share):
    """(_host, line) of the lines that more documents of the host hold than its limit allows."""
    once = profiled.select("_host", F.explode(F.array_distinct("_lines.line")).alias("line"))
    counts = once.groupBy("_host", "line").agg(F.count("*").alias("_docs"))
    often = counts.where(F.col("_docs") > max_docs)
    if not max_share:
        return often.select("_host", "line")
    hosts = profiled.groupBy("_host").agg(F.count("*").alias("_all"))
    often = often.join(hosts, "_host")
    return often.where(F.col("_docs") > max_share * F.col("_all")).select("_host", "line")


def quality(
    docs,
    host="source",
    max_docs=MAX_DOCS,
    max_share=MAX_SHARE,
    min_percent_left=MIN_PERCENT_LEFT,
):
    """Verdicts on ``docs`` (doc_id, text and the column ``host``), one row for each document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and n_words_left, the words outside removed lines. A null text counts as empty and
    fails the base rules; rows without a host form one host; repeated rows count as different
    documents; other columns are not read; an empty table gives no rows.
    """
    profiled = staged(profiles(docs, host), "line-profiles")
    lines = profiled.select("_row", "_host", F.inline("_lines"))
    removed = (
        lines.join(frequent_lines(profiled, max_docs, max_share), ["_host", "line"])
        .groupBy("_row")
        .agg(F.sum("words").alias("_removed"))
    )
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_PERCENT_REPEATED * F.col("n_words")
    )
    depleted = 100 * left < min_percent_left * F.col("n_words")
    return profiled.drop("_lines", "_host").join(removed, "_row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"),
        left.alias("n_words_left"),
    )


# ``quality`` over the table ``documents`` with its defaults.
QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host,
         coalesce(text, '') AS text
  FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), tri AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM tri CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2 GROUP BY r
), raw AS (
  SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT r, host, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS ws FROM raw
), norm AS (
  SELECT r, host, line, array_to_string(ws, ' ') AS n, len(ws) AS words
  FROM lines WHERE len(ws) > 0
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM norm GROUP BY r
), hosts AS (
  SELECT host, count(*) AS docs FROM d GROUP BY host
), often AS (
  SELECT host, n FROM norm JOIN hosts USING (host) GROUP BY host, n, docs
  HAVING count(DISTINCT r) > {MAX_DOCS} AND count(DISTINCT r) > {MAX_SHARE} * docs
), gone AS (
  SELECT r, sum(words) AS n FROM norm JOIN often USING (host, n) GROUP BY r
), base AS (
  SELECT doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ws) - coalesce(gone.n, 0) AS n_words_left
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
), judged AS (
  SELECT *, n_words < {MIN_WORDS}
            OR 100 * n_repeat_words > {MAX_PERCENT_REPEATED} * n_words AS base_failed
  FROM base
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_words_left >= {MIN_PERCENT_LEFT} * n_words AS kept,
       n_words_left::BIGINT AS n_words_left
FROM judged
"""
