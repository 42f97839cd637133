"""Connected components of links that are spread over the cluster."""

from pyspark.sql import functions as F

from prefspark.llm.common import staged


def components(links):
    """(id, root) for each end of ``links`` (a, b): linked ids, and no others, share a root.

    In each round every id goes over to the one of its neighbours and itself that comes first,
    and links are rewritten. In every other round the smallest id comes first, which ends a
    star around a small id at once; in the others the order is pseudorandom, so that ids fall
    off by a constant factor, long chains of growing ids included. Rounds are written to the
    shared folder. Nothing is gathered: hubs meet in
    aggregates that combine before the shuffle, and in joins that Spark can split.
    """
    ends = _both_ways(links).select(F.col("a").alias("id")).distinct()
    links, rounds = staged(_distinct(links), "links"), []
    while not links.isEmpty():
        order = F.xxhash64(F.lit(len(rounds)), "b") if len(rounds) % 2 else F.col("b")
        first = F.min_by("b", order).alias("_to")
        near = _both_ways(links)
        near = near.unionByName(near.select("a", F.col("a").alias("b")))
        rounds.append(staged(near.groupBy(F.col("a").alias("_from")).agg(first), "components"))
        for end in ("a", "b"):
            links = links.join(rounds[-1], links[end] == rounds[-1]["_from"])
            links = links.drop("_from", end).withColumnRenamed("_to", end)
        links = staged(_distinct(links), "links")
    found = ends.withColumn("root", F.col("id"))
    for step in rounds:
        found = found.join(step, found["root"] == step["_from"], "left")
        found = found.select("id", F.coalesce("_to", "root").alias("root"))
    return found


def _both_ways(links):
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _distinct(links):
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return links.where("a <> b").select(low, high).distinct()
