"""Links across repositories and workflows over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach

# Which way each workflow follows consumer-to-provider links.
WORKFLOWS = {"impact": "inbound", "flow": "outbound", "context": "both", "plan": "both", "migration": "both"}


def link_overlay(declarations: DataFrame, max_candidates: int = 8) -> DataFrame:
    """(consumer, consumer_repository, kind, key, provider, provider_repository, confidence, caveats, candidate_count).

    ``declarations``: id, repository, direction (provider or consumer), kind, key, confidence, caveats
    (array). Consumers meet providers of other repositories by kind and key; the first
    ``max_candidates`` of a consumer by (repository, id) are kept, the count says how many there were.
    """
    c = declarations.where("direction = 'consumer'").select(F.col("id").alias("consumer"), F.col("repository").alias("consumer_repository"), "kind", "key", F.col("confidence").alias("cc"), F.col("caveats").alias("ca"))
    p = declarations.where("direction = 'provider'").select(F.col("id").alias("provider"), F.col("repository").alias("provider_repository"), "kind", "key", F.col("confidence").alias("pc"), F.col("caveats").alias("pa"))
    # Per key, a repository needs no more than max_candidates of its providers to be listed.
    near = Window.partitionBy("kind", "key", "provider_repository").orderBy("provider")
    first = p.withColumn("r", F.row_number().over(near)).where(F.col("r") <= max_candidates).drop("r")
    all_ = p.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_all"))
    own = p.groupBy("kind", "key", F.col("provider_repository").alias("consumer_repository")).agg(F.count(F.lit(1)).alias("n_own"))
    counts = c.join(all_, ["kind", "key"]).join(own, ["kind", "key", "consumer_repository"], "left")
    counts = counts.withColumn("candidate_count", F.col("n_all") - F.coalesce("n_own", F.lit(0))).where("candidate_count > 0").drop("n_all", "n_own")
    # And a key needs no more than this many in all: those of its first repositories, skipping one.
    order = Window.partitionBy("kind", "key").orderBy("provider_repository", "provider")
    head = first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= 2 * max_candidates)
    met = counts.join(head, ["kind", "key"]).where("provider_repository <> consumer_repository")
    pick = Window.partitionBy("consumer", "kind", "key").orderBy("provider_repository", "provider")
    met = met.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= max_candidates)
    none = F.array().cast("array<string>")
    more = F.when(F.col("candidate_count") > 1, F.array(F.lit("multiple_candidates"))).otherwise(none)
    cut = F.when(F.col("candidate_count") > max_candidates, F.array(F.lit("candidate_limit"))).otherwise(none)
    caveats = F.array_sort(F.array_union(F.array_union("ca", "pa"), F.array_union(more, cut)))
    return met.select(
        "consumer", "consumer_repository", "kind", "key", "provider", "provider_repository", F.least("cc", "pc").alias("confidence"), F.array_join(caveats, ",").alias("caveats"), "candidate_count"
    )


def unresolved_consumers(declarations: DataFrame) -> DataFrame:
    """(consumer): those without a provider in another repository."""
    c = declarations.where("direction = 'consumer'").select(F.col("id").alias("consumer"), "repository", "kind", "key")
    spread = declarations.where("direction = 'provider'").groupBy("kind", "key").agg(F.min("repository").alias("lo"), F.max("repository").alias("hi"))
    met = c.join(spread, ["kind", "key"], "left")
    other = (F.col("lo") != F.col("repository")) | (F.col("hi") != F.col("repository"))
    return met.where(F.col("lo").isNull() | ~other).select("consumer")


def workflow(links: DataFrame, kind: str, seeds: DataFrame, max_depth: int = 3, max_fanout: int = 50) -> DataFrame:
    """(endpoint, depth): what a workflow reaches from ``seeds`` (id) over ``links`` (consumer, provider), a node's first ``max_fanout`` links each way.

    A hop ranks the links of the nodes that it stands on, not those of all; links that come again count once.
    """
    way = WORKFLOWS[kind]
    ends = [("consumer", "provider")] * (way != "inbound") + [("provider", "consumer")] * (way != "outbound")
    # The way tells a link's two directions apart: each has its own rank.
    edges = [links.select(F.col(near).alias("subject"), F.col(far).alias("object"), F.lit(1000).alias("confidence"), F.lit(near).alias("way")) for near, far in ends]
    order = Window.partitionBy("src", "way").orderBy("dst")
    first = lambda step: step.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= max_fanout)
    return reach(reduce(DataFrame.unionByName, edges), seeds, "outbound", max_depth, first, "way").select(F.col("node").alias("endpoint"), "depth")


def snapshot(members: DataFrame, generations: DataFrame) -> DataFrame:
    """(repository, generation, status): the active generation of each member; missing or stale ones say so."""
    newest = generations.groupBy("repository").agg(F.max_by("generation", "sequence").alias("active"))
    known = generations.select("repository", "generation").distinct().withColumn("known", F.lit(True))
    j = members.join(newest, "repository", "left").join(known, ["repository", "generation"], "left")
    status = (
        F.when(F.col("active").isNull(), "missing_repository")
        .when(F.col("generation").isNull(), "resolved_active")
        .when(F.col("known"), F.when(F.col("generation") == F.col("active"), "pinned_active").otherwise("pinned_stale"))
        .otherwise("unknown_generation")
    )
    return j.select("repository", F.coalesce("generation", "active").alias("generation"), status.alias("status"))


def stitched(relations: DataFrame, links: DataFrame) -> DataFrame:
    """Relations of all repositories with their links as calls_foreign edges, for traces that cross repositories."""
    own = relations.select("subject", "predicate", "object", "confidence")
    over = links.select(F.col("consumer").alias("subject"), F.lit("calls_foreign").alias("predicate"), F.col("provider").alias("object"), "confidence")
    return own.unionByName(over)
