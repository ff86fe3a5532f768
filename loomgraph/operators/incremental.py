"""Change data: input deltas, invalidation, reconciling scans, equivalence of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import mapping
from ..runtime import materialize
from .graph import reach

# What a changed value means, by the kind of its key.
CHANGE_CLASSES = {
    "file_content": "body_only",
    "body_summary": "body_only",
    "file_path": "move",
    "public_surface": "surface",
    "import_set": "surface",
    "build_target": "build_context",
    "compiler_options": "build_context",
    "dependency_version": "build_context",
    "grammar_version": "provider_change",
    "adapter_version": "provider_change",
    "resolver_version": "provider_change",
    "configuration_revision": "configuration",
    "search_revision": "configuration",
    "derived_plan": "configuration",
}


def input_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, kind, before, after, change) of inputs (key, kind, value) that differ: added, delete or the class of the kind."""
    b, a = before.select("key", "kind", F.col("value").alias("before")), after.select("key", "kind", F.col("value").alias("after"))
    j = b.join(a, ["key", "kind"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "delete").otherwise(mapping(F.col("kind"), CHANGE_CLASSES))
    return j.select("key", "kind", "before", "after", change.alias("change"))


def invalidation(changes: DataFrame, input_edges: DataFrame, fact_edges: DataFrame, max_work: int = 1_000_000) -> DataFrame:
    """(node, cause): facts to redo. ``input_edges``: key, node; ``fact_edges``: subject, object (object depends on subject).

    Dependents are followed until no new one is found. A changed key without declared dependents, or more work than ``max_work``, falls back to every
    node, with that as its cause.
    """
    changes = materialize(changes.select("key"), "changes")  # read by each test below
    undeclared = changes.join(input_edges.select("key"), "key", "left_anti")
    nodes = input_edges.select("node").union(fact_edges.select("subject")).union(fact_edges.select("object")).distinct()
    if not undeclared.isEmpty():
        return nodes.select("node", F.lit("missing_dependency_declaration").alias("cause"))
    seeds = input_edges.join(changes.select("key"), "key", "left_semi").select(F.col("node").alias("id")).distinct()
    found = reach(fact_edges.select("subject", "object", F.lit(1000).alias("confidence")), seeds, "outbound")
    work = fact_edges.join(found.select(F.col("node").alias("subject")), "subject", "left_semi").count()
    if work > max_work:
        return nodes.select("node", F.lit("closure_work_exceeded").alias("cause"))
    return found.select("node", F.when(F.col("depth") == 0, "input").otherwise("fact").alias("cause"))


def artifact_decisions(artifacts: DataFrame, outputs: DataFrame, dependencies: DataFrame, invalidated: DataFrame, current: DataFrame) -> DataFrame:
    """(artifact, decision, reason): reuse only if no output is invalidated and every dependency's value is unchanged."""
    hit = outputs.join(invalidated.select("node"), "node", "left_semi").select("artifact").distinct().withColumn("hit", F.lit(True))
    now = current.select("key", F.col("value").alias("now"))
    stale = dependencies.join(now, "key", "left").where(~F.col("value").eqNullSafe(F.col("now"))).select("artifact").distinct().withColumn("stale", F.lit(True))
    j = artifacts.select("artifact").join(hit, "artifact", "left").join(stale, "artifact", "left")
    reason = F.when(F.col("hit"), "artifact_output_invalidated").when(F.col("stale"), "artifact_dependency_changed").otherwise("complete_dependency_match")
    return j.select("artifact", F.when(F.col("hit") | F.col("stale"), "rebuild").otherwise("reuse").alias("decision"), reason.alias("reason"))


def reconcile_plan(baseline: DataFrame, scan: DataFrame, audit: bool = False) -> DataFrame:
    """(file, previous_file, decision, reason) for every scanned file.

    Both: file, path, identity, size, mtime, trusted; the baseline has hash too. Files match by file
    id, else by a platform identity that is unique among the unmatched of both sides.
    """
    same = scan.select("file").join(baseline.select("file"), "file").withColumn("previous_file", F.col("file"))
    rest = lambda df: df.join(same.select("file"), "file", "left_anti").where("identity IS NOT NULL")
    one = lambda df, name: rest(df).groupBy("identity").agg(F.min("file").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    moved = one(scan, "file").join(one(baseline, "previous_file"), "identity").select("file", "previous_file")
    b = baseline.select(F.col("file").alias("previous_file"), *[F.col(c).alias(f"b_{c}") for c in ("identity", "size", "mtime", "trusted")])
    j = scan.join(same.union(moved), "file", "left").join(b, "previous_file", "left")
    trusted = F.col("trusted") & F.col("b_trusted")
    equal = F.col("size").eqNullSafe(F.col("b_size")) & F.col("mtime").eqNullSafe(F.col("b_mtime")) & F.col("identity").eqNullSafe(F.col("b_identity"))
    reason = (
        F.when(F.lit(audit), "audit_mode")
        .when(F.col("previous_file").isNull(), "new_file")
        .when(trusted & equal, "trusted_metadata_unchanged")
        .when(~trusted, "metadata_untrusted")
        .otherwise("metadata_changed")
    )
    return j.select("file", "previous_file", F.when(reason == "trusted_metadata_unchanged", "reuse").otherwise("hash").alias("decision"), reason.alias("reason"))


def file_transitions(baseline: DataFrame, scan: DataFrame, matches: DataFrame) -> DataFrame:
    """(file, previous_file, change): no_change, added, modified, moved, moved_and_modified or deleted, from paths and hashes."""
    s = scan.select("file", F.col("path").alias("sp"), F.col("hash").alias("sh"))
    b = baseline.select(F.col("file").alias("previous_file"), F.col("path").alias("bp"), F.col("hash").alias("bh"))
    j = s.join(matches.select("file", "previous_file"), "file", "left").join(b, "previous_file", "full_outer")
    moved = ~F.col("sp").eqNullSafe(F.col("bp")) | ~F.col("file").eqNullSafe(F.col("previous_file"))
    other = ~F.col("sh").eqNullSafe(F.col("bh"))
    change = (
        F.when(F.col("file").isNull(), "deleted").when(F.col("previous_file").isNull(), "added").when(moved & other, "moved_and_modified").when(moved, "moved").when(other, "modified").otherwise("no_change")
    )
    return j.select("file", "previous_file", change.alias("change"))


def digest(domains: dict[str, DataFrame]) -> DataFrame:
    """(domain, n, digest, total): a count and two order-free digests of each frame, combined map-side.

    Rows that come in pairs cancel in ``digest``, an exclusive or; they do not in ``total``, a sum of
    hashes of another seed.
    """
    parts = []
    for name, df in domains.items():
        columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
        rows = df.select(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit("total"), *columns).cast("decimal(38,0)").alias("g"))
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("digest"), F.sum("g").alias("total"))
        parts.append(sums.select(F.lit(name).alias("domain"), "n", "digest", "total"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def equivalence(incremental: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """(domain, n_incremental, n_clean, equal)."""
    a, b = digest(incremental), digest(clean)
    j = a.alias("a").join(b.alias("b"), "domain", "full_outer")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.total").eqNullSafe(F.col("b.total"))
    return j.select("domain", F.coalesce("a.n", F.lit(0)).alias("n_incremental"), F.coalesce("b.n", F.lit(0)).alias("n_clean"), same.alias("equal"))
