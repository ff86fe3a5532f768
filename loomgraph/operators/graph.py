"""Graph steps as joins: breadth-first reach, simple paths, components, cycles, communities.

``edges`` are frames of subject, object (and confidence). Loops write their small frontier, not the
edges, to the shared folder each round; a hub's edges are met once, by an equi-join the adaptive
planner may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, read_all, release


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as src, dst in the direction of travel, other columns kept."""
    rest = [c for c in edges.columns if c not in ("subject", "object")]
    out = edges.select(F.col("subject").alias("src"), F.col("object").alias("dst"), *rest)
    back = edges.select(F.col("object").alias("src"), F.col("subject").alias("dst"), *rest)
    return {"outbound": lambda: out, "inbound": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "outbound", max_depth: int | None = 5) -> DataFrame:
    """(node, depth): what ``seeds`` (id) reach, each node once at its least depth; seeds at 0 are left out."""
    found = reach(edges.select("subject", "object", F.lit(1000).alias("confidence")), seeds, direction, max_depth)
    return found.where("depth > 0").select("node", "depth")


def reach(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int | None = None, weigh: Callable[[DataFrame], DataFrame] | None = None, *more: str) -> DataFrame:
    """(node, depth, confidence): least depth and, over shortest walks, the best weakest-link confidence; seeds have 1000.

    Without ``max_depth`` until a hop finds nothing new. A hop joins the edges with the last level and
    drops what any level holds already; levels are written, and read again as one table. ``weigh`` gives
    a hop's edges (src, dst, confidence and the columns ``more`` of ``edges``), a stored table, their
    confidence or drops them; edges that no hop meets are not weighed.
    """
    steps = oriented(edges.select("subject", "object", "confidence", *more), direction)
    seen = seeds.select(F.col("id").alias("node")).distinct().select("node", F.lit(0).alias("depth"), F.lit(1000).alias("confidence"))
    levels = [materialize(seen, "reach-0")]
    while max_depth is None or len(levels) <= max_depth:
        before = levels[-1].select(F.col("node").alias("src"), F.col("confidence").alias("c"))
        step = steps.join(before, "src")
        if weigh:
            step = weigh(materialize(step, "reach-step"))
        step = step.groupBy(F.col("dst").alias("node")).agg(F.max(F.least("confidence", "c")).alias("confidence"))
        step = step.join(read_all(levels).select("node"), "node", "left_anti")
        level = materialize(step.select("node", F.lit(len(levels)).alias("depth"), "confidence"), f"reach-{len(levels)}")
        if level.isEmpty():
            break
        levels.append(level)
    return read_all(levels)


def simple_paths(
    edges: DataFrame, seeds: DataFrame, target: str | None = None, direction: str = "outbound", max_depth: int = 8, max_paths: int = 100, max_open: int | None = 100_000,
    weigh: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(path, hops, confidence, cyclic, truncated): the first ``max_paths`` of each seed by hops, confidence downwards and path.

    Walks have no repeated node, but for one closing hop back to a node on them (cyclic). Without
    ``target`` every outward walk of one hop or more counts, so a seed is done once it has enough: no
    longer walk comes before those found. With it only paths that end there count, and walks are kept
    while the target is near enough for the hops left. ``truncated``: there are more of this seed than
    are returned, or, with ``target``, a hop had over ``max_open`` walks and kept the strongest; with
    None it keeps all. ``edges`` are written once and met by each hop's walks; ``weigh`` as in ``reach``.
    """
    edges = materialize(edges.select("subject", "object", "confidence"), "paths-edges")
    steps = oriented(edges, direction)
    near = None
    if target:
        back = {"outbound": "inbound", "inbound": "outbound", "both": "both"}[direction]
        goal = steps.sparkSession.createDataFrame([(target,)], "id string")
        near = reach(edges, goal, back, max_depth, weigh).select(F.col("node").alias("dst"), F.col("depth").alias("left"))
    seed = F.element_at("path", 1)
    open_ = seeds.select(F.array("id").alias("path"), F.lit(1000).alias("confidence"), F.lit(False).alias("cut"))
    done: list[DataFrame] = []
    rank = Window.partitionBy(seed).orderBy(F.desc("confidence"), "path")
    for hop in range(1, max_depth + 1):
        ends = open_.select("path", F.col("confidence").alias("c"), F.element_at("path", -1).alias("src"), "cut")
        # The edges that this hop's walks meet, the strongest of each pair of ends.
        met = steps.join(ends.select("src").distinct(), "src", "left_semi")
        if weigh:
            met = weigh(materialize(met, f"paths-met-{hop}"))
        grown = ends.join(met.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")), "src")
        if near is not None:
            grown = grown.join(near, "dst").where(F.col("left") <= max_depth - hop)
        grown = grown.select(
            F.concat("path", F.array("dst")).alias("path"),
            F.least("c", "confidence").alias("confidence"),
            F.array_contains("path", F.col("dst")).alias("cyclic"),
            (F.col("dst") == F.lit(target)).alias("arrived") if target else F.lit(True).alias("arrived"),
            F.lit(hop).alias("hops"),
            "cut",
        )
        if target:
            grown = grown.where("NOT cyclic")
        grown = materialize(grown, f"paths-{hop}")
        done.append(grown)
        more = grown.where("NOT cyclic AND NOT arrived" if target else "NOT cyclic")
        counts = read_all(done).groupBy(seed.alias("seed")).agg(F.count_if("arrived").alias("n"))
        if hop == max_depth or more.isEmpty():
            break
        enough = counts.where(F.col("n") > max_paths).select("seed")
        more = more.withColumn("seed", seed).join(enough, "seed", "left_anti")
        if target and max_open is not None:
            more = more.withColumn("r", F.row_number().over(rank)).withColumn("cut", F.col("cut") | (F.count(F.lit(1)).over(Window.partitionBy(seed)) > max_open))
            more = more.where(F.col("r") <= max_open)
        open_ = materialize(more.select("path", "confidence", "cut"), f"paths-open-{hop}")
        if open_.isEmpty():
            break
    found = read_all(done)
    cuts = found.groupBy(seed.alias("seed")).agg((F.count_if("arrived") > max_paths).alias("over"), F.bool_or("cut").alias("cut"))
    final = Window.partitionBy("seed").orderBy("hops", F.desc("confidence"), "path")
    out = found.where("arrived").withColumn("seed", seed).withColumn("r", F.row_number().over(final)).where(F.col("r") <= max_paths)
    return out.drop("cut").join(cuts, "seed").select("path", "hops", "confidence", "cyclic", (F.col("over") | F.col("cut")).alias("truncated"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every walk of one edge or more, by doubling; for projected graphs of few nodes."""
    now = materialize(edges.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct(), "closure-0")
    size = now.count()
    while True:
        left, right = now.select("src", F.col("dst").alias("mid")), now.select(F.col("src").alias("mid"), "dst")
        after = materialize(now.union(left.join(right, "mid").select("src", "dst")).distinct(), "closure")
        grown = after.count()
        release(now)
        if grown == size:
            return after
        now, size = after, grown


#: Graphs of at most so many edges take the closure; larger ones are coloured.
CLOSURE_EDGES = 2000


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node of its cycle of mutual reach; nodes on no cycle are left out."""
    pairs = materialize(edges.select("subject", "object").where("subject <> object").distinct(), "scc-edges")
    if pairs.count() <= CLOSURE_EDGES:
        all_ = closure(pairs)
        mutual = all_.alias("a").join(all_.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")))
        return mutual.groupBy(F.col("a.src").alias("node")).agg(F.min("a.dst").alias("component")).where("node IS NOT NULL")
    return _coloured(pairs)


def _trimmed(pairs: DataFrame) -> DataFrame:
    """``pairs`` without the edges of nodes that nothing enters or that nothing leaves, until none is such."""
    size = pairs.count()
    while True:
        ends = pairs.select(F.col("subject").alias("object")).distinct()
        starts = pairs.select(F.col("object").alias("subject")).distinct()
        after = materialize(pairs.join(ends.hint("merge"), "object", "left_semi").join(starts.hint("merge"), "subject", "left_semi").select("subject", "object"), "scc-edges")
        left = after.count()
        if left == size:
            return after
        pairs, size = after, left


def _coloured(pairs: DataFrame) -> DataFrame:
    """Colour by the least node that reaches each node; within a colour, what reaches its root is one component.

    Nodes on no cycle are trimmed first, so what is coloured shrinks with the components that are
    found. A hop sends only the colours that the last one changed. Joins are told to shuffle: what
    they would broadcast each round goes through the driver.
    """
    out = None
    pairs = _trimmed(pairs)
    while not pairs.isEmpty():
        nodes = pairs.select(F.col("subject").alias("node")).distinct()  # trimmed: every node has an edge out
        colour = materialize(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("changed")), "scc-colour")
        while True:
            fresh = colour.where("changed").select(F.col("node").alias("subject"), F.col("colour").alias("sent"))
            got = pairs.join(fresh.hint("merge"), "subject").groupBy(F.col("object").alias("node")).agg(F.min("sent").alias("got"))
            less = F.coalesce(F.col("got") < F.col("colour"), F.lit(False))
            after = materialize(colour.join(got.hint("merge"), "node", "left").select("node", F.when(less, F.col("got")).otherwise(F.col("colour")).alias("colour"), less.alias("changed")), "scc-colour")
            release(colour)
            colour = after
            if colour.where("changed").isEmpty():
                break
        own = pairs.join(colour.select(F.col("node").alias("subject"), F.col("colour").alias("cs")).hint("merge"), "subject")
        own = own.join(colour.select(F.col("node").alias("object"), F.col("colour").alias("co")).hint("merge"), "object").where("cs = co")
        own = materialize(own.select("subject", "object", F.col("cs").alias("colour")), "scc-own")
        levels = [materialize(colour.where("node = colour").select("node", "colour"), "scc-member")]
        while True:
            front = levels[-1].select(F.col("node").alias("object"), "colour")
            back = own.join(front.hint("merge"), ["object", "colour"]).select(F.col("subject").alias("node"), "colour").distinct()
            level = materialize(back.join(read_all(levels).hint("merge"), ["node", "colour"], "left_anti"), "scc-member")
            if level.isEmpty():
                break
            levels.append(level)
        member = read_all(levels)
        many = member.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
        part = materialize(member.join(many.hint("merge"), "colour").select("node", F.col("colour").alias("component")), "scc-part")
        out = part if out is None else out.union(part)
        gone = member.select("node")
        left = pairs.join(gone.withColumnRenamed("node", "subject").hint("merge"), "subject", "left_anti")
        left = left.join(gone.withColumnRenamed("node", "object").hint("merge"), "object", "left_anti").select("subject", "object")
        pairs = _trimmed(materialize(left, "scc-edges"))
    return out if out is not None else pairs.select(F.col("subject").alias("node"), F.col("object").alias("component"))


def shortest_cycles(inner: DataFrame) -> DataFrame:
    """(component, path array, confidence): a shortest cycle of each component, from its least node on.

    ``inner``: component, subject, object, confidence, both ends in the component. Of equally short
    cycles the one of strongest weakest link, then the first by path. All nodes of a component search
    at once, in step, each through nodes after itself alone, as a cycle is found from its least node;
    the first hop that closes any ends the component's search. A second search, from the nodes that
    have the best, goes over links that strong for the path.
    """
    key = ["component", "source"]
    start = inner.select("component", F.col("subject").alias("source")).distinct()
    levels = [materialize(start.select(*key, F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(1000).alias("b")), "cycle-0")]
    closed: list[DataFrame] = []
    while True:
        hop = len(levels)
        front = levels[-1].select(*key, F.col("node").alias("subject"), "b")
        step = inner.join(front, ["component", "subject"]).where("object >= source").groupBy(*key, F.col("object").alias("node")).agg(F.max(F.least("confidence", "b")).alias("b"))
        step = materialize(step, f"cycle-step-{hop}")
        # The least source of the strongest that close at this hop.
        ends = step.where("node = source").groupBy("component").agg(F.min(F.struct(-F.col("b"), F.col("source").alias("source"))).alias("e"))
        closed.append(materialize(ends.select("component", "e.source", F.lit(hop).alias("length"), (-F.col("e.col1")).alias("best")), f"cycle-closed-{hop}"))
        fresh = step.join(closed[-1].select("component"), "component", "left_anti").join(read_all(levels).select(*key, "node"), [*key, "node"], "left_anti")
        level = materialize(fresh.select(*key, "node", F.lit(hop).alias("depth"), "b"), f"cycle-{hop}")
        if level.isEmpty():
            break
        levels.append(level)
    ends = read_all(closed)
    depths = materialize(read_all(levels).join(ends.select(*key), key, "left_semi"), "cycle-depths")
    strong = materialize(inner.join(ends, "component").where("confidence >= best AND object >= source"), "cycle-strong")
    front = ends.select("component", F.col("source").alias("subject"), F.array("source").alias("path"))
    found = []
    for hop in range(1, len(levels) + 1):
        grown = strong.join(front, ["component", "subject"]).select("component", "source", "object", "length", "best", F.concat("path", F.array("object")).alias("path"))
        grown = materialize(grown, f"cycle-path-{hop}")
        last = grown.where((F.col("length") == hop) & (F.col("object") == F.col("source")))
        found.append(materialize(last.groupBy("component").agg(F.min("path").alias("path"), F.max("best").alias("confidence")), f"cycle-found-{hop}"))
        at = depths.where(F.col("depth") == hop).select("component", F.col("node").alias("object"))
        front = grown.where(F.col("length") > hop).join(at, ["component", "object"]).groupBy("component", F.col("object").alias("subject")).agg(F.min("path").alias("path"))
    return read_all(found)


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation over undirected weighted edges: the heaviest label wins, the least of equals."""
    both = materialize(oriented(edges.select("subject", "object", F.col("confidence").alias("w")).where("subject <> object"), "both"), "communities-edges")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(-F.col("w"), "community")).alias("b"))
        labels = materialize(best.select("node", F.col("b.community").alias("community")), f"communities-{k}")
    return labels


def refuse_rings(entities: DataFrame) -> None:
    """Raise if containers hold each other."""
    container_of(entities.select("id", F.lit("").alias("kind"), "container_id"), ("no kind",))


def container_of(entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, container): the nearest entity of ``kinds`` at or above each entity; null if there is none.

    Pointers up are doubled, so there are as many rounds as the longest chain has digits in base two.
    Chains of more rounds than there are entities to climb are rings, and refused.
    """
    own = F.when(F.col("kind").isin(*kinds), F.col("id"))
    now = materialize(entities.select("id", own.alias("container"), F.when(own.isNull(), F.col("container_id")).alias("up")), "containers")
    rounds = now.count().bit_length() + 1
    while not now.where("up IS NOT NULL").isEmpty():
        if not rounds:
            raise ValueError("containers hold each other: " + ", ".join(sorted(r["id"] for r in now.where("up IS NOT NULL").limit(3).collect())))
        rounds -= 1
        above = now.select(F.col("id").alias("up"), F.col("container").alias("found"), F.col("up").alias("next"))
        after = now.join(above, "up", "left").select("id", F.coalesce("container", "found").alias("container"), F.when(F.coalesce("container", "found").isNull(), F.col("next")).alias("up"))
        after = materialize(after, "containers")
        release(now)
        now = after
    return now.select("id", "container")
