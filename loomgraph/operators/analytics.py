"""Ready-made analyses over a fact graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FAMILIES, Graph, ceiling
from ..runtime import materialize
from .graph import communities, container_of, oriented, reach, shortest_cycles, simple_paths, strong_components


def _top(tier: str) -> Column:
    """The most confidence that an endpoint allows; one without entity clamps nothing."""
    return F.when(F.col(tier).isNull(), F.lit(1000)).otherwise(ceiling(tier))


def effective(graph: Graph, edges: DataFrame, ends: tuple[str, str] = ("subject", "object"), few: bool = False) -> DataFrame:
    """Edges with confidence clamped to what both endpoints' tiers allow; an endpoint without entity clamps nothing.

    ``few``: ``edges`` is a stored table of a part of all edges; the entities that it names are told first,
    so neither join meets all entities.
    """
    a, b = ends
    tiers = graph.entities.select("id", "tier")
    if few:
        named = edges.select(F.explode(F.array(a, b)).alias("id")).distinct()
        tiers = materialize(tiers.join(named, "id", "left_semi"), "tiers")
    out = edges.join(tiers.select(F.col("id").alias(a), F.col("tier").alias("ts")), a, "left")
    out = out.join(tiers.select(F.col("id").alias(b), F.col("tier").alias("to")), b, "left")
    return out.withColumn("confidence", F.least("confidence", _top("ts"), _top("to"))).drop("ts", "to")


def _weighing(graph: Graph, min_confidence: int):
    """What a walk does to the edges of a hop: those of ``min_confidence`` or more, by their effective confidence."""
    return lambda step: effective(graph, step, ("src", "dst"), few=True).where(F.col("confidence") >= min_confidence)


def edges_of(graph: Graph, families: list[str], min_confidence: int = 0) -> DataFrame:
    """Edges of the families with effective confidence, those of ``min_confidence`` or more."""
    edges = effective(graph, graph.of(*families))
    return edges.where(F.col("confidence") >= min_confidence) if min_confidence else edges


def explain_symbols(
    graph: Graph,
    ids: list[str],
    max_rows: int = 100,
    occurrences: DataFrame | None = None,
    provenance: DataFrame | None = None,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """(id, kind, name, section, other, detail, confidence): each entity, what touches it, its container; ordered and cut per section. Confidence is effective.

    Sections: entity, outbound, inbound; with ``occurrences`` (id, role, enclosing, target, file) those
    that it encloses or that target it; with ``provenance`` (id, producer, version) its producer; with
    ``coverage`` (scope_kind, scope_id, status) that of its language and path.
    """
    wanted = graph.entities.where(F.col("id").isin(*ids))
    own = wanted.select("id", "kind", "name", F.lit("entity").alias("section"), F.coalesce("container_id", F.lit("")).alias("other"), F.col("visibility").alias("detail"), F.lit(1000).alias("confidence"))
    row = lambda df, id_, section, other, detail, confidence: df.select(F.col(id_).alias("id"), F.lit(section).alias("section"), F.col(other).alias("other"), F.col(detail).alias("detail"), confidence.cast("int").alias("confidence"))
    mine = lambda df, column: df.where(F.col(column).isin(*ids))
    full = F.lit(1000)
    parts = [
        row(effective(graph, mine(graph.relations, "subject")), "subject", "outbound", "object", "predicate", F.col("confidence")),
        row(effective(graph, mine(graph.relations, "object")), "object", "inbound", "subject", "predicate", F.col("confidence")),
    ]
    if occurrences is not None:
        parts.append(row(mine(occurrences, "enclosing"), "enclosing", "encloses", "id", "role", full))
        parts.append(row(mine(occurrences, "target"), "target", "targeted_by", "id", "role", full))
    if provenance is not None:
        parts.append(row(mine(provenance, "id"), "id", "provenance", "producer", "version", full))
    if coverage is not None:
        scopes = wanted.select("id", F.explode(F.array(F.struct(F.lit("language").alias("scope_kind"), F.col("language").alias("scope_id")), F.struct(F.lit("path").alias("scope_kind"), F.col("path").alias("scope_id")))).alias("s")).select("id", "s.*")
        parts.append(row(scopes.join(coverage, ["scope_kind", "scope_id"]), "id", "coverage", "scope_id", "status", full))
    sides = parts[0]
    for p in parts[1:]:
        sides = sides.unionByName(p)
    named = sides.join(wanted.select("id", "kind", "name"), "id").select(*own.columns)
    order = Window.partitionBy("id", "section").orderBy("detail", "other")
    cut = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_rows).drop("r")
    return own.unionByName(cut)


def relationships(
    graph: Graph, seeds: list[str], families: list[str], direction: str | None = None, min_confidence: int = 0, max_results: int = 100
) -> DataFrame:
    """(seed, family, direction, symbol, confidence, total): neighbours, by symbol, with the count before the cut.

    Without ``direction`` called_by looks inbound and every other family outbound.
    """
    natural = {f: "inbound" if f == "called_by" else "outbound" for f in families}
    parts = []
    for family in families:
        if not FAMILIES[family]:
            continue
        for way in ("outbound", "inbound") if direction == "both" else (direction or natural[family],):
            near, far = ("subject", "object") if way == "outbound" else ("object", "subject")
            edges = graph.relations.where(F.col("predicate").isin(*FAMILIES[family]) & F.col(near).isin(*seeds))
            parts.append(
                effective(graph, edges).select(
                    F.col(near).alias("seed"), F.lit(family).alias("family"), F.lit(way).alias("direction"), F.col(far).alias("symbol"), "confidence"
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("confidence") >= min_confidence).groupBy("seed", "family", "direction", "symbol").agg(F.max("confidence").alias("confidence"))
    group = Window.partitionBy("seed", "family", "direction")
    out = out.withColumn("total", F.count(F.lit(1)).over(group)).withColumn("r", F.row_number().over(group.orderBy("symbol")))
    return out.where(F.col("r") <= max_results).drop("r")


def flow_trace(graph: Graph, start: str, families: list[str], target: str | None = None, direction: str = "outbound", min_confidence: int = 0, max_depth: int = 8, max_paths: int = 100, max_open: int | None = 100_000) -> DataFrame:
    """(path, hops, confidence, cyclic, truncated) of ``simple_paths`` over effective confidence, the path joined by '>'."""
    seeds = graph.entities.where(F.col("id") == start).select("id")
    found = simple_paths(graph.of(*families), seeds, target, direction, max_depth, max_paths, max_open, _weighing(graph, min_confidence))
    return found.select(F.array_join("path", ">").alias("path"), "hops", "confidence", "cyclic", "truncated")


def flow_frontier(graph: Graph, start: str, families: list[str], direction: str = "outbound", max_depth: int = 8) -> DataFrame:
    """(reached_nodes, examined_edges, truncated, unresolved_boundaries) of the walk that a trace makes.

    Truncated: an edge leads from the last hop to a node not reached. Boundaries: reached nodes that no
    entity describes.
    """
    edges = materialize(graph.of(*families), "frontier-edges")
    seeds = graph.entities.where(F.col("id") == start).select("id")
    found = reach(edges, seeds, direction, max_depth)
    steps = oriented(edges.select("subject", "object"), direction)
    examined = steps.join(found.where(F.col("depth") < max_depth).select(F.col("node").alias("src")), "src", "left_semi").agg(F.count(F.lit(1)).alias("examined_edges"))
    beyond = steps.join(found.where(F.col("depth") == max_depth).select(F.col("node").alias("src")), "src", "left_semi")
    beyond = beyond.join(found.select(F.col("node").alias("dst")), "dst", "left_anti").agg((F.count(F.lit(1)) > 0).alias("truncated"))
    unknown = found.join(graph.entities.select(F.col("id").alias("node")), "node", "left_anti").agg(F.count(F.lit(1)).alias("unresolved_boundaries"))
    out = found.agg(F.count(F.lit(1)).alias("reached_nodes"))
    for one in (examined, beyond, unknown):  # a row each
        out = out.join(F.broadcast(one))
    return out


def project_edges(graph: Graph, edges: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    """Edges between the nearest containers of ``kinds``; (subject, object, confidence, weight) between distinct ones, strongest confidence."""
    if kinds:
        at = container_of(graph.entities, kinds)
        edges = edges.join(at.select(F.col("id").alias("subject"), F.col("container").alias("cs")), "subject")
        edges = edges.join(at.select(F.col("id").alias("object"), F.col("container").alias("co")), "object")
        edges = edges.where("cs IS NOT NULL AND co IS NOT NULL").withColumns({"subject": F.col("cs"), "object": F.col("co")})
    return edges.groupBy("subject", "object").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("weight"))


def omitted_nodes(graph: Graph, families: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """(omitted_nodes): ends of the families' edges that ``project_edges`` leaves out, as no entity of ``kinds`` holds them."""
    ends = graph.of(*families).select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    held = container_of(graph.entities, kinds).where("container IS NOT NULL").select("id")
    return ends.join(held, "id", "left_anti").agg(F.count(F.lit(1)).alias("omitted_nodes"))


def _inside(edges: DataFrame, include_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the strong components, and the edges (component, subject, object, ..) inside them."""
    edges = materialize(edges, "cycle-edges")
    member = strong_components(edges)
    if include_self:
        own = edges.where("subject = object").select(F.col("subject").alias("node"), F.col("subject").alias("component"))
        member = member.union(own.join(member.select("node"), "node", "left_anti"))
    member = materialize(member, "cycle-members")
    inner = edges.join(member.select(F.col("node").alias("subject"), "component").hint("merge"), "subject")
    inner = inner.join(member.select(F.col("node").alias("object"), F.col("component").alias("c2")).hint("merge"), "object").where("component = c2").drop("c2")
    return member, materialize(inner, "cycle-inner")


def cycle_members(graph: Graph, families: list[str], kinds: tuple[str, ...] | None = None, min_confidence: int = 0) -> DataFrame:
    """(component, node) of every strong component, a row for each member."""
    member, _ = _inside(project_edges(graph, edges_of(graph, families, min_confidence), kinds))
    return member.select("component", "node")


def cycles(
    graph: Graph,
    families: list[str],
    min_size: int = 2,
    max_cycles: int = 200,
    kinds: tuple[str, ...] | None = None,
    min_confidence: int = 0,
    rank_by: str = "size",
    include_self: bool = False,
    max_members: int = 64,
) -> DataFrame:
    """(component, size, members, internal_edges, edge_weight, change_risk, break_cost): strong components, ranked.

    Confidence is effective: ``edge_weight`` is its sum, ``break_cost`` its least, over edges inside.
    ``change_risk``: history edges between members. ``members``: the first ``max_members`` of them;
    ``cycle_members`` has all as rows. Ranks: size, weight, change_risk, break_cost, all downwards.
    """
    member, inner = _inside(project_edges(graph, edges_of(graph, families, min_confidence), kinds), include_self)
    sums = inner.groupBy("component").agg(F.count(F.lit(1)).alias("internal_edges"), F.sum("confidence").alias("edge_weight"), F.min("confidence").alias("break_cost"))
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("r") <= max_members)
    shown = first.groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("members"))
    past = project_edges(graph, graph.of("history"), kinds)
    past = past.join(member.select(F.col("node").alias("subject"), "component"), "subject")
    past = past.join(member.select(F.col("node").alias("object"), F.col("component").alias("c2")), "object").where("component = c2")
    risk = past.groupBy("component").agg(F.sum("weight").alias("change_risk"))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    out = sizes.where((F.col("size") >= min_size) | (F.lit(include_self) & (F.col("size") == 1))).join(shown, "component").join(sums, "component")
    out = out.join(risk, "component", "left").fillna(0, ["change_risk"])
    out = out.select("component", "size", "members", "internal_edges", "edge_weight", "change_risk", "break_cost")
    order = {"size": "size", "weight": "edge_weight", "change_risk": "change_risk", "break_cost": "break_cost"}[rank_by]
    return out.orderBy(F.desc(order), "component").limit(max_cycles)


def break_candidates(graph: Graph, families: list[str], per_component: int = 3) -> DataFrame:
    """(component, subject, object, cost, rank): the cheapest edges inside each cycle, cost being the effective confidence."""
    _, inner = _inside(project_edges(graph, edges_of(graph, families), None))
    order = Window.partitionBy("component").orderBy("confidence", "subject", "object")
    ranked = inner.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_component)
    return ranked.select("component", "subject", "object", F.col("confidence").alias("cost"), "rank")


def representative_cycles(graph: Graph, families: list[str]) -> DataFrame:
    """(component, path, confidence): for each component a shortest cycle, its least node first and repeated last; ``shortest_cycles`` says which."""
    _, inner = _inside(project_edges(graph, edges_of(graph, families), None))
    return shortest_cycles(inner).select("component", F.array_join("path", ">").alias("path"), "confidence")


def overview_components(graph: Graph, kinds: tuple[str, ...], max_components: int = 50) -> DataFrame:
    """(component, kind, name, symbol_count, file_count): what lies in each container of ``kinds``, the largest first."""
    at = container_of(graph.entities, kinds)
    inside = at.where("container IS NOT NULL AND container <> id").join(graph.entities.select("id", "path"), "id")
    sums = inside.groupBy("container").agg(F.count(F.lit(1)).alias("symbol_count"), F.count_distinct("path").alias("file_count"))
    named = graph.entities.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("component"), "kind", "name")
    out = named.join(sums.withColumnRenamed("container", "component"), "component", "left")
    out = out.fillna(0, ["symbol_count", "file_count"])
    return out.orderBy(F.desc("symbol_count"), "component").limit(max_components)


def overview_connections(graph: Graph, kinds: tuple[str, ...], families: list[str]) -> DataFrame:
    """(source, target, family, weight, confidence) between distinct components, by the strongest effective confidence."""
    edges = graph.of(*families).select("subject", "object", "family", "confidence", F.lit(1).alias("n"))
    return _connections(edges, _held(graph.entities, kinds), ["n"]).withColumnRenamed("n", "weight").select("source", "target", "family", "weight", "confidence")


def _held(entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, container, tier) of the entities that lie in one of ``kinds``."""
    at = container_of(entities, kinds).where("container IS NOT NULL")
    return materialize(at.join(entities.select("id", "tier"), "id"), "held")


def _connections(edges: DataFrame, held: DataFrame, weights: list[str]) -> DataFrame:
    """(source, target, family, confidence, ..) between distinct components, with the sums of ``weights``.

    An edge meets its subject's component and tier in one join; edges of one component to one object are
    then one row, so the join of objects does not grow with the edges.
    """
    sums = [F.sum(w).alias(w) for w in weights]
    out = edges.join(held.select(F.col("id").alias("subject"), F.col("container").alias("source"), F.col("tier").alias("ts")), "subject")
    out = out.groupBy("source", "object", "family").agg(F.max(F.least("confidence", _top("ts"))).alias("confidence"), *sums)
    out = out.join(held.select(F.col("id").alias("object"), F.col("container").alias("target"), F.col("tier").alias("to")), "object").where("source <> target")
    return out.groupBy("source", "target", "family").agg(F.max(F.least("confidence", _top("to"))).alias("confidence"), *sums)


def community_view(graph: Graph, families: list[str]) -> DataFrame:
    """(node, community) of ``communities`` over effective confidence."""
    return communities(edges_of(graph, families))


def hotspots(connections: DataFrame) -> DataFrame:
    """(component, fan_in, fan_out, score): distinct neighbours each way; score 0..1000 against the busiest."""
    out = connections.groupBy(F.col("source").alias("component")).agg(F.count_distinct("target").alias("fan_out"))
    in_ = connections.groupBy(F.col("target").alias("component")).agg(F.count_distinct("source").alias("fan_in"))
    both = out.join(in_, "component", "full_outer").fillna(0, ["fan_in", "fan_out"])
    most = both.agg(F.max(F.col("fan_in") + F.col("fan_out")).alias("most"))
    return both.join(F.broadcast(most)).select("component", "fan_in", "fan_out", F.expr("(fan_in + fan_out) * 1000 div most").alias("score"))


#: What each policy takes for entry points beside those given: public entities, tests, kinds.
DEAD_POLICIES = {
    "standard": (False, True, ()),
    "library": (True, True, ()),
    "application": (False, True, ("route", "service")),
    "framework_specific": (False, True, ("route", "service", "event", "migration")),
    "explicit": (False, False, ()),
}


def dead_code(
    graph: Graph,
    entries: DataFrame,
    kinds: tuple[str, ...],
    families: list[str],
    policy: str = "standard",
    include_exported: bool = False,
    include_tests: bool = False,
    min_confidence: int = 0,
    max_depth: int | None = None,
) -> DataFrame:
    """(symbol, classification, confidence, why, incoming_edges, strongest): entities of ``kinds`` that no entry point reaches.

    Entry points are ``entries`` (id) and what ``policy`` adds. They are followed until nothing new is
    reached, unless ``max_depth`` is given. Exported entities and tests are suppressed unless asked
    for. No incoming edge: isolated, 300. Incoming at an effective confidence of 900 or more:
    strongly_referenced, 100; else weakly_referenced, 200. All of it is evidence from partial entry
    points, which ``why`` says. By confidence downwards, then symbol.
    """
    public, tests, more = DEAD_POLICIES[policy]
    edges = materialize(edges_of(graph, families, min_confidence), "dead-edges")
    also = F.col("kind").isin(*more) if more else F.lit(False)
    if public:
        also = also | (F.col("visibility") == "public")
    if tests:
        also = also | (F.col("kind") == "test")
    start = entries.select("id").union(graph.entities.where(also).select("id"))
    alive = reach(edges, start, "outbound", max_depth).select(F.col("node").alias("id"))
    rows = graph.entities.where(F.col("kind").isin(*kinds))
    if not include_exported:
        rows = rows.where("visibility <> 'public'")
    if not include_tests:
        rows = rows.where("kind <> 'test'")
    rows = rows.select("id").join(alive, "id", "left_anti")
    incoming = edges.groupBy(F.col("object").alias("id")).agg(F.count(F.lit(1)).alias("incoming_edges"), F.max("confidence").alias("strongest"))
    out = rows.join(incoming, "id", "left").fillna(0, ["incoming_edges", "strongest"])
    none, strong = F.col("incoming_edges") == 0, F.col("strongest") >= 900
    name = F.when(none, "isolated").when(strong, "strongly_referenced").otherwise("weakly_referenced")
    level = F.when(none, 300).when(strong, 100).otherwise(200)
    partial = "not_observed_from_partial_entry_points"
    why = F.when(none, f"no_incoming_references,{partial}").otherwise(partial)
    out = out.select(F.col("id").alias("symbol"), name.alias("classification"), level.alias("confidence"), why.alias("why"), "incoming_edges", "strongest")
    return out.orderBy(F.desc("confidence"), "symbol")


def dead_code_suppressions(graph: Graph, kinds: tuple[str, ...], include_exported: bool = False, include_tests: bool = False) -> DataFrame:
    """(reason, count) of the entities of ``kinds`` that ``dead_code`` doesn't judge."""
    rows = graph.entities.where(F.col("kind").isin(*kinds))
    reason = F.when((F.col("visibility") == "public") & F.lit(not include_exported), "exported").when((F.col("kind") == "test") & F.lit(not include_tests), "test")
    return rows.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


#: Lines of a bin in which changed lines meet the spans of entities.
LINE_BIN = 64


def resolve_changes(graph: Graph, changes: DataFrame) -> DataFrame:
    """(id, path, classification, lines) of changed files (path) or hunks (path, start, end; both lines are changed).

    A changed line belongs to the innermost entity whose span (line_start, line_end) holds it:
    symbol_level, with the number of such lines; lines that none holds are their file's: file_level, id
    null. Lines meet spans in bins of ``LINE_BIN`` lines of a file, so a long file's entities are not all
    paired with all its hunks. Of files without lines every entity there is changed. An empty hunk (end
    before start), which only takes lines away, changes the line it stands at.
    """
    if "start" not in changes.columns:
        at = changes.select("path").distinct().join(graph.entities.select("id", "path"), "path", "left")
        return at.select("id", "path", F.when(F.col("id").isNull(), "file_level").otherwise("symbol_level").alias("classification"), F.lit(None).cast("long").alias("lines"))
    bin_of = lambda c: F.floor(c / LINE_BIN)
    lines = changes.select("path", F.explode(F.sequence("start", F.greatest("start", "end"))).alias("line")).distinct().withColumn("bin", bin_of(F.col("line")))
    spans = graph.entities.where("kind <> 'file' AND line_start <= line_end")
    spans = spans.select("id", "path", "line_start", "line_end", F.explode(F.sequence(bin_of(F.col("line_start")), bin_of(F.col("line_end")))).alias("bin"))
    met = lines.join(spans, ["path", "bin"]).where("line BETWEEN line_start AND line_end")
    inner = met.groupBy("path", "line").agg(F.max(F.struct("line_start", -F.col("line_end"), "id")).alias("in"))
    own = lines.join(inner, ["path", "line"], "left").groupBy("path", F.col("in.id").alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    return own.select("id", "path", F.when(F.col("id").isNull(), "file_level").otherwise("symbol_level").alias("classification"), "lines")


def impact_of_changes(graph: Graph, changes: DataFrame, families: list[str], max_depth: int = 3, policy: str = "standard") -> DataFrame:
    """``change_impact`` of what ``resolve_changes`` finds in changed files or hunks; file-level changes count as their file's entity, if there is one."""
    found = materialize(resolve_changes(graph, changes), "changes-resolved")
    files = graph.entities.where("kind = 'file'").select("path", F.col("id").alias("file_id"))
    ids = found.join(files, "path", "left").select(F.coalesce("id", "file_id").alias("id")).where("id IS NOT NULL").distinct()
    return change_impact(graph, ids, families, max_depth, policy)


def change_impact(graph: Graph, changed: DataFrame, families: list[str], max_depth: int = 3, policy: str = "standard") -> DataFrame:
    """(symbol, distance, confidence, via, dynamic, is_public): what depends on ``changed`` (id), by reverse steps.

    direct_only takes one step; standard leaves out links of an effective confidence below 300;
    conservative takes all. ``via``: families of the links that lead one step nearer; ``dynamic``: all
    of these are dispatch candidates, so the dependence itself is not sure. Only edges that a hop meets
    are given their effective confidence, the others are not joined with entities.
    """
    least = 300 if policy == "standard" else 0
    edges = graph.of(*families)
    found = reach(edges, changed, "inbound", 1 if policy == "direct_only" else max_depth, _weighing(graph, least))
    near = found.select(F.col("node").alias("object"), (F.col("depth") + 1).alias("depth"))
    steps = edges.select("subject", "object", "family", "predicate", "confidence").join(near, "object")
    steps = materialize(steps.join(found.select(F.col("node").alias("subject"), "depth"), ["subject", "depth"]), "impact-steps")
    steps = effective(graph, steps, few=True).where(F.col("confidence") >= least)
    via = steps.groupBy(F.col("subject").alias("node")).agg(
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("via"), F.bool_and(F.col("predicate") == "dispatch_candidate").alias("dynamic")
    )
    out = materialize(found.where("depth > 0").join(via, "node"), "impact-found")
    public = graph.entities.select(F.col("id").alias("node"), (F.col("visibility") == "public").alias("is_public"))
    out = out.join(public.join(out.select("node"), "node", "left_semi"), "node", "left")
    return out.select(F.col("node").alias("symbol"), F.col("depth").alias("distance"), "confidence", "via", "dynamic", F.coalesce("is_public", F.lit(False)).alias("is_public"))


def risk_summary(impact: DataFrame) -> DataFrame:
    """(level, fanout, breaking_surface, dynamic_blind_spots): none 0, low under 5, medium under 20, else high; public and 20 or more: critical."""
    sums = impact.agg(F.count(F.lit(1)).alias("fanout"), F.count_if("is_public").alias("breaking_surface"), F.count_if("dynamic").alias("dynamic_blind_spots"))
    level = (
        F.when(F.col("fanout") == 0, "none")
        .when((F.col("fanout") >= 20) & (F.col("breaking_surface") > 0), "critical")
        .when((F.col("fanout") >= 20) | ((F.col("fanout") >= 5) & (F.col("breaking_surface") > 0)), "high")
        .when(F.col("fanout") >= 5, "medium")
        .otherwise("low")
    )
    return sums.select(level.alias("level"), "fanout", "breaking_surface", "dynamic_blind_spots")


#: Kinds of tests, by what their path holds; the first that fits.
TEST_KINDS = (("end_to_end", r"(^|/)e2e(/|_)|end_to_end"), ("integration", r"(^|/)integration|_it\."), ("property", r"prop(erty)?_?test|(^|/)fuzz"), ("benchmark", r"(^|/)bench"), ("snapshot", r"snapshot|golden"))


def kind_of_test(path: Column) -> Column:
    """The kind of a test by its path."""
    out = F.lit("unit")
    for kind, pattern in reversed(TEST_KINDS):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def select_tests(
    graph: Graph,
    subjects: DataFrame,
    max_hops: int = 2,
    max_results: int = 100,
    budget: int | None = None,
    cost: int = 1,
    kinds: tuple[str, ...] | None = None,
    co_located: bool = False,
) -> DataFrame:
    """(test, score, why, rank): tests of ``subjects`` (id) ranked; direct edge 900 or its effective confidence, through callers 700 - 100 a hop.

    With ``co_located`` tests that lie in the folder of a subject count 300. ``kinds``: of
    ``TEST_KINDS`` or unit, by path. With ``budget`` the ranked tests are taken while their running
    cost fits.
    """
    near = reach(graph.of("calls", "build_dependency"), subjects, "inbound", max_hops)
    hit = graph.of("tests").select("subject", "object", "confidence").join(near.select(F.col("node").alias("object"), "depth"), "object")
    hit = effective(graph, materialize(hit, "test-hits"), few=True).select(F.col("subject").alias("test"), "depth", "confidence")
    scored = hit.select(
        "test",
        F.when(F.col("depth") == 0, F.least("confidence", F.lit(900))).otherwise(700 - 100 * F.col("depth")).alias("score"),
        F.when(F.col("depth") == 0, "direct_test_edge").otherwise(F.concat(F.lit("via:calls:"), F.col("depth").cast("string"))).alias("why"),
    )
    folder = F.regexp_extract("path", "^(.*)/", 1)
    if co_located:
        there = graph.entities.join(subjects.select("id").distinct(), "id", "left_semi").select(folder.alias("folder")).where("folder <> ''").distinct()
        beside = graph.entities.where("kind = 'test'").select(F.col("id").alias("test"), folder.alias("folder")).join(there, "folder", "left_semi")
        scored = scored.union(beside.select("test", F.lit(300), F.lit("co_located")))
    if kinds:
        of_kind = graph.entities.where(kind_of_test(F.col("path")).isin(*kinds)).select(F.col("id").alias("test"))
        scored = scored.join(of_kind, "test", "left_semi")
    best = scored.groupBy("test").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("why")), ",").alias("why"))
    top = best.orderBy(F.desc("score"), "test").limit(max_results)  # the report's bound; ranks are of the report
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "test")))
    return out.where(F.col("rank") * cost <= budget) if budget is not None else out


def gaps_of_tests(graph: Graph, subjects: DataFrame, max_hops: int = 2) -> DataFrame:
    """(id): subjects that no test reaches, directly or through callers."""
    tested = graph.of("tests").select(F.col("object").alias("id")).distinct()
    covered = reach(graph.of("calls", "build_dependency"), tested, "outbound", max_hops)
    return subjects.select("id").distinct().join(covered.select(F.col("node").alias("id")), "id", "left_anti")


def compare(base: Graph, head: Graph) -> DataFrame:
    """(id, change, significance, consumers): entities added, removed, renamed, moved, of another signature or modified, with consumers of the base.

    Signatures are compared where both sides have the column ``signature``.
    """
    signed = "signature" in base.entities.columns and "signature" in head.entities.columns
    cols = ("kind", "name", "qualified_name", "visibility", "container_id", "language", *(("signature",) if signed else ()))
    b = base.entities.select("id", F.struct(*cols).alias("b"))
    h = head.entities.select("id", F.struct(*cols).alias("h"))
    joined = b.join(h, "id", "full_outer").where(~F.col("b").eqNullSafe(F.col("h")))
    change = (
        F.when(F.col("b").isNull(), "added")
        .when(F.col("h").isNull(), "removed")
        .when(~F.col("b.qualified_name").eqNullSafe(F.col("h.qualified_name")), "renamed")
        .when(~F.col("b.container_id").eqNullSafe(F.col("h.container_id")), "moved")
        .when(~F.col("b.signature").eqNullSafe(F.col("h.signature")) if signed else F.lit(False), "signature_modified")
        .otherwise("modified")
    )
    consumers = base.relations.where("predicate <> 'contains' AND predicate <> 'declares'").groupBy(F.col("object").alias("id")).agg(F.count_distinct("subject").alias("consumers"))
    out = joined.select("id", change.alias("change"), F.coalesce("b.visibility", "h.visibility").alias("visibility")).join(consumers, "id", "left")
    weight = (
        F.when((F.col("change") == "removed") & (F.col("visibility") == "public"), 1000)
        .when(F.col("change") == "removed", 800)
        .when(F.col("change") == "signature_modified", 900)
        .when(F.col("change").isin("renamed", "moved"), 700)
        .when(F.col("change") == "added", 600)
        .otherwise(400)
    )
    return out.select("id", "change", weight.alias("significance"), F.coalesce("consumers", F.lit(0)).alias("consumers"))


def compare_relations(base: Graph, head: Graph) -> DataFrame:
    """(id, change): relations added, removed, or of another confidence."""
    b = base.relations.groupBy("id").agg(F.max("confidence").alias("b"))
    h = head.relations.groupBy("id").agg(F.max("confidence").alias("h"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("modified")
    return b.join(h, "id", "full_outer").where(~F.col("b").eqNullSafe(F.col("h"))).select("id", change.alias("change"))


def lineage(base: Graph, head: Graph) -> DataFrame:
    """(base_id, head_id, confidence, is_rename): the same id 1000; else the only pair of a removed and an added entity of equal kind, name and container, 700."""
    same = base.entities.select(F.col("id").alias("base_id")).join(head.entities.select(F.col("id").alias("head_id")), F.col("base_id") == F.col("head_id"))
    gone = base.entities.join(head.entities.select("id"), "id", "left_anti")
    new = head.entities.join(base.entities.select("id"), "id", "left_anti")
    key = [F.col("kind"), F.col("name"), F.coalesce("container_id", F.lit("")).alias("c")]
    one = lambda df, name: df.groupBy(*key).agg(F.min("id").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    moved = one(gone, "base_id").join(one(new, "head_id"), ["kind", "name", "c"]).select("base_id", "head_id")
    return same.select("base_id", "head_id", F.lit(1000).alias("confidence"), F.lit(False).alias("is_rename")).union(
        moved.select("base_id", "head_id", F.lit(700), F.lit(True))
    )


def compare_lineage(head: Graph) -> DataFrame:
    """(id, change, parts): entities split or merged, as the head's lineage relations tell; parts of a split, sources of a merger."""
    r = head.relations.where(F.col("predicate").isin("lineage_split_from", "lineage_merged_from"))
    split = r.where("predicate = 'lineage_split_from'").groupBy(F.col("object").alias("id")).agg(F.count_distinct("subject").alias("parts"))
    merged = r.where("predicate = 'lineage_merged_from'").groupBy(F.col("subject").alias("id")).agg(F.count_distinct("object").alias("parts"))
    return split.select("id", F.lit("split").alias("change"), "parts").union(merged.select("id", F.lit("merged"), "parts"))


def compare_architecture(base: Graph, head: Graph, kinds: tuple[str, ...], families: list[str]) -> DataFrame:
    """(source, target, family, change, weight_before, weight_after): connections between components that came, went or changed in weight."""
    if base.entities is head.entities:  # both sides' edges lie in the same components: one pass has both weights
        tell = lambda g, b, h: g.of(*families).select("subject", "object", "family", F.lit(0).alias("confidence"), F.lit(b).cast("int").alias("b"), F.lit(h).cast("int").alias("h"))
        j = _connections(tell(base, 1, None).unionByName(tell(head, None, 1)), _held(base.entities, kinds), ["b", "h"])
    else:
        side = lambda g, n: overview_connections(g, kinds, families).select("source", "target", "family", F.col("weight").alias(n))
        j = side(base, "b").join(side(head, "h"), ["source", "target", "family"], "full_outer")
    j = j.where(~F.col("b").eqNullSafe(F.col("h")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("architecture_changed")
    return j.select("source", "target", "family", change.alias("change"), F.coalesce("b", F.lit(0)).alias("weight_before"), F.coalesce("h", F.lit(0)).alias("weight_after"))


#: What is done to the targets of a plan, by its objective.
OBJECTIVES = {"bug_fix": "edit_target", "refactor": "refactor_target", "explanation": "read_target", "migration": "migrate_target", "review": "review_target"}


def plan_change(graph: Graph, targets: DataFrame, families: list[str], max_steps: int = 6, objective: str = "bug_fix") -> DataFrame:
    """(step, action, symbol, depends_on): change the targets, then dependents by distance, then run the tests; ``max_steps`` of them.

    What is done to the targets is that of ``objective``; each step depends on the one before.
    """
    edit = targets.select(F.lit(0).alias("phase"), F.lit(OBJECTIVES[objective]).alias("action"), F.col("id").alias("symbol"))
    impact = change_impact(graph, targets, families, max_depth=2)
    adapt = impact.select(F.col("distance").alias("phase"), F.lit("adapt_dependent").alias("action"), "symbol")
    check = select_tests(graph, targets, max_hops=1, max_results=max_steps).select(F.lit(9).alias("phase"), F.lit("run_test").alias("action"), F.col("test").alias("symbol"))
    steps = edit.union(adapt).union(check).orderBy("phase", "symbol").limit(max_steps)
    order = Window.orderBy("phase", "symbol")  # over the few steps kept
    numbered = steps.withColumn("step", F.row_number().over(order))
    return numbered.select("step", "action", "symbol", F.when(F.col("step") > 1, F.col("step") - 1).otherwise(0).alias("depends_on"))


def graph_projection(nodes: DataFrame, edges: DataFrame, max_nodes: int = 512, max_edges: int = 2048) -> DataFrame:
    """(source, target, family, weight, confidence) over ordinals of ``nodes`` (id, in id order), both ends shown, at most ``max_edges``."""
    shown = nodes.select("id").orderBy("id").limit(max_nodes)
    shown = shown.withColumn("ordinal", (F.row_number().over(Window.orderBy("id")) - 1).cast("int"))
    out = edges.join(shown.select(F.col("id").alias("source"), F.col("ordinal").alias("s")), "source")
    out = out.join(shown.select(F.col("id").alias("target"), F.col("ordinal").alias("t")), "target")
    out = out.select(F.col("s").alias("source"), F.col("t").alias("target"), "family", "weight", "confidence")
    return out.orderBy("source", "target", "family").limit(max_edges)


def projection_omissions(nodes: DataFrame, edges: DataFrame, max_nodes: int = 512, max_edges: int = 2048) -> DataFrame:
    """(omitted_nodes, omitted_edges): what ``graph_projection`` of the same arguments leaves out."""
    shown = graph_projection(nodes, edges, max_nodes, max_edges).agg(F.count(F.lit(1)).alias("e"))
    sums = nodes.agg(F.greatest(F.count(F.lit(1)) - max_nodes, F.lit(0)).alias("omitted_nodes"))
    all_ = edges.agg(F.count(F.lit(1)).alias("a"))
    return sums.join(F.broadcast(all_)).join(F.broadcast(shown)).select("omitted_nodes", (F.col("a") - F.col("e")).alias("omitted_edges"))  # a row each
