"""From a folder of source files to an active snapshot, and its status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROLE_PREDICATES, mapping
from ..operators.resolve import candidates, decide, derive_relations
from ..runtime import materialize
from .calls import bindings, bound_calls, call_relations, module_keys, modules, route_of
from .files import discover
from .snapshots import SnapshotStore
from .syntax import HOLDERS, imported_module, module_name, routes, scoped_declarations, scoped_lines, uses


_FID = "file:"


def _fid(path) -> Column:
    return F.concat(F.lit(_FID), path)


def local_facts(texts: DataFrame, root: str = "", roles: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Entities, occurrences, bindings and routes of (path, language, text): what each file says by itself, in rows of its ``file``.

    Declarations lie in what is open around them: methods in types, functions in functions, the rest in
    their file; each has the span of its lines. A use stands for the innermost declaration around it,
    else for its file; a base for its heir. With ``roles`` occurrences are the uses of these alone.
    """
    below = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "") if root else F.col("path")
    texts = materialize(texts.select("path", "language", "text", below.alias("below")), "source-texts")
    lines = materialize(scoped_lines(texts), "source-lines")
    d = scoped_declarations(lines)
    none, no_line = F.lit(None).cast("string"), F.lit(None).cast("int")
    own_id = lambda path, name, line: F.concat(_fid(F.col(path)), F.lit("#"), F.col(name), F.lit("@"), F.col(line).cast("string"))
    module = texts.select(
        _fid(F.col("path")).alias("id"), F.lit("file").alias("kind"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), module_name(F.col("below")).alias("qualified_name"),
        none.alias("container_id"), F.lit("public").alias("visibility"), F.lit("B").alias("tier"), "language", "path", F.lit(1).alias("line_start"), F.size(F.split("text", "\r?\n")).alias("line_end"),
        none.alias("holder"), no_line.alias("holder_line"), no_line.alias("holder_end"), "below",
    )
    # What a declaration lies in: by its line where that declares it, else by name (a block that implements a type, a receiver).
    d = materialize(d, "source-declarations")
    types = d.where(F.col("kind").isin(*HOLDERS)).groupBy("path", F.col("name").alias("holder")).agg(F.min(F.struct("line", "end")).alias("type"))
    d = d.join(types, ["path", "holder"], "left").withColumn("holder_line", F.coalesce("holder_line", "type.line"))
    ends = d.groupBy("path", F.col("line").alias("holder_line")).agg(F.max("end").alias("holder_end"))
    d = materialize(d.join(ends, ["path", "holder_line"], "left").withColumn("id", own_id("path", "name", "line")).dropDuplicates(["id"]), "source-declared")
    inner = F.when(F.col("holder_line").isNotNull(), own_id("path", "holder", "holder_line")).otherwise(_fid(F.col("path")))
    own = d.select(
        "id", "kind", "name", F.concat_ws(".", F.col("path"), "chain", F.col("name")).alias("qualified_name"), inner.alias("container_id"), F.when(F.col("name").startswith("_"), "private").otherwise("public").alias("visibility"),
        F.lit("B").alias("tier"), "language", "path", F.col("line").alias("line_start"), F.col("end").alias("line_end"), "holder", "holder_line", "holder_end", none.alias("below"),
    )
    # The innermost declaration around a use: the last one of the line that opened its scope, which the use's own line tells.
    of_scope = d.groupBy("path", F.col("line").alias("inside")).agg(F.max(F.struct("kind", "id", "holder")).alias("scope"))
    u = uses(texts, lines)
    u = u if roles is None else u.where(F.col("role").isin(*roles))
    u = u.withColumn("text", F.when(F.col("role") == "import_use", imported_module(F.col("text"), below)).otherwise(F.col("text")))
    heirs = own.where(F.col("kind").isin("class", "struct", "interface", "trait", "enum")).groupBy("path", F.col("name").alias("heir")).agg(F.min("id").alias("heir_id"))
    # Few uses have an heir; the others are not shuffled to look for one.
    u = u.where("heir IS NOT NULL").join(heirs, ["path", "heir"], "left").unionByName(u.where("heir IS NULL").withColumn("heir_id", none))
    u = u.join(of_scope, ["path", "inside"], "left")
    tail = [F.coalesce(F.concat(F.lit(":"), F.col(c)), F.lit("")) for c in ("qualifier", "heir")]
    enclosing = F.coalesce("heir_id", F.when(F.col("role") != "import_use", F.col("scope.id")), _fid(F.col("path")))
    occurrences = u.select(
        F.concat(_fid(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(":"), "role", F.lit(":"), "text", *tail).alias("id"), "role", "text", "language", F.lit("B").alias("tier"),
        F.col("path").alias("file"), enclosing.alias("enclosing"), F.lit("line.use").alias("syntax_kind"), "line", "qualifier", F.col("scope.holder").alias("holder"),
    )
    return {
        "entities": materialize(module.unionByName(own).withColumn("file", F.col("path")), "source-entities"),
        "occurrences": materialize(occurrences, "occurrences"),
        "bindings": materialize(bindings(lines.withColumn("below", below)).withColumnRenamed("path", "file"), "source-bindings"),
        "routes": materialize(routes(texts).withColumnRenamed("path", "file"), "source-routes"),
    }


def route_entities(served: DataFrame) -> DataFrame:
    """An entity for each route, whatever files serve it."""
    none = F.lit(None).cast("string")
    return served.groupBy("key").agg(F.min("file").alias("path"), F.min("language").alias("language")).select(
        F.concat(F.lit("route:"), "key").alias("id"), F.lit("route").alias("kind"), F.col("key").alias("name"), F.col("key").alias("qualified_name"), none.alias("container_id"), F.lit("public").alias("visibility"), F.lit("B").alias("tier"), "language", "path"
    )


def relations_of(found: dict[str, DataFrame], only: DataFrame | None = None) -> DataFrame:
    """(id, subject, predicate, object, confidence, file) of the facts of all files; with ``only`` (file) those that the uses of these files yield.

    Calls are bound by scopes, imports and qualifiers; those that are not, and all other uses, by the
    resolver. Files are modules by their path below the root, so an import binds to the file it names.
    """
    part = lambda df: df if only is None else df.join(only, "file", "left_semi")
    entities = found["entities"]
    occurrences = found["occurrences"] if only is None else materialize(part(found["occurrences"]), "occurrences-asked")
    calls = occurrences.where("role = 'call_site'").withColumn("qualifier", F.coalesce("qualifier", F.lit(""))).withColumn("path", F.col("file"))
    declared = entities.where("kind NOT IN ('file', 'route')")
    units = modules(entities.where("kind = 'file'"))
    bound = materialize(bound_calls(calls, declared, part(found["bindings"]).withColumnRenamed("file", "path"), units), "calls-bound")
    called = call_relations(calls, bound).select("subject", "predicate", "object", "confidence", "file")
    rest = materialize(occurrences.join(bound.select("id"), "id", "left_anti"), "occurrences-left")
    near = candidates(rest, entities)
    decided = materialize(decide(rest, near), "decisions")
    resolved = derive_relations(decided, near)
    # A base named in another file scores below a resolved one: the only candidate is taken, at its score.
    only_one = decided.where("outcome = 'candidates' AND total = 1 AND role IN ('inheritance_use', 'implementation_use', 'type_use')")
    alone = only_one.select(F.col("occurrence").alias("subject"), mapping(F.col("role"), ROLE_PREDICATES).alias("predicate"), F.col("symbols")[0].alias("object"), "confidence")
    held = resolved.union(alone).join(occurrences.select(F.col("id").alias("subject"), "enclosing", "file"), "subject").select(F.col("enclosing").alias("subject"), "predicate", "object", "confidence", "file")
    inside = part(declared).select(F.col("container_id").alias("subject"), F.lit("contains").alias("predicate"), F.col("id").alias("object"), F.lit(1000).alias("confidence"), "file")
    serves = part(found["routes"]).select(_fid(F.col("file")).alias("subject"), F.lit("serves_route").alias("predicate"), F.concat(F.lit("route:"), "key").alias("object"), F.lit(900).alias("confidence"), "file")
    relations = held.union(called).union(inside).union(serves).groupBy("subject", "predicate", "object", "file").agg(F.max("confidence").alias("confidence"))
    return relations.withColumn("id", F.concat_ws("|", "subject", "predicate", "object"))


def facts(texts: DataFrame, root: str = "", roles: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Entities, occurrences and relations of (path, language, text; paths are unique); with ``roles`` the occurrences of these alone, and the relations that they yield."""
    found = local_facts(texts, root, roles)
    found["entities"] = found["entities"].unionByName(route_entities(found["routes"]), allowMissingColumns=True)
    return {"entities": found["entities"], "occurrences": found["occurrences"], "relations": relations_of(found)}


_KNOWN = "language <> 'unknown' AND status = 'eligible'"
#: Tables whose rows a file's own text gives.
_LOCAL = ("entities", "occurrences", "bindings", "routes")


def _listed(spark: SparkSession, root: str, exclude: tuple[str, ...]) -> DataFrame:
    listed = discover(spark, root, exclude=exclude)
    return listed.select(_fid(F.col("path")).alias("id"), "path", "content_hash", "byte_length", "language", "generated", "class", "status")


def _texts(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.join(files.where(_KNOWN).select("path", "language"), "path").select("path", "language", F.decode("content", "UTF-8").alias("text"))


def _covered(files: DataFrame) -> DataFrame:
    known = F.expr(_KNOWN)
    out = files.groupBy("language").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(known).alias("indexed"), F.count_if(~known).alias("skipped"))
    return out.select(F.concat(F.lit("coverage:"), "language").alias("id"), F.lit("language").alias("scope_kind"), F.col("language").alias("scope_id"), F.lit("syntax").alias("domain"), "discovered", "indexed", "skipped")


def _local_root(spark: SparkSession, root: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()


def index_repository(spark: SparkSession, root: str, store: SnapshotStore, generation: str, exclude: tuple[str, ...] = ()) -> None:
    """Discover, extract, resolve, and commit as the active snapshot, whose facts are kept file by file."""
    files = materialize(_listed(spark, root, exclude), "source-files")
    found = local_facts(_texts(spark, root, files), _local_root(spark, root))
    routed = route_entities(found["routes"])
    relations = relations_of(found | {"entities": found["entities"].unionByName(routed, allowMissingColumns=True)})
    at = F.lit(generation)
    parts = {t: (found[t], "facts_at") for t in _LOCAL} | {"relations": (relations, "relations_at")}
    store.stage(generation, {"files": files.withColumns({"facts_at": at, "relations_at": at}), "coverage": _covered(files), "entities": routed}, parts=parts)
    store.commit(generation)


def refresh_repository(spark: SparkSession, root: str, store: SnapshotStore, generation: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Bring the active snapshot up to the folder as it is now; (path, change) of files added, modified or deleted.

    Only changed files are read and extracted; their facts replace the old ones. Relations are derived
    anew for these files and for those whose uses or imports may mean something else now: they spell a
    name that a changed file declares or declared, or a module that came or went. A moved file is
    deleted here and added there. Nothing changed: no snapshot is made.
    """
    active = store.active()
    base = materialize(store.read("files", active), "refresh-base")
    now = materialize(_listed(spark, root, exclude), "refresh-files")
    same = ["path", "content_hash", "language", "status"]
    key = F.struct(*same[1:])
    j = base.select("path", key.alias("b"), "facts_at", "relations_at").join(now.select("path", key.alias("n")), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~F.col("b").eqNullSafe(F.col("n")), "modified")
    j = materialize(j.select("path", change.alias("change"), "facts_at", "relations_at"), "refresh-changes")
    changes = j.where("change IS NOT NULL").select("path", "change")
    if changes.isEmpty():
        return changes
    fresh = now.join(changes.where("change <> 'deleted'"), "path", "left_semi")
    new = local_facts(_texts(spark, root, fresh), _local_root(spark, root))
    touched = changes.select(F.col("path").alias("file"))
    old = {t: store.read(t, active) for t in _LOCAL}
    kept = {t: df.where("file IS NOT NULL").join(touched, "file", "left_anti") for t, df in old.items()}
    whole = {t: kept[t].unionByName(new[t], allowMissingColumns=True) for t in _LOCAL}
    routed = materialize(route_entities(whole["routes"]), "refresh-routes")
    # What a use may spell differently now: names in changed files before and after, and what their modules may be called.
    gone = old["entities"].join(touched, "file", "left_semi")
    stirred = materialize(gone.unionByName(new["entities"], allowMissingColumns=True), "refresh-stirred")
    names = stirred.select(F.explode(F.array("name", "qualified_name")).alias("text"))
    keys = module_keys(stirred.where("kind = 'file'")).select(F.col("key").alias("text"))
    routes_now = old["routes"].join(touched, "file", "left_semi").select("key").union(new["routes"].select("key")).select(F.col("key").alias("text"))
    spelled = materialize(names.union(keys).union(routes_now).distinct(), "refresh-names")
    said = kept["occurrences"].select("file", F.explode(F.array("text", route_of("qualifier"))).alias("text"))
    said = said.union(kept["bindings"].select("file", F.explode(F.array("imported", "module")).alias("text")))
    again = materialize(said.join(spelled, "text", "left_semi").select("file").union(touched).distinct(), "refresh-again")
    entities = whole["entities"].unionByName(routed, allowMissingColumns=True)
    relations = relations_of(whole | {"entities": entities}, again)
    at = j.select("path", F.when(F.col("change").isNull(), F.col("facts_at")).otherwise(generation).alias("facts_at"), F.col("relations_at").alias("r"))
    files = now.join(at, "path").join(again.select(F.col("file").alias("path"), F.lit(generation).alias("new_at")), "path", "left").withColumn("relations_at", F.coalesce("new_at", "r")).drop("r", "new_at")
    parts = {t: (new[t], "facts_at") for t in _LOCAL} | {"relations": (relations, "relations_at")}
    store.stage(generation, {"files": files, "coverage": _covered(now), "entities": routed}, carry_from=active, parts=parts)
    store.commit(generation)
    return changes


def status(store: SnapshotStore) -> DataFrame:
    """(generation, discovered, indexed, skipped, status) of the active snapshot: complete only if nothing was skipped."""
    c = store.read("coverage").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("discovered", "indexed", "skipped")])
    return c.select(F.lit(store.active()).alias("generation"), "*", F.when(F.col("skipped") == 0, "complete").otherwise("bounded").alias("status"))
