"""Who calls whom: calls are bound to declarations by scopes, imports and qualifiers, all by equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .syntax import imported_module, module_name

# Imports that name what they bring, as (pattern, group of the module, group of the names, form).
BINDINGS = {
    "python": ((r"^\s*from\s+([\w.]+)\s+import\s+\(?([\w\s,*]+)", 1, 2, "named"), (r"^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", 1, 2, "namespace")),
    "javascript": (
        (r"^\s*import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]", 2, 1, "named"),
        (r"^\s*import\s+\*\s+as\s+(\w+)\s+from\s*['\"]([^'\"]+)['\"]", 2, 1, "namespace"),
        (r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*require\(['\"]([^'\"]+)['\"]", 2, 1, "namespace"),
        (r"^\s*(?:const|let|var)\s+\{([^}]*)\}\s*=\s*require\(['\"]([^'\"]+)['\"]", 2, 1, "named"),
    ),
    "rust": ((r"^\s*(?:pub\s+)?use\s+([\w:]+?)::\{?([\w\s,*]+)\}?\s*;", 1, 2, "named"), (r"^\s*(?:pub\s+)?use\s+([\w:]+)(?:\s+as\s+(\w+))?\s*;", 1, 2, "namespace")),
    "go": ((r"^\s*(?:import\s+)?(\w+)?\s*\"([^\"]+)\"\s*$", 2, 1, "namespace"),),
    "java": ((r"^\s*import\s+(?:static\s+)?([\w.]+\.(\w+))\s*;", 1, 2, "named"),),
}
BINDINGS["typescript"] = BINDINGS["javascript"]
# What a line that one of these patterns fits holds at least one of.
BINDING_SIGNS = ("import", "use", "require", '"')
# The confidence of a call by what its language leaves open until it runs.
CALL_CONFIDENCE = {"rust": 850, "go": 850, "java": 850, "c": 850, "cpp": 850, "csharp": 850, "typescript": 800, "javascript": 650, "python": 650, "ruby": 650, "php": 650}
# Names of the object whose method runs, and languages in which it need not be named.
OWN = ("self", "this", "Self", "cls")
IMPLICIT_OWN = ("java", "csharp", "cpp", "ruby")
#: Languages of one family import each other's files.
FAMILY = {"typescript": "javascript", "cpp": "c"}
#: Languages whose unit of names is the folder.
BY_FOLDER = ("go",)


def family(language: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in FAMILY.items() for x in p])[language], language)


def unit_of(path: Column, language: Column) -> Column:
    """What top-level names of a file are visible in without an import: the file, or its folder."""
    return F.when(language.isin(*BY_FOLDER), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(path)


def module_keys(files: DataFrame) -> DataFrame:
    """(family, unit, whole, key) of file entities (path, language, below): all dotted endings of a unit's path below the root."""
    dotted = F.when(F.col("language").isin(*BY_FOLDER), F.translate(F.regexp_extract("below", "^(.*)/[^/]*$", 1), "/", ".")).otherwise(module_name(F.col("below")))
    named = files.select(family(F.col("language")).alias("family"), dotted.alias("whole"), unit_of(F.col("path"), F.col("language")).alias("unit")).distinct()
    parts = F.split("whole", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return named.select("family", "unit", "whole", F.explode(ends).alias("key"))


def modules(files: DataFrame) -> DataFrame:
    """(family, key, unit): what an import may call a unit, by its whole dotted path below the root, or by an ending of it that no other has."""
    # A whole name goes before an ending; a key of several units names none.
    best = module_keys(files).groupBy("family", "key").agg(F.count_if(F.col("key") == F.col("whole")).alias("wholes"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("key") != F.col("whole"), "unit")).alias("first"))
    return best.where("wholes = 1 OR (wholes = 0 AND n = 1)").select("family", "key", F.col("first.unit").alias("unit"))


def route_of(qualifier: str) -> Column:
    """The dotted module that a qualifier's path names."""
    return F.regexp_replace(imported_module(F.concat(F.col(qualifier), F.lit("::")), F.lit("")), r"\.+$", "")


def bindings(lines: DataFrame) -> DataFrame:
    """(path, family, local, module, imported, form) of import lines: named (local stands for ``imported`` of the module), namespace or wildcard.

    ``lines``: path, language, line and below, the part of the path below the root, for relative imports.
    """
    kind = "struct<module:string,names:string,form:string>"
    found = F.array().cast(f"array<{kind}>")
    for language, rules in BINDINGS.items():
        hits = []
        for pattern, module, names, form in rules:
            m = F.regexp_extract("line", pattern, module)
            hits.append(F.when(m != "", F.array(F.struct(m.alias("module"), F.regexp_extract("line", pattern, names).alias("names"), F.lit(form).alias("form")))).otherwise(F.array().cast(f"array<{kind}>")))
        found = F.when(F.col("language") == language, F.concat(*hits)).otherwise(found)
    # Outer: for a plain explode the planner asks twice more, by a filter, whether the array is empty.
    some = lines.where(reduce(lambda a, b: a | b, [F.col("line").contains(s) for s in BINDING_SIGNS]))
    rows = some.select("path", "language", "below", F.explode_outer(found).alias("b")).where("b IS NOT NULL").select("path", "language", "below", "b.*")
    last = F.regexp_extract("module", r"([\w$]+)$", 1)
    alone = F.when(F.col("names") != "", F.col("names")).when(F.col("language") == "python", F.col("module")).otherwise(last)
    each = rows.withColumn("name", F.explode(F.when(F.col("form") == "named", F.split("names", ",")).otherwise(F.array(alone))))
    name = F.trim(F.col("name"))
    renamed = F.split(name, r"\s+as\s+|\s*:\s*")
    return each.where(name != "").select(
        "path", family(F.col("language")).alias("family"), F.element_at(renamed, -1).alias("local"), imported_module(F.col("module"), F.col("below")).alias("module"),
        F.element_at(renamed, 1).alias("imported"), F.when(name == "*", "wildcard").otherwise(F.col("form")).alias("form"),
    )


def bound_calls(calls: DataFrame, declared: DataFrame, imports: DataFrame, units: DataFrame) -> DataFrame:
    """(id, symbol) of ``calls`` (id, path, language, line, text, qualifier, holder) for each declaration that scopes and imports let it mean.

    ``declared``: id, path, language, name, kind, holder, holder_line, holder_end; ``holder`` of a call is
    the type that its method belongs to. Without a qualifier: the innermost visible function of the
    file or package, or one imported by name or by all names. With one: an own method, a function of a
    namespace or of a path of modules, or a method of a type that is declared here or imported. Calls
    meet declarations by unit and name, never by name alone.
    """
    d = declared.select("id", "path", family(F.col("language")).alias("family"), unit_of(F.col("path"), F.col("language")).alias("unit"), "name", "kind", "holder", "holder_line", "holder_end")
    d = materialize(d.withColumnRenamed("id", "symbol"), "call-targets")
    top = d.where("holder IS NULL AND kind = 'function'").select("unit", F.col("name").alias("text"), "symbol")
    c = calls.select("id", "path", "line", "text", "qualifier", "holder", "language", family(F.col("language")).alias("family"), unit_of(F.col("path"), F.col("language")).alias("unit"))
    bare, full = c.where("qualifier = ''"), c.where("qualifier <> ''")
    seen = imports.join(units.select("family", F.col("key").alias("module"), F.col("unit").alias("to")), ["family", "module"]).select("path", "local", "imported", "form", "to").distinct()
    seen = materialize(seen, "call-imports")

    around = d.where("kind = 'function'").select("unit", F.col("path").alias("d_path"), F.col("name").alias("text"), "symbol", "holder_line", "holder_end")
    visible = bare.join(around, ["unit", "text"]).where("holder_line IS NULL OR (d_path = path AND line BETWEEN holder_line AND holder_end)")
    inner = visible.groupBy("id").agg(F.max(F.coalesce("holder_line", F.lit(0))).alias("at"))
    local = visible.join(inner, "id").where("coalesce(holder_line, 0) = at").select("id", "symbol")
    by_name = bare.join(seen.where("form = 'named'").select("path", F.col("local").alias("text"), F.col("imported"), F.col("to")), ["path", "text"])
    by_name = by_name.select("id", F.col("to").alias("unit"), F.col("imported").alias("text")).join(top, ["unit", "text"]).select("id", "symbol")
    by_all = bare.join(seen.where("form = 'wildcard'").select("path", "to"), "path").select("id", F.col("to").alias("unit"), "text").join(top, ["unit", "text"]).select("id", "symbol")
    through = full.join(seen.where("form = 'namespace'").select("path", F.col("local").alias("qualifier"), "to"), ["path", "qualifier"])
    through = through.select("id", F.col("to").alias("unit"), "text").join(top, ["unit", "text"]).select("id", "symbol")
    route = full.where("family = 'rust' AND qualifier NOT IN ('self', 'Self')").withColumn("module", route_of("qualifier"))
    route = route.join(units.select("family", F.col("key").alias("module"), F.col("unit").alias("to")), ["family", "module"])
    route = route.select("id", F.col("to").alias("unit"), "text").join(top, ["unit", "text"]).select("id", "symbol")
    methods = d.where("holder IS NOT NULL AND kind = 'method'").select("unit", F.col("holder").alias("type"), F.col("name").alias("text"), "symbol")
    own = c.where(F.col("qualifier").isin(*OWN) | ((F.col("qualifier") == "") & F.col("language").isin(*IMPLICIT_OWN))).where("holder IS NOT NULL")
    own = own.select("id", "unit", F.col("holder").alias("type"), "text").join(methods, ["unit", "type", "text"]).select("id", "symbol")
    typed = full.withColumn("type", F.regexp_extract("qualifier", r"(\w+)$", 1))
    here = typed.select("id", "unit", "type", "text").join(methods, ["unit", "type", "text"]).select("id", "symbol")
    there = typed.join(seen.where("form = 'named'").select("path", F.col("local").alias("type"), "imported", "to"), ["path", "type"])
    there = there.select("id", F.col("to").alias("unit"), F.col("imported").alias("type"), "text").join(methods, ["unit", "type", "text"]).select("id", "symbol")
    out = local
    for part in (by_name, by_all, through, route, own, here, there):
        out = out.union(part)
    return out.distinct()


def call_relations(calls: DataFrame, bound: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, confidence, file): ``calls`` to the one declaration that a call is bound to; of several, a dispatch candidate each."""
    one = bound.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    level = F.create_map(*[F.lit(x) for p in CALL_CONFIDENCE.items() for x in p])[F.col("language")]
    return calls.join(one, "id").select(
        "id", F.col("enclosing").alias("subject"), F.when(F.col("n") == 1, "calls").otherwise("dispatch_candidate").alias("predicate"), F.col("symbol").alias("object"), F.coalesce(level, F.lit(550)).alias("confidence"), "file"
    )
