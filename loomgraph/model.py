"""The fact-graph model: closed vocabularies and the frames of one snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query-level kinds and the entity kinds each stands for.
KIND_GROUPS = {
    "file": ("file",),
    "module": ("module", "namespace", "package"),
    "type": ("class", "struct", "enum", "union", "type_alias", "trait", "interface", "protocol", "type_parameter"),
    "function": ("function", "constructor", "closure"),
    "method": ("method",),
    "field": ("field", "property"),
    "constant": ("constant",),
    "variable": ("variable", "parameter"),
    "configuration": ("configuration_key",),
    "external_symbol": ("external_symbol",),
}

# Relation families and the predicates behind each; ownership has none.
FAMILIES = {
    "calls": ("calls", "dispatch_candidate"),
    "called_by": ("calls", "dispatch_candidate"),
    "references": ("refers_to",),
    "types": ("uses_type", "returns_type", "parameter_type"),
    "implements": ("implements", "satisfies", "extends", "embeds", "mixes_in", "overrides"),
    "imports": ("imports",),
    "tests": ("tests",),
    "ownership": (),
    "service_call": ("calls_foreign", "calls_route", "serves_route"),
    "calls_route": ("calls_route", "serves_route"),
    "messaging": ("publishes", "consumes"),
    "reads_table": ("reads_table",),
    "writes_table": ("writes_table",),
    "build_dependency": ("depends_on",),
    "data_flow": ("reads", "writes"),
    "history": ("changed_in", "lineage_renamed_from", "lineage_moved_from", "lineage_split_from", "lineage_merged_from"),
}

# Relations that a traversal names, as (predicates, whether it runs against the edge).
TRAVERSALS = {
    "calls": (FAMILIES["calls"], False),
    "called_by": (FAMILIES["calls"], True),
    "imports": (("imports",), False),
    "imported_by": (("imports",), True),
    "tests": (("tests",), False),
    "tested_by": (("tests",), True),
    "contains": (("contains", "declares"), False),
    "contained_by": (("contains", "declares"), True),
    "implements": (FAMILIES["implements"], False),
    "implemented_by": (FAMILIES["implements"], True),
    "references": (("refers_to",), False),
    "referenced_by": (("refers_to",), True),
}

# The most confidence that each tier of analysis allows.
TIER_CEILINGS = {"A": 1000, "B": 999, "C": 699, "D": 399}
EXACT_CONFIDENCE = 900

# Entity kinds that an occurrence of each role may bind to; None: any but those of NOT_REFERABLE.
_TYPES = (*KIND_GROUPS["type"], "external_symbol")
NOT_REFERABLE = ("repository", "worktree", "directory", "commit", "change", "community_view")
ROLE_KINDS = {
    "call_site": ("function", "method", "constructor", "closure", "external_symbol"),
    "type_use": _TYPES,
    "inheritance_use": _TYPES,
    "implementation_use": _TYPES,
    "import_use": ("package", "build_target", "directory", "file", "module", "namespace", "import", "export", "external_symbol"),
    "route_use": ("route", "service", "function", "method", "external_symbol"),
    "test_use": ("test", "function", "method", "external_symbol"),
    "reference": None,
    "write": None,
    "read": None,
    "decorator_use": None,
    "macro_use": None,
}

# The predicate that a resolved occurrence of each role yields.
ROLE_PREDICATES = {
    "reference": "refers_to",
    "decorator_use": "refers_to",
    "macro_use": "refers_to",
    "call_site": "calls",
    "type_use": "uses_type",
    "import_use": "imports",
    "inheritance_use": "extends",
    "implementation_use": "implements",
    "route_use": "calls_route",
    "test_use": "tests",
    "read": "reads",
    "write": "writes",
}

# Evidence namespaces of foreign links and the predicates each supports.
FOREIGN_NAMESPACES = {
    "foreign_function": ("binds_to", "calls_foreign"),
    "http": ("calls_route", "serves_route"),
    "rpc": ("binds_to", "calls_foreign"),
    "messaging": ("publishes", "consumes"),
    "database": ("reads_table", "writes_table"),
    "test": ("tests",),
    "configuration": ("depends_on", "generated_from"),
}


@dataclass(frozen=True)
class Graph:
    """``entities``: id, kind, name, qualified_name, container_id, visibility, tier, language, path.

    ``relations``: id, subject, predicate, object, confidence.
    """

    entities: DataFrame
    relations: DataFrame

    def of(self, *families: str) -> DataFrame:
        """Edges of the families, each under its family's name."""
        parts = [
            self.relations.where(F.col("predicate").isin(*FAMILIES[f])).withColumn("family", F.lit(f)) for f in families if FAMILIES[f]
        ]
        out = parts[0] if parts else self.relations.where("false").withColumn("family", F.lit(""))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def ceiling(tier: Column | str) -> Column:
    """The most confidence of a tier; of an unknown tier as of the lowest."""
    tier = F.col(tier) if isinstance(tier, str) else tier
    out = F.lit(TIER_CEILINGS["D"])
    for t, top in TIER_CEILINGS.items():
        out = F.when(tier == t, top).otherwise(out)
    return out


def mapping(name: Column, table: dict[str, str]) -> Column:
    """A fixed lookup as one literal map, so nothing is joined."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[name]
