"""Immutable snapshots as Parquet: staged, committed, activated, rolled back, removed, shared."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("files", "entities", "occurrences", "relations", "bindings", "routes", "provenance", "source_mappings", "skipped_regions", "diagnostics", "extensions", "coverage", "postings", "maxima", "lengths")


class SnapshotError(ValueError):
    pass


class SnapshotStore:
    """``root``/staging and ``root``/generations hold one folder a snapshot, with a folder a table; ``root``/active numbers which is active.

    All paths go through the file system that the session resolves for them, so any store Spark reads
    will do. A snapshot becomes visible by the rename of its folder, and stays addressable after the
    next is activated; activation adds a numbered pointer, of which the newest counts, so there is
    never a moment without one. A table that does not change is carried: the snapshot names the one
    that has it, which cannot be removed before.

    A table may also be kept in parts, one from each snapshot that changed some files: its rows have the
    column ``file``, and the table ``files`` says in an owner column which snapshot has a file's rows. To
    read it, the parts are merged by that; rows of files that are gone, or whose facts a later snapshot
    replaced, are left out.
    """

    #: A table in more parts than this is written anew as one.
    MOST_PARTS = 8

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _put(self, path: str, data: dict) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()

    def json(self, path: str) -> dict:
        """A JSON file anywhere in the store's file system."""
        return self._get(path)

    def _get(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _carried(self, area: str, generation: str) -> dict[str, str]:
        path = self._at(area, generation, "carried.json")
        return self._get(path) if self._exists(path) else {}

    def _table(self, table: str, generation: str, area: str = "generations") -> str | None:
        """Where a snapshot's table lies, its own or carried; None if it has none."""
        own = self._at(area, generation, table)
        if self._exists(own):
            return own
        owner = self._carried(area, generation).get(table)
        return self._at("generations", owner, table) if owner else None

    def _parts(self, generation: str, area: str = "generations") -> dict[str, dict]:
        """{table: {owner: column of files, generations: those that have a part}}."""
        path = self._at(area, generation, "parts.json")
        return self._get(path) if self._exists(path) else {}

    def _part(self, table: str, generation: str, area: str) -> DataFrame:
        return self.spark.read.parquet(self._at(area, generation, f"{table}.part"))

    def _frame(self, table: str, generation: str, area: str = "generations") -> DataFrame | None:
        """A snapshot's table: what it has of it whole, and the rows of its parts that the files' owners have."""
        whole = self._table(table, generation, area)
        out = self.spark.read.parquet(whole) if whole else None
        known = self._parts(generation, area).get(table)
        if known:
            part = lambda g: self._part(table, g, area if g == generation else "generations").withColumn("__at", F.lit(g))
            rows = part(known["generations"][0])
            for g in known["generations"][1:]:
                rows = rows.unionByName(part(g), allowMissingColumns=True)
            owners = self._frame("files", generation, area).select(F.col("path").alias("file"), F.col(known["owner"]).alias("__at"))
            rows = rows.join(owners, ["file", "__at"], "left_semi").drop("__at")
            out = rows if out is None else rows.unionByName(out, allowMissingColumns=True)
        return out

    def tables(self, generation: str) -> list[str]:
        return [t for t in TABLES if self._table(t, generation) or t in self._parts(generation)]

    def stage(
        self,
        generation: str,
        tables: dict[str, DataFrame],
        partition_by: dict[str, list[str]] | None = None,
        carry_from: str | None = None,
        parts: dict[str, tuple[DataFrame, str]] | None = None,
    ) -> None:
        """Write ``tables``; with ``carry_from`` the snapshot has all other tables of that one as well.

        ``parts``: tables of which only some files' rows are new, each with the owner column of the table
        ``files`` (staged too) that names this snapshot for those files; the other files' rows are those
        of ``carry_from``. A table of more than ``MOST_PARTS`` parts becomes one again.
        """
        parts = parts or {}
        unknown = (set(tables) | set(parts)) - set(TABLES)
        if unknown or self._exists(self._at("generations", generation)):
            raise SnapshotError(f"unknown tables {sorted(unknown)}" if unknown else f"{generation} exists")
        for name, df in tables.items():
            df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(self._at("staging", generation, name))
        before = self._parts(carry_from) if carry_from else {}
        held = {t: known for t, known in before.items() if t not in tables or t in parts}
        for name, (df, owner) in parts.items():
            df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(self._at("staging", generation, f"{name}.part"))
            held[name] = {"owner": owner, "generations": [*before.get(name, {"generations": []})["generations"], generation]}
        if carry_from:
            known = self._carried("generations", carry_from)
            owners = {t: known.get(t, carry_from) for t in self.tables(carry_from) if t not in tables and self._table(t, carry_from)}
            self._put(self._at("staging", generation, "carried.json"), owners)
        if held:
            self._put(self._at("staging", generation, "parts.json"), held)
            self._merge_parts(generation, held)

    def _merge_parts(self, generation: str, held: dict[str, dict]) -> None:
        owners = {known["owner"] for known in held.values() if len(known["generations"]) > self.MOST_PARTS}
        long = [t for t, known in held.items() if known["owner"] in owners]
        if not long:
            return
        files = self._frame("files", generation, "staging")
        for owner in owners:
            files = files.withColumn(owner, F.lit(generation))
        for t in long:
            merged = self._frame(t, generation, "staging").where("file IS NOT NULL")
            merged.write.mode("overwrite").parquet(self._at("staging", generation, f"{t}.merged"))
        new = self._at("staging", generation, "files.merged")
        files.write.mode("overwrite").parquet(new)
        for t in [*(f"{t}.part" for t in long), "files"]:
            own = self._path(self._at("staging", generation, t))
            self._fs.delete(own, True)
            self._fs.rename(self._path(self._at("staging", generation, f"{t.removesuffix('.part')}.merged")), own)
        self._put(self._at("staging", generation, "parts.json"), held | {t: held[t] | {"generations": [generation]} for t in long})

    def _checked(self, generation: str) -> None:
        """Ids are unique; the ends of relations and the containers of entities exist; coverage adds up."""
        frames = {t: self._frame(t, generation, "staging") for t in TABLES}
        has = {t for t, df in frames.items() if df is not None}
        read = frames.get
        for t in has & {"entities", "relations", "files", "occurrences"}:
            if not read(t).groupBy("id").count().where("count > 1").isEmpty():
                raise SnapshotError(f"repeated ids in {t}")
        if {"entities", "relations"} <= has:
            ids = read("entities").select("id")
            ends = read("relations").selectExpr("explode(array(subject, object)) AS id").distinct()
            if not ends.join(ids, "id", "left_anti").isEmpty():
                raise SnapshotError("a relation's end is missing")
        if "coverage" in has and not read("coverage").where("indexed > discovered OR skipped > discovered - indexed").isEmpty():
            raise SnapshotError("coverage does not add up")

    def commit(self, generation: str, activate: bool = True) -> None:
        self._checked(generation)
        self._fs.mkdirs(self._path(self._at("generations")))
        if not self._fs.rename(self._path(self._at("staging", generation)), self._path(self._at("generations", generation))):
            raise SnapshotError(f"cannot commit {generation}")
        if activate:
            self.activate(generation)

    def rollback(self, generation: str) -> None:
        self._fs.delete(self._path(self._at("staging", generation)), True)

    def activate(self, generation: str) -> None:
        if not self._exists(self._at("generations", generation)):
            raise SnapshotError(f"no {generation}")
        new = self._at("active", f"new-{uuid.uuid4().hex}")
        self._put(new, {"generation": generation})
        at = self._pointers()
        number = int(at[-1][:9]) + 1 if at else 1
        if not self._fs.rename(self._path(new), self._path(self._at("active", f"{number:09d}.json"))):
            raise SnapshotError(f"another job has activated a snapshot; {generation} is not active")

    def _pointers(self) -> list[str]:
        if not self._exists(self._at("active")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._at("active")))]
        return sorted(n for n in names if re.fullmatch(r"[0-9]{9}\.json", n))

    def active(self) -> str | None:
        at = self._pointers()
        return self._get(self._at("active", at[-1]))["generation"] if at else None

    def was_active(self, generation: str) -> bool:
        """Whether ``generation`` is or has been the active snapshot, newest pointers first."""
        return any(self._get(self._at("active", n))["generation"] == generation for n in reversed(self._pointers()))

    def generations(self) -> list[str]:
        if not self._exists(self._at("generations")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self._at("generations"))))

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        generation = generation or self.active()
        if generation not in self.generations():
            raise SnapshotError(f"no snapshot {generation}")
        found = self._frame(table, generation)
        if found is None:
            raise SnapshotError(f"{generation} has no {table}")
        return found

    def remove(self, generation: str) -> None:
        if generation == self.active():
            raise SnapshotError("the active snapshot stays")
        if any(generation in self._carried("generations", g).values() for g in self.generations()):
            raise SnapshotError(f"other snapshots carry tables of {generation}")
        if any(generation in known["generations"] for g in self.generations() if g != generation for known in self._parts(g).values()):
            raise SnapshotError(f"other snapshots carry parts of {generation}")
        self._fs.delete(self._path(self._at("generations", generation)), True)

    def export_bundle(self, generation: str, target: str) -> None:
        """Tables without source text, and a manifest of counts, for another store to import."""
        rows = []
        for table in self.tables(generation):
            df = self.read(table, generation)
            df = df.drop(*[c for c in ("text", "content") if c in df.columns])
            df.write.parquet(f"{target}/{table}")
            rows.append((generation, table, df.count()))
        self.spark.createDataFrame(rows, "generation string, table string, rows long").coalesce(1).write.json(f"{target}/manifest")

    def import_bundle(self, source: str) -> str:
        manifest = self.spark.read.json(f"{source}/manifest").collect()  # a row for each of ten tables
        generation = manifest[0]["generation"]
        tables = {r["table"]: self.spark.read.parquet(f"{source}/{r['table']}") for r in manifest}
        for r in manifest:
            if tables[r["table"]].count() != r["rows"]:
                raise SnapshotError(f"{r['table']} has another number of rows")
        self.stage(generation, tables)
        self.commit(generation, activate=False)
        return generation
