"""What scopes look like to a search, in versions: swapped whole, old answers kept, readers undisturbed."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import file_system, publish_version, read_version


class Projections:
    """One version of a table of scopes below a folder.

    Its manifest says for every scope which commit it shows and in which written table the rows are, and where
    the rows of commits that it showed before are kept. Tables are written once and never changed, and a
    manifest comes last, so that a version is there whole or not at all, and a reader of one is not
    disturbed by the next.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, version: int | None = None):
        """``schema`` has scope_id and commit_hash."""
        self.spark, self.path, self.schema = spark, path, schema
        m = read_version(spark, path, version) or {"version": 0, "scopes": {}, "old": []}
        self.version, self.scopes, self.old = m["version"], m["scopes"], m["old"]

    def _read(self, places: list[tuple[str, str, str]]) -> DataFrame:
        """Rows of (scope, commit, table) triples, each table read once for all its scopes."""
        by_table: dict[str, list[tuple[str, str]]] = {}
        for scope, commit, name in places:
            by_table.setdefault(name, []).append((scope, commit))
        parts = []
        for name, own in sorted(by_table.items()):
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/tables/{name}")
            asked = self.spark.createDataFrame(own, "scope_id string, commit_hash string")  # as many as there are scopes
            parts.append(rows.join(asked, ["scope_id", "commit_hash"], "left_semi"))
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def current(self, scopes: list[str] | None = None) -> DataFrame:
        """The rows of all scopes, or some, as they are in this version."""
        return self._read([(s, c, t) for s, (c, t) in self.scopes.items() if scopes is None or s in scopes])

    def at(self, commit: str) -> DataFrame:
        """The rows of the scopes that show a commit, or showed it before and kept the answer."""
        return self._read([(s, c, t) for s, (c, t) in self.scopes.items() if c == commit] + [(s, c, t) for s, c, t in self.old if c == commit])

    def replace(self, rows: DataFrame, heads: dict[str, str], *, preserve_at: bool = False) -> Projections:
        """The version in which each scope of ``heads`` (scope -> commit) has the rows of ``rows`` for it, and no others.

        A scope without rows is there, empty. With ``preserve_at`` what the scopes showed before still
        answers ``at``; without it, those answers go, also older ones. Rows of other scopes or commits are an error.
        """
        name = uuid.uuid4().hex
        asked = self.spark.createDataFrame(list(heads.items()), "scope_id string, commit_hash string")
        fields = [f.strip().split()[0] for f in self.schema.split(",")]
        stray = rows.join(asked, ["scope_id", "commit_hash"], "left_anti")
        if not stray.isEmpty():
            raise ValueError(f"rows of another scope or commit: {stray.select('scope_id', 'commit_hash').first()}")
        rows.select(*fields).repartitionByRange("scope_id").sortWithinPartitions("scope_id").write.parquet(f"{self.path}/tables/{name}")
        before = [[s, *self.scopes[s]] for s in heads if s in self.scopes and self.scopes[s][0] != heads[s]]
        old = [x for x in self.old if x[0] not in heads or (preserve_at and x[1] != heads[x[0]])] + (before if preserve_at else [])
        return self._published(self.scopes | {s: [c, name] for s, c in heads.items()}, old)

    def retain(self, live: list[str]) -> Projections:
        """The version without scopes that are not ``live``, and without their old answers."""
        return self._published({s: x for s, x in self.scopes.items() if s in live}, [x for x in self.old if x[0] in live])

    def _published(self, scopes: dict, old: list) -> Projections:
        publish_version(self.spark, self.path, {"version": self.version + 1, "scopes": scopes, "old": old})
        return Projections(self.spark, self.path, self.schema, self.version + 1)

    def vacuum(self) -> int:
        """Delete tables and manifests that this version does not need; readers of older ones must be done. Returns how many went."""
        fs, at = file_system(self.spark, self.path)
        keep = {"tables": {t for _, t in self.scopes.values()} | {t for *_, t in self.old}, "manifests": {f"{self.version:012d}"}}
        gone = 0
        for kind, names in keep.items():
            folder = at(f"{self.path}/{kind}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f.getPath().getName() not in names:
                    gone += fs.delete(f.getPath(), True)
        return gone


def verified_scopes(projections: Projections) -> DataFrame:
    """scope_id, commit_hash and rows of every scope in a version, empty ones too."""
    listed = projections.spark.createDataFrame([(s, c) for s, (c, _) in projections.scopes.items()], "scope_id string, commit_hash string")
    counts = projections.current().groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "scope_id", "left").select("scope_id", "commit_hash", F.coalesce("n", F.lit(0)).alias("rows"))
