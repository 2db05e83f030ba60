"""Commits over several tables that are whole or not at all.

A store is a folder with a subfolder for each table, a subfolder of that for each
commit, and version files:

    <root>/<table>/commit=<id>/part-*.parquet    rows of one commit, written once
    <root>/_owners/<id>/part-*.parquet           (table, key, commit): who holds the live rows of a key
    <root>/_versions/<n>.json                    what version n consists of

A commit writes the new rows of all its tables next to the old ones, then the owners,
and last puts the next version file in place by a rename that never overwrites. Until
then every reader sees the version before, whatever fails and wherever; after that, all
tables change at once. Of two commits that start from one version the second to be
renamed fails (``Conflict``), so none is lost silently.

A commit replaces keys (sessions): all keys that have rows in one of its tables, and
those of ``replaced``, lose their old rows in each of these tables. A reader opens only
folders of live commits, so rows of failed commits are never listed, and matches
(key, commit) with the owners, a join of the rows with one narrow row a key.

Version files are small: their size grows with the commits that hold live rows, not
with rows or keys; ``compact`` brings those back to one.

Defined results: a null key is a key like others; a table without rows keeps its
columns; a table that a version doesn't have can't be read (KeyError).
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, key: str = "session_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    # --- files ---------------------------------------------------------------

    def _place(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        place = hadoop.Path(f"{self.root}/{path}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        place, fs = self._place(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []

    def _delete(self, path: str) -> None:
        place, fs = self._place(path)
        fs.delete(place, True)

    def _read_text(self, path: str) -> str:
        place, fs = self._place(path)
        stream = fs.open(place)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> None:
        """Put a file in place, whole, unless it is there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        draft, fs = self._place(f"_drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = self._place(name)
        fs.mkdirs(target.getParent())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:  # without the option to overwrite, so it fails if the target is there
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} is there already") from e
            raise

    # --- versions ------------------------------------------------------------

    def version(self) -> int:
        """The newest version; 0 without any."""
        return max((int(m[1]) for x in self._names("_versions") if (m := re.fullmatch(r"(\d+)\.json", x))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """tables: {name: {schema, commits}}, owners: folder."""
        n = self.version() if version is None else version
        return json.loads(self._read_text(f"_versions/{n}.json")) if n else {"tables": {}, "owners": None}

    def _owners(self, manifest: dict) -> DataFrame:
        kind = T.StructType([T.StructField("table", T.StringType()), T.StructField(self.key, self._key_type(manifest)), T.StructField("commit", T.StringType())])
        return self.spark.read.schema(kind).parquet(f"{self.root}/{manifest['owners']}") if manifest["owners"] else self.spark.createDataFrame([], kind)

    def _key_type(self, manifest: dict) -> T.DataType:
        schemas = (T.StructType.fromJson(x["schema"]) for x in manifest["tables"].values())
        return next((s[self.key].dataType for s in schemas), T.LongType())

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The live rows of a table."""
        m = self.manifest(version)
        of = m["tables"][table]
        schema = T.StructType.fromJson(of["schema"])
        if not of["commits"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.add("commit", T.StringType())).option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/commit={c}" for c in of["commits"]))
        owners = self._owners(m).where(F.col("table") == table)
        live = rows[self.key].eqNullSafe(owners[self.key]) & (rows["commit"] == owners["commit"])
        return rows.join(owners, live, "left_semi").drop("commit")

    def commit(self, tables: dict[str, DataFrame], replaced: DataFrame | None = None, base: int | None = None) -> int:
        """Replace keys in all these tables at once. replaced: further keys (column ``key``) whose rows go. Returns the new version.

        base: the version that the new rows were made from; the commit fails if there is a newer one.
        """
        n = self.version() if base is None else base
        old, name = self.manifest(n), uuid.uuid4().hex
        for table, rows in tables.items():
            if table in old["tables"]:
                known = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(old["tables"][table]["schema"]).fields]
                if rows.dtypes != known:
                    raise ValueError(f"{table} has the columns {known}, not {rows.dtypes}")
        written = {}
        for table, rows in tables.items():
            path = f"{self.root}/{table}/commit={name}"
            rows.write.parquet(path)
            written[table] = self.spark.read.schema(rows.schema).parquet(path)
        keys = [rows.select(self.key) for rows in written.values()] + ([replaced.select(self.key)] if replaced is not None else [])
        touched = reduce(DataFrame.unionByName, keys).distinct()
        mine = touched.select(F.explode(F.array(*map(F.lit, tables))).alias("table"), self.key, F.lit(name).alias("commit"))
        before = self._owners(old).alias("o")
        gone = touched.select(F.col(self.key).alias("__key"))
        stays = before.where(~F.col("table").isin(*tables)).unionByName(before.where(F.col("table").isin(*tables)).join(gone, F.col(f"o.{self.key}").eqNullSafe(F.col("__key")), "left_anti"))
        stays.unionByName(mine).write.parquet(f"{self.root}/_owners/{name}")
        return self._put(n, {t: json.loads(r.schema.json()) for t, r in written.items()}, old, name)

    def _put(self, base: int, schemas: dict[str, dict], old: dict, name: str) -> int:
        """The version after ``base`` with the owners of the commit ``name``."""
        known = {t: x["schema"] for t, x in old["tables"].items()} | schemas
        manifest = {"tables": {t: {"schema": s} for t, s in known.items()}, "owners": f"_owners/{name}"}
        live = self._owners(manifest).groupBy("table").agg(F.sort_array(F.collect_set("commit")).alias("commits"))
        commits = {r["table"]: r["commits"] for r in live.collect()}  # a row for each table
        for t in known:
            there = set(self._names(t))  # a key may be replaced by nothing, in a commit that has no rows of this table
            manifest["tables"][t]["commits"] = [c for c in commits.get(t, []) if f"commit={c}" in there]
        self._publish(f"_versions/{base + 1}.json", json.dumps(manifest))
        return base + 1

    def compact(self) -> int:
        """A version with the same rows in one commit."""
        m = self.manifest()
        return self.commit({t: self.read(t) for t in m["tables"]}, base=self.version())

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the newest ``keep`` versions don't need, also of failed commits; none may be going on. Returns the folders."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        manifests = [self.manifest(n) for n in kept]
        needed = {f"{t}/commit={c}" for m in manifests for t, x in m["tables"].items() for c in x["commits"]} | {m["owners"] for m in manifests}
        there = [f"{t}/{x}" for t in self._names("") if not t.startswith(("_", ".")) for x in self._names(t) if x.startswith("commit=")] + [f"_owners/{x}" for x in self._names("_owners")]
        gone = sorted(set(there) - needed)
        for n in range(1, newest + 1):
            if n not in kept:
                self._delete(f"_versions/{n}.json")
        for path in gone:
            self._delete(path)
        return gone


def save_analysis(store: Store, shots: DataFrame, metrics: DataFrame, rallies: DataFrame, sessions: DataFrame) -> int:
    """Put the results of sessions in place of their old ones, all three tables at once; a session without any result loses its old ones, too."""
    key = store.key
    by_shot = shots.select("shot_id", key)
    return store.commit({"metrics": metrics.join(by_shot, "shot_id") if key not in metrics.columns else metrics, "shots": shots, "rallies": rallies}, replaced=sessions)
