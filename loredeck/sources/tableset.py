"""Several tables that change together: upserts of all of them become visible at once, or not at all.

Each table is kept in hash buckets of its key. A commit writes the buckets that its rows touch to a new folder (copy
on write) and then publishes one manifest that names the files of every table; readers go by the newest manifest, so a
commit that breaks off half-way leaves what was there. The newest manifests are kept, older ones go with the files
that only they name. Two commits at once can't both take the next number: the second one fails.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEPT = 3


@dataclass(frozen=True)
class TableSet:
    """Tables by name with their keys; `kept` columns of a table keep their first value when a row is updated."""

    spark: SparkSession
    root: str
    keys: dict[str, str]
    buckets: int = 16
    kept: dict[str, tuple[str, ...]] = field(default_factory=dict)

    # ---- files of the manifest

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the manifests that are kept, newest first."""
        fs, path = self._at("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the newest) names: for each table its schema and the folder of each bucket."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}}
        rows = self.spark.read.text(f"{self.root}/manifests/{version or known[0]:010d}.json", wholetext=True)
        return json.loads(rows.first().value)

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['version']:010d}"
        fs, staged = self._at("manifests", f".{name}.staged")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(staged, self._at("manifests", f"{name}.json")[1]):
            raise RuntimeError(f"version {manifest['version']} is there already")

    def rotate(self) -> None:
        """SNK-17: keep the newest manifests; of the others, the manifests and what only they name."""
        old = self.versions()[KEPT:]
        used = {p for v in self.versions()[:KEPT] for t in self.manifest(v)["tables"].values() for p in t["files"].values()}
        for v in old:
            for t in self.manifest(v)["tables"].values():
                for p in set(t["files"].values()) - used:
                    fs, path = self._at(p)
                    fs.delete(path, True)
            fs, path = self._at("manifests", f"{v:010d}.json")
            fs.delete(path, False)

    # ---- reading and writing

    def _read(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.root}/{p}" for b, p in entry["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)["tables"][name])

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def commit(self, changes: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> int:
        """Lay changes (whole rows, one of each key) over their tables and delete the keys of `gone`; the new version.

        SNK-01/02/03/09/10: a new key is added, a known one gets the new values but for the table's kept columns.
        """
        gone = gone or {}
        manifest = self.manifest()
        version = manifest["version"] + 1
        tables = dict(manifest["tables"])
        for name in {**changes, **gone}:
            key = self.keys[name]
            rows = changes[name] if name in changes else self._read(tables[name]).limit(0)
            away = gone[name].select(key).distinct() if name in gone else rows.select(key).limit(0)
            entry = tables.get(name, {"schema": json.loads(rows.schema.json()), "files": {}})
            touched = rows.select(key).unionByName(away).select(self._bucket(key).alias("b")).distinct().collect()  # at most a row a bucket
            touched = sorted(r.b for r in touched)
            old = self._read(entry, touched)
            new = self._laid_over(old, rows.select(*old.columns), key, self.kept.get(name, ())).join(away, key, "left_anti")
            folder = f"{name}/v{version:010d}"
            new.withColumn("bucket", self._bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
            fs, _ = self._at(folder)
            left = {str(b): f"{folder}/bucket={b}" for b in touched if fs.exists(self._at(folder, f"bucket={b}")[1])}
            others = {b: p for b, p in entry["files"].items() if int(b) not in touched}
            tables[name] = {"schema": entry["schema"], "files": others | left}
        self._publish({"version": version, "tables": tables})
        self.rotate()
        return version

    @staticmethod
    def _laid_over(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
        t, s = old.withColumn("__old", F.lit(True)).alias("t"), new.withColumn("__new", F.lit(True)).alias("s")
        joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")

        def value(c: str) -> Column:
            first = F.when(F.col("__old"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
            return first if c in kept else F.when(F.col("__new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

        return joined.select(*(value(c).alias(c) for c in old.columns))
