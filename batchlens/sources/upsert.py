"""Keyed upsert, in memory and against a versioned Parquet table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``; reduced before the shuffle, so a key with very many rows stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order, F.to_json(F.struct(*rest))))
    return df.groupBy(*keys).agg(pick.alias("v")).select(*keys, "v.*").select(*df.columns)


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; two rows of one key fail the job."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("v"))
    checked = F.when(F.col("_n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("several rows of one key and no load order")))
    return grouped.select(*keys, checked.alias("v")).select(*keys, "v.*").select(*df.columns)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None, on_match: str = "set") -> DataFrame:
    """Target after the keyed write.

    ``order`` names the columns that tell which of several incoming rows of a
    key was loaded last; None says that keys are unique, and a repeated key
    then fails the job.

    ``set`` takes incoming values for columns the incoming frame has;
    ``coalesce`` keeps an existing value and only fills gaps.  Keys compare
    null-safe.
    """
    if on_match not in ("set", "coalesce"):
        raise ValueError("on_match must be 'set' or 'coalesce'")
    new = unique_by(incoming, keys) if order is None else newest_per_key(incoming, keys, order)
    t, n = target.alias("t").withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    n = n.withColumnsRenamed({c: f"_n_{c}" for c in new.columns})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        cond = one if cond is None else cond & one
    j = t.join(n, cond, "full_outer")
    cols = []
    for c in [*target.columns, *(c for c in new.columns if c not in target.columns)]:
        if c in keys:
            cols.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        elif c not in new.columns:
            cols.append(F.col(c))
        elif c not in target.columns:
            cols.append(F.col(f"_n_{c}").alias(c))
        elif on_match == "coalesce":
            cols.append(F.coalesce(c, f"_n_{c}").alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return j.select(*cols)


class VersionedTable:
    """A Parquet table whose writes become visible at once.

    Rows lie in ``parts`` folders by a hash of the key.  A version is a small
    manifest that names the folder of each part; an upsert writes only the
    parts that incoming keys fall into and points to the old ones for the
    rest.  Creating the manifest fails if another writer has made that version
    meanwhile, and a failed write leaves the old version readable.

    The manifest also is the ledger of streams: it names the last batch of each
    that is in the table.  Data and ledger change with the same manifest, so a
    batch that comes again, after a failure anywhere, is either wholly there
    and skipped, or not there at all and written.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 32):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, version: int):
        return self._at(f"{self.path}/_versions/{version:08d}.json")

    def versions(self) -> list[int]:
        folder = self._manifest(0).getParent()
        return sorted(int(s.getPath().getName()[:8]) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def version(self) -> int:
        """Number of the newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def _state(self, version: int) -> dict[str, dict]:
        if not version:
            return {"parts": {}, "batches": {}}
        lines = self.spark.read.text(self._manifest(version).toString()).collect()  # one short line
        return json.loads(lines[0][0])

    def _commit(self, version: int, folders: dict[str, str], batches: dict[str, int]) -> None:
        try:
            out = self._fs.create(self._manifest(version), False)
        except Exception as error:
            raise VersionConflict(f"version {version} of {self.path} was written by someone else") from error
        out.write(bytearray(json.dumps({"parts": folders, "batches": batches}).encode()))
        out.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or an older one that is still kept."""
        folders = self._state(self.version() if version is None else version)["parts"]
        return self.spark.read.option("mergeSchema", "true").parquet(*sorted(folders.values())) if folders else None

    def upsert(
        self, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None, on_match: str = "set", batch: tuple[str, int] | None = None,
    ) -> bool:
        """Write a new version; with ``batch`` (stream name, batch number) only if that batch is not in the table yet.

        Returns whether something was written.
        """
        version = self.version()
        state = self._state(version)
        folders, batches = state["parts"], state["batches"]
        if batch is not None and batches.get(batch[0], -1) >= batch[1]:
            return False
        part = F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")
        touched = {str(r[0]) for r in incoming.select(part.alias("p")).distinct().collect()}  # at most ``parts``
        old = sorted(folders[p] for p in touched if p in folders)
        current = self.spark.read.parquet(*old) if old else self.spark.createDataFrame([], incoming.schema)
        root = f"{self.path}/{version + 1:08d}-{uuid.uuid4().hex}"
        if touched:
            upsert(current, incoming, keys, order, on_match).withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(root)
        self._commit(version + 1, {**folders, **{p: f"{root}/_part={p}" for p in touched}}, {**batches, **({batch[0]: batch[1]} if batch else {})})
        return True

    def expire(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and part folders that none of those names; return how many folders went.

        A folder is named after the version it was written for, so what a
        running writer has put down for a later version stays.
        """
        known = self.versions()
        kept = known[-max(1, keep):]
        if not kept:
            return 0
        used = {folder for v in kept for folder in self._state(v)["parts"].values()}
        for v in known[:-len(kept)]:
            self._fs.delete(self._manifest(v), False)
        gone = 0
        for root in self._fs.listStatus(self._at(self.path)):
            name = root.getPath().getName()
            if not name[:8].isdigit() or int(name[:8]) > kept[-1]:
                continue
            parts = [p.getPath() for p in self._fs.listStatus(root.getPath()) if p.getPath().getName().startswith("_part=")]
            loose = [p for p in parts if f"{self.path}/{name}/{p.getName()}" not in used]
            for folder in loose if len(loose) < len(parts) else [root.getPath()]:
                self._fs.delete(folder, True)
            gone += len(loose)
        return gone


class VersionConflict(RuntimeError):
    """Another writer took the version."""
