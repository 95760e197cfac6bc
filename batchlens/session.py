"""Session helpers: builder for local work and lineage cutting for loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(app: str = "batchlens", cpus: str = "8", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="batchlens-"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did; a cluster gets it by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def work_dir(spark: SparkSession) -> str:
    """Shared folder for loop state.

    Taken from ``spark.checkpoint.dir``.  Only a session that runs in one
    process and has no such setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    made = tempfile.mkdtemp(prefix="batchlens-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Bytes of rows in memory for each byte of a written table: names of roots, runs and scenarios repeat, so files hold a few bytes a row.
UNPACKED = 30


def plan_by_row_size(spark: SparkSession) -> None:
    """Let the planner take stored tables for as large as their rows are, unless the session says otherwise.

    By file size alone a table of millions of (scenario, node) rows counts as
    small enough to be broadcast, which the driver has to hold.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(UNPACKED)))


#: Whether Spark deletes the shuffle files of a statement when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class LoopState:
    """Written tables that cut the lineage of one iterative operator.

    Each round's result becomes a Parquet table in the shared folder, so the
    next round plans from files with known sizes and a lost executor re-reads
    files instead of replaying every earlier round.  Shuffles behind a written
    table are not read again, so their files go once it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame, parts: Sequence[str] = ()) -> tuple[DataFrame, int]:
        """Write ``df`` (in folders by the values of ``parts``); return the stored table and its row count."""
        stored, counts = self._save(df, {}, parts)
        return stored, counts["n"]

    def save_counting(self, df: DataFrame, parts: Sequence[str] = (), **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
        """Write ``df`` and count its rows, and those meeting each condition, in the same pass."""
        return self._save(df, {name: F.count_if(c) for name, c in conditions.items()}, parts)

    def _save(self, df: DataFrame, facts: dict[str, Column], parts: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
        self._n += 1
        path = f"{self.root}/{self._n:05d}"
        seen = Observation()
        wanted = [F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in facts.items())]
        before = self.spark.conf.get(SHUFFLES_GO)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.observe(seen, *wanted).write.partitionBy(*parts).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = (stored, path)
        return stored, {name: int(v) for name, v in seen.get.items()}

    def save_summing(self, df: DataFrame, parts: Sequence[str] = (), **terms: Column) -> tuple[DataFrame, dict[str, int]]:
        """Write ``df``; count its rows and sum each (non-negative) term in the same pass."""
        return self._save(df, {name: F.coalesce(F.sum(c), F.lit(0)) for name, c in terms.items()}, parts)

    def save_largest(self, df: DataFrame, **values: Column) -> tuple[DataFrame, dict[str, int]]:
        """Write ``df``; find the largest of each (non-negative) value in the same pass, -1 where there is none."""
        return self._save(df, {name: F.coalesce(F.max(c), F.lit(-1)) for name, c in values.items()})

    def drop(self, table: DataFrame) -> None:
        """Delete a table saved here that nothing will read again."""
        _, path = self._paths.pop(id(table))
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def union_of(self, tables: list[DataFrame], part: str = "") -> DataFrame:
        """One scan over several tables saved here with the same schema, or over one of their folders (``column=value``) that all have."""
        columns = [f for f in tables[0].schema if not part.startswith(f"{f.name}=")]
        return self.spark.read.schema(StructType(columns)).parquet(*(f"{self._paths[id(t)][1]}/{part}".rstrip("/") for t in tables))
