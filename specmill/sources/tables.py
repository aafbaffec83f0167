"""Record and ledger tables as Parquet snapshots, and their JSON export form.

Plain Parquet has no row updates. A table is a folder of snapshots plus a pointer
table naming the current one: a new snapshot is written in full, then the pointer moves.
Readers that resolved the old pointer keep reading the old snapshot.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.numbers import shown
from specmill.sources.files import exists
from specmill.sources.rules import PROBLEM, RuleSet

LEDGER = T.StructType(
    [
        T.StructField("source_hash", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)


class SnapshotTable:
    """One table kept as snapshots below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._read_version: int | None = None

    def _current(self) -> tuple[int, str] | None:
        pointers = f"{self.root}/pointer"
        if not exists(self.spark, pointers):
            return None
        last = (
            self.spark.read.schema("version bigint, path string")
            .json(pointers)
            .agg(F.max(F.struct("version", "path")).alias("last"))
            .first()["last"]
        )
        return (last["version"], last["path"]) if last else None

    def read(self) -> DataFrame:
        """The current snapshot; an empty table before the first write. The next ``replace`` builds on this version."""
        current = self._current()
        self._read_version = current[0] if current else 0
        if current is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{current[1]}")

    def replace(self, rows: DataFrame, sort: list[str] | None = None) -> None:
        """Write ``rows`` as the version after the one last read (or the current one), and move the pointer to it.

        ``sort`` orders rows inside each file, which makes Parquet's min/max statistics
        useful for later filters on those columns.
        """
        if self._read_version is None:
            self.read()
        version = self._read_version + 1
        path = f"snapshot-{version:08d}-{uuid.uuid4().hex[:8]}"
        ordered = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if sort:
            ordered = ordered.sortWithinPartitions(*sort)
        ordered.write.mode("errorifexists").parquet(f"{self.root}/{path}")
        self._claim(version, path)
        self._read_version = version

    def remove_old(self, keep: int = 2) -> None:
        """Delete all snapshots but those of the last ``keep`` versions; readers of older ones must be done."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        last = self._current()
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        if last is None:
            return
        system = folder.getFileSystem(conf)
        for found in system.listStatus(folder):
            name = found.getPath().getName()
            if name.startswith("snapshot-") and int(name.split("-")[1]) <= last[0] - keep:
                system.delete(found.getPath(), True)

    def _claim(self, version: int, path: str) -> None:
        """Make ``path`` version ``version``; of two writers that started from one version, the second fails.

        The file system creates the version's pointer file only if it is not there yet.
        """
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer/version-{version:08d}.json")
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            stream = system.create(target, False)
        except Py4JJavaError as problem:
            raise ConcurrentWriteError(f"{self.root}: version {version} was written by another run") from problem
        stream.write(bytearray(json.dumps({"version": version, "path": path}).encode()))
        stream.close()


class PartLog:
    """Rows that are only ever added, a Parquet folder per part, until one call replaces all parts by what is left."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def read(self) -> DataFrame:
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.root)

    def add(self, name: str, rows: DataFrame) -> None:
        """Write ``rows`` as part ``name``; the same part written again takes the place of the first."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def compact(self, left: DataFrame) -> None:
        """Replace all parts by ``left``. It is written first: a crash in between leaves some rows twice, and loses none."""
        if not exists(self.spark, self.root):
            return
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        system = folder.getFileSystem(conf)
        read = [found.getPath() for found in system.listStatus(folder)]
        self.add(f"left-{uuid.uuid4().hex}", left)
        for path in read:
            system.delete(path, True)


class ConcurrentWriteError(RuntimeError):
    """Another run has written the table since this one read it."""


def record_table(spark: SparkSession, root: str, rules: RuleSet) -> SnapshotTable:
    return SnapshotTable(spark, f"{root}/records", rules.record_type)


def ledger_table(spark: SparkSession, root: str) -> SnapshotTable:
    return SnapshotTable(spark, f"{root}/files", LEDGER)


def data_json(rules: RuleSet, data: str = "data") -> Column:
    """The checked values as a JSON object with every key; whole numbers print as such."""
    members = []
    for rule in rules.fields:
        value = F.col(data)[rule.name]
        text = shown(value) if rule.kind == "number" else _json_text(value)
        members.append(
            F.concat(_json_text(F.lit(rule.name)), F.lit(": "), F.coalesce(text, F.lit("null")))
        )
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def _json_text(text: Column) -> Column:
    """``text`` as a JSON string: to_json does the escaping, its ``{"v":`` and ``}`` are cut."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), wrapped.substr(F.lit(6), F.length(wrapped) - 6))


def exported(records: DataFrame, rules: RuleSet) -> DataFrame:
    """Records with ``data`` and ``problems`` as JSON text."""
    return records.withColumn("data", data_json(rules)).withColumn("problems", F.to_json("problems"))


def imported(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """Inverse of :func:`exported`."""
    return rows.withColumn("data", F.from_json("data", rules.data_type)).withColumn(
        "problems", F.from_json("problems", T.ArrayType(PROBLEM))
    )
