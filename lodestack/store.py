"""Log-structured storage: every commit adds Parquet parts to some tables and publishes them together.

A commit is one JSON file with the next number, created exclusively: of two writers one gets the number, the
other is told to read again. Parts are written before they are published, so a reader never sees half a commit, and what was read
once (a snapshot) never changes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestack.functions.values import CatalogError
from lodestack.schema import TABLES, VERSION


class Lost(CatalogError):
    """Another writer committed first; read again and retry."""


@dataclass
class Snapshot:
    """The tables as of one commit."""

    spark: SparkSession
    root: str
    version: int
    parts: dict[str, list[str]] = field(default_factory=dict)

    def read(self, table: str) -> DataFrame:
        reader = self.spark.read.schema(TABLES[table])
        if not self.parts.get(table):
            return self.spark.createDataFrame([], TABLES[table])
        return reader.parquet(*[f"{self.root}/{p}" for p in self.parts[table]])

    def next_id(self, table: str) -> int:
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1


class Store:
    """A catalog's tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self._commits())

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        names = self._commits()
        if not names:
            raise CatalogError(f"no catalog at {self.root}")
        if version is not None:
            names = [n for n in names if int(n[:-5]) <= version]
        made = Snapshot(self.spark, self.root, int(names[-1][:-5]))
        for name in names:
            said = self._load(name)
            if said["schema"] > VERSION:
                raise CatalogError(f"{self.root} was written by a later schema, {said['schema']}")
            for table, parts in said["parts"].items():
                made.parts.setdefault(table, []).extend(parts)
        return made

    def commit(self, changes: dict[str, DataFrame], after: int) -> int:
        """Publish the rows of several tables at once, if no other commit followed ``after``."""
        parts: dict[str, list[str]] = {}
        for table, df in changes.items():
            at = f"data/{table}/{uuid.uuid4().hex}"
            columns = [c.split(" ")[0] for c in TABLES[table].split(", ")]
            shaped = df.select(*[F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in TABLES[table].split(", "))]) if set(columns) <= set(df.columns) else None
            if shaped is None:
                raise CatalogError(f"{table} lacks {sorted(set(columns) - set(df.columns))}")
            shaped.write.parquet(f"{self.root}/{at}")
            parts[table] = [at]
        number = after + 1
        target = self._path(f"{self.root}/_commits/{number:020d}.json")
        if self._fs.exists(target):
            raise Lost(f"commit {number} is taken")
        try:
            out = self._fs.create(target, False)
        except Exception as taken:  # the exclusive create failed: another writer was faster
            raise Lost(f"commit {number} is taken") from taken
        out.write(bytearray(json.dumps({"schema": VERSION, "parts": parts}).encode()))
        out.close()
        return number

    def text(self, path: str) -> str | None:
        """A small file of the catalog's filesystem, or nothing."""
        target = self._path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        target = self._path(path)
        out = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(text.encode()))
        out.close()

    def move(self, source: str, target: str) -> None:
        """Put a folder in the place of another."""
        a, b = self._path(source), self._path(target)
        fs = a.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(b, True)
        if b.getParent() is not None:
            fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise CatalogError(f"{source} cannot be moved to {target}")

    def create(self, identity: str) -> int:
        if self.exists():
            raise CatalogError(f"{self.root} holds a catalog already")
        return self.commit({"catalog_identity": self.spark.createDataFrame([(identity,)], "id string").withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))}, 0)


def with_ids(df: DataFrame, first: int, *order: str) -> DataFrame:
    """Dense ids from ``first`` in the given order, counted per range partition so that no task sees more than its own."""
    from lodestack.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn("id", F.lit(first) + F.col("_before") + F.col("_at") - 1).drop("_part", "_before", "_at")


def copy_index(source: Snapshot, target: Store) -> int:
    """Every table of a snapshot, ids and identity kept; refused where the target holds a catalog."""
    if target.exists():
        raise CatalogError(f"{target.root} holds a catalog already")
    return target.commit({t: source.read(t) for t in TABLES if source.parts.get(t)}, 0)


# views over the logs -------------------------------------------------------------------------------------------


def samples(snapshot: Snapshot) -> DataFrame:
    """Samples as they stand: the last description wins, a tombstone sets ``deleted_at``."""
    events = snapshot.read("event")
    described = events.where("kind = 'described'").groupBy("sample_id").agg(F.max_by(F.struct("after"), "id").alias("d"))
    gone = events.where("kind = 'tombstoned'").groupBy("sample_id").agg(F.min("at").alias("gone"))
    base = snapshot.read("sample")
    joined = base.join(described.withColumnRenamed("sample_id", "id"), "id", "left").join(gone.withColumnRenamed("sample_id", "id"), "id", "left")
    after = F.col("d.after")
    return joined.select(
        *[
            F.when(F.col("d").isNotNull(), F.get_json_object(after, "$.metadata")).otherwise(F.col("metadata")).alias("metadata")
            if c == "metadata"
            else F.coalesce("gone", "deleted_at").alias("deleted_at")
            if c == "deleted_at"
            else F.col(c)
            for c in base.columns
        ]
    )


def annotations(snapshot: Snapshot) -> DataFrame:
    """The answer log with ``superseded_at`` worked out: the next row's time, or that of a withdrawal; rows that arrived as history keep their own."""
    log, events = snapshot.read("annotation"), snapshot.read("event")
    arrived = events.where("kind = 'arrived'").select(F.col("annotation_id").alias("id"), F.lit(True).alias("arrived"))
    withdrawn = events.where("kind = 'withdrawn'").groupBy(F.col("annotation_id").alias("id")).agg(F.min("at").alias("withdrawn"))
    rows = log.join(arrived, "id", "left").join(withdrawn, "id", "left")
    w = W.partitionBy("sample_id", "label_set_id", F.col("arrived").isNull()).orderBy("id")
    superseded = F.when(F.col("arrived").isNotNull(), F.col("superseded_at")).otherwise(F.coalesce("withdrawn", F.lead("created_at").over(w)))
    return rows.withColumn("superseded_at", superseded).select(*log.columns)
