"""Files, raw intake and the layout of tar shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestack.functions.values import CatalogError

SHARD_BYTES = 512 << 20


def files_under(spark: SparkSession, root: str, listed: list[str] | None = None) -> DataFrame:
    """(path, length, checksum, content) of the files under a folder, paths relative to it, or of a listed subset; a listed path that leaves the folder or is absent refuses the whole.

    The content is a row's value here, so files of more than 2 GB need ``blobs.hash_files``.
    """
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    base = "/" + root.removeprefix("file:").lstrip("/")
    rows = found.select(F.substr(plain, F.lit(len(base) + 2)).alias("path"), "length", F.sha2("content", 256).alias("checksum"), "content")
    if listed is None:
        return rows
    names = {p.removeprefix(f"{base}/") for p in listed}
    if outside := sorted(n for n in names if n.startswith("/") or ".." in n.split("/")):
        raise CatalogError(f"outside {root}: {outside[:20]}")
    wanted = spark.createDataFrame([(n,) for n in names], "path string")
    if absent := [r.path for r in wanted.join(rows.select("path"), "path", "left_anti").orderBy("path").take(20)]:
        raise CatalogError(f"not there: {absent}")
    return rows.join(wanted, "path", "left_semi")


def raw_ingest(files: DataFrame, raw: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Of files (path, checksum, length): the names new to the collection, and the counts files, added, held, checksums, blobs.

    A held name with other bytes refuses the whole. Each new checksum is one blob, however many names it has.
    """
    if not collection or collection.strip("/") != collection:
        raise CatalogError(f"{collection!r} is not a collection path")
    held = raw.where(F.col("collection") == collection).select("path", F.col("checksum").alias("had"))
    joined = files.select("path", "checksum", "length").join(held, "path", "left")
    if clash := [r.path for r in joined.where("had is not null and had <> checksum").orderBy("path").take(20)]:
        raise CatalogError(f"held with other bytes: {clash}")
    added = joined.where("had is null").drop("had")
    stored = raw.select("checksum").distinct()
    blobs = added.select("checksum").distinct().join(stored, "checksum", "left_anti").agg(F.count("*").alias("blobs"))
    counts = joined.agg(F.count("*").alias("files"), F.count_if(F.col("had").isNull()).alias("added"), F.count_if(F.col("had").isNotNull()).alias("held"), F.countDistinct("checksum").alias("checksums"))
    return added, counts.join(blobs)


def shard_plan(blobs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(checksum, length, shard, offset): blobs (checksum, length, first_id) laid into shards in id order, each shard at most ``shard_bytes`` unless one blob is larger.

    A tar member takes a 512-byte header and its bytes rounded up to 512. The running sum is taken per range of ids and the ranges are added up,
    so no task sees more than its range; a shard ends where the sum passes a multiple of the shard size.
    """
    from lodestack.session import cut

    size = (F.lit(512) + F.ceil(F.col("length") / 512) * 512).cast("bigint")
    ranged = cut(blobs.withColumn("size", size).repartitionByRange("first_id").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = sums.select("part", F.coalesce(F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.coalesce(F.sum("size").over(W.partitionBy("part").orderBy("first_id", "checksum").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("upto"))
    placed = placed.withColumn("shard", F.expr(f"at div {shard_bytes}"))
    first = placed.groupBy("shard").agg(F.min("at").alias("from"))
    return placed.join(first, "shard").select("checksum", "length", "shard", (F.col("at") - F.col("from") + 512).alias("offset"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(item): the lines of a text file, one checksum or name each; blank ones left out, repeated ones once."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> ''").distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of lines "old new"; a line of other shape, or an old checksum paired twice, is refused."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] <> ''")
    if bad := rows.where(F.size("p") != 2).take(1):
        raise CatalogError(f"not a pair: {' '.join(bad[0].p)}")
    pairs = rows.select(F.col("p")[0].alias("old"), F.col("p")[1].alias("new")).distinct()
    if twice := [r.old for r in pairs.groupBy("old").count().where("count > 1").orderBy("old").take(20)]:
        raise CatalogError(f"paired twice: {twice}")
    return pairs
