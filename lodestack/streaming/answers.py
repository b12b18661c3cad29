"""The answer log as a stream: current answers kept up to date as rows are appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.selection import answers_asof
from lodestack.session import shared_folder


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log's Parquet files, and those that follow."""
    return spark.readStream.schema(schema).parquet(path)


def last_answers(log: DataFrame) -> DataFrame:
    """The last row per sample and label set of a streamed log, in update mode; the state is one row per pair."""
    answer = F.struct("id", "state", "value", "source", "batch", "created_at")
    return log.groupBy("sample_id", "label_set_id").agg(F.max_by(answer, "id").alias("a")).select("sample_id", "label_set_id", "a.*")


def batch_counts(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Answers per day, label set and source of a streamed log; rows later than ``late`` are dropped."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "label_set_id", "source").agg(F.count("*").alias("n"))


def follow(log: DataFrame, folder: str) -> StreamingQuery:
    """Keep the current answers of a streamed log under a shared folder: the updates of every batch as Parquet, a batch that runs again over itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    return last_answers(log).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(availableNow=True).start()


def now(spark: SparkSession, folder: str) -> DataFrame:
    """The answers that ``follow`` has seen so far: of the updates under its folder the last by id."""
    return answers_asof(spark.read.parquet(f"{folder}/updates"))


def run_to_end(spark: SparkSession, directory: str) -> DataFrame:
    """Drive a table's log through the stream once and return what it holds; nothing of it passes through the driver."""
    path = f"{directory}/annotation.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    log = read_log(spark, path, schema) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    follow(log, at).awaitTermination()
    return now(spark, at)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
