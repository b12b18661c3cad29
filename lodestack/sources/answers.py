"""Answers files: what a label set's samples were answered, one JSON line per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT = 1
_ROW = "struct<state:string,value:string,source:string,batch:string,created_at:string,superseded_at:string>"
SCHEMA = f"format int, catalog_id string, label_set string, checksum string, type string, rows array<{_ROW}>"


def export_answers(samples: DataFrame, annotations: DataFrame, label_sets: DataFrame, label_set: str, catalog_id: str, sources: list[str] | None = None) -> DataFrame:
    """One row per live sample with an answer: its bytes, type and history in order; rows of other sources are left out if some are named."""
    rows = annotations.join(F.broadcast(label_sets.where(F.col("name") == label_set).select(F.col("id").alias("label_set_id"))), "label_set_id", "left_semi")
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    row = F.struct("state", "value", "source", "batch", F.col("created_at").cast("string").alias("created_at"), F.col("superseded_at").cast("string").alias("superseded_at"))
    by = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", row.alias("row")))).alias("h"))
    kept = samples.where("deleted_at is null").join(by, samples.id == by.sample_id)
    return kept.select(
        F.lit(FORMAT).alias("format"), F.lit(catalog_id).alias("catalog_id"), F.lit(label_set).alias("label_set"), "checksum", F.concat_ws("/", "media", "subtype").alias("type"), F.col("h.row").alias("rows")
    )


def write_answers(answers: DataFrame, path: str) -> None:
    answers.write.json(path)


def read_answers(spark, path: str) -> DataFrame:
    """The file's samples; lines that do not parse, or of another format, end the read."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.withColumn("format", F.when(F.col("format") == FORMAT, F.col("format")).otherwise(F.raise_error(F.lit("not an answers file of format 1")).cast("int")))


def read_document(spark, path: str) -> DataFrame:
    """The samples of an answers file in one JSON document {format, catalog_id, label_set, samples: [{checksum, type, rows}]}, as ``read_answers`` gives them; another format ends the read."""
    shape = f"format int, catalog_id string, label_set string, samples array<struct<checksum:string,type:string,rows:array<{_ROW}>>>"
    document = spark.read.schema(shape).option("mode", "FAILFAST").option("multiLine", "true").json(path)
    right = F.when(F.col("format") == FORMAT, F.col("format")).otherwise(F.raise_error(F.lit("not an answers file of format 1")).cast("int"))
    return document.select(right.alias("format"), "catalog_id", "label_set", F.explode("samples").alias("s")).select("format", "catalog_id", "label_set", "s.checksum", "s.type", "s.rows")
