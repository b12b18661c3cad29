"""Verdicts of merging a copy's answers and of importing another catalog's, each one CASE over a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.history import rank


def _held(annotations: DataFrame) -> DataFrame:
    standing = annotations.where("superseded_at is null")
    return standing.groupBy("sample_id", "label_set_id").agg(F.max_by(F.struct("state", "value", "source"), "id").alias("held"))


def merge_verdicts(incoming: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows (sample_id, label_set_id, state, value, source) of a copy's current answers with ``verdict`` and ``writes``.

    ``verdict`` is null for a skip over anything that stands, which is not counted. A conflict is two different answers of equal authority.
    """
    joined = incoming.join(_held(annotations), ["sample_id", "label_set_id"], "left")
    new, old = rank(F.col("source")), rank(F.col("held.source"))
    same = F.col("value").eqNullSafe(F.col("held.value"))
    none, answered = F.col("held").isNull(), F.col("held.state") == "annotated"
    verdict = (
        F.when((F.col("state") == "skipped") & none, "skipped")
        .when(F.col("state") == "skipped", None)
        .when(none, "copied")
        .when(~answered, F.when(new >= old, "copied").otherwise("outranked"))
        .when(same, F.when(new > old, "confirmed").otherwise("agreed"))
        .when(new > old, "superseded")
        .when(new < old, "outranked")
        .otherwise("conflicted")
    )
    writes = F.coalesce(verdict.isin("skipped", "copied", "confirmed", "superseded"), F.lit(False))
    return joined.select("sample_id", "label_set_id", "state", "value", "source", verdict.alias("verdict"), writes.alias("writes"))


def import_verdicts(incoming: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows (sample_id, label_set_id, state, value, source, created_at) of another catalog's current answers with ``verdict``, ``writes_current`` and ``writes_history``.

    A row that is already in the log (same time, source, state and value) is ``already``.
    """
    key = ["sample_id", "label_set_id", "created_at", "source", "state", "value"]
    present = annotations.select(*key).distinct().withColumn("present", F.lit(True))
    on = [incoming[c].eqNullSafe(present[c]) for c in key]
    marked = incoming.join(present, on, "left").select(incoming["*"], F.coalesce("present", F.lit(False)).alias("present"))
    joined = marked.join(_held(annotations), ["sample_id", "label_set_id"], "left")
    new, old = rank(F.col("source")), rank(F.col("held.source"))
    same = F.col("value").eqNullSafe(F.col("held.value"))
    none, answered = F.col("held").isNull(), F.col("held.state") == "annotated"
    by_rank = F.when(new > old, "confirmed").when(new < old, "outranked").otherwise("agreed")
    verdict = (
        F.when(F.col("present"), "already")
        .when(F.col("state") == "skipped", F.when(none, "copied").when(answered, "skips_ignored").otherwise(by_rank))
        .when(none, "copied")
        .when(~answered, F.when(old <= new, "copied").otherwise("outranked"))
        .when(same, F.when(new > old, "confirmed").otherwise("agreed"))
        .when(new > old, "superseded")
        .when(new < old, "outranked")
        .otherwise("conflicted")
    )
    current = verdict.isin("copied", "confirmed", "superseded")
    return joined.select(*key, verdict.alias("verdict"), current.alias("writes_current"), (current | (verdict == "already")).alias("writes_history"))


def match_samples(incoming: DataFrame, samples: DataFrame) -> DataFrame:
    """(item, sample_id, matched): rows (item, checksum, type or null) to live samples: by type, untyped ones only where one type holds the bytes."""
    held = samples.where("deleted_at is null").select(F.col("id").alias("sample_id"), "checksum", F.concat_ws("/", "media", "subtype").alias("held_type"))
    joined = incoming.join(held, "checksum", "left").where(F.col("type").isNull() | F.col("held_type").isNull() | (F.col("type") == F.col("held_type")))
    by = joined.groupBy("item").agg(F.countDistinct("sample_id").alias("n"), F.min("sample_id").alias("sample_id"))
    every = incoming.select("item").distinct().join(by, "item", "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("item", F.when(n == 1, F.col("sample_id")).alias("sample_id"), F.when(n == 1, "matched").when(n == 0, "unmatched").otherwise("ambiguous").alias("matched"))


def disputed(conflicts: DataFrame, samples: DataFrame) -> DataFrame:
    """The open conflicts (sample_id, label_set_id, other_value, ..) of live samples."""
    return conflicts.join(samples.where("deleted_at is null").select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
