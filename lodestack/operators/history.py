"""The answer log: timelines, second looks, review counts, and the set-based form of writing answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestack.functions.values import CatalogError
from lodestack.schema import RANK


def rank(source: Column) -> Column:
    """Authority of a source: model 0, import 1, human 2; null of an unknown one."""
    made = F.lit(None).cast("int")
    for name, n in RANK.items():
        made = F.when(source == name, n).otherwise(made)
    return made


def timeline(annotations: DataFrame) -> DataFrame:
    """Every row with its place in the history of its sample and label set, by time, then id."""
    w = W.partitionBy("sample_id", "label_set_id").orderBy("created_at", "id")
    return annotations.withColumn("place", F.row_number().over(w)).withColumn("next_at", F.lead("created_at").over(w))


def second_looks(annotations: DataFrame) -> DataFrame:
    """(sample_id, label_set_id, agreed): where a human looked twice and the last look is current, whether both say the same."""
    human = annotations.where("source = 'human'")
    w = W.partitionBy("sample_id", "label_set_id").orderBy(F.desc("created_at"), F.desc("id"))
    # the two latest rows of each history, by a window that needs no more than its partition
    two = human.withColumn("n", F.row_number().over(w)).where("n <= 2")
    said = F.struct("state", "value")
    looks = two.groupBy("sample_id", "label_set_id").agg(
        F.max(F.when(F.col("n") == 1, said)).alias("last"), F.max(F.when(F.col("n") == 2, said)).alias("before"), F.max(F.when(F.col("n") == 1, F.col("superseded_at").isNull())).alias("current")
    )
    return looks.where("before is not null and current").select("sample_id", "label_set_id", F.col("last").eqNullSafe(F.col("before")).alias("agreed"))


def review_counts(annotations: DataFrame) -> DataFrame:
    """(label_set_id, batch, pending, accepted, corrected) over the latest imported answer of each sample: what has become of it."""
    row = F.struct("created_at", "id", "batch", "value")
    imported = annotations.where("source = 'import' and state = 'annotated'").groupBy("sample_id", "label_set_id").agg(F.max_by(row, F.struct("created_at", "id")).alias("i"))
    standing = annotations.where("superseded_at is null").groupBy("sample_id", "label_set_id").agg(F.max_by(F.struct("id", "source", "state", "value"), "id").alias("s"))
    both = imported.join(standing, ["sample_id", "label_set_id"], "left")
    pending = F.col("s").isNull() | (F.col("s.id") == F.col("i.id")) | (F.col("s.source") != "human")
    accepted = ~pending & (F.col("s.state") == "annotated") & F.col("s.value").eqNullSafe(F.col("i.value"))
    return both.groupBy("label_set_id", F.coalesce("i.batch", F.lit("")).alias("batch")).agg(
        F.count_if(pending).alias("pending"), F.count_if(accepted).alias("accepted"), F.count_if(~pending & ~accepted).alias("corrected")
    )


def write_answers(annotations: DataFrame, batch: DataFrame, source: str, batch_name: str | None = None) -> DataFrame:
    """Verdict for each row of (item, sample_id, label_set_id, value): ``annotated``, ``skipped`` or ``kept``, and the batch it is written under.

    A row is written unless a current answer of higher authority stands. Of several rows of one sample the last
    becomes current. A null value is a skip; a batch not given is taken over from the answer replaced.
    """
    if source not in RANK:
        raise CatalogError(f"no source {source!r}")
    standing = annotations.where("superseded_at is null").groupBy("sample_id", "label_set_id").agg(F.max_by(F.struct("source", "batch"), "id").alias("held"))
    joined = batch.join(standing, ["sample_id", "label_set_id"], "left")
    accepted = F.col("held").isNull() | (rank(F.col("held.source")) <= RANK[source])
    verdict = F.when(~accepted, "kept").when(F.col("value").isNull(), "skipped").otherwise("annotated")
    last = F.row_number().over(W.partitionBy("sample_id", "label_set_id").orderBy(F.desc("item"))) == 1
    return joined.select(
        "item", "sample_id", "label_set_id", "value", F.lit(source).alias("source"), F.coalesce(F.lit(batch_name), "held.batch").alias("batch"), verdict.alias("verdict"), (accepted & last).alias("current")
    )


def unskip(annotations: DataFrame, samples: DataFrame) -> DataFrame:
    """The current skips of the given samples (sample_id, label_set_id), which a withdrawal takes back."""
    return annotations.where("superseded_at is null and state = 'skipped'").join(samples.select("sample_id", "label_set_id").distinct(), ["sample_id", "label_set_id"], "left_semi")
