"""Rewrites of tables that an older catalog wrote, each one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.values import CatalogError, asserted


def sides_of(members: DataFrame) -> DataFrame:
    """Members (.., val boolean) with ``side`` in its place; null is train."""
    return members.withColumn("side", F.when(F.coalesce("val", F.lit(False)), "val").otherwise("train")).drop("val")


_OLD_SPANS = "array<struct<label:string,start:bigint,end:bigint,text:string>>"
_SPANS = "array<struct<labels:array<string>,start:bigint,end:bigint,text:string>>"


def _with_values(value: Column, spans: Column) -> Column:
    # keys of an answer beside its kind and values are none of a span set
    return F.to_json(F.struct(F.lit("spans").alias("kind"), spans.alias("values")))


def label_lists(value: Column) -> Column:
    """A span answer whose spans have one ``label`` each with ``labels`` in its place; other answers, and spans that have labels, stay."""
    spans = F.from_json(F.get_json_object(value, "$.values"), _OLD_SPANS)
    old = (F.get_json_object(value, "$.kind") == "spans") & F.exists(spans, lambda s: s["label"].isNotNull())
    new = F.transform(spans, lambda s: F.struct(F.array(s["label"]).alias("labels"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return F.when(F.coalesce(old, F.lit(False)), _with_values(value, new)).otherwise(value)


def single_labels(rows: DataFrame, column: str = "value") -> DataFrame:
    """The way back: spans with one ``label`` each; a span with another number of labels cannot go back and is refused."""
    value = F.col(column)
    spans = F.from_json(F.get_json_object(value, "$.values"), _SPANS)
    isspans = F.coalesce(F.get_json_object(value, "$.kind") == "spans", F.lit(False))
    if rows.where(isspans & F.exists(spans, lambda s: F.size(s["labels"]) != 1)).take(1):
        raise CatalogError("spans with several labels have no older form")
    back = F.transform(spans, lambda s: F.struct(s["labels"][0].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return rows.withColumn(column, F.when(isspans, _with_values(value, back)).otherwise(value))


#: fixed values: the metadata key that a group id becomes, by the first part of a subtype
GROUP_KEYS = {"frames": "video", "email": "thread"}


def group_key(samples: DataFrame) -> DataFrame:
    """Samples (.., subtype, metadata json, group_id) with the group among their metadata: as video of frames, thread of e-mails, else group."""
    kind = F.split("subtype", "/")[0]
    name = F.lit("group")
    for first, key in GROUP_KEYS.items():
        name = F.when(kind == first, key).otherwise(name)
    pair = F.to_json(F.map_from_arrays(F.array(name), F.array("group_id")))
    inner = F.regexp_replace(F.trim("metadata"), r"\}$", "")
    empty = F.coalesce(F.size(F.json_object_keys("metadata")), F.lit(0)) <= 0
    put = F.when(empty, pair).otherwise(F.concat(inner, F.lit(","), F.substr(pair, F.lit(2))))
    return samples.withColumn("metadata", F.when(F.col("group_id").isNull(), F.col("metadata")).otherwise(put)).drop("group_id")


def history(cells: DataFrame) -> DataFrame:
    """One row per cell (sample_id, label_set_id, .., updated_at) as the first row of its history: dense ids in the order of time, nothing superseded."""
    from lodestack.store import with_ids

    numbered = with_ids(cells, 1, "updated_at", "sample_id", "label_set_id")
    return numbered.withColumnRenamed("updated_at", "created_at").withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))


def label_type(schema: Column) -> Column:
    """A label set's schema with ``label_type`` for the older key ``task``."""
    return F.when(F.get_json_object(schema, "$.label_type").isNotNull(), schema).otherwise(F.regexp_replace(schema, r'"task"\s*:', '"label_type":'))


def class_index(annotations: DataFrame, label_sets: DataFrame) -> DataFrame:
    """(annotation_id, class_name) of every answer, standing or not; of a label set whose schema does not read, of the standing ones only."""
    reads = label_sets.select(F.col("id").alias("label_set_id"), F.try_parse_json("label_schema").isNotNull().alias("reads"))
    rows = annotations.join(F.broadcast(reads), "label_set_id", "left").where("state = 'annotated' and (reads or superseded_at is null)")
    return rows.select(F.col("id").alias("annotation_id"), F.explode(asserted(F.col("value"))).alias("class_name"))


def membership_ids(memberships: DataFrame) -> DataFrame:
    """Memberships (sample_id, collection, ..) with dense ids in the order of sample and collection."""
    from lodestack.store import with_ids

    return with_ids(memberships.drop("id"), 1, "sample_id", "collection", "added_at")


def list_types(lists: DataFrame, samples: DataFrame) -> DataFrame:
    """(list_id, media, subtype): the one type that the members (list_id, checksum) of a list have among all samples, tombstoned ones too; null where there are several or none."""
    held = lists.join(samples.select("checksum", "media", "subtype"), "checksum", "left")
    by = held.groupBy("list_id").agg(F.countDistinct("media", "subtype").alias("n"), F.min("media").alias("media"), F.min("subtype").alias("subtype"))
    return by.select("list_id", F.when(F.col("n") == 1, F.col("media")).alias("media"), F.when(F.col("n") == 1, F.col("subtype")).alias("subtype"))
