"""What every query leans on: live samples, current answers, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.values import CatalogError, ancestors


def live(samples: DataFrame) -> DataFrame:
    return samples.where("deleted_at is null")


def current(annotations: DataFrame) -> DataFrame:
    return annotations.where("superseded_at is null")


def collection_filter(collection: Column, names: list[str]) -> Column:
    """Equal to or under one of the named collections; "*" alone is everything, no name at all is refused."""
    if not names:
        raise CatalogError("an empty list of collections selects nothing; name some, or *")
    if names == ["*"]:
        return F.lit(True)
    hit = F.lit(False)
    for name in sorted(set(names)):
        hit = hit | (collection == name) | collection.startswith(f"{name}/")
    return hit


def scoped(samples: DataFrame, memberships: DataFrame, names: list[str]) -> DataFrame:
    """Samples with a membership in scope, each once."""
    if names == ["*"]:
        return samples
    inside = memberships.where(collection_filter(F.col("collection"), names)).select(F.col("sample_id").alias("id"))
    return samples.join(inside, "id", "left_semi")


def label_set_id(label_sets: DataFrame, name: str) -> int:
    rows = label_sets.where(F.col("name") == name).select("id").take(1)
    if not rows:
        raise CatalogError(f"no label set {name!r}")
    return rows[0].id


def of_set(annotations: DataFrame, label_sets: DataFrame, name: str) -> DataFrame:
    """The rows of one label set, by a join so that no look-up runs ahead of the query."""
    return annotations.join(F.broadcast(label_sets.where(F.col("name") == name).select(F.col("id").alias("label_set_id")).limit(1)), "label_set_id", "left_semi")


def by_state(samples: DataFrame, annotations: DataFrame, state: str, source: str | None = None) -> DataFrame:
    """Live samples whose current answer (rows of one label set) has the state, and the source if one is asked for."""
    rows = current(annotations).where(F.col("state") == state)
    if source:
        rows = rows.where(F.col("source") == source)
    return live(samples).join(rows.select(F.col("sample_id").alias("id")), "id", "left_semi")


def unlabelled(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    return live(samples).join(current(annotations).select(F.col("sample_id").alias("id")), "id", "left_anti")


def longest_collection(names: DataFrame, collections: DataFrame) -> DataFrame:
    """(name, collection): for each name the longest collection that holds it, by an equi-join on its ancestors."""
    under = names.select("name", F.explode(ancestors(F.col("name"))).alias("collection")).where("collection <> name")
    return under.join(collections.select("collection").distinct(), "collection").groupBy("name").agg(F.max_by("collection", F.length("collection")).alias("collection"))
