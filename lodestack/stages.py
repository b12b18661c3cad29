"""Steps of a training pipeline over a catalog: freeze, materialise, draw the sides of a materialised version anew."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.catalog import Catalog
from lodestack.functions.values import CatalogError, content_hash
from lodestack.operators import versions
from lodestack.operators.selection import Spec
from lodestack.schema import SIDES


@dataclass(frozen=True)
class Sides:
    """What a split stage answers: the folder, whether sides were drawn, and how many members stand on each."""

    path: str
    drawn: bool
    counts: dict[str, int]


def dataset(catalog: Catalog, name: str, spec: Spec | None = None, pinned: int | None = None, **freeze) -> dict:
    """Freeze, or take the pinned version of the name, which must be there and of the same label set; (dataset, reused, groups cut by a given split)."""
    if pinned is not None:
        rows = catalog.now.read("dataset").where((F.col("name") == name) & (F.col("version") == pinned)).take(1)
        if not rows:
            raise CatalogError(f"no version {name}@{pinned}")
        wanted = catalog._label_set(catalog.now, spec.label_set).id if spec is not None else rows[0].label_set_id
        if rows[0].label_set_id != wanted:
            raise CatalogError(f"{name}@{pinned} is of another label set")
        number, reused = rows[0].id, True
    else:
        number, reused = catalog.freeze(name, spec, **freeze)
    held = catalog.dataset(number)
    cut = 0
    if held.given_split and held.group_by:
        members = catalog.now.read("dataset_member").where(F.col("dataset_id") == number).select(F.col("sample_id").alias("id"), "side")
        grp = F.get_json_object("metadata", f"$['{held.group_by}']")
        cut = versions.groups_cut(members.join(catalog.samples().select("id", grp.alias("grp")), "id")).first()[0]
    return {"dataset": number, "reused": reused, "groups_cut": cut}


def materialise(catalog: Catalog, number: int, path: str, **options) -> dict:
    """Materialise a version; what of it is there, and how many members have no answer."""
    reused = catalog.materialise(number, path, **options)
    rows = catalog.spark.read.parquet(f"{path}/members").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("skipped")).first()
    return {"path": path, "reused": reused, "samples": rows.n, "skipped": rows.skipped}


def _counts(members: DataFrame) -> dict[str, int]:
    held = {r.split: r.n for r in members.groupBy("split").agg(F.count("*").alias("n")).collect()}
    return {side: held.get(side, 0) for side in SIDES}


def split(catalog: Catalog, path: str, seed: int | None = None, val_ratio: float = 0.1, holdout_ratio: float = 0.0, group_by: str | None = None) -> Sides:
    """Without a seed the sides that a materialised version has; with one a fresh draw, inheriting nothing, in a copy beside it that is named for the draw."""
    members = catalog.spark.read.parquet(f"{path}/members")
    if seed is None:
        return Sides(path, False, _counts(members))
    grp = F.get_json_object("metadata", f"$['{group_by}']") if group_by else F.lit(None).cast("string")
    sided = versions.assign_sides(members.select("id", grp.alias("grp"), "checksum"), val_ratio, holdout_ratio, seed)
    tag = content_hash({"seed": seed, "val": val_ratio, "holdout": holdout_ratio, "group_by": group_by})[:12]
    return apply_sides(catalog, path, sided, tag, val_ratio, holdout_ratio, group_by)


def apply_sides(catalog: Catalog, path: str, sides: DataFrame, tag: str, val_ratio: float | None = None, holdout_ratio: float | None = None, group_by: str | None = None) -> Sides:
    """A copy of a materialised version beside it, ``<path>-split-<tag>``, with the sides (id, side) given for exactly its members; the version itself is never rewritten.

    The copy's manifest names the folder that has the files.
    """
    store, spark = catalog.store, catalog.spark
    target = f"{path.rstrip('/')}-split-{tag}"
    if store.text(f"{target}/manifest.json") is None:
        members = spark.read.parquet(f"{path}/members")
        joined = members.drop("split").join(sides.select("id", F.col("side").alias("split")), "id")
        have, given, met = members.count(), sides.count(), joined.count()
        if not have == given == met:
            raise CatalogError(f"{given} sides for {have} members, {met} of which they name")
        staging = f"{target}.pending-{uuid.uuid4().hex}"
        joined.select(*members.columns).write.parquet(f"{staging}/members")
        counts = _counts(spark.read.parquet(f"{staging}/members"))
        manifest = json.loads(store.text(f"{path}/manifest.json") or "{}")
        manifest |= {"counts": counts, "val_ratio": val_ratio, "val_ratio_achieved": counts["val"] / max(1, have), "holdout_ratio": holdout_ratio, "holdout_ratio_achieved": counts["holdout"] / max(1, have), "group_by": group_by, "files_of": path}
        store.write_text(f"{staging}/manifest.json", json.dumps(manifest, indent=1))
        store.move(staging, target)
    return Sides(target, True, _counts(spark.read.parquet(f"{target}/members")))
