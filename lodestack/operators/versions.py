"""Frozen versions: given sides, grouped assignment of sides, members, features, settling of inputs."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestack.functions.values import CatalogError, grouping
from lodestack.operators.components import components
from lodestack.session import cut


class SplitError(CatalogError):
    """A split with nothing to train on, or nothing to validate with."""


def split_groups(members: DataFrame) -> DataFrame:
    """(id, unit): members (id, grp or null, checksum) by the unit that must stay on one side; groups that share bytes are one unit.

    Units are named by their least member, so their order is that of the ids. Found by distributed union-find over (group, bytes) edges.
    """
    own = F.coalesce(F.concat(F.lit("g:"), F.col("grp")), F.concat(F.lit("s:"), F.col("id").cast("string")))
    mask = F.lit((1 << 62) - 1)
    node = lambda kind, c: F.xxhash64(F.lit(kind), c).bitwiseAND(mask).bitwiseOR(F.lit(1 << 62))
    edges = members.select("id", node("g", own).alias("n")).union(members.where("checksum is not null").select("id", node("c", F.col("checksum")).alias("n")))
    return components(edges).where(F.col("node") < (1 << 62)).select(F.col("node").alias("id"), F.col("root").alias("unit"))


#: undecided units up to which sides follow the one random stream of the seed, in a task that holds two numbers for each
STREAM_UNITS = 10_000_000


def draw(sizes: list[tuple[int, int]], total: int, fixed: dict[str, int], val_ratio: float, holdout_ratio: float, seed: int, units: int | None = None) -> dict[int, str]:
    """Sides of the undecided units (unit, size), in their order. ``fixed`` counts the members whose side is given or inherited.

    ``units`` is how many there are with those whose side is inherited, by which it is judged whether a side must not stay empty.

    The units are shuffled by the seed; holdout is filled first, then val, each taking a unit if that moves it
    strictly closer to its target. A side that must not stay empty takes the unit whose size is closest to the target.
    """
    pending = list(sizes)
    random.Random(seed).shuffle(pending)
    decided: dict[int, str] = {}
    groups = len(pending) if units is None else units
    for side, ratio, forced in (("holdout", holdout_ratio, holdout_ratio > 0 and groups > 2), ("val", val_ratio, groups > 1)):
        target, have, rest = round(total * ratio), fixed.get(side, 0), []
        for unit, size in pending:
            if abs(target - (have + size)) < abs(target - have):
                decided[unit] = side
                have += size
            else:
                rest.append((unit, size))
        if not have and forced and rest:
            best = min(rest, key=lambda x: abs(target - x[1]))
            decided[best[0]] = side
            rest.remove(best)
        pending = rest
    return decided | {unit: "train" for unit, _ in pending}


def assign_sides(members: DataFrame, val_ratio: float, holdout_ratio: float, seed: int, inherited: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """(id, side) for members (id, grp, checksum). ``inherited`` and ``given`` hold (id, side).

    Given sides stand. A unit with one inherited side takes it, with several train. The draw is sequential over units, so up to ``STREAM_UNITS`` of them
    one task gets their sizes: one number per unit, not per member. More are ranked by a hash of unit and seed, and the sides are cut from that order.
    """
    spark = members.sparkSession
    none = spark.createDataFrame([], "id bigint, side string")
    fixed = (given or none).join(members.select("id"), "id", "left_semi")
    units = split_groups(members if given is None else members.join(fixed.select("id"), "id", "left_anti"))
    kept = units.join(inherited or none, "id", "left").groupBy("unit").agg(F.count("*").alias("size"), F.collect_set("side").alias("sides"))
    kept = cut(kept.withColumn("side", F.when(F.size("sides") == 1, F.col("sides")[0]).when(F.size("sides") > 1, F.lit("train"))))
    counts = {r.side: r.n for r in fixed.groupBy("side").agg(F.count("*").alias("n")).collect()} if given is not None else {}
    found = {r.side: r for r in kept.groupBy("side").agg(F.sum("size").alias("n"), F.count("*").alias("units")).collect()}
    total = sum(counts.values()) + sum(r.n for r in found.values())
    for side, r in found.items():
        if side is not None:
            counts[side] = counts.get(side, 0) + r.n
    number, pending = sum(r.units for r in found.values()), found[None].units if None in found else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        decided = draw(sizes, total, counts, val_ratio, holdout_ratio, seed, number)
        yield pa.RecordBatch.from_arrays([pa.array(decided.keys(), pa.int64()), pa.array(decided.values(), pa.string())], ["unit", "drawn"])

    open_units = kept.where("side is null").select("unit", "size")
    if pending <= STREAM_UNITS:
        drawn = open_units.repartition(1).sortWithinPartitions("unit").mapInArrow(run, "unit bigint, drawn string")
    else:
        drawn = ranked(open_units, total, counts, val_ratio, holdout_ratio, seed)
    sided = units.join(kept.select("unit", "side"), "unit").join(drawn, "unit", "left").select("id", F.coalesce("side", "drawn").alias("side"))
    out = cut(fixed.union(sided))
    found = {r.side for r in out.select("side").distinct().collect()}
    if "train" not in found or "val" not in found:
        raise SplitError(f"every side but {sorted({'train', 'val'} - found)} has members")
    return out


#: bits of a sample's id beside the version it is a member of
ID_BITS = 44


def assign_many(members: DataFrame, settings: dict[int, tuple[float, float, int]]) -> DataFrame:
    """(dataset_id, id, side) for members (dataset_id, id, grp, checksum) of several versions at once, each as ``assign_sides`` draws it with nothing inherited or given.

    ``settings`` holds (val_ratio, holdout_ratio, seed) of every version. Units are found for all versions together; one task draws a version.
    """
    known = members.where(F.col("dataset_id").isin(*settings)) if settings else members.limit(0)
    fits = F.col("id").between(0, (1 << ID_BITS) - 1) & F.col("dataset_id").between(0, (1 << (62 - ID_BITS)) - 1)
    key = F.when(fits, F.shiftleft(F.col("dataset_id").cast("bigint"), ID_BITS) + F.col("id")).otherwise(F.raise_error(F.lit(f"ids beyond {ID_BITS} bits")).cast("bigint"))
    tag = lambda c: F.concat("dataset_id", F.lit(":"), c)
    units = split_groups(known.select(key.alias("id"), tag("grp").alias("grp"), tag("checksum").alias("checksum")))
    version = F.shiftright("unit", ID_BITS).alias("dataset_id")
    sizes = cut(units.groupBy("unit").agg(F.count("*").alias("size")).select(version, "unit", "size"))
    found = {r.dataset_id: r for r in sizes.groupBy("dataset_id").agg(F.sum("size").alias("total"), F.count("*").alias("units")).collect()}
    totals, large = {d: r.total for d, r in found.items()}, [d for d, r in found.items() if r.units > STREAM_UNITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def solve() -> pa.RecordBatch:
            val, holdout, seed = settings[at]
            decided = draw(held, totals[at], {}, val, holdout, seed)
            return pa.RecordBatch.from_arrays([pa.array(decided.keys(), pa.int64()), pa.array(decided.values(), pa.string())], ["unit", "side"])

        for batch in batches:
            for dataset, unit, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if dataset != at:
                    if held:
                        yield solve()
                    at, held = dataset, []
                held.append((unit, size))
        if held:
            yield solve()

    streamed = sizes.where(~F.col("dataset_id").isin(*large)) if large else sizes
    drawn = streamed.repartition("dataset_id").sortWithinPartitions("dataset_id", "unit").mapInArrow(run, "unit bigint, side string")
    for d in large:
        drawn = drawn.union(ranked(sizes.where(F.col("dataset_id") == d), totals[d], {}, *settings[d]).withColumnRenamed("drawn", "side"))
    sided = cut(units.join(drawn, "unit").select(version, F.col("id").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id"), "side"))
    for r in sided.groupBy("dataset_id").agg(F.collect_set("side").alias("sides")).collect():
        if lacks := {"train", "val"} - set(r.sides):
            raise SplitError(f"version {r.dataset_id}: nothing on {sorted(lacks)}")
    return sided


def ranked(units: DataFrame, total: int, fixed: dict[str, int], val_ratio: float, holdout_ratio: float, seed: int) -> DataFrame:
    """(unit, drawn) for units (unit, size) in the order of a seeded hash: those first that fill holdout, then val, the rest on train.

    The running size is taken per range of hashes and the ranges are added up, so that no task sees more than its range. A side misses its target by less than the
    largest unit.
    """
    hashed = cut(units.withColumn("h", F.xxhash64(F.lit(seed), "unit")).repartitionByRange("h", "unit").withColumn("part", F.spark_partition_id()))
    sums = hashed.groupBy("part").agg(F.sum("size").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("size").over(W.partitionBy("part").orderBy("h", "unit"))
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    holdout = max(0, round(total * holdout_ratio) - fixed.get("holdout", 0))
    val = max(0, round(total * val_ratio) - fixed.get("val", 0))
    placed = hashed.withColumn("upto", upto).join(F.broadcast(before), "part")
    return placed.select("unit", F.when(middle < holdout, "holdout").when(middle < holdout + val, "val").otherwise("train").alias("drawn"))


def given_sides(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset_id, sample_id, side) of all entries of the versions with a given split {key, holdout, val}; one scan, whatever the number of versions.

    The driver reads the keys that the versions name, a handful of a fixed table.
    """
    given = versions.where("given_split is not null").select(
        F.col("id").alias("dataset_id"),
        F.get_json_object("given_split", "$.key").alias("key"),
        F.from_json(F.get_json_object("given_split", "$.holdout"), "array<string>").alias("holdout"),
        F.from_json(F.get_json_object("given_split", "$.val"), "array<string>").alias("val"),
    )
    joined = entries.select("dataset_id", "sample_id", "metadata").join(F.broadcast(given), "dataset_id")
    group = F.lit(None).cast("string")
    for key in sorted(r.key for r in given.select("key").where("key is not null").distinct().collect()):
        group = F.when(F.col("key") == key, grouping(F.col("metadata"), key, F.col("sample_id"))).otherwise(group)
    named = lambda side: F.coalesce(F.array_contains(F.transform(side, lambda v: F.concat(F.lit("g:"), v)), F.col("grp")), F.lit(False))
    return joined.withColumn("grp", group).select("dataset_id", "sample_id", F.when(named("holdout"), "holdout").when(named("val"), "val").otherwise("train").alias("side"))


@dataclass(frozen=True)
class GivenSplit:
    """Sides the data came with: values of a metadata key, or lists of checksums."""

    key: str | None = None
    holdout: tuple[str, ...] = ()
    val: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if set(self.holdout) & set(self.val):
            raise CatalogError(f"on two sides at once: {sorted(set(self.holdout) & set(self.val))}")
        if self.key is None and (self.holdout or self.val):
            raise CatalogError("values of which key?")

    def sides(self, members: DataFrame) -> DataFrame:
        """(id, side) of members (id, checksum, metadata): by the value at the key, else train."""
        group = grouping(F.col("metadata"), self.key, F.col("id"))
        side = F.when(group.isin([f"g:{v}" for v in self.holdout]), "holdout").when(group.isin([f"g:{v}" for v in self.val]), "val").otherwise("train")
        return members.select("id", side.alias("side"))

    def named(self, members: DataFrame, lists: DataFrame | None = None) -> DataFrame:
        """(id, side) of those members (id, checksum, metadata) only that the key or a list (checksum, side) puts on holdout or val, and of all with their bytes.

        Bytes that would come to stand on two sides are refused.
        """
        sided = self.with_lists(members, lists) if lists is not None else self.sides(members)
        held = sided.where("side <> 'train'").join(members.select("id", "checksum"), "id").select("checksum", "side").distinct()
        if torn := [r.checksum for r in torn_bytes(held).orderBy("checksum").take(20)]:
            raise CatalogError(f"bytes on two sides: {torn}")
        return members.select("id", "checksum").join(held, "checksum").select("id", "side")

    def record(self) -> dict:
        """How a version records the split."""
        return {"key": self.key, "holdout": sorted(self.holdout), "val": sorted(self.val)}

    def with_lists(self, members: DataFrame, lists: DataFrame) -> DataFrame:
        """(id, side) as ``sides``, but the bytes that ``lists`` (checksum, side) names take the side named there, whatever their type.

        A checksum on two sides, or a list against the key, is refused.
        """
        if twice := [r.checksum for r in torn_bytes(lists).orderBy("checksum").take(20)]:
            raise CatalogError(f"listed on two sides: {twice}")
        named = lists.select("checksum", F.col("side").alias("listed")).distinct()
        keyed = self.sides(members) if self.key else members.select("id", F.lit("train").alias("side"))
        both = members.select("id", "checksum").join(keyed, "id").join(named, "checksum", "left")
        if clash := [r.checksum for r in both.where("listed is not null and side <> 'train' and listed <> side").orderBy("checksum").take(20)]:
            raise CatalogError(f"listed on another side than the key gives: {clash}")
        return both.select("id", F.coalesce("listed", "side").alias("side"))


def torn_bytes(sided: DataFrame) -> DataFrame:
    """(checksum, sides) of the bytes of (checksum, side) that stand on more than one side."""
    return sided.groupBy("checksum").agg(F.countDistinct("side").alias("sides")).where("sides > 1")


def groups_cut(sided: DataFrame) -> DataFrame:
    """(cut): how many groups of (grp, side) have more than one side; null groups are none."""
    return sided.where("grp is not null").groupBy("grp").agg(F.countDistinct("side").alias("sides")).agg(F.count_if(F.col("sides") > 1).alias("cut"))


def features(members: DataFrame, declared: dict[str, tuple[str, str]], samples: DataFrame, annotations: DataFrame, label_sets: DataFrame) -> DataFrame:
    """Members with one column per declared feature, name -> (source, ref): of ``metadata`` the value at a key, of ``label_set`` the current answer's value; absent is null."""
    out = members
    meta = {name: ref for name, (source, ref) in declared.items() if source == "metadata"}
    if meta:
        picked = samples.select("id", *[F.get_json_object("metadata", f"$['{ref}']").alias(name) for name, ref in meta.items()])
        out = out.join(picked, "id", "left")
    if wrong := [name for name, (source, _) in declared.items() if source not in ("metadata", "label_set")]:
        raise CatalogError(f"features {wrong} are of no known source")
    refs = {name: ref for name, (source, ref) in declared.items() if source == "label_set"}
    if refs:
        # one pass over the answers for all label sets
        sets = label_sets.where(F.col("name").isin(*set(refs.values()))).select(F.col("id").alias("label_set_id"), F.col("name").alias("set_name"))
        rows = annotations.where("superseded_at is null and state = 'annotated'").join(F.broadcast(sets), "label_set_id")
        said = rows.groupBy(F.col("sample_id").alias("id")).agg(*[F.max_by(F.when(F.col("set_name") == ref, F.col("value")), F.when(F.col("set_name") == ref, F.col("id"))).alias(name) for name, ref in refs.items()])
        out = out.join(said, "id", "left")
    return out


def settle_inputs(origins: DataFrame, option: str) -> tuple[DataFrame, DataFrame]:
    """Of origins (id, sample_id, input): (sample_id, input, inputs) with the first input of each sample, and the samples that stay.

    Inputs are compared up to white space. ``drop`` takes out samples whose inputs disagree, ``first`` keeps them.
    """
    if option not in ("drop", "first"):
        raise CatalogError(f"disagreeing inputs: drop or first, not {option!r}")
    canonical = F.trim(F.regexp_replace("input", r"\s+", " "))
    settled = origins.groupBy("sample_id").agg(F.min_by("input", "id").alias("input"), F.countDistinct(canonical).alias("inputs"))
    kept = settled if option == "first" else settled.where("inputs <= 1")
    return settled, kept.select("sample_id", "input")


def combine(origins: DataFrame) -> DataFrame:
    """(sample_id, metadata): origins (id, sample_id, metadata json) folded key by key, the first value of the least origin id winning; null values count as values."""
    pairs = origins.where("metadata is not null").select("sample_id", "id", "metadata", F.explode(F.json_object_keys("metadata")).alias("key"))
    value = F.call_function("get_json_object", F.col("metadata"), F.concat(F.lit("$['"), F.col("key"), F.lit("']")))
    first = pairs.withColumn("value", value).groupBy("sample_id", "key").agg(F.min_by("value", "id").alias("value"))
    return first.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
