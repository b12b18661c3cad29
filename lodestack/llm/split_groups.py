"""Problem 4: splits that keep related records together.

Method: distributed union-find with local forests merged hierarchically (operators.components), then
greedy largest-first assignment of groups to the split furthest below its target.

Defined results
* A key that is null, missing, empty, a placeholder, or neither a string, number nor list relates nothing.
* A list relates by each of its elements; nested lists and objects in it relate nothing.
* Repeated rows of one entry count once; an empty table gives empty results.
* A version without ratios puts everything on train; ratios below 0 count as 0.
* Ties go to the earlier of train, val, holdout; equally large groups are ordered by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestack.operators.components import components
from lodestack.session import cut

#: fixed values: the metadata keys that relate entries, and the values that stand for "not known"
RELATING_KEYS = ("author", "source_file", "entity")
PLACEHOLDERS = ("", "unknown", "n/a")

_TOP = 1 << 62


def _clean(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", ""))


def key_values(metadata: Column, key: str) -> Column:
    """The cleaned values of ``key`` in a JSON object: one for a scalar, one per element for a list."""
    raw = F.get_json_object(metadata, f"$['{key}']")
    many = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    values = F.coalesce(many, F.when(raw.startswith("{"), F.array().cast("array<string>")), F.array(raw))
    cleaned = F.transform(F.filter(values, lambda x: x.isNotNull()), _clean)
    return F.array_distinct(F.filter(cleaned, lambda x: ~x.isin(*PLACEHOLDERS)))


def related_edges(entries: DataFrame, keys: tuple[str, ...] = RELATING_KEYS) -> DataFrame:
    """Edges (entry_id, node) from every entry to a node for each (dataset, key, value) it carries.

    The nodes lie above 2**62 (a 62-bit hash), so that the least node of a component is an entry. A value
    held by a third of all entries is no hot key: its edges stay where they are read, and each task
    contracts its own share.
    """

    def tagged(key: str) -> Column:
        return F.transform(key_values(F.col("metadata"), key), lambda v: F.struct(F.lit(key).alias("k"), v.alias("v")))

    values = F.concat(*[F.coalesce(tagged(k), F.array().cast("array<struct<k:string,v:string>>")) for k in keys])
    exploded = entries.select("entry_id", "dataset_id", F.explode(values).alias("kv"))
    node = F.xxhash64("dataset_id", "kv.k", "kv.v").bitwiseAND(F.lit(_TOP - 1)).bitwiseOR(F.lit(_TOP))
    return exploded.select("entry_id", node.alias("node"))


def groups(entries: DataFrame) -> DataFrame:
    """(entry_id, group_id) of every entry that carries any relating value; group_id is the least entry of its group."""
    found = components(related_edges(entries))
    return found.where(F.col("node") < _TOP).select(F.col("node").alias("entry_id"), F.col("root").alias("group_id"))


def related(entries: DataFrame) -> DataFrame:
    """Entries related to another, with their group."""
    every = cut(groups(entries))
    shared = every.groupBy("group_id").count().where("count > 1").select("group_id")
    return every.join(shared, "group_id").select("entry_id", "group_id")


SIDES = ("train", "val", "holdout")


def _fill(lack: list[float], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each side gets when every next group goes where most is lacking."""
    took = [0] * len(lack)
    while count:
        if count > 64:
            # all sides drop to one level in one stride; the last few are dealt one by one below
            top = sorted(range(len(lack)), key=lambda i: -lack[i])
            for k in range(1, len(top) + 1):
                level = (sum(lack[i] for i in top[:k]) - size * (count - 2 * len(lack))) / k
                if k == len(top) or level >= lack[top[k]]:
                    break
            stride = [max(0, int((lack[i] - level) // size)) if i in top[:k] else 0 for i in range(len(lack))]
            if 0 < sum(stride) <= count:
                for i, n in enumerate(stride):
                    took[i] += n
                    lack[i] -= n * size
                    count -= n
                continue
        best = max(range(len(lack)), key=lambda i: (lack[i], -i))
        took[best] += 1
        lack[best] -= size
        count -= 1
    return took


def assign(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset_id, entry_id, group_id, side): every entry of every version on one side with its relatives.

    Groups are dealt largest first to the side furthest below its target. Groups of one size are alike to
    that rule, so the driver deals from the histogram (dataset, size, number of groups) only, whose length is
    at most the root of twice the entries, and each group finds its side by its rank among its size. The rank is counted per
    range partition, so no window spans more than one partition.
    """
    spark = entries.sparkSession
    rows = entries.where("entry_id is not null").groupBy("entry_id").agg(F.min("dataset_id").alias("dataset_id"))
    found = cut(
        rows.join(groups(entries), "entry_id", "left").select("dataset_id", "entry_id", F.coalesce("group_id", "entry_id").alias("group_id"))
    )
    seeds = versions.select(F.col("id").alias("dataset_id"), F.coalesce("seed", F.lit(0)).alias("seed"), "val_ratio", "holdout_ratio")
    sizes = found.groupBy("dataset_id", "group_id").agg(F.count("*").alias("size"))
    placed = sizes.join(seeds.select("dataset_id", "seed"), "dataset_id", "left").withColumn("h", F.xxhash64("group_id", F.coalesce("seed", F.lit(0))))
    ranged = cut(placed.repartitionByRange("dataset_id", "size", "h", "group_id").withColumn("part", F.spark_partition_id()).drop("seed"))
    counts = ranged.groupBy("dataset_id", "size", "part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("dataset_id", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    ratios = {r.dataset_id: (r.val_ratio, r.holdout_ratio) for r in seeds.collect()}
    histogram: dict[int, list[tuple[int, int]]] = {}
    for r in counts.groupBy("dataset_id", "size").agg(F.sum("count").alias("n")).collect():
        histogram.setdefault(r.dataset_id, []).append((r["size"], r.n))
    cuts = []
    for dataset, sized in histogram.items():
        total = sum(s * n for s, n in sized)
        val, hold = (max(0.0, x or 0.0) for x in ratios.get(dataset, (0.0, 0.0)))
        lack = [total * max(0.0, 1 - val - hold), total * val, total * hold]
        for size, n in sorted(sized, reverse=True):
            took, at = _fill(lack, size, n), 0
            for side, k in zip(SIDES, took):
                if k:
                    cuts.append((dataset, size, at, at + k, side))
                at += k
    ranges = spark.createDataFrame(cuts, "dataset_id bigint, size bigint, lo bigint, hi bigint, side string")
    within = F.row_number().over(W.partitionBy("dataset_id", "size", "part").orderBy("h", "group_id"))
    ranked = ranged.withColumn("rank", within).join(before.drop("count"), ["dataset_id", "size", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before") - 1)
    sided = ranked.join(ranges, ["dataset_id", "size"]).where("rank >= lo and rank < hi")
    return found.join(sided.select("dataset_id", "group_id", "side"), ["dataset_id", "group_id"])
