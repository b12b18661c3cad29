"""Problem 3: same or near-same records across splits.

Method: similarity-hash bit fingerprints. Each text's minwise code is segmented into blocks; blocks are joined across the
splits of a version, pairs within the Hamming radius of the sketch are kept and verified on the whole texts. Equal texts are one code, so copies do not multiply
the join. Texts of a block with more than ``SPREAD`` of them meet by their rarest triples instead: ordered from rare to frequent, two alike texts of n triples share one of the first
n - ceil(0.6 n) + 1 of either, so what many texts share brings none together unless it is most of a text, and no alike pair is lost. Triples that stay as crowded are joined where a text has
several, and train and held-out rows that share them meet once, in a grid of tasks.

Defined results
* The side of an entry is that of its metadata value at the version's key, as a string, compared exactly; missing and null are train.
* Versions without a usable given split have no sides. Entries without exported text overlap nothing.
* A pair is reported once per version, however often either sample was exported or listed; a sample on both sides of one version by
  repeated rows with different metadata is paired with others on either side, never with itself. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.fingerprints import ALIKE, RADIUS, SPREAD, classes, hot_blocks, verified
from lodestack.llm.rolling import triples
from lodestack.operators.components import components
from lodestack.session import cut


def sides(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset_id, sample_id, held, side) of the entries of all versions with a given split."""
    given = versions.where("given_split is not null").select(
        F.col("id").alias("dataset_id"),
        F.get_json_object("given_split", "$.key").alias("key"),
        F.from_json(F.get_json_object("given_split", "$.holdout"), "array<string>").alias("holdout"),
        F.from_json(F.get_json_object("given_split", "$.val"), "array<string>").alias("val"),
    )
    value = F.call_function("get_json_object", F.col("metadata"), F.concat(F.lit("$['"), F.col("key"), F.lit("']")))
    joined = entries.select("dataset_id", "sample_id", "metadata").join(given.where("key is not null"), "dataset_id")
    at = joined.withColumn("value", value)
    side = F.when(F.coalesce(F.array_contains("holdout", F.col("value")), F.lit(False)), "holdout").when(
        F.coalesce(F.array_contains("val", F.col("value")), F.lit(False)), "val"
    )
    return at.select("dataset_id", F.col("sample_id").cast("bigint").alias("sample_id"), F.coalesce(side, F.lit("train")).alias("side"))


def _triple_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, t, train, held, text) -> (rep, t, train, held, triple, n) per distinct triple of the n of a text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            codes, offsets = triples(part.column(4).to_pylist())
            sizes = np.diff(offsets)
            row = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            made = [pa.array(codes.view(np.int64)), pa.array(np.repeat(sizes, sizes).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(4)), *made], ["rep", "t", "train", "held", "triple", "n"])


def _rarest(crowd: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(key, rep): those triples of the texts (id, text) of a crowd (rep, train, held) by which every alike pair of a train and a held-out text meets."""
    known = texts.where("text is not null").withColumn("t", F.xxhash64("text")).dropDuplicates(["id", "t"])
    rows = known.join(crowd, known.id == crowd.rep).select("rep", "t", "train", "held", "text")
    rows = cut(rows.mapInArrow(_triple_rows, "rep bigint, t bigint, train boolean, held boolean, triple bigint, n int"))
    # a triple of one text or of one side joins none: it stands before all others in the order
    met = rows.groupBy("triple").agg(F.count("*").alias("c"), F.max("train").alias("train"), F.max("held").alias("held")).where("c > 1 and train and held").select("triple", "c")
    ordered = rows.join(met, "triple").groupBy("rep", "t").agg(F.sort_array(F.collect_list(F.struct("c", "triple"))).alias("met"), F.first("n").alias("n"))
    first = F.size("met") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    return ordered.withColumn("first", first).where("first > 0").select(F.explode(F.slice("met", F.lit(1), F.col("first"))["triple"]).alias("key"), "rep").distinct()


def overlaps(entries: DataFrame, versions: DataFrame, exported: DataFrame, least: float = ALIKE, radius: int = RADIUS) -> DataFrame:
    """(dataset_id, train_id, held_id, side): every pair of alike samples of a version, one on train and one held out."""
    placed = cut(sides(entries, versions).where("sample_id is not null").distinct())
    used = placed.select(F.col("sample_id").alias("id")).distinct()
    texts = exported.select(F.col("sample_id").cast("bigint").alias("id"), "text").join(used, "id", "left_semi")
    members, codes = classes(texts)
    members, codes = cut(members), cut(codes)
    located = placed.join(members, placed.sample_id == members.id).select("dataset_id", "sample_id", "side", "rep")
    located = cut(located)

    # the versions whose train, and whose held-out side, a text is on
    where = located.groupBy("rep").agg(
        F.collect_set(F.when(F.col("side") == "train", F.col("dataset_id"))).alias("train"), F.collect_set(F.when(F.col("side") != "train", F.col("dataset_id"))).alias("held")
    )
    placed_codes = cut(codes.join(where, "rep"))
    blocks = placed_codes.select(F.explode("keys").alias("key"), "rep", "f1", "f2", "train", "held")
    hot = hot_blocks(codes, SPREAD)
    grid = None
    if hot.take(1):
        crowd = blocks.join(hot.select("key"), "key", "left_semi").groupBy("rep").agg(F.max(F.size("train") > 0).alias("train"), F.max(F.size("held") > 0).alias("held"))
        keys = cut(_rarest(crowd, texts, least))
        many = keys.groupBy("key").count().where(F.col("count") > SPREAD).select("key")
        crowded = cut(keys.join(many, "key", "left_semi"))
        if crowded.take(1):
            # a text goes to one grid: crowded triples that it has together count as one
            least_of = crowded.groupBy("rep").agg(F.min("key").alias("a"))
            links = cut(crowded.join(least_of, "rep").where("a <> key").select("a", F.col("key").alias("b")).distinct())
            root = components(links).select(F.col("node").alias("key"), "root")
            one = crowded.join(root, "key", "left").select(F.coalesce("root", "key").alias("key"), "rep").distinct()
            keys = cut(keys.join(crowded.select("key").distinct(), "key", "left_anti").unionByName(one))
            grid = cut(keys.groupBy("key").count().where(F.col("count") > SPREAD).select("key", F.ceil(F.col("count") / SPREAD).cast("int").alias("parts")))
        blocks = blocks.join(hot.select("key"), "key", "left_anti").unionByName(keys.join(placed_codes, "rep").select(*blocks.columns))
    train = blocks.where(F.size("train") > 0).select("key", F.col("rep").alias("a"), F.col("f1").alias("a1"), F.col("f2").alias("a2"), "train")
    held = blocks.where(F.size("held") > 0).select("key", F.col("rep").alias("b"), F.col("f1").alias("b1"), F.col("f2").alias("b2"), "held")
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    meet = ["key"]
    if grid is not None:
        train = train.join(grid, "key", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        held = held.join(grid, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        meet = ["key", "part"]
    near = train.join(held, meet).where((F.col("a") != F.col("b")) & (apart <= radius) & F.arrays_overlap("train", "held"))
    pairs = cut(near.select("a", "b").distinct())
    alike = verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, least)
    equal = located.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = alike.union(alike.select("b", "a")).union(equal)

    left = located.where("side = 'train'").select("dataset_id", F.col("rep").alias("a"), F.col("sample_id").alias("train_id"))
    right = located.where("side <> 'train'").select("dataset_id", F.col("rep").alias("b"), F.col("sample_id").alias("held_id"), "side")
    return left.join(links, "a").join(right, ["dataset_id", "b"]).where("train_id <> held_id").select("dataset_id", "train_id", "held_id", "side")


def found(pairs: DataFrame) -> DataFrame:
    """(dataset_id, sample_a, sample_b) of the overlaps, sample_a < sample_b."""
    return pairs.select("dataset_id", F.least("train_id", "held_id").alias("sample_a"), F.greatest("train_id", "held_id").alias("sample_b")).distinct()


def report(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(dataset_id, side, source, pairs, held, train): overlaps per version, held-out side and the source (metadata collection) of the held-out sample."""
    source = entries.select("dataset_id", F.col("sample_id").cast("bigint").alias("held_id"), F.get_json_object("metadata", "$.collection").alias("source"))
    source = source.groupBy("dataset_id", "held_id").agg(F.min("source").alias("source"))
    return (
        pairs.join(source, ["dataset_id", "held_id"], "left")
        .groupBy("dataset_id", "side", "source")
        .agg(F.count("*").alias("pairs"), F.countDistinct("held_id").alias("held"), F.countDistinct("train_id").alias("train"))
    )
