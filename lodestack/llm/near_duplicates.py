"""Problem 6: near-duplicate records with small edits.

Method: BK-trees over codes of the texts. Texts that share a code block meet in that block's shard; the shard's tree
holds children keyed by their integer Hamming distance to the parent, and every member follows only the edges within the
radius. What a tree finds is verified on the whole texts and joined by distributed union-find.

A crowded block is taken in two rounds. First every member is linked to the first tree node in its radius, against a tree of at most ``TREE`` nodes;
a block of more than ``SPREAD`` members is spread over several tasks. Those links are verified and joined. A block whose members are then one group is done. In one with
several groups the members of its largest stand in trees of ``TREE`` nodes, now by codes of one byte per hash, whose distances let a tree leave out a whole family of texts.
The others visit them unless they are too far from the whole group, and meet each other in finer blocks, of one or two more code blocks that they share; what is
crowded even there meets in trees again. A visitor is first compared with the nearest of each group, and where that joins nothing, with all in the radius. So a family of copies and edits, or a passage
that many different texts share, were it in a third of all rows, costs in proportion to its rows, and no link between groups is lost.

Defined results
* Null texts are alike to nothing; equal texts, the empty text too, are alike. Texts of fewer than three words are alike only if equal.
* Repeated rows of a sample count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestack.llm.fingerprints import ALIKE, HASHES, RADIUS, classes, hot_blocks, symbols, verified
from lodestack.operators.components import components
from lodestack.session import cut

CROWD = 64
TREE = 4096
#: places of ``HASHES`` in which texts at the threshold differ, 51 on average, and 4.5 deviations above
SYMBOL_RADIUS = 76
#: nearest nodes of each group that a visitor is compared with at first
NEAREST = 4
#: further code blocks by which crowded blocks are made finer before trees take the rest
FINER = 2
#: pairs that a task holds before it hands them on
PAIRS = 100_000


def bits_apart(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def symbols_apart(a: int, b: int) -> int:
    """How many of the ``HASHES`` bytes of two codes differ."""
    return HASHES - (a ^ b).to_bytes(HASHES, "little").count(0)


class BKTree:
    """Codes as integers; a node's children are keyed by their distance to it, equal codes share a node."""

    def __init__(self, apart: Callable[[int, int], int] = bits_apart) -> None:
        self.apart = apart
        self.codes: list[int] = []
        self.numbers: list[list[int]] = []
        self.children: list[dict[int, int]] = []
        self.size = self.visited = 0

    def __len__(self) -> int:
        return self.size

    def add(self, code: int) -> None:
        """Add a code as number len(self)."""
        at, distance = 0, -1
        while at < len(self.codes) and (distance := self.apart(self.codes[at], code)):
            at = self.children[at].setdefault(distance, len(self.codes))
        if at == len(self.codes):
            self.codes.append(code)
            self.numbers.append([])
            self.children.append({})
        self.numbers[at].append(self.size)
        self.size += 1

    def near(self, code: int, radius: int) -> Iterator[tuple[int, int]]:
        """(distance, number) of all codes within the radius of ``code``."""
        stack = [0] if self.codes else []
        while stack:
            at = stack.pop()
            self.visited += 1
            distance = self.apart(self.codes[at], code)
            if distance <= radius:
                for number in self.numbers[at]:
                    yield distance, number
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)

    def within(self, code: int, radius: int) -> Iterator[int]:
        return (number for _, number in self.near(code, radius))


def _codes(batch: pa.RecordBatch) -> list[int]:
    high, low = (batch.column(batch.schema.get_field_index(n)).to_numpy().view(np.uint64).tolist() for n in ("f1", "f2"))
    return [(a << 64) | b for a, b in zip(high, low)]


def _pairs(a: list[int], b: list[int], crowded: list[int]) -> pa.RecordBatch:
    rows = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a + crowded, pa.int64()), pa.array(b + [None] * len(crowded), pa.int64())], ["a", "b"]
    ) if rows or crowded else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])


def _first_round(radius: int):
    """Rows (key, rep, f1, f2, part) ordered by key and part -> candidate pairs; (key, null) for a crowded key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, at, size = BKTree(), [], None, 0
        for batch in batches:
            keys, reps, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy()
            same = (keys[1:] == keys[:-1]) & (parts[1:] == parts[:-1])
            same_before = np.concatenate([[len(keys) > 0 and at == (keys[0], parts[0])], same])
            same_after = np.append(same, True)  # the last block may go on in the next batch
            a, b, crowded = [], [], []
            busy = np.flatnonzero(same_before | same_after)
            part = batch.take(pa.array(busy))
            for key, rep, code, own in zip(keys[busy].tolist(), reps[busy].tolist(), _codes(part), parts[busy].tolist()):
                if (key, own) != at:
                    tree, ids, at, size = BKTree(), [], (key, own), 0
                size += 1
                if size == CROWD + 1:
                    crowded.append(key)
                for node in tree.within(code, radius):
                    if ids[node] != rep:
                        a.append(ids[node])
                        b.append(rep)
                        if size > CROWD:
                            break
                if len(tree) < TREE:
                    tree.add(code)
                    ids.append(rep)
                if len(a) > PAIRS:
                    yield _pairs(a, b, [])
                    a, b = [], []
            yield _pairs(a, b, crowded)

    return run


def _second_round(radius: int, nearest: int | None):
    """Rows (key, part, node, visits, rep, label, code) ordered by key, part, nodes first -> pairs of different labels.

    ``nearest`` is how many nodes of each label a visitor is paired with, all in the radius if None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, labels, at = BKTree(symbols_apart), [], [], None
        for batch in batches:
            keys, parts, node, visits, reps, label, codes = (batch.column(k).to_pylist() for k in range(7))
            a, b = [], []
            for key, part, holds, goes, rep, lab, raw in zip(keys, parts, node, visits, reps, label, codes):
                if (key, part) != at:
                    tree, ids, labels, at = BKTree(symbols_apart), [], [], (key, part)
                code = int.from_bytes(raw, "little")
                if goes:
                    taken: dict[int, int] = {}
                    hits = tree.near(code, radius)
                    for _, number in hits if nearest is None else sorted(hits):
                        other = labels[number]
                        if other != lab and (nearest is None or taken.setdefault(other, 0) < nearest):
                            if nearest is not None:
                                taken[other] += 1
                            a.append(ids[number])
                            b.append(rep)
                if holds:
                    tree.add(code)
                    ids.append(rep)
                    labels.append(lab)
                if len(a) > PAIRS:
                    yield _pairs(a, b, [])
                    a, b = [], []
            yield _pairs(a, b, [])

    return run


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(symbols(part.column(1).to_pylist()), pa.binary())], ["rep", "code"])


@F.pandas_udf(IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([symbols_apart(int.from_bytes(x, "little"), int.from_bytes(y, "little")) for x, y in zip(a, b)], dtype="int32")


def _torn(rows: DataFrame) -> DataFrame:
    """Members (key, rep, label) of those blocks that have several labels, with the label of most (main) and how many have it."""
    by = rows.groupBy("key", "label").count()
    torn = by.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("held"), F.sum("count").alias("members"), F.count("*").alias("labels"))
    return rows.join(torn.where("labels > 1").drop("labels"), "key")


def _walk(rows: DataFrame, nearest: int | None, nodes: str) -> DataFrame:
    """Pairs of different labels that trees find for rows (key, rep, label, main, code): all but those of the main label visit every tree of their block.

    ``nodes`` is the column that counts a block's nodes: with ``held`` members of the main label alone, with ``members`` all.
    """
    parts = F.ceil(F.col(nodes) / TREE).cast("int")
    home = F.pmod(F.xxhash64("rep"), parts).cast("int")
    main = F.col("label") == F.col("main")
    spread = rows.withColumn("home", home).withColumn("part", F.explode(F.when(main, F.array("home")).otherwise(F.sequence(F.lit(0), parts - 1))))
    node = (F.col("home") == F.col("part")) & (main | F.lit(nodes == "members"))
    spread = spread.select("key", "part", node.alias("node"), (~main).alias("visits"), "rep", "label", "code")
    # nodes of the main label first; visitors that are nodes too meet those behind them
    ordered = spread.repartition("key", "part").sortWithinPartitions("key", "part", "visits", F.desc("node"), "rep")
    return ordered.mapInArrow(_second_round(SYMBOL_RADIUS, nearest), "a bigint, b bigint").where("b is not null")


def _across(codes: DataFrame, crowded: DataFrame, links: DataFrame, samples: DataFrame, radius: int, nearest: int | None, rest: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Candidate pairs (a, b) of different groups of the links in crowded blocks (key), None if every such block is one group; and what is crowded in finer blocks too.

    With all in the radius (``nearest`` None) the finer blocks are left out, as they have been paired in full, but for that ``rest`` (key, rep) of them.
    """
    label = cut(components(links).select(F.col("node").alias("rep"), "root"))
    members = codes.select(F.explode("keys").alias("key"), "rep").join(crowded, "key").join(label, "rep", "left")
    rows = cut(_torn(cut(members.select("key", "rep", F.coalesce("root", "rep").alias("label")))))
    if not rows.take(1):
        return None, None
    ids = rows.select(F.col("rep").alias("id")).distinct()
    texts = samples.select(F.col("id").cast("bigint").alias("id"), "text").where("text is not null").join(ids, "id", "left_semi").dropDuplicates(["id"])
    coded = cut(texts.mapInArrow(_symbol_rows, "rep bigint, code binary"))

    # the largest group of a block against all others: who is further from its first member than the radius and the group's own reach visits no tree
    placed = rows.join(coded, "rep")
    pivot = placed.where("label = main").groupBy("key").agg(F.min_by("code", "rep").alias("pivot"))
    placed = cut(placed.join(pivot, "key").withColumn("far", _apart("code", "pivot")).drop("pivot"))
    reach = placed.where("label = main").groupBy("key").agg(F.max("far").alias("reach"))
    near = placed.join(reach, "key").where((F.col("label") == F.col("main")) | (F.col("far") - F.col("reach") <= SYMBOL_RADIUS))
    found = [_walk(near, nearest, "held")]

    # all others among themselves: in finer blocks, of one or two code blocks more that they share
    finer = rows.where("label <> main").select("key", "rep", "label", F.array("key").alias("used"))
    for _ in range(FINER if nearest is not None else 0):
        more = finer.join(codes.select("rep", "keys", "f1", "f2"), "rep").withColumn("next", F.explode(F.array_except("keys", "used")))
        more = more.select(F.xxhash64("key", "next").alias("key"), "rep", "label", F.concat("used", F.array("next")).alias("used"), "f1", "f2")
        more = cut(more.join(more.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n"), "key"))
        usual = more.where(F.col("n") <= CROWD).select("key", "rep", "f1", "f2", F.lit(0).alias("part"))
        found.append(usual.repartition("key").sortWithinPartitions("key").mapInArrow(_first_round(radius), "a bigint, b bigint").where("b is not null"))
        finer = more.where(F.col("n") > CROWD).select("key", "rep", "label", "used")
        if not finer.take(1):
            break
    else:
        rest = finer.select("key", "rep") if nearest is not None else rest
    if rest is not None:
        again = rest.join(label, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("label"))
        found.append(_walk(_torn(again).join(coded, "rep"), nearest, "members"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), rest


def alike_groups(samples: DataFrame, least: float = ALIKE, radius: int = RADIUS, also: DataFrame | None = None) -> DataFrame:
    """(id, group_id) of every row of (id, text) alike to another, with the least id of its group.

    ``also`` holds further links (a, b) between ids, with or without text.
    """
    members, codes = classes(samples)
    members, codes = cut(members), cut(codes)
    blocks = codes.select(F.explode("keys").alias("key"), "rep", "f1", "f2")
    hot = hot_blocks(codes)
    dealt = blocks.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(0)).cast("int")).drop("parts") if hot.take(1) else blocks.withColumn("part", F.lit(0))
    raw = cut(dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_first_round(radius), "a bigint, b bigint"))
    order = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = cut(verified(raw.where("b is not null").select(*order).distinct(), samples, least))

    crowded = raw.where("b is null").select(F.col("a").alias("key")).union(hot.select("key")).distinct()
    if crowded.take(1):
        crowded, tried, rest = cut(crowded), None, None
        for nearest in (NEAREST, None):
            pairs, rest = _across(codes, crowded, links, samples, radius, nearest, rest)
            if pairs is None:
                break
            new = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
            links, tried = cut(links.union(verified(new, samples, least))), pairs

    if also is not None:
        # ends without text stand for themselves
        rep = members.select(F.col("id"), "rep")
        ends = also.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null")
        named = ends.join(rep.withColumnRenamed("id", "a").withColumnRenamed("rep", "x"), "a", "left").join(rep.withColumnRenamed("id", "b").withColumnRenamed("rep", "y"), "b", "left")
        links = links.union(cut(named.select(F.coalesce("x", "a"), F.coalesce("y", "b"))))
        alone = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(rep.select("id"), "id", "left_anti")
        members = members.union(alone.select("id", F.col("id").alias("rep")))
    joined = components(links).select(F.col("node").alias("rep"), "root")
    copies = members.groupBy("rep").count().where("count > 1").select("rep")
    grouped = members.join(joined, "rep", "left").join(copies.withColumn("copied", F.lit(True)), "rep", "left")
    return grouped.where("root is not null or copied").select("id", F.coalesce("root", "rep").alias("group_id"))


def equal_bytes(rows: DataFrame) -> DataFrame:
    """(a, b): links between samples (id, checksum) of equal bytes, each to the least id of them."""
    known = rows.where("id is not null and checksum is not null").select(F.col("id").cast("bigint").alias("a"), "checksum").distinct()
    least = known.groupBy("checksum").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    return known.join(least, "checksum").where("a <> b").select("a", "b")
