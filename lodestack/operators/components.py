"""Connected components by distributed union-find.

Every task builds a forest over the edges it happens to hold and forwards only (node, local root). Nodes
that got different roots in different tasks become the edges of a much smaller graph over roots. While that is more than one task
should hold, it is contracted in rounds, each of which takes away a share of its nodes, so their number grows with the logarithm
of the edges; the rounds are then unwound by joins. No task holds more than a chunk of edges, and nothing but the edge count of
each round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut

#: Edges of one local forest; also the size up to which a whole level is contracted by a single task.
CHUNK = 400_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a[i], b[i]) and, for each, the least node of its component."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # hook the larger root of every edge under the smaller, then halve all paths until they are stars
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = lo < hi
        if not open_.any():
            return nodes, nodes[root]
        x, y = x[open_], y[open_]
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def flush() -> pa.RecordBatch:
        a = np.concatenate([h[0] for h in held])
        b = np.concatenate([h[1] for h in held])
        node, label = local_roots(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of ``edges``, an undirected edge list of two bigint columns.

    The two columns are taken by position. Edges with a null end are no edges; loops make a node its own
    root; repeated edges change nothing; an empty input gives an empty result. ``root`` is the least
    node of the component.
    """
    a, b = (F.col(f"`{c}`").cast("bigint") for c in edges.columns[:2])
    pairs = edges.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    forest = pairs.mapInArrow(_forest, "node bigint, label bigint")
    nodes = cut(forest.groupBy("node").agg(F.min("label").alias("m"), F.collect_set("label").alias("labels")))
    torn = nodes.where(F.size("labels") > 1)
    rest = cut(torn.select(F.explode("labels").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    left = rest.count()
    if not left:
        return nodes.select("node", F.col("m").alias("root"))
    upper = _contracted(rest, left, chunk)
    return nodes.join(upper.select(F.col("node").alias("m"), F.col("root").alias("r")), "m", "left").select(
        "node", F.coalesce("r", "m").alias("root")
    )


def contraction(pairs: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """One round: (node, to) for every node, and the distinct edges (a, b) left between the nodes gone to.

    Every node goes to the one of itself and its neighbours that a hash drawn anew for the round puts first. So a fixed share of the
    nodes is expected to go, whatever the order of their ids, also on a chain in ascending order.
    """

    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("v"))

    both = pairs.union(pairs.select("b", "a"))
    first = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("n"))
    gone = cut(first.select(F.col("a").alias("node"), F.col("n.v").alias("to")))
    left = pairs.join(gone.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(gone.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
    return gone, cut(left.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def _contracted(pairs: DataFrame, left: int, chunk: int) -> DataFrame:
    """(node, root) of edges between roots of local forests: rounds of contraction until one task can hold what is left."""
    rounds = []
    while left > chunk:
        gone, pairs = contraction(pairs, len(rounds))
        rounds.append(gone)
        left = pairs.count()
    found = pairs.coalesce(1).mapInArrow(_forest, "node bigint, label bigint").withColumnRenamed("label", "root")
    if not rounds:
        return found
    for gone in reversed(rounds):
        above = found.select(F.col("node").alias("to"), "root")
        found = cut(gone.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
