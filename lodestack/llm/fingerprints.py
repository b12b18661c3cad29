"""Bit fingerprints of texts for similarity search: minwise codes over word triples, their blocks and their sketch.

``HASHES`` minwise values per text give two things. Blocks of ``ROWS`` values each are the segmented code
blocks by which texts meet: texts of Jaccard similarity J agree on a given block with probability J**ROWS, so of texts at the threshold 0.6 a
share of 1 - (1 - 0.6**3)**42 = 0.99996 meets, of texts at 0.7 all but 4e-8. One bit of each value makes the sketch of 128 bits: it differs
in (1 - J) / 2 of the bits on average, at J = 0.6 in 25.6 with a deviation of 4.5; ``RADIUS`` is 4.5 deviations above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rolling import WORD, mix, triples
from lodestack.session import cut

HASHES, ROWS = 128, 3
BLOCKS = HASHES // ROWS
RADIUS = 46
ALIKE = 0.6

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) | np.uint64(1)


def _minwise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a triple, and the ``HASHES`` minwise values of each of those, a row per hash."""
    codes, offsets = triples(texts)
    full = np.flatnonzero(np.diff(offsets))
    least = np.empty((HASHES, len(full)), np.uint64)
    for k in range(HASHES if len(full) else 0):
        least[k] = np.minimum.reduceat((codes ^ _SEEDS[k]) * _FACTORS[k], offsets[full])
    return full, mix(least)


def symbols(texts: list[str | None]) -> list[bytes]:
    """A byte of each minwise value: texts of similarity J differ in (1 - J) of the ``HASHES`` places; without triples all bytes are 0."""
    full, least = _minwise(texts)
    codes = np.zeros((len(texts), HASHES), np.uint8)
    codes[full] = (least & np.uint64(255)).astype(np.uint8).T
    return [row.tobytes() for row in codes]


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Block keys (a row of ``BLOCKS`` per text) and sketches (two 64-bit words per text); keys are all 0 where there is no triple."""
    full, least = _minwise(texts)
    keys = np.zeros((len(texts), BLOCKS), np.uint64)
    sketch = np.zeros((len(texts), 2), np.uint64)
    if len(full):
        for b in range(BLOCKS):
            key = np.full(len(full), b + 1, np.uint64)
            for row in least[b * ROWS : (b + 1) * ROWS]:
                key = mix(key ^ row)
            keys[full, b] = key | np.uint64(1)
        bits = (least & np.uint64(1)).astype(np.uint8)
        sketch[full] = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64)
    return keys, sketch


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys, sketch = fingerprints(part.column(3).to_pylist())
            has = keys[:, 0] != 0
            offsets = np.concatenate([[0], np.cumsum(np.where(has, BLOCKS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(sketch[:, 0].view(np.int64)), pa.array(sketch[:, 1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel().view(np.int64)))],
                ["id", "h1", "h2", "f1", "f2", "keys"],
            )


def classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (id, text): members (id, rep) by equal text, and codes (rep, f1, f2, keys) of each class; rep is the least id.

    Rows without id or text are left out; repeated rows count once.
    """
    rows = texts.where("id is not null and text is not null").select(
        F.col("id").cast("bigint").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.reverse("text")).alias("h2"), F.col("text").cast("string").alias("text")
    )
    coded = cut(rows.mapInArrow(_rows, "id bigint, h1 bigint, h2 bigint, f1 bigint, f2 bigint, keys array<bigint>"))
    least = coded.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = coded.join(least, ["h1", "h2"]).select("id", "rep", "f1", "f2", "keys")
    codes = members.where("id = rep").select("rep", "f1", "f2", "keys")
    return members.select("id", "rep").distinct(), codes


#: rows of a block that one task may get; blocks of more are spread
SPREAD = 100_000


def hot_blocks(codes: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(key, parts): the blocks of codes (rep, f1, f2, keys) with more than ``spread`` members, and over how many tasks to spread each.

    A block of that many has, by counting, its share of them in some task; so tasks name only the keys they see that often, and the
    few named are counted exactly.
    """
    tasks = max(1, codes.rdd.getNumPartitions())
    spread = max(spread, tasks)
    often = -(-spread // tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([seen, batch.column(0).flatten().to_numpy()])
            seen, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(keys) - len(counts), np.int64)]), len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen[counts >= often])], ["key"])

    named = codes.select("keys").mapInArrow(run, "key bigint").distinct()
    if not (named := cut(named)).take(1):
        return named.withColumn("parts", F.lit(1))
    counted = codes.select(F.explode("keys").alias("key")).join(named, "key").groupBy("key").count()
    return cut(counted.where(F.col("count") > spread).select("key", F.ceil(F.col("count") / spread).cast("int").alias("parts")))


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            a, b = (WORD.findall(t.lower()) for t in (x, y))
            a, b = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
            both = len(a & b)
            if x == y or both and both >= least * (len(a) + len(b) - both) - 1e-9:
                kept.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, least: float = ALIKE) -> DataFrame:
    """Those of the candidate pairs (a, b) whose texts are alike, by the triples of the whole texts.

    Only texts that occur in a pair move.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = texts.select(F.col("id").cast("bigint").alias("id"), "text").where("text is not null").join(ids, "id", "left_semi").dropDuplicates(["id"])
    held = cut(needed)
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lambda it: _alike(it, least), "a bigint, b bigint")
