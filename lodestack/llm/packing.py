"""Problem 7: filling fixed-capacity containers with items.

Method: vector bin packing by the dot-product heuristic. An item is a vector of tokens, one segment, and loss-bearing tokens (all but those of its first
line, which stands for the prompt); a container has a limit in each. The item placed next in an open container is the one whose
vector has the largest dot product with what the container has left, each dimension weighted by how scarce it is, among those that fit in all three.

Documents longer than a container are cut into full containers and a rest, which is packed as an item. Items are dealt to packing tasks by a hash, so that every task
sees a like mix of sizes; a task works on a histogram of item vectors, so its heuristic costs by distinct sizes, and closes the containers
that are full enough in a dimension. What is left in badly filled containers is dealt again, to fewer tasks, as long as each round closes at least half of
its items; what does not fill containers any better stays in those it has. So no task ever gets more than ``shard`` items.

Defined results
* Null and empty texts have no tokens and get no container. A repeated doc_id with the same text counts once; with another text it is an item of its own.
* Repeated or non-positive capacities count once or not at all. Empty tables give an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut

#: most segments of a container, per token of capacity: 5 in 512, 21 in 2048, 85 in 8192
SEGMENTS = 1 / 96
#: most loss-bearing tokens of a container, per token of capacity, so that prompts hold a share; an item that alone has more gets a container of its own
LOSS = 0.95
#: a container filled to this share is closed in its round
FULL = 0.99
#: items of one packing task
SHARD = 20_000


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    return "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, tokens, loss) of every document with a token. The driver reads the tokenizer's file, a fixed few MB, and sends it to the executors."""
    held = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")).where("doc_id is not null and text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            heads = [t.partition("\n")[0] if "\n" in t else "" for t in texts]
            tokens = np.array([len(encoding.encode_ordinary(t)) for t in texts], np.int64)
            prompt = np.array([len(encoding.encode_ordinary(h)) if h else 0 for h in heads], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(np.maximum(tokens - prompt, 0)), batch.column(2)], ["doc_id", "tokens", "loss", "h"])

    counted = docs.mapInArrow(run, "doc_id bigint, tokens bigint, loss bigint, h bigint")
    return counted.where("tokens > 0").distinct().drop("h")


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Container number of every item, and how full each container is: the largest share used of its three limits. No item may exceed the capacity.

    Items of one (tokens, loss) are alike and wait in one stack. A container opens with the largest item left and is filled with
    whatever fits and has the largest dot product with the room left, until nothing fits.
    """
    vectors, stack_of = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    stack_of = stack_of.ravel()
    order = np.argsort(stack_of, kind="stable")
    ends = np.cumsum(np.bincount(stack_of, minlength=len(vectors)))
    left = np.diff(np.concatenate([[0], ends]))
    size, weighs = vectors[:, 0], vectors[:, 1]
    capacity, most, most_loss = limits
    # how scarce a dimension is: the containers that all items would fill in it alone
    scarce = np.array([tokens.sum() / capacity, len(tokens) / most, loss.sum() / most_loss])
    scarce = scarce / max(scarce.max(initial=0), 1e-9)
    # an item's product with the room left: a sum over the dimensions of weight, the item's share of the limit and the share left
    by_size, by_seat, by_loss = scarce[0] * size / capacity**2, scarce[1] / most**2, scarce[2] * weighs / most_loss**2
    container = np.full(len(tokens), -1, np.int64)
    fills = []
    top = len(vectors)
    while True:
        while top and not left[top - 1]:
            top -= 1
        if not top:
            return container, np.array(fills, np.float64)
        room, seats, room_loss = capacity, most, most_loss
        pick = top - 1
        while True:
            ends[pick] -= 1
            left[pick] -= 1
            container[order[ends[pick]]] = len(fills)
            room, seats, room_loss = room - int(size[pick]), seats - 1, room_loss - int(weighs[pick])
            if not seats or room <= 0:
                break
            fit = int(np.searchsorted(size[:top], room, side="right"))
            if not fit:
                break
            score = np.where((left[:fit] > 0) & (weighs[:fit] <= room_loss), by_size[:fit] * room + by_seat * seats + by_loss[:fit] * room_loss, -1.0)
            pick = int(score.argmax())
            if score[pick] < 0:
                break
        fills.append(max(1 - room / capacity, 1 - seats / most, 1 - room_loss / most_loss))


def _limits(capacity: int, segments: float, loss: float) -> tuple[int, int, int]:
    return capacity, max(1, int(capacity * segments)), max(1, int(capacity * loss))


def _packer(segments: float, loss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (capacity, shard, item, tokens, loss) ordered by the first two -> the same with box, and whether the box is full."""
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            capacity, shard = table["capacity"][0].as_py(), table["shard"][0].as_py()
            box, fills = pack(table["tokens"].to_numpy(), table["loss"].to_numpy(), _limits(capacity, segments, loss))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(box), capacity)), table["doc_id"].combine_chunks(), table["part"].combine_chunks(), table["tokens"].combine_chunks(), table["loss"].combine_chunks(),
                 pa.array(np.full(len(box), shard)), pa.array(box), pa.array(fills[box] >= FULL)],
                ["capacity", "doc_id", "part", "tokens", "loss", "shard", "box", "full"],
            )

        for batch in batches:
            at = 0
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k in range(1, len(keys) + 1):
                if held and (held[-1]["capacity"][0].as_py(), held[-1]["shard"][0].as_py()) != keys[at]:
                    yield solve()
                    held.clear()
                if k == len(keys) or keys[k] != keys[at]:
                    held.append(batch.slice(at, k - at))
                    at = k
        if held:
            yield solve()

    return run


def packed(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, shard: int = SHARD, segments: float = SEGMENTS, loss: float = LOSS) -> DataFrame:
    """(capacity, container, doc_id, part, tokens, loss): the container of every document, or of each of its parts if it exceeds the capacity.

    ``container`` is unique within a capacity; ``part`` counts from 0. ``segments`` and ``loss`` are the limits on documents and loss-bearing tokens in a
    container, per token of its capacity.
    """
    return pack_items(token_counts(documents, tokenizer or default_tokenizer()), targets, shard, segments, loss)


def pack_items(counts: DataFrame, targets: DataFrame, shard: int = SHARD, segments: float = SEGMENTS, loss: float = LOSS) -> DataFrame:
    """``packed`` for documents (doc_id, tokens, loss) that are counted already."""
    counted = cut(counts)
    sizes = sorted({r.capacity for r in targets.where("capacity > 0").select(F.col("capacity").cast("bigint").alias("capacity")).toLocalIterator()})
    every = F.array(*map(F.lit, sizes)).cast("array<bigint>")
    # a document past the capacity fills floor(tokens / capacity) containers; of its loss every part bears its share
    items = counted.withColumn("capacity", F.explode(every)).withColumn("whole", F.expr("tokens div capacity")).withColumn("rest", F.expr("tokens % capacity"))
    full = items.where("whole > 0 and tokens > capacity or rest = 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)))
    full = full.select("capacity", F.concat_ws("-", F.lit("full"), "doc_id", "tokens", "loss", "part").alias("container"), "doc_id", "part", F.col("capacity").alias("tokens"),
                       F.least("capacity", F.expr("loss * capacity div tokens")).alias("loss"))
    rest = items.where("rest > 0").select("capacity", "doc_id", F.col("whole").cast("int").alias("part"), F.col("rest").alias("tokens"), F.expr("least(rest, loss * rest div tokens)").alias("loss"))

    left = cut(rest)
    out, step = full, 0
    count = left.count()
    while count:
        shards = max(1, -(-count // shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", F.lit(step)), F.lit(shards)).cast("bigint"))
        dealt = dealt.select("capacity", "shard", "doc_id", "part", "tokens", "loss")
        boxed = dealt.repartition("capacity", "shard").sortWithinPartitions("capacity", "shard", "doc_id", "part", "tokens").mapInArrow(
            _packer(segments, loss), "capacity bigint, doc_id bigint, part int, tokens bigint, loss bigint, shard bigint, box bigint, full boolean"
        )
        boxed = cut(boxed)
        open_ = boxed.where("not full").count()
        # a rest that more tasks would not fill better stays where it is
        last = shards == 1 or open_ > count // 2
        placed = boxed if last else boxed.where("full")
        out = out.unionByName(placed.select("capacity", F.concat_ws("-", F.lit(str(step)), "shard", "box").alias("container"), "doc_id", "part", "tokens", "loss"))
        if last:
            break
        left, count = boxed.where("not full").select("capacity", "doc_id", "part", "tokens", "loss"), open_
        step += 1
    return out


def report(boxes: DataFrame) -> DataFrame:
    """(capacity, containers, items, tokens, fill, most_items, most_loss): how well each capacity was used, and the most items and loss-bearing tokens in a container of several items."""
    by = boxes.groupBy("capacity", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))
    return by.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("items").alias("most_items"), F.max(F.when(F.col("items") > 1, F.col("loss"))).alias("most_loss")
    ).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def conserved(boxes: DataFrame, segments: float = SEGMENTS, loss: float = LOSS) -> DataFrame:
    """(capacity, documents, over): documents in containers, and containers beyond a limit: of tokens, or, where several items lie in one, of segments or loss."""
    by = boxes.groupBy("capacity", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))
    several = (F.col("items") > F.greatest(F.lit(1), F.floor(F.col("capacity") * segments))) | (F.col("loss") > F.greatest(F.lit(1), F.floor(F.col("capacity") * loss)))
    over = by.groupBy("capacity").agg(F.count_if((F.col("tokens") > F.col("capacity")) | ((F.col("items") > 1) & several)).alias("over"))
    return boxes.groupBy("capacity").agg(F.countDistinct("doc_id").alias("documents")).join(over, "capacity")
