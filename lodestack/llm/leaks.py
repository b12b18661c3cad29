"""Problem 8: evaluation texts leaking into training text.

Method: q-gram lemma filtering. Every stretch of ``words`` consecutive item words has at least ``n`` characters, so a copy
of it with at most ``edits`` character edits shares at least ``n + 1 - q (edits + 1)`` q-grams with it, all on diagonals
(document position less item position) that lie within ``edits`` of each other. Shared q-grams are counted in
overlapping diagonal bands, bands that meet the bound are kept, and banded alignment decides.

The item set is a stated query set: it is taken in blocks of at most ``BLOCK`` characters, each of which is one pass
over the documents, so what the driver holds and sends to the executors at once is bounded whatever the size of the set. With ``exact`` the
pairs found within the edits are kept only if they hold ``words`` consecutive words without any.

Defined results
* Null and empty documents or items hold nothing; an item of fewer than ``words`` words is never found.
* Repeated rows of a document or item report a pair once; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rolling import Spans, normalised
from lodestack.session import cut

WORDS = 12
BLOCK = 4_000_000
_BITS = 22


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Passages:
    """The q-grams of a block of items, and where in which item each stands."""

    def __init__(self, items: list[tuple[int, str]], words: int, edits: int) -> None:
        kept = [(i, n) for i, t in items if (n := normalised(t)) and n.count(" ") + 1 >= words]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.texts = [_points(f" {n} ") for _, n in kept]
        self.words, self.edits = words, edits
        self.runs: dict[int, set[tuple[str, ...]]] = {}
        blanks = [np.flatnonzero(t == 32) for t in self.texts]
        #: characters of the shortest stretch with the blanks around it
        self.least = min((int((b[words:] - b[:-words]).min()) + 1 for b in blanks), default=0)
        self.q = max(1, (self.least + 1) // (edits + 2))
        self.bound = self.least + 1 - self.q * (edits + 1)
        grams, owner, at = [], [], []
        for k, t in enumerate(self.texts):
            n = len(t) - self.q + 1
            pos = np.arange(n)
            grams.append(Spans(t).hash(pos, pos + self.q))
            owner.append(np.full(n, k))
            at.append(pos)
        joined = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if grams else np.zeros(0, np.int64)
        self.grams, first = np.unique(joined[order], return_index=True)
        self.first = np.append(first, len(joined))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _BITS)] = True

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) index pairs for all texts that hold a stretch of an item."""
        none = np.zeros(0, np.int64)
        points = _points("\n".join(f" {normalised(t)} " for t in texts))
        if not len(self.ids) or len(points) < self.q:
            return none, none
        starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
        pos = np.arange(len(points) - self.q + 1)
        grams = Spans(points).hash(pos, pos + self.q)
        pos = np.flatnonzero(self.seen[grams >> np.uint64(64 - _BITS)])
        if not len(pos):
            return none, none
        k = np.minimum(np.searchsorted(self.grams, grams[pos]), len(self.grams) - 1)
        real = self.grams[k] == grams[pos]
        pos, k = pos[real], k[real]
        counts = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        pos = np.repeat(pos, counts)
        item, diagonal = self.owner[entry], pos - self.at[entry]
        text = np.searchsorted(starts, pos, side="right") - 1

        # bands of ``width`` diagonals, each reaching ``edits`` further so that no alignment is torn
        width = 2 * self.edits + 1
        band = diagonal // width
        again = diagonal % width < self.edits
        place = self.at[entry]
        text, item, band, pos, place = (np.concatenate([x, x[again] - s]) for x, s in ((text, 0), (item, 0), (band, 1), (pos, 0), (place, 0)))
        order = np.lexsort((pos, band, item, text))
        text, item, band, pos, place = text[order], item[order], band[order], pos[order], place[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        at = np.flatnonzero(new)
        distinct = np.add.reduceat((new | (np.diff(pos, prepend=-1) != 0)).astype(np.int64), at) if len(at) else none
        stop = np.append(at[1:], len(text))[distinct >= self.bound]
        at = at[distinct >= self.bound]
        found = {}
        ends = np.append(starts[1:] - 1, len(points))
        for g, h, t, i, b in zip(at.tolist(), stop.tolist(), text[at].tolist(), item[at].tolist(), band[at].tolist()):
            if (t, i) not in found and self._aligned(points, int(starts[t]), int(ends[t]), i, b * width, width + self.edits, np.unique(place[g:h])):
                found[t, i] = True
        return (np.array([t for t, _ in found], np.int64), np.array([i for _, i in found], np.int64)) if found else (none, none)

    def exact(self, text: str | None, item: int) -> bool:
        """Whether the text holds ``words`` consecutive words of the item as they are."""
        if item not in self.runs:
            words = self.texts[item].tobytes().decode("utf-32-le", "surrogatepass").split()
            self.runs[item] = {tuple(words[k : k + self.words]) for k in range(len(words) - self.words + 1)}
        words = normalised(text).split(" ")
        return not self.runs[item].isdisjoint(zip(*(words[k:] for k in range(self.words))))

    def _aligned(self, points: np.ndarray, start: int, end: int, item: int, diagonal: int, width: int, places: np.ndarray) -> bool:
        """Whether a stretch of the item aligns with the text along diagonals ``diagonal`` .. + ``width``, within the edits.

        ``places`` are the item positions of the band's shared q-grams; a stretch with fewer than its length allows is passed over.
        """
        text = self.texts[item]
        if not self.edits:
            a, b = max(0, start - diagonal), min(len(text), end - diagonal)
            same = text[a:b] == points[a + diagonal : b + diagonal]
            blanks = np.cumsum(same & (text[a:b] == 32))
            stops = np.flatnonzero(~same)
            edges = np.concatenate([[0], np.where(stops >= 0, blanks[stops], 0), [blanks[-1] if len(blanks) else 0]])
            return bool((np.diff(edges) > self.words).any())
        blanks = np.flatnonzero(text == 32)
        shift = np.arange(-self.edits, width + self.edits + 1)
        firsts, lasts = blanks[: -self.words], blanks[self.words :]
        shared = np.searchsorted(places, lasts - self.q + 1, side="right") - np.searchsorted(places, firsts)
        enough = shared >= lasts - firsts + 2 - self.q * (self.edits + 1)
        for first, last in zip(firsts[enough], lasts[enough]):
            # row by row of the stretch; cost[k] is that of ending at text position row + diagonal + shift[k]
            cost = np.zeros(len(shift), np.int64)
            for row in range(first, last + 1):
                at = row + diagonal + shift
                inside = (at >= start) & (at < end)
                match = np.where(inside, points[np.clip(at, 0, len(points) - 1)] != text[row], 1)
                step = np.minimum(cost + match, np.append(cost[1:] + 1, self.edits + 1))
                cost = np.minimum.accumulate(step - shift) + shift
                if cost.min() > self.edits:
                    break
            else:
                return True
        return False


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``BLOCK`` characters, or of one item; one list is held at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in queries.toLocalIterator():
        if size + len(row.text) > BLOCK and block:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = 0, exact: bool = False) -> DataFrame:
    """(doc_id, item_id) of all documents that hold ``words`` consecutive words of an item with at most ``edits`` character edits.

    Words are runs of letters and digits in any case, whatever stands between them. With ``exact`` a pair so found must hold the words without edits too.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    queries = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        held = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = Passages(held.value, words, edits)
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    texts = part.column(1).to_pylist()
                    text, item = passages.search(texts)
                    if exact and edits:
                        keep = np.array([passages.exact(texts[t], i) for t, i in zip(text.tolist(), item.tolist())], bool)
                        text, item = text[keep], item[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[text]), pa.array(passages.ids[item])], ["doc_id", "item_id"])

        return docs.mapInArrow(run, "doc_id bigint, item_id bigint")

    found = None
    for block in _blocks(queries):
        if found is not None:  # of several blocks each is answered before the next is read
            found = cut(found)
        found = scan(block) if found is None else found.union(scan(block))
    return found.distinct()
