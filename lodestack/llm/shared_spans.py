"""Problem 9: long exact spans shared between records.

Method: a compressed FM-index (wavelet matrix over the Burrows-Wheeler transform of word symbols) per
shard; documents are streamed against it by backward search, and intervals of at least the threshold are
reported. So that no document has to visit every shard, shards are cut by content: every run of ``least``
words holds at least one anchor, the minimal hashed ``ANCHOR``-gram of its window, and the neighbourhoods
of one anchor meet in one shard, wherever their documents lie. Anchors that occur in a single document are dropped before
any text moves, and equal texts are counted once. An anchor with more neighbourhoods than one index should hold (a footer of many documents)
gets none: each of the few runs of ``least`` words around it is counted by its hash, pre-aggregated, so such an anchor costs in
proportion to its neighbourhoods and lies in no one task.

Defined results
* Null and empty texts share nothing. Words are what blank, tab, LF or CR separates, compared exactly.
* Spans repeated within a single document only are not shared. Rows repeating a doc_id with the same text count once.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rolling import Spans, utf8, words_of
from lodestack.session import cut

LEAST = 25
ANCHOR = 12
#: fixed value: the white space that separates words
GAPS = b" \t\n\r"
#: words of one FM-index; a shard with more is indexed in several parts of whole anchors
SHARD_WORDS = 500_000
#: texts hashed at once
SLICE = 1000


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the offsets of the texts among the words."""
    data, starts = utf8(texts)
    first, last, before = words_of(data, starts, GAPS)
    return (Spans(data).hash(first, last) if len(first) else np.zeros(0, np.uint64)), before


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def anchors(words: np.ndarray, before: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) and hashes of the anchors: for every run of ``least`` words of a text the least gram in it."""
    width = least - gram + 1
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(words) - gram + 1)
    grams = Spans(words).hash(at, at + gram)
    minima = _window_minima(grams, width)
    # a run that crosses the end of a text is none: no gram can equal a minimum of 0
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    minima[text[: len(minima)] != text[least - 1 :]] = 0
    pad = np.zeros(width - 1, np.uint64)
    # all minima around a gram are at most the gram itself, so it is one of them iff it is their maximum
    highest = ~_window_minima(~np.concatenate([pad, minima, pad]), width)
    where = np.flatnonzero((highest == grams) & (grams > 0))
    return where, grams[where]


class Index:
    """FM-index over word symbols: suffixes ordered by their first ``depth`` symbols, the transform in a wavelet matrix."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        self.n = n
        self.symbols, codes = np.unique(text, return_inverse=True)
        rank, step = codes.astype(np.int64), 1
        while step < depth:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1:
                break
        self.order = np.argsort(rank, kind="stable")
        bwt = codes[self.order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.symbols)))])
        self.levels = max(1, int(len(self.symbols) - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        begin = np.zeros(len(self.symbols), np.int64)
        alphabet = np.arange(len(self.symbols))
        for level in range(self.levels - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + (-n) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
            begin = self._down(len(self.words) - 1, begin, (alphabet >> level) & 1)
        self.begin = begin

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        block = at >> 6
        ones = self.blocks[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def back(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns lengthened to the left by one symbol each."""
        both, codes = np.concatenate([lo, hi]), np.concatenate([code, code])
        for k in range(self.levels):
            both = self._down(k, both, (codes >> (self.levels - 1 - k)) & 1)
        both = both - self.begin[codes] + self.first[codes]
        return both[: len(lo)], both[len(lo) :]


def shared_runs(pieces: np.ndarray, offsets: np.ndarray, docs: np.ndarray, copied: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which stretches of the pieces (symbols above 0, piece p at offsets[p]:offsets[p+1]) another document also holds.

    All pieces make the index, and all are streamed against it. Returned are (piece, first, end) of stretches each word of which lies in a
    run of ``least`` words that a piece of another document has, or that lies in a text with copies. A window is
    read from its right end; where it stops being shared, all windows over the stop are passed over.
    """
    sizes = np.diff(offsets)
    cut_at = np.cumsum(sizes)
    text = np.insert(pieces, cut_at, 0)
    owner = np.insert(np.repeat(np.arange(len(sizes)), sizes), cut_at, -1)
    index = Index(text, least)
    row = owner[index.order]
    doc = np.where(row >= 0, docs[row], -1)
    change = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    many = np.concatenate([[0], np.cumsum(np.where(row >= 0, copied[row], False))])
    at = np.searchsorted(index.symbols, pieces)
    at[at == len(index.symbols)] = 0
    known = index.symbols[at] == pieces

    live = np.flatnonzero(sizes >= least)
    start = np.zeros(len(live), np.int64)
    floor = np.full(len(live), -1, np.int64)  # the first shared window; from there on the last one is sought downwards
    j = start + least - 1
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        word = offsets[live] + j
        lo, hi = index.back(lo, hi, at[word])
        ok = known[word] & (hi > lo)
        a, b = np.where(ok, lo, 0), np.where(ok, hi, 1)
        ok &= (change[b - 1] > change[a]) | (many[b] > many[a]) | copied[live] | (doc[a] != docs[live])
        whole = ok & (j == start)
        last = sizes[live] - least
        if whole.any():
            found.append((live[whole], start[whole], start[whole] + least))
        # after the first shared window of a piece its last one is sought from the right
        down = whole & (floor < 0) & (last > start)
        over = whole & ~down
        failed = ~ok
        ahead, below = failed & (floor < 0), failed & (floor >= 0)
        floor = np.where(down, start, floor)
        start = np.where(down, last, np.where(ahead, j + 1, np.where(below, start - 1, start)))
        fresh = down | failed
        over |= (ahead & (start > last)) | (below & (start <= floor))
        j = np.where(fresh, start + least - 1, j - 1)
        lo, hi = np.where(fresh, 0, lo), np.where(fresh, index.n, hi)
        go = ~over
        live, start, floor, j, lo, hi = live[go], start[go], floor[go], j[go], lo[go], hi[go]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    piece, first, end = (np.concatenate(x) for x in zip(*found))
    # the windows of a piece overlap, as no piece is longer than two of them less one word
    order = np.lexsort((first, piece))
    piece, first, end = piece[order], first[order], end[order]
    new = np.concatenate([[True], piece[1:] != piece[:-1]])
    return piece[new], first[new], np.maximum.reduceat(end, np.flatnonzero(new))


def _columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: hashing takes some forty bytes for each byte of text."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _anchor_rows(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts = _columns(batch, "doc_id", "text")
            words, before = _word_hashes(texts.to_pylist())
            where, grams = anchors(words, before, least, gram)
            text = np.searchsorted(before, where, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(ids.to_numpy()[text]), pa.array((where - before[text]).astype(np.int32))],
                ["anchor", "doc_id", "pos"],
            )

    return run


def _pieces(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts, copied, hits, grams = _columns(batch, "doc_id", "text", "copied", "pos", "anchor")
            words, before = _word_hashes(texts.to_pylist())
            short = (words >> np.uint64(32)).astype(np.uint32)
            short[short == 0] = 1
            counts = np.diff(hits.offsets.to_numpy())
            text = np.repeat(np.arange(batch.num_rows), counts)
            pos = hits.flatten().to_numpy()
            first = np.maximum(0, pos - (least - gram)) + before[text]
            end = np.minimum(before[text] + pos + least, before[text + 1])
            sizes = end - first
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])
            data = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(short[flat])])
            yield pa.RecordBatch.from_arrays(
                [grams.flatten(), pa.array(ids.to_numpy()[text]), pa.array(copied.to_numpy(zero_copy_only=False)[text]), pa.array((first - before[text]).astype(np.int32)), data],
                ["anchor", "doc_id", "copied", "first", "words"],
            )

    return run


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all pieces of a column, and the offsets of the pieces."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    words = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(np.uint32) if data is not None else np.zeros(0, np.uint32)
    return words.astype(np.int64), (ends - ends[0]) // 4


def _search(least: int, most: int):
    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        docs, first, copied = (table[c].to_numpy() for c in ("doc_id", "first", "copied"))
        words = table["words"].combine_chunks()
        pieces, offsets = _words_of(words.chunk(0) if isinstance(words, pa.ChunkedArray) else words)
        piece, a, b = shared_runs(pieces, offsets, docs, copied, least)
        return pa.RecordBatch.from_arrays([pa.array(docs[piece]), pa.array((first[piece] + a).astype(np.int32)), pa.array((first[piece] + b).astype(np.int32))], ["doc_id", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows (anchor, doc_id, copied, first, words) come ordered by anchor; an index takes whole anchors until it is full
        held: list[pa.RecordBatch] = []
        words = 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != anchor[0]:
                new = np.concatenate([[0], new])
            done = 0
            total = np.concatenate([[0], np.cumsum(np.diff(_words_of(batch.column(4))[1]) + 1)])
            for at in new:
                if words + total[at] - total[done] >= most:
                    if at > done:
                        held.append(batch.slice(done, at - done))
                    if held:
                        yield solve(held)
                    held, words, done = [], 0, at
            if done < batch.num_rows:
                held.append(batch.slice(done))
                words += int(total[-1] - total[done])
        if held:
            yield solve(held)

    return run


def _windows(least: int):
    """Every run of ``least`` words of a piece of (doc_id, copied, first, words): (run, doc_id, copied, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, copied, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            words, offsets = _words_of(batch.column(3))
            counts = np.maximum(0, np.diff(offsets) - least + 1)
            piece = np.repeat(np.arange(batch.num_rows), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = offsets[piece] + at
            runs = Spans(words).hash(start, start + least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs.view(np.int64)), pa.array(docs[piece]), pa.array(copied[piece]), pa.array((first[piece] + at).astype(np.int32))], ["run", "doc_id", "copied", "first"]
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unbroken stretches of each document's shared runs; a batch row holds all runs of one document."""
    for batch in batches:
        ids, runs = batch.column(0).to_numpy(), batch.column(1)
        counts = np.diff(runs.offsets.to_numpy())
        doc = np.repeat(np.arange(len(ids)), counts)
        flat = runs.flatten()
        first, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        order = np.lexsort((first, doc))
        doc, first, end = doc[order], first[order].astype(np.int64), end[order].astype(np.int64)
        span = int(end.max(initial=0)) + 2
        reach = np.maximum.accumulate(doc * span + end)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] * span + first[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(doc)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc[at]]), pa.array(first[at] + 1), pa.array((reach[last] - doc[last] * span))],
            ["doc_id", "first_word", "last_word"],
        )


def shared_spans(documents: DataFrame, least: int = LEAST, gram: int = ANCHOR, hot: int = 20_000) -> DataFrame:
    """(doc_id, first_word, last_word): the stretches of each document whose words lie in runs of ``least`` words that another document also holds.

    ``gram`` (at most ``least``) sets how many anchors there are, not what is found. Around an anchor with more than
    ``hot`` neighbourhoods runs are counted by their hashes instead of searched in an index.
    """
    if not 1 <= gram <= least:
        raise ValueError("1 <= gram <= least")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # equal texts: the least document stands for all of them
    texts = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.reverse("text")).alias("h2"))
    classes = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    members = cut(texts.distinct().join(classes, ["h1", "h2"]).select("doc_id", "rep", (F.col("top") > F.col("rep")).alias("copied")))

    found = cut(docs.mapInArrow(_anchor_rows(least, gram), "anchor bigint, doc_id bigint, pos int"))
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    reps = members.where("doc_id = rep").select("doc_id", "copied")
    hits = found.join(several, "anchor").join(reps, "doc_id").distinct().groupBy("doc_id").agg(F.max("copied").alias("copied"), F.collect_list(F.struct("pos", "anchor")).alias("h"))
    hits = hits.select("doc_id", "copied", F.col("h.pos").alias("pos"), F.col("h.anchor").alias("anchor"))
    pieces = docs.join(hits, "doc_id").mapInArrow(_pieces(least, gram), "anchor bigint, doc_id bigint, copied boolean, first int, words binary")
    pieces = cut(pieces)
    crowded = cut(pieces.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    usual, extra = pieces, None
    if crowded.take(1):
        usual = pieces.join(crowded, "anchor", "left_anti").select(*pieces.columns)
        spread = cut(pieces.join(crowded, "anchor", "left_semi").select("doc_id", "copied", "first", "words").mapInArrow(_windows(least), "run bigint, doc_id bigint, copied boolean, first int"))
        held = spread.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("copied").alias("copied")).where("a < b or copied").select("run")
        extra = spread.join(held, "run").select("doc_id", "first", (F.col("first") + least).cast("int").alias("end"))
    runs = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search(least, SHARD_WORDS), "doc_id bigint, first int, end int")
    if extra is not None:
        runs = runs.union(extra)
    per_doc = runs.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    merged = per_doc.mapInArrow(_merged, "rep bigint, first_word bigint, last_word bigint")
    return members.join(merged, "rep").select("doc_id", "first_word", "last_word")
