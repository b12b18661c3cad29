"""Moving span answers from one text to another version of it."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def remap_spans(value: str | None, old: str | None, new: str | None) -> tuple[str | None, int]:
    """The span answer for the new text, and how many of its spans are lost.

    A span is carried by its text: what the old text has there, or what it says itself where there is no old text. It goes to the place of that text in
    the new one that is nearest to where the texts' matching blocks put its start, or to its old start where no block holds it; without such a place, or without
    text, it is lost. A null value stays null, and without a new text nothing moves.
    """
    if value is None or new is None:
        return value, 0
    answer = json.loads(value)
    if answer.get("kind") != "spans" or old == new:
        return value, 0
    blocks: list | None = [] if old is None else None
    kept, lost = [], 0
    for span in answer["values"]:
        at = span["start"]
        text = old[at : span["end"]] if old is not None else span.get("text") or ""
        places = [m.start() for m in re.finditer(f"(?={re.escape(text)})", new)] if text else []
        if not places:
            lost += 1
            continue
        if len(places) > 1:  # which of them takes the blocks, the costly part
            if blocks is None:
                blocks = difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()
            guess = next((b.b + at - b.a for b in blocks if b.a <= at < b.a + b.size), at)
            places.sort(key=lambda p: (abs(p - guess), p))
        start = places[0]
        kept.append(span | {"start": start, "end": start + len(text), "text": text})
    return json.dumps(answer | {"values": kept}, ensure_ascii=False, separators=(",", ":")), lost


def remap(rows: DataFrame) -> DataFrame:
    """(item, value, lost) for rows (item, value, old_text, new_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [remap_spans(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["item", "value", "lost"])

    return rows.select("item", "value", "old_text", "new_text").mapInArrow(run, "item bigint, value string, lost bigint")
