"""Runs and where samples come from: lists, lines of runs, preparation, and the identities that a run's counts must meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.values import CatalogError, canonical_text, content_hash, set_digest


def put_list(latest: DataFrame | None, checksums: DataFrame) -> tuple[str, int, int, bool]:
    """(digest, size, version, reused) of a list: the latest version again if it holds the same set, else the next.

    ``latest`` holds (version, digest) of the list's versions, or nothing.
    """
    bad = checksums.where(~F.col("checksum").rlike("^[0-9a-f]{64}$")).take(1)
    if bad:
        raise CatalogError(f"{bad[0].checksum!r} is not a sha256")
    digest, size = set_digest(checksums, "checksum")
    held = [] if latest is None else latest.orderBy(F.desc("version")).take(1)
    same = bool(held) and held[0].digest == digest
    version = held[0].version if same else held[0].version + 1 if held else 1
    return digest, size, version, same


def line_of(runs: DataFrame, run_id: str) -> list[str]:
    """A run and those it continues, back to the first, by rounds of look-ups; a cycle is refused."""
    line, at = [], run_id
    held = runs.select("id", "continues")
    while at is not None:
        if at in line:
            raise CatalogError(f"run {at} continues itself")
        rows = held.where(F.col("id") == at).take(1)
        if not rows:
            raise CatalogError(f"no run {at}")
        line.append(at)
        at = rows[0].continues
    return line


class Drop(Exception):
    """Raised by a stage to leave an input out, with the reason."""


Stage = Callable[[bytes, dict], list[tuple[bytes, dict]]]


def chain_identity(spec: dict) -> str:
    return content_hash({"stages": spec.get("stage", []), "output": spec.get("output", {})})


def prepare(inputs: DataFrame, stages: list[Stage], done: DataFrame | None = None) -> DataFrame:
    """(input, position, checksum, content, metadata, dropped) of the outputs of every distinct input (checksum, content) not yet in ``done`` (checksum).

    Each stage maps content and metadata to any number of outputs or raises ``Drop``; an input without outputs has one row with the reason in
    ``dropped``. Text outputs are canonical. Any other error ends the run.
    """
    todo = inputs.dropDuplicates(["checksum"])
    if done is not None:
        todo = todo.join(done.select("checksum").distinct(), "checksum", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import json

        for batch in batches:
            rows = []
            for checksum, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items, reason = [(content, {})], None
                try:
                    for stage in stages:
                        items = [out for data, meta in items for out in stage(data, meta)]
                except Drop as drop:
                    items, reason = [], str(drop)
                if not items:
                    rows.append((checksum, None, None, None, None, reason or "empty"))
                for n, (data, meta) in enumerate(items):
                    data = canonical_text(data)
                    rows.append((checksum, n, hashlib.sha256(data).hexdigest(), data, json.dumps(meta, sort_keys=True), None))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string())
            names = ["input", "position", "checksum", "content", "metadata", "dropped"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return todo.select("checksum", "content").mapInArrow(run, "input string, position int, checksum string, content binary, metadata string, dropped string")


def prepare_counts(outputs: DataFrame, already: int) -> DataFrame:
    """(inputs, produced, already, emptied, outputs, samples): inputs = produced + already + emptied."""
    by = outputs.groupBy("input").agg(F.count("checksum").alias("n"))
    per = by.agg(F.count("*").alias("todo"), F.count_if(F.col("n") > 0).alias("produced"))
    made = outputs.agg(F.count("checksum").alias("outputs"), F.countDistinct("checksum").alias("samples"))
    return per.join(made).select((F.col("todo") + already).alias("inputs"), "produced", F.lit(already).cast("bigint").alias("already"), (F.col("todo") - F.col("produced")).alias("emptied"), "outputs", "samples")


#: fixed values: what the recorded counts of each kind of run must add up to
IDENTITIES = {
    "ingest": (("files", ("added", "held")), ("checksums", ("inputs_recorded",)), ("added", ("rows",))),
    "prepare": (("inputs", ("produced", "already", "emptied")), ("samples", ("live_samples",))),
    "import": (("rows", ("carried",)), ("samples", ("matched", "paired", "unmatched"))),
    "derive": (("origins", ("origins_recorded",)), ("samples", ("live_samples",))),
    "generate": (("origins", ("origins_recorded",)), ("generations", ("generations_recorded",)), ("samples", ("live_samples",))),
}


def verify_counts(kind: str, counts: dict[str, int]) -> list[str]:
    """What of a run's recorded and replayed counts does not add up."""
    if kind not in IDENTITIES:
        raise CatalogError(f"nothing to verify of a {kind} run")
    said = []
    for left, right in IDENTITIES[kind]:
        total = sum(counts.get(r, 0) for r in right)
        if counts.get(left, 0) != total:
            said.append(f"{left} {counts.get(left, 0)} is not {' + '.join(right)} {total}")
    return said


def torn_checksums(samples: DataFrame) -> DataFrame:
    """(checksum, types): checksums of live samples held under several types, which a removal by checksum must name a type for."""
    kinds = samples.where("deleted_at is null").groupBy("checksum").agg(F.countDistinct("media", "subtype").alias("types"))
    return kinds.where("types > 1")
