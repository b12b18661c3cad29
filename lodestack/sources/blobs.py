"""Blobs under a folder of any filesystem that pyarrow reaches from the executors: local or mounted, HDFS, object stores."""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.values import CatalogError

#: bytes read or hashed at once
STEP = 1 << 20


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a folder's address, and its path there; a plain path is local."""
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def blob_name(checksum: str, ending: str = "") -> str:
    return f"{checksum[:2]}/{checksum[2:4]}/{checksum}{ending}"


def write_whole(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file under a name of its own and move it: a task that runs again, or two at once, leave one whole file."""
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.partial"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, path)


def there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.File


def put(blobs: DataFrame, root: str) -> DataFrame:
    """Store rows (checksum, ending, content) as ``ab/cd/<checksum><ending>``; (checksum, container, offset, length). What is there already stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        for batch in batches:
            rows = []
            for checksum, ending, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if hashlib.sha256(content).hexdigest() != checksum:
                    raise CatalogError(f"these bytes are not {checksum}")
                name = blob_name(checksum, ending or "")
                if not there(files, f"{base}/{name}"):
                    write_whole(files, f"{base}/{name}", content)
                rows.append((checksum, name, 0, len(content)))
            yield _rows(rows, ("checksum", "container", "offset", "length"))

    return blobs.select("checksum", "ending", "content").mapInArrow(run, "checksum string, container string, offset bigint, length bigint")


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(name, pa.string())) for n, name in enumerate(names)], list(names))


def get(root: str, container: str, offset: int, length: int) -> bytes:
    """One range of a container."""
    files, base = filesystem(root)
    with files.open_input_file(f"{base}/{container}") as f:
        f.seek(offset)
        return f.read(length)


def fetch(located: DataFrame, root: str) -> DataFrame:
    """(checksum, content) of rows (container, offset, length, checksum): each container is opened once by the task that has its rows, bytes that do not hash are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        file, name = None, None
        for batch in batches:
            rows = []
            for container, offset, length, checksum in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if container != name:
                    if file:
                        file.close()
                    file, name = files.open_input_file(f"{base}/{container}"), container
                file.seek(offset)
                content = file.read(length)
                if hashlib.sha256(content).hexdigest() != checksum:
                    raise CatalogError(f"{container} at {offset} is not {checksum}")
                rows.append((checksum, content))
                if sum(len(c) for _, c in rows) > 64 * STEP:
                    yield _rows(rows, ("checksum", "content"))
                    rows = []
            yield _rows(rows, ("checksum", "content"))
        if file:
            file.close()

    rows = located.select("container", "offset", "length", "checksum").repartition("container").sortWithinPartitions("container", "offset")
    return rows.mapInArrow(run, "checksum string, content binary")


def hash_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, length, checksum) of files (path) under a folder, read in steps, so that files of any size pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                state, length = hashlib.sha256(), 0
                with files.open_input_stream(f"{base}/{path}") as f:
                    while step := f.read(STEP):
                        state.update(step)
                        length += len(step)
                rows.append((path, length, state.hexdigest()))
            yield _rows(rows, ("path", "length", "checksum"))

    return paths.select("path").mapInArrow(run, "path string, length bigint, checksum string")


def write_out(located: DataFrame, root: str, target: str, cache: str | None = None) -> DataFrame:
    """(checksum, path) of rows (container, offset, length, checksum, name) copied to ``target/name``; out of the cache where it has them, else through it.

    A file that is there is not written again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = filesystem(root)
        out, folder = filesystem(target)
        kept, held = filesystem(cache) if cache else (None, None)
        file, opened = None, None
        for batch in batches:
            rows = []
            for container, offset, length, checksum, name in zip(*(batch.column(k).to_pylist() for k in range(5))):
                path = f"{folder}/{name}"
                rows.append((checksum, path))
                if there(out, path):
                    continue
                near = f"{held}/{blob_name(checksum)}" if kept else None
                if near and there(kept, near):
                    with kept.open_input_file(near) as f:
                        content = f.read()
                else:
                    if container != opened:
                        if file:
                            file.close()
                        file, opened = source.open_input_file(f"{base}/{container}"), container
                    file.seek(offset)
                    content = file.read(length)
                    if hashlib.sha256(content).hexdigest() != checksum:
                        raise CatalogError(f"{container} at {offset} is not {checksum}")
                    if near:
                        write_whole(kept, near, content)
                write_whole(out, path, content)
            yield _rows(rows, ("checksum", "path"))
        if file:
            file.close()

    rows = located.select("container", "offset", "length", "checksum", "name").repartition("container").sortWithinPartitions("container", "offset")
    return rows.mapInArrow(run, "checksum string, path string")


def ensure_cached(located: DataFrame, root: str, cache: str) -> DataFrame:
    """(checksum, path) in the cache of rows (container, offset, length, checksum), each checksum once; what is missing there is fetched."""
    one = located.dropDuplicates(["checksum"])
    name = F.concat(F.substring("checksum", 1, 2), F.lit("/"), F.substring("checksum", 3, 2), F.lit("/"), F.col("checksum"))
    return write_out(one.withColumn("name", name), root, cache)


def write_shards(planned: DataFrame, root: str) -> DataFrame:
    """Write rows (shard, offset, checksum, content) as one tar per shard; (container, checksum, offset, length) of every member.

    A shard is written under a name of its own and moved, so a task that runs again leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        files.create_dir(base, recursive=True)
        tar = out = part = shard = None
        rows: list[tuple] = []

        def close() -> None:
            tar.close()
            out.close()
            files.move(part, f"{base}/shard-{shard:08d}.tar")

        for batch in batches:
            for s, checksum, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if s != shard:
                    if tar is not None:
                        close()
                    shard, part = s, f"{base}/.shard-{s:08d}-{uuid.uuid4().hex}.partial"
                    out = files.open_output_stream(part)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                info = tarfile.TarInfo(checksum)
                info.size = len(content)
                at = tar.offset + 512
                tar.addfile(info, io.BytesIO(content))
                rows.append((f"shard-{s:08d}.tar", checksum, at, len(content)))
        if tar is not None:
            close()
        yield _rows(rows, ("container", "checksum", "offset", "length"))

    ordered = planned.select("shard", "offset", "checksum", "content").repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, "container string, checksum string, offset bigint, length bigint")


def sampled(packed: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` rows of (container, checksum, ..) by a seeded hash, every container represented by one at least."""
    from pyspark.sql import Window as W

    ranked = packed.withColumn("h", F.xxhash64(F.lit(seed), "checksum"))
    first = F.row_number().over(W.partitionBy("container").orderBy("h", "checksum"))
    ranked = ranked.withColumn("first", first == 1)
    every = ranked.where("first")
    more = ranked.where("not first").orderBy("h", "checksum").limit(max(0, count - every.count()))
    return every.union(more).drop("h", "first")
