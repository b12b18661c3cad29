"""The catalog: one store, and what people do with it. Every call is one commit."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestack import store as S
from lodestack.functions import values as V
from lodestack.functions.values import CatalogError, asserted, content_hash, faults, host_token, run_id, split_type
from lodestack.operators import history, selection, sync, versions
from lodestack.operators.selection import Mark, Spec
from lodestack.schema import TABLES
from lodestack.session import cut
from lodestack.types import Types


def _now():
    return F.current_timestamp().cast("timestamp_ntz")


class Catalog:
    """A labelled-data catalog at a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, types: Types | None = None) -> None:
        self.spark, self.store, self.types = spark, S.Store(spark, root), types or Types()

    @classmethod
    def create(cls, spark: SparkSession, root: str, identity: str | None = None) -> Catalog:
        made = cls(spark, root)
        made.store.create(identity or run_id(datetime.datetime.now(datetime.UTC), os.uname().nodename))
        return made

    @property
    def now(self) -> S.Snapshot:
        return self.store.snapshot()

    def identity(self) -> str:
        return self.now.read("catalog_identity").first().id

    def samples(self) -> DataFrame:
        return S.samples(self.now)

    def annotations(self) -> DataFrame:
        return S.annotations(self.now)

    def _fill(self, table: str, df: DataFrame) -> DataFrame:
        """Missing columns of a table as nulls, in its order."""
        return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in TABLES[table].split(", "))])

    def _commit(self, snapshot: S.Snapshot, changes: dict[str, DataFrame]) -> int:
        return self.store.commit({t: self._fill(t, df) for t, df in changes.items()}, snapshot.version)

    # samples ---------------------------------------------------------------------------------------------------

    def ingest(self, files: DataFrame, media: str, subtype: str, collections: list[str] | None = None) -> DataFrame:
        """Add (path, checksum, length, metadata json) as samples; returns (path, id).

        A known sample, tombstoned ones too, keeps its id and is described by the metadata given, if that differs; of several paths with the same bytes
        the last by path describes it. Memberships are added once.
        """
        split_type(f"{media}/{subtype}")
        self.types.refuse_generated(f"{media}/{subtype}", "an ingest")
        return self._add(self.now, files, media, subtype, collections)

    def ingest_files(self, root: str, type_name: str, collections: list[str], metadata: DataFrame | None = None, listed: list[str] | None = None, blobs: str | None = None) -> DataFrame:
        """Ingest the files under a folder in the form their type is stored in; (path, id).

        Metadata are the facts of the bytes, the path, and over them those of ``metadata`` (path, metadata). Where the stored form is not what the file holds, its own checksum is
        recorded. With ``blobs`` the stored bytes are put there.
        """
        from lodestack.sources import blobs as B
        from lodestack.sources import files, runs

        self.types.refuse_generated(type_name, "an ingest")
        media, subtype = split_type(type_name)
        found = files.files_under(self.spark, root, listed)
        stored = cut(found.join(runs.canonical_files(found, self.types, type_name), "path").withColumn("stored", F.sha2("canonical", 256)))
        runs.refuse(stored.where("fault is not null").select(F.concat_ws(": ", "path", "fault").alias("problem")), root)
        own = metadata.select("path", F.col("metadata").alias("given")) if metadata is not None else stored.select("path", F.lit(None).cast("string").alias("given")).limit(0)
        source = F.to_json(F.struct(F.col("path").alias("source_path"), *[F.when(F.col("stored") != F.col("checksum"), v).alias(k) for k, v in (("canonicalised", F.lit(True)), ("source_checksum", F.col("checksum")))]))
        rows = stored.join(own, "path", "left").withColumn("source", source)
        rows = cut(rows.select("path", F.col("stored").alias("checksum"), F.length("canonical").cast("bigint").alias("length"), runs.merged("facts", "source", "given").alias("metadata")))
        if blobs:
            self.place(stored.select(F.col("stored").alias("checksum"), F.lit("").alias("ending"), F.col("canonical").alias("content")).dropDuplicates(["checksum"]), blobs)
        return self._add(self.now, rows, media, subtype, collections)

    def intake(self, root: str, type_name: str, collections: list[str], label_set: str | None = None) -> dict[str, int]:
        """Take in a prepared corpus, its candidate answers as imported ones; what was counted."""
        from lodestack.sources import runs

        rows, said = runs.admit(self.spark, root, type_name, self.types)
        rows = cut(rows.withColumn("checksum", F.sha2("content", 256)))
        media, subtype = split_type(type_name)
        ids = cut(self._add(self.now, rows.select("path", "checksum", F.length("content").cast("bigint").alias("length"), "metadata"), media, subtype, collections))
        counts = {"samples": ids.select("id").distinct().count(), "unindexed": said["unindexed"], "answers": 0}
        if label_set:
            batch = rows.where("value is not null").join(ids, "path").select(F.col("id").alias("item"), F.col("id").alias("sample_id"), "value")
            counts["answers"] = self.annotate(batch, label_set, "import", said["produced_by"]).where("verdict <> 'kept'").count()
        return counts

    def _add(self, at: S.Snapshot, files: DataFrame, media: str, subtype: str, collections: list[str] | None) -> DataFrame:
        files = cut(files.select("path", "checksum", "length", "metadata"))
        held = S.samples(at).where((F.col("media") == media) & (F.col("subtype") == subtype)).select("checksum", F.col("id").alias("held"), F.col("metadata").alias("had"))
        one = files.groupBy("checksum").agg(F.max_by(F.struct("metadata", "length", "path"), "path").alias("f"), F.min("path").alias("first")).join(held, "checksum", "left")
        new = S.with_ids(one.where("held is null"), at.next_id("sample"), "first")
        known = one.where("held is not null and not (had <=> f.metadata)")
        changes = {
            "sample": new.select("id", "checksum", F.lit(media).alias("media"), F.lit(subtype).alias("subtype"), "f.metadata", "f.length", F.col("f.path").alias("container"), F.lit(0).alias("offset"), _now().alias("ingested_at")),
            "event": S.with_ids(
                known.select(F.lit("described").alias("kind"), F.col("held").alias("sample_id"), F.to_json(F.struct(F.lit(subtype).alias("subtype"), F.col("had").alias("metadata"))).alias("before"),
                             F.to_json(F.struct(F.col("f.metadata").alias("metadata"))).alias("after"), _now().alias("at")), at.next_id("event"), "sample_id"),
        }
        ids = new.select("checksum", "id").union(one.where("held is not null").select("checksum", F.col("held").alias("id")))
        if collections:
            wanted = ids.select(F.col("id").alias("sample_id"), F.explode(F.array(*map(F.lit, sorted(set(collections))))).alias("collection"))
            fresh = wanted.join(at.read("sample_collection").select("sample_id", "collection"), ["sample_id", "collection"], "left_anti")
            changes["sample_collection"] = S.with_ids(fresh, at.next_id("sample_collection"), "sample_id", "collection").withColumn("added_at", _now())
        self._commit(at, changes)
        return files.select("path", "checksum").join(ids, "checksum").select("path", "id")

    def tombstone(self, ids: DataFrame) -> int:
        at = self.now
        alive = S.samples(at).where("deleted_at is null").join(ids.select("id"), "id", "left_semi").select(F.lit("tombstoned").alias("kind"), F.col("id").alias("sample_id"), _now().alias("at"))
        return self._commit(at, {"event": S.with_ids(alive, at.next_id("event"), "sample_id")})

    # answers ---------------------------------------------------------------------------------------------------

    def add_label_set(self, name: str, schema: dict) -> int:
        at = self.now
        if at.read("label_set").where(F.col("name") == name).count():
            raise CatalogError(f"label set {name!r} is there already")
        number = at.next_id("label_set")
        self._commit(at, {"label_set": self.spark.createDataFrame([(number, name, json.dumps(schema))], "id bigint, name string, schema string").withColumn("created_at", _now())})
        return number

    def _label_set(self, at: S.Snapshot, name: str):
        rows = at.read("label_set").where(F.col("name") == name).take(1)
        if not rows:
            raise CatalogError(f"no label set {name!r}")
        return rows[0]

    @staticmethod
    def _classes(written: DataFrame) -> DataFrame:
        """The class rows of written answers (id, value)."""
        return written.select(F.col("id").alias("annotation_id"), F.explode(asserted(F.col("value"))).alias("class_name"))

    def annotate(self, batch: DataFrame, label_set: str, source: str, batch_name: str | None = None) -> DataFrame:
        """Write (item, sample_id, value), null values as skips; the verdicts of all rows.

        Values that the label set's schema does not allow refuse the whole batch. A schema without a label type allows any.
        """
        at = self.now
        held = self._label_set(at, label_set)
        if json.loads(held.schema or "{}").get("label_type"):
            wrong = batch.select("item", F.explode(faults(F.col("value"), F.lit(held.schema))).alias("fault")).orderBy("item").take(20)
            if wrong:
                raise CatalogError(f"values that {label_set!r} does not allow: {[(r['item'], r.fault) for r in wrong]}")
        verdicts = cut(history.write_answers(S.annotations(at), batch.withColumn("label_set_id", F.lit(held.id)), source, batch_name))
        written = verdicts.where("verdict <> 'kept'").withColumn("state", F.when(F.col("value").isNull(), "skipped").otherwise("annotated")).withColumn("created_at", _now())
        numbered = cut(S.with_ids(written, at.next_id("annotation"), "item"))
        self._commit(at, {"annotation": numbered, "annotation_class": self._classes(numbered), "annotation_conflict": self._settled(at, numbered)})
        return verdicts

    def _settled(self, at: S.Snapshot, written: DataFrame) -> DataFrame:
        """Rows that end the open conflicts of what a person has now answered."""
        open_ = at.read("annotation_conflict").select("sample_id", "label_set_id").distinct()
        said = written.where("source = 'human'").select("sample_id", "label_set_id").distinct()
        return open_.join(said, ["sample_id", "label_set_id"], "left_semi").withColumn("noticed_at", _now())

    def conflicts(self) -> DataFrame:
        """The open conflicts (sample_id, label_set_id, kept_value, other_value, ..) of live samples: of each the last noticed, unless an answer of a person ended it."""
        at = self.now
        last = at.read("annotation_conflict").groupBy("sample_id", "label_set_id").agg(F.max_by(F.struct("kept_value", "other_value", "other_origin", "noticed_at"), F.struct("noticed_at", F.col("other_value").isNull())).alias("c"))
        return sync.disputed(last.select("sample_id", "label_set_id", "c.*").where("other_value is not null"), S.samples(at))

    def unskip(self, samples: DataFrame) -> int:
        """Withdraw the current skips of (sample_id, label_set_id)."""
        at = self.now
        rows = history.unskip(S.annotations(at), samples).select(F.lit("withdrawn").alias("kind"), "sample_id", F.col("id").alias("annotation_id"), _now().alias("at"))
        return self._commit(at, {"event": S.with_ids(rows, at.next_id("event"), "sample_id", "annotation_id")})

    def merge(self, copy: Catalog, dry_run: bool = False) -> DataFrame:
        """Take over a copy's current answers, matched by bytes and type, and its lists; the verdicts. Conflicts are recorded, not written. A dry run writes nothing."""
        if self.identity() != copy.identity():
            raise CatalogError("only a copy of this catalog can be merged; import the answers of another")
        at = self.now
        lists = self._merged_lists(at, copy.now)
        mine = S.samples(at).select(F.col("id").alias("sample_id"), "checksum", "media", "subtype")
        theirs = copy.samples().select(F.col("id").alias("their_id"), "checksum", "media", "subtype")
        sets = copy.now.read("label_set").select(F.col("id").alias("label_set_id"), "name").join(at.read("label_set").select(F.col("id").alias("mine"), "name"), "name")
        rows = copy.annotations().where("superseded_at is null").withColumnRenamed("sample_id", "their_id").join(theirs, "their_id").join(mine, ["checksum", "media", "subtype"]).join(sets, "label_set_id")
        incoming = rows.select("sample_id", F.col("mine").alias("label_set_id"), "state", "value", "source")
        verdicts = cut(sync.merge_verdicts(incoming, S.annotations(at)))
        if dry_run:
            return verdicts
        written = cut(S.with_ids(verdicts.where("writes"), at.next_id("annotation"), "sample_id", "label_set_id").withColumn("created_at", _now()))
        standing = S.annotations(at).where("superseded_at is null").groupBy("sample_id", "label_set_id").agg(F.max_by("value", "id").alias("kept_value"))
        clashes = verdicts.where("verdict = 'conflicted'").join(standing, ["sample_id", "label_set_id"], "left")
        clashes = clashes.select("sample_id", "label_set_id", "kept_value", F.col("value").alias("other_value"), F.lit("merge").alias("other_origin"), _now().alias("noticed_at"))
        self._commit(at, {"annotation": written, "annotation_class": self._classes(written), "annotation_conflict": clashes, **lists})
        return verdicts

    def _merged_lists(self, at: S.Snapshot, other: S.Snapshot) -> dict[str, DataFrame]:
        """The list versions that only a copy has, with their members; one of the same name and version with another set or type refuses the merge."""
        mine, theirs = at.read("list_version"), other.read("list_version")
        kind = lambda df: F.concat_ws("/", df["media"], df["subtype"])
        both = theirs.join(mine, (theirs["name"] == mine["name"]) & (theirs["version"] == mine["version"]))
        if clash := both.where((theirs["digest"] != mine["digest"]) | (kind(theirs) != kind(mine))).select(theirs["name"], theirs["version"]).take(20):
            raise CatalogError(f"lists that differ: {[f'{r.name}@{r.version}' for r in clash]}")
        new = theirs.join(mine.select("name", "version"), ["name", "version"], "left_anti").withColumnRenamed("id", "their_id")
        if not new.take(1):
            return {}
        numbered = cut(S.with_ids(new, at.next_id("list_version"), "name", "version"))
        members = other.read("list_member").withColumnRenamed("list_id", "their_id").join(numbered.select("their_id", F.col("id").alias("list_id")), "their_id")
        return {"list_version": numbered, "list_member": members.select("list_id", "checksum")}

    def import_answers(self, exported: DataFrame, dry_run: bool = False, into: str | None = None, pairs: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
        """Take over another catalog's answers (rows as of ``sources.answers``); the verdict of every current row.

        ``into`` names the label set that gets them instead of the one of their own name. ``pairs`` (old, new) name checksums that stand for others here; span answers of paired
        samples are moved to the new text, given ``texts`` (checksum, text) of both, and spans whose text is gone are left out.

        Samples are matched by bytes and type. Current rows are written where the verdict says so, as imported; the history of a written or already
        held answer arrives with it, marked so that it is never read as an answer. A dry run writes nothing.
        """
        if exported.where(F.col("catalog_id") == self.identity()).take(1):
            raise CatalogError("these answers came from this catalog")
        at = self.now
        items = exported.withColumn("item", F.monotonically_increasing_id()).withColumn("old", F.col("checksum"))
        if into:
            items = items.withColumn("label_set", F.lit(self._label_set(at, into).name))
        if pairs is not None:
            items = items.join(pairs.select(F.col("old").alias("checksum"), "new"), "checksum", "left").withColumn("checksum", F.coalesce("new", "checksum")).drop("new")
        items = cut(items)
        matched = sync.match_samples(items.select("item", "checksum", "type"), S.samples(at)).where("matched = 'matched'").select("item", "sample_id")
        sets = at.read("label_set").select(F.col("id").alias("label_set_id"), F.col("name").alias("label_set"))
        rows = items.join(matched, "item").join(sets, "label_set").select("sample_id", "label_set_id", "old", "checksum", F.explode("rows").alias("r")).select("sample_id", "label_set_id", "old", "checksum", "r.*")
        if pairs is not None:
            rows = _moved(cut(rows.withColumn("row", F.monotonically_increasing_id())), texts)
        rows = cut(rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("superseded_at", F.col("superseded_at").cast("timestamp_ntz")))
        log = S.annotations(at)
        current = rows.where("superseded_at is null").select("sample_id", "label_set_id", "state", "value", "source", "created_at")
        verdicts = cut(sync.import_verdicts(current, log))
        if dry_run:
            return verdicts
        key = ["sample_id", "label_set_id", "created_at", "source", "state", "value"]
        written = verdicts.where("writes_current").join(rows.where("superseded_at is null").select(*key, "batch").distinct(), [verdicts[k].eqNullSafe(rows[k]) for k in key], "left").select(*[verdicts[k] for k in key], "batch")
        past = rows.where("superseded_at is not null").join(verdicts.where("writes_history").select("sample_id", "label_set_id").distinct(), ["sample_id", "label_set_id"], "left_semi")
        held = log.select(*key).distinct()
        past = past.join(held, [past[k].eqNullSafe(held[k]) for k in key], "left_anti")
        # history first, so that the answer that stands has the larger id
        both = past.select(*key, "batch", "superseded_at", F.lit(0).alias("stands")).unionByName(written.withColumn("superseded_at", F.lit(None).cast("timestamp_ntz")).withColumn("stands", F.lit(1)))
        numbered = cut(S.with_ids(both, at.next_id("annotation"), "stands", "sample_id", "label_set_id", "created_at"))
        arrived = numbered.where("stands = 0").select(F.lit("arrived").alias("kind"), "sample_id", F.col("id").alias("annotation_id"), _now().alias("at"))
        clashes = verdicts.where("verdict = 'conflicted'").select("sample_id", "label_set_id", F.col("value").alias("other_value"), F.lit("import").alias("other_origin"), _now().alias("noticed_at"))
        self._commit(at, {"annotation": numbered, "annotation_class": self._classes(numbered), "annotation_conflict": clashes, "event": S.with_ids(arrived, at.next_id("event"), "annotation_id")})
        return verdicts

    # lists, raw files and preparation ------------------------------------------------------------------------------

    def put_list(self, name: str, checksums: DataFrame, list_type: str | None = None) -> tuple[int, bool]:
        """The version of a list that holds exactly these checksums: (version, whether it was there already)."""
        from lodestack.operators.lineage import put_list

        at = self.now
        held = at.read("list_version").where(F.col("name") == name)
        digest, size, version, reused = put_list(held.select("version", "digest"), checksums.select("checksum"))
        if reused:
            return version, True
        media, subtype = split_type(list_type) if list_type else (None, None)
        number = at.next_id("list_version")
        header = self.spark.createDataFrame([(number, name, version, digest, size, media, subtype)], "id bigint, name string, version int, digest string, size bigint, media string, subtype string")
        self._commit(at, {"list_version": header.withColumn("created_at", _now()), "list_member": checksums.select(F.lit(number).alias("list_id"), "checksum").distinct()})
        return version, False

    def lists(self, refs: list[str]) -> dict[str, DataFrame]:
        """The members of named list versions, as a selection takes them."""
        from lodestack.functions.values import parse_ref

        at, out = self.now, {}
        for ref in refs:
            name, version = parse_ref(ref)
            header = at.read("list_version").where((F.col("name") == name) & (F.col("version") == version)).take(1)
            if not header:
                raise CatalogError(f"no list {ref}")
            out[ref] = at.read("list_member").where(F.col("list_id") == header[0].id).select("checksum", F.lit(header[0].media).cast("string").alias("media"), F.lit(header[0].subtype).cast("string").alias("subtype"))
        return out

    def ingest_raw(self, found: DataFrame, collection: str, producer: str = "ingest") -> dict[str, int]:
        """Record files (path, checksum, length) under a collection; the run's counts."""
        from lodestack.sources.files import raw_ingest

        at = self.now
        added, counts = raw_ingest(found, at.read("raw"), collection)
        said = counts.first().asDict()
        number = run_id(datetime.datetime.now(datetime.UTC), os.uname().nodename)
        run = self.spark.createDataFrame([(number, "ingest", producer, json.dumps(said))], "id string, kind string, producer string, counts string").withColumn("started_at", _now()).withColumn("finished_at", _now())
        rows = S.with_ids(added.withColumn("collection", F.lit(collection)), at.next_id("raw"), "path").withColumn("run_id", F.lit(number)).withColumn("ingested_at", _now())
        self._commit(at, {"run": run, "run_input": found.select(F.lit(number).alias("run_id"), "checksum").distinct(), "raw": rows})
        return said

    def prepare(self, inputs: DataFrame, spec: dict, stages: list, collection: str, continues: str | None = None) -> dict[str, int]:
        """Run a chain of stages over the inputs (checksum, content) that no run of the same chain was given before, and add what comes out as samples.

        Samples keep the metadata of their first origin. Inputs that a run of another chain was given are refused unless that run lies on the line that is
        continued.
        """
        from lodestack.operators import lineage

        self.types.refuse_generated(spec["output"]["type"], "a prepare run")
        at, chain = self.now, lineage.chain_identity(spec)
        media, subtype = split_type(spec["output"]["type"])
        runs = at.read("run").where("kind = 'prepare'")
        given = at.read("run_input").join(runs.select(F.col("id").alias("run_id"), "chain"), "run_id").join(inputs.select("checksum").distinct(), "checksum", "left_semi")
        line = lineage.line_of(runs, continues) if continues else []
        if others := [r.run_id for r in given.where(F.col("chain") != chain).select("run_id").distinct().collect() if r.run_id not in line]:
            raise CatalogError(f"prepared before by {sorted(others)}; say which run this continues")
        done = given.where(F.col("chain") == chain).select("checksum").distinct()
        outputs = cut(lineage.prepare(inputs, stages, done))
        counts = lineage.prepare_counts(outputs, done.count()).first().asDict()
        if line:
            # samples that the runs continued made of the inputs that are prepared anew, and those of them that a person has answered
            again = inputs.select(F.col("checksum").alias("input")).distinct().join(done.withColumnRenamed("checksum", "input"), "input", "left_anti")
            old = at.read("origin").where(F.col("run_id").isin(*line)).join(again, "input", "left_semi").select("sample_id").distinct()
            human = S.annotations(at).where("superseded_at is null and state = 'annotated' and source = 'human'").select("sample_id")
            counts |= {"superseded": old.count(), "superseded_answered": old.join(human, "sample_id", "left_semi").count()}
        number = run_id(datetime.datetime.now(datetime.UTC), os.uname().nodename)
        made = outputs.where("checksum is not null")
        held = S.samples(at).where((F.col("media") == media) & (F.col("subtype") == subtype)).select("checksum", F.col("id").alias("held"))
        one = made.groupBy("checksum").agg(F.min_by(F.struct("metadata", F.length("content").alias("length")), F.struct("input", "position")).alias("f")).join(held, "checksum", "left")
        new = cut(S.with_ids(one.where("held is null"), at.next_id("sample"), "checksum"))
        ids = new.select("checksum", "id").union(one.where("held is not null").select("checksum", F.col("held").alias("id")))
        origins = made.join(ids, "checksum").groupBy(F.col("id").alias("sample_id"), "input").agg(F.min(F.struct("position", "metadata")).alias("o"))
        run = self.spark.createDataFrame([(number, "prepare", spec.get("name", ""), chain, continues, json.dumps(counts))], "id string, kind string, producer string, chain string, continues string, counts string")
        members = ids.join(at.read("sample_collection").where(F.col("collection") == collection).select(F.col("sample_id").alias("id")), "id", "left_anti")
        self._commit(at, {
            "run": run.withColumn("started_at", _now()).withColumn("finished_at", _now()),
            "run_input": inputs.select(F.lit(number).alias("run_id"), "checksum").distinct(),
            "sample": new.select("id", "checksum", F.lit(media).alias("media"), F.lit(subtype).alias("subtype"), "f.metadata", "f.length", _now().alias("ingested_at")),
            "sample_collection": S.with_ids(members.select(F.col("id").alias("sample_id"), F.lit(collection).alias("collection")), at.next_id("sample_collection"), "sample_id").withColumn("added_at", _now()),
            "origin": S.with_ids(origins, at.next_id("origin"), "input", "sample_id").select("id", "sample_id", F.lit(number).alias("run_id"), F.lit("raw").alias("input_kind"), "input", "o.position", "o.metadata", _now().alias("recorded_at")),
        })
        return counts | {"run": number}

    def commit_directory(self, root: str) -> dict[str, int]:
        """Commit the derive or generate run of a folder."""
        from lodestack.sources import runs

        run, outputs = runs.read_directory(self.spark, root)
        return self.commit_run(run, outputs)

    def commit_run(self, run, outputs: DataFrame, blobs: str | None = None) -> dict[str, int]:
        """Check a derive or generate run (``sources.runs.Run``) and its outputs (file, origins, generation, content) whole, then write it as one commit; its counts.

        A sample's metadata are the facts of its bytes, then those of its origins, of each key the first; new samples take them, live ones are described by them, tombstoned ones stay as they are.
        """
        from lodestack.sources import runs

        run.check(self.types)
        at = self.now
        outputs = cut(outputs.select("file", "origins", "generation", "content"))
        if not run.left_out and not outputs.take(1):
            raise CatalogError("the run has no outputs and counts nothing it left out")
        stored = runs.canonical_files(outputs.where("content is not null").select(F.col("file").alias("path"), "content"), self.types, run.type)
        stored = cut(stored.select(F.col("path").alias("file"), "facts", "fault", "canonical", F.sha2("canonical", 256).alias("checksum")))
        runs.refuse(runs.output_problems(run, outputs, stored, self.types), f"the outputs of the {run.kind} run")
        samples = S.samples(at).withColumn("type", F.concat_ws("/", "media", "subtype"))
        live = samples.where("deleted_at is null").select("checksum", "type", F.col("metadata").alias("held"))
        named = outputs.select("file", F.posexplode_outer("origins").alias("place", "o")).where("o is not null")
        inputs = named.select("o.checksum", "o.type").distinct()
        copied = outputs.select(F.explode("generation.copied_from").alias("c")).select("c.checksum", "c.type", "c.field").distinct()
        unknown = inputs.join(live, ["checksum", "type"], "left_anti").union(copied.select("checksum", "type").distinct().join(live, ["checksum", "type"], "left_anti"))
        fields = copied.join(live, ["checksum", "type"]).where(~F.coalesce(F.array_contains(F.json_object_keys("held"), F.col("field")), F.lit(False)))
        runs.refuse(unknown.select(F.concat_ws(" ", F.lit("no live sample"), "type", "checksum").alias("problem")).union(fields.select(F.concat_ws(" ", "type", "checksum", F.lit("has no"), "field").alias("problem"))), "what the run names")

        media, subtype = split_type(run.type)
        number = run_id(datetime.datetime.now(datetime.UTC), os.uname().nodename)
        held = samples.where((F.col("media") == media) & (F.col("subtype") == subtype)).select("checksum", F.col("id").alias("held"), F.col("metadata").alias("had"), F.col("deleted_at").alias("gone"))
        one = stored.groupBy("checksum").agg(F.min_by("facts", "file").alias("facts"), F.max(F.length("canonical")).alias("length")).join(held, "checksum", "left")
        new = cut(S.with_ids(one.where("held is null"), at.next_id("sample"), "checksum"))
        ids = cut(new.select("checksum", "id").union(one.where("held is not null").select("checksum", F.col("held").alias("id"))))
        made = stored.select("file", "checksum").join(ids, "checksum").select("file", F.col("id").alias("sample_id"))
        rows = made.join(named, "file").select("sample_id", F.lit("sample").alias("input_kind"), F.col("o.checksum").alias("input"), F.col("o.type").alias("input_type"), F.col("o.role").alias("role"), F.col("o.position").alias("position"), F.col("o.metadata").alias("metadata"), "file", "place")
        first = rows.groupBy("sample_id", "input_kind", "input", "input_type", "role").agg(F.min_by(F.struct("position", "metadata", "file", "place"), F.struct("file", "place")).alias("f"))
        origins = cut(S.with_ids(first.select("sample_id", "input_kind", "input", "input_type", "role", "f.*"), at.next_id("origin"), "file", "place", "sample_id"))
        said = made.join(outputs.where("generation is not null").select("file", "generation"), "file").select("sample_id", "generation.*").withColumn("copied_from", F.to_json("copied_from")).distinct()
        generations = cut(S.with_ids(said, at.next_id("generation"), "sample_id"))

        # facts first, then all recorded origins in their order
        pairs = one.join(ids, "checksum").select(F.col("id").alias("sample_id"), F.lit(0).cast("bigint").alias("at"), F.col("facts").alias("metadata"))
        past = at.read("origin").select("sample_id", F.col("id").alias("at"), "metadata").join(ids.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
        pairs = pairs.union(past).union(origins.select("sample_id", F.col("id").alias("at"), "metadata"))
        merged = cut(combined(pairs))
        known = one.where("held is not null and gone is null").join(merged.withColumnRenamed("sample_id", "held"), "held", "left").where("not (had <=> metadata)")
        described = known.select(F.lit("described").alias("kind"), F.col("held").alias("sample_id"), F.to_json(F.struct(F.lit(subtype).alias("subtype"), F.col("had").alias("metadata"))).alias("before"), F.to_json(F.struct("metadata")).alias("after"), _now().alias("at"))
        wanted = ids.select(F.col("id").alias("sample_id"), F.explode(F.array(*map(F.lit, sorted(set(run.collections))))).alias("collection"))
        fresh = wanted.join(at.read("sample_collection").select("sample_id", "collection"), ["sample_id", "collection"], "left_anti")
        counts = {
            "outputs": outputs.count(), "samples": ids.count(), "new_samples": new.count(), "inputs": inputs.count(), "origins": origins.count(), "generations": generations.count(), "left_out": dict(sorted(run.left_out.items())),
        }
        header = [(number, run.kind, run.producer, json.dumps(run.code) if run.code else None, json.dumps(run.spec), content_hash(run.spec), json.dumps(counts))]
        self._commit(at, {
            "run": self.spark.createDataFrame(header, "id string, kind string, producer string, code string, spec string, spec_hash string, counts string").withColumn("started_at", _now()).withColumn("finished_at", _now()),
            "run_input": inputs.select(F.lit(number).alias("run_id"), "checksum").distinct(),
            "sample": new.join(merged.withColumnRenamed("sample_id", "id"), "id", "left").select("id", "checksum", F.lit(media).alias("media"), F.lit(subtype).alias("subtype"), "metadata", "length", _now().alias("ingested_at")),
            "sample_collection": S.with_ids(fresh, at.next_id("sample_collection"), "sample_id", "collection").withColumn("added_at", _now()),
            "origin": origins.withColumn("run_id", F.lit(number)).withColumn("recorded_at", _now()),
            "generation": generations.withColumn("run_id", F.lit(number)).withColumn("recorded_at", _now()),
            "event": S.with_ids(described, at.next_id("event"), "sample_id"),
        })
        if blobs:
            self.place(stored.select("checksum", F.lit("").alias("ending"), F.col("canonical").alias("content")).dropDuplicates(["checksum"]), blobs)
        return counts | {"run": number}

    def verify_run(self, number: str, blobs: str | None = None) -> list[str]:
        """What of a run's recorded counts does not meet its tables; with ``blobs`` the bytes of all its samples are read and hashed too."""
        from lodestack.operators.lineage import verify_counts

        at = self.now
        rows = at.read("run").where(F.col("id") == number).take(1)
        if not rows:
            raise CatalogError(f"no run {number}")
        counts = json.loads(rows[0].counts or "{}")
        mine = lambda table: at.read(table).where(F.col("run_id") == number)
        made = mine("origin").select("sample_id").union(mine("generation").select("sample_id")).distinct()
        alive = S.samples(at).where("deleted_at is null")
        live = alive.join(made.select(F.col("sample_id").alias("id")), "id", "left_semi")
        if rows[0].kind == "ingest":
            counts |= {"inputs_recorded": mine("run_input").count(), "rows": mine("raw").count()}
        elif rows[0].kind == "import":
            counts |= {"carried": at.read("annotation").where(F.col("run_id") == number).count()}
        else:
            counts |= {"origins_recorded": mine("origin").count(), "generations_recorded": mine("generation").count(), "live_samples": live.count()}
        said = verify_counts(rows[0].kind, counts)
        if blobs:
            from lodestack.sources.blobs import fetch

            wanted = live.select("checksum").distinct()
            located = self.locations().join(wanted, "checksum", "left_semi")
            if lost := wanted.join(located.select("checksum"), "checksum", "left_anti").count():
                said.append(f"{lost} blobs are nowhere")
            try:
                fetch(located, blobs).select("checksum").write.format("noop").mode("overwrite").save()
            except Exception as bad:
                said.append(f"blobs that do not read back: {str(bad).splitlines()[0]}")
        return said

    # blobs ---------------------------------------------------------------------------------------------------------

    def locations(self) -> DataFrame:
        """(checksum, container, offset, length): where each blob was placed last."""
        last = self.now.read("location").groupBy("checksum").agg(F.max_by(F.struct("container", "offset", "length"), F.struct("placed_at", "container")).alias("l"))
        return last.select("checksum", "l.*")

    def place(self, content: DataFrame, root: str) -> int:
        """Store blobs (checksum, ending, content) under a folder and record where; one that has a place already keeps it."""
        from lodestack.sources.blobs import put

        fresh = content.join(self.locations().select("checksum"), "checksum", "left_anti")
        placed = cut(put(fresh, root)).withColumn("placed_at", _now())
        return self._commit(self.now, {"location": placed})

    def repack(self, source: str, target: str, shard_bytes: int | None = None, dry_run: bool = False, verify: int = 64, seed: int = 0, batch: int = 64, on_progress: Callable[[int, int], None] | None = None) -> dict[str, int]:
        """Move all single blobs into tar shards, in the order of their first samples; what was moved.

        Every ``batch`` shards are written, a seeded sample of them with every shard in it is read back and hashed, and their places are committed, so a repack that was stopped goes on with what is left.
        """
        from lodestack.sources import blobs as B
        from lodestack.sources.files import SHARD_BYTES, shard_plan

        shard_bytes = shard_bytes or SHARD_BYTES
        if shard_bytes > (1 << 31) - 1:
            raise CatalogError(f"a shard of {shard_bytes} bytes is beyond 32-bit offsets")
        at, held = self.now, cut(self.locations())
        order = at.read("sample").select("checksum", F.struct(F.lit(0).alias("kind"), "id").alias("o")).union(at.read("raw").select("checksum", F.struct(F.lit(1).alias("kind"), "id").alias("o")))
        pending = held.where("container not like 'shard-%'").join(order.groupBy("checksum").agg(F.min("o").alias("o")), "checksum", "left")
        ranked = pending.withColumn("first_id", F.coalesce(F.col("o.kind") * F.lit(1 << 40) + F.col("o.id"), F.lit((1 << 62)))).select("checksum", "container", "offset", "length", "first_id")
        plan = cut(shard_plan(ranked.select("checksum", "length", "first_id"), shard_bytes))
        total = plan.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct("shard").alias("shards"), F.max("shard").alias("last")).first()
        counts = {"blobs": total.blobs, "bytes": total.bytes, "shards": total.shards, "verified": 0}
        if dry_run or not total.blobs:
            return counts
        first = held.where("container like 'shard-%'").agg(F.max(F.regexp_extract("container", r"shard-(\d+)", 1).cast("bigint"))).first()[0]
        first = 0 if first is None else first + 1
        for start in range(0, total.last + 1, batch):
            part = plan.where((F.col("shard") >= start) & (F.col("shard") < start + batch))
            content = B.fetch(ranked.join(part.select("checksum"), "checksum", "left_semi"), source)
            packed = cut(B.write_shards(part.withColumn("shard", F.col("shard") + first).join(content, "checksum"), target))
            checked = B.fetch(B.sampled(packed, verify, seed), target).count()
            self._commit(self.now, {"location": packed.withColumn("placed_at", _now())})
            counts["verified"] += checked
            if on_progress:
                on_progress(min(start + batch, total.shards), total.shards)
        return counts

    def ensure_cached(self, checksums: DataFrame, blobs: str, cache: str) -> DataFrame:
        """(checksum, path) in the cache of those checksums that a live sample has; unknown ones are absent."""
        from lodestack.sources.blobs import ensure_cached

        live = self.samples().where("deleted_at is null").select("checksum")
        return ensure_cached(self.locations().join(checksums.select("checksum"), "checksum", "left_semi").join(live, "checksum", "left_semi"), blobs, cache)

    # look-ups --------------------------------------------------------------------------------------------------------

    def find(self, checksum: str, type_name: str) -> int | None:
        """The sample of bytes and type, tombstoned or not."""
        media, subtype = split_type(type_name)
        rows = self.now.read("sample").where((F.col("checksum") == checksum) & (F.col("media") == media) & (F.col("subtype") == subtype)).select("id").take(1)
        return rows[0].id if rows else None

    def by_checksum(self, checksum: str, type_name: str | None = None):
        """The live sample of these bytes; under several types one must be named."""
        rows = self.samples().where((F.col("deleted_at").isNull()) & (F.col("checksum") == checksum)).take(100)
        rows = [r for r in rows if type_name in (None, f"{r.media}/{r.subtype}")]
        if len(rows) > 1:
            raise CatalogError(f"{checksum} is held as {sorted(f'{r.media}/{r.subtype}' for r in rows)}; name one")
        return rows[0] if rows else None

    def identities(self, ids: DataFrame) -> DataFrame:
        """(id, checksum, type, metadata, container, offset, length) of samples (id)."""
        rows = self.samples().join(ids.select("id"), "id", "left_semi")
        return rows.select("id", "checksum", F.concat_ws("/", "media", "subtype").alias("type"), "metadata").join(self.locations(), "checksum", "left")

    def values_of(self, ids: DataFrame, label_set: str) -> DataFrame:
        """(id, value, source, batch): the current answers of samples (id); skips are none."""
        number = self._label_set(self.now, label_set).id
        rows = self.annotations().where((F.col("superseded_at").isNull()) & (F.col("state") == "annotated") & (F.col("label_set_id") == number))
        said = rows.groupBy(F.col("sample_id").alias("id")).agg(F.max_by(F.struct("value", "source", "batch"), "id").alias("a"))
        return said.join(ids.select("id"), "id", "left_semi").select("id", "a.*")

    def disputed_members(self, dataset: int, features: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """(id): members of a version whose own label set, or that of a feature, has an open conflict over them."""
        sets = [ref for source, ref in (features or {}).values() if source == "label_set"]
        named = self.now.read("label_set").where(F.col("name").isin(*sets) if sets else F.lit(False)).select(F.col("id").alias("label_set_id"))
        named = named.union(self.spark.createDataFrame([(self.dataset(dataset).label_set_id,)], "label_set_id bigint")).distinct()
        members = self.now.read("dataset_member").where(F.col("dataset_id") == dataset).select(F.col("sample_id").alias("id"))
        return members.join(self.conflicts().join(F.broadcast(named), "label_set_id", "left_semi").select(F.col("sample_id").alias("id")), "id", "left_semi")

    def probe(self, blobs: str | None = None) -> dict:
        """Counts, and whether the first live sample reads back as what it is."""
        live = self.samples().where("deleted_at is null")
        said = {"identity": self.identity(), "commit": self.now.version, "samples": live.count()}
        if blobs:
            from lodestack.sources.blobs import get

            rows = live.join(self.locations().withColumnRenamed("container", "at_container").withColumnRenamed("offset", "at_offset").withColumnRenamed("length", "at_length"), "checksum").orderBy("id").take(1)
            said["reads_back"] = bool(rows) and hashlib.sha256(get(blobs, rows[0].at_container, rows[0].at_offset, rows[0].at_length)).hexdigest() == rows[0].checksum
        return said

    def remove(self, collections: list[str] | None = None, where=None, checksums: list[str] | None = None, type_name: str | None = None) -> int:
        """Tombstone the live samples that meet all that is named; nothing named, or bytes under several types without a type, is refused."""
        if not (collections or where is not None or checksums):
            raise CatalogError("remove what? name collections, conditions or checksums")
        from lodestack.operators.lineage import torn_checksums
        from lodestack.operators.views import scoped

        gone = self.samples().where("deleted_at is null")
        if type_name:
            gone = gone.where(V.type_covers(F.col("media"), F.col("subtype"), type_name))
        if checksums:
            gone = gone.where(F.col("checksum").isin(*checksums))
            if not type_name and (torn := [r.checksum for r in torn_checksums(gone).take(20)]):
                raise CatalogError(f"held under several types: {torn}")
        if where is not None:
            gone = gone.where(selection.compile_condition(where, F.col("metadata")))
        if collections:
            gone = scoped(gone, self.now.read("sample_collection"), collections)
        return self.tombstone(cut(gone.select("id")))

    # versions --------------------------------------------------------------------------------------------------

    def mark(self) -> Mark:
        at = self.now
        top = {r.log: r.mark for r in selection.watermark({t: at.read(t) for t in ("sample", "sample_collection", "annotation", "event", "origin")}).collect()}
        return Mark(**top)

    def select(self, spec: Spec, mark: Mark = Mark(), lists: dict[str, DataFrame] | None = None) -> selection.Selection:
        """Run a selection as of a mark, its lists looked up unless given. A condition on a key of another kind, or that no candidate has, is refused."""
        at = self.now
        self._label_set(at, spec.label_set)
        lists = lists or self.lists([*spec.include, *spec.exclude])
        chosen = selection.run_selection(spec, at.read("sample"), at.read("sample_collection"), at.read("annotation"), at.read("label_set"), lists, mark, at.read("event"))
        if spec.where is not None:
            selection.check_keys(spec.where, chosen.candidates, self.types.declared(list(spec.types)))
        return chosen

    def _settle(self, members: DataFrame, option: str, mark: Mark) -> tuple[DataFrame, str | None, dict[str, int]]:
        """Members without those fine-tuning examples whose origins disagree on their input, if they are to be dropped; the option, null if there are no examples; what was counted."""
        at = self.now
        typed = S.samples(at).select("id", F.concat_ws("/", "media", "subtype").alias("type"), "metadata").join(members, "id")
        inputs = {r.type: t.inputs for r in typed.select("type").distinct().collect() if (t := self.types.example(r.type)) is not None}
        if option not in ("drop", "first"):
            raise CatalogError(f"disagreeing inputs: drop or first, not {option!r}")
        if not inputs:
            return members, None, {}
        from lodestack.sources import runs

        own = typed.where(F.col("type").isin(*inputs))
        origins = selection.upto(at.read("origin"), mark.origin).select(F.col("id").alias("origin"), F.col("sample_id").alias("id"), F.col("metadata").alias("given"))
        seen = own.join(origins, "id", "left").withColumn("seen", runs.merged("metadata", "given"))
        text = F.lit(None).cast("string")
        for name, keys in inputs.items():
            text = F.when(F.col("type") == name, F.to_json(F.array(*[F.coalesce(F.get_json_object("seen", f"$['{k}']"), F.lit("")) for k in keys]))).otherwise(text)
        settled, kept = versions.settle_inputs(seen.select(F.coalesce("origin", F.lit(0)).alias("id"), F.col("id").alias("sample_id"), text.alias("input")), option)
        wrong = settled.where("inputs > 1").select(F.col("sample_id").alias("id"))
        n = wrong.count()
        if option == "first":
            return members, option, {"disagreeing": n, "kept_first": n}
        return cut(members.join(wrong, "id", "left_anti")), option, {"disagreeing": n, "left_out": n}

    def freeze(
        self, name: str, spec: Spec | None = None, val_ratio: float = 0.1, holdout_ratio: float = 0.0, seed: int = 0, group_by: str | None = None, *, ids: DataFrame | None = None, label_set: str | None = None,
        given: versions.GivenSplit | None = None, given_lists: dict[str, list[str]] | None = None, disagreeing: str = "drop", inherit: bool = True, mark: Mark | None = None,
    ) -> tuple[int, bool]:
        """Freeze a selection, or given samples (id), as the next version of a name: (dataset id, whether an identical latest version was reused).

        Sides are inherited from the latest version, so that a sample keeps its side from version to version, unless ``inherit`` is off. ``given`` fixes the sides of the
        samples it names, by a key or by ``given_lists`` {side: list refs}; where that contradicts an inherited side it is refused.
        """
        if (spec is None) == (ids is None):
            raise CatalogError("freeze either a selection or given samples")
        if spec is not None and label_set not in (None, spec.label_set):
            raise CatalogError(f"the selection is of label set {spec.label_set!r}, not {label_set!r}")
        at, mark = self.now, mark or self.mark()
        label = self._label_set(at, spec.label_set if spec is not None else label_set or "")
        counts: dict = {}
        if spec is not None:
            chosen = self.select(spec, mark)
            members = cut(chosen.members)
            counts = {f"{r.what}:{r.name}" if r.name else r.what: r.n for r in chosen.counts().collect()}
            if not members.take(1):
                raise CatalogError(f"the selection chose nothing: {counts}")
        else:
            live = S.samples(at).where("deleted_at is null")
            if absent := [r.id for r in ids.select("id").join(live, "id", "left_anti").orderBy("id").take(20)]:
                raise CatalogError(f"no live samples {absent}")
            members = cut(ids.select(F.col("id").cast("bigint").alias("id")).distinct())
            if not members.take(1):
                raise CatalogError("no samples were given")
        members, option, settled = self._settle(members, disagreeing, mark)
        if not members.take(1):
            raise CatalogError(f"the inputs of every member disagree: {settled}")
        counts |= {f"inputs:{k}": n for k, n in settled.items()}

        answers = selection.answers_asof(at.read("annotation"), mark, at.read("event")).where(F.col("label_set_id") == label.id)
        said = answers.select(F.col("sample_id").alias("id"), "state", "source", "value").join(members, "id")
        made = V.set_digests(said.select(F.lit(0).cast("bigint").alias("g"), "id", _answer_text("id", "state", "source", "value").alias("said")), "g", "said", order="id").take(1)
        digest = made[0].digest if made else hashlib.sha256(b"").hexdigest()
        record = json.dumps((given.record() if given else {}) | ({"lists": given_lists} if given_lists else {})) if given or given_lists else None
        past = at.read("dataset").where(F.col("name") == name).orderBy(F.desc("version")).take(1)
        inherited = None
        if past:
            sides = at.read("dataset_member").where(F.col("dataset_id") == past[0].id).select(F.col("sample_id").alias("id"), "side")
            was = (past[0].spec_hash, past[0].annotation_digest, past[0].val_ratio, past[0].holdout_ratio, past[0].group_by, past[0].given_split, past[0].disagreeing_inputs)
            now = (spec.hash() if spec is not None else None, digest, val_ratio, holdout_ratio, group_by, record, option)
            drawn = inherit or (past[0].sides_from_version == past[0].version and past[0].seed == seed)
            if was == now and drawn and not sides.select("id").exceptAll(members).take(1) and not members.exceptAll(sides.select("id")).take(1):
                return past[0].id, True
            inherited = sides if inherit else None
        known = members.join(S.samples(at).select("id", "checksum", "metadata"), "id")
        fixed = None
        if given or given_lists:
            lists = None
            for side, refs in sorted((given_lists or {}).items()):
                for ref, rows in self.lists(refs).items():
                    one = rows.select("checksum", F.lit(side).alias("side"))
                    lists = one if lists is None else lists.union(one)
            fixed = cut((given or versions.GivenSplit()).named(known, lists))
            if inherited is not None and (moved := fixed.join(inherited.select("id", F.col("side").alias("was")), "id").where("side <> was").count()):
                raise CatalogError(f"the given split moves {moved} samples off the side of the version before; freeze without inheriting to draw afresh")
        grp = F.get_json_object("metadata", f"$['{group_by}']") if group_by else F.lit(None).cast("string")
        sided = cut(versions.assign_sides(known.select("id", grp.alias("grp"), "checksum"), val_ratio, holdout_ratio, seed, inherited, fixed))
        by = {r.side: r.n for r in sided.groupBy("side").agg(F.count("*").alias("n")).collect()}
        total, number, version = sum(by.values()), at.next_id("dataset"), past[0].version + 1 if past else 1
        start = past[0].sides_from_version if past and inherit else version
        row = {
            "id": number, "name": name, "version": version, "label_set_id": label.id, "spec": json.dumps(spec.canonical()) if spec is not None else None, "spec_hash": spec.hash() if spec is not None else None,
            "watermark": json.dumps(mark.__dict__) if spec is not None else None, "selection": json.dumps(counts), "annotation_digest": digest, "val_ratio": float(val_ratio), "val_achieved": by.get("val", 0) / total,
            "holdout_ratio": float(holdout_ratio), "holdout_achieved": by.get("holdout", 0) / total, "group_by": group_by, "sides_from_version": start, "seed": seed, "given_split": record, "disagreeing_inputs": option, "created_at": None,
        }
        header = self.spark.createDataFrame([row], TABLES["dataset"]).withColumn("created_at", _now())
        self._commit(at, {"dataset": header, "dataset_member": sided.select(F.lit(number).alias("dataset_id"), F.col("id").alias("sample_id"), "side")})
        return number, False

    def dataset(self, number: int):
        rows = self.now.read("dataset").where(F.col("id") == number).take(1)
        if not rows:
            raise CatalogError(f"no version {number}")
        return rows[0]

    def verify_dataset(self, dataset: int) -> list[str]:
        """Replay a version's spec at its mark, its lists and settled inputs too: what of its members and counts differs."""
        held = self.dataset(dataset)
        if not held.spec:
            raise CatalogError(f"version {dataset} was frozen without a spec")
        tree = json.loads(held.spec)["select"]
        lists = tree.get("lists", {})
        spec = Spec(tuple(tree["types"]), tree["label_set"], tuple(tree["collections"]) if "collections" in tree else None, tuple(tree.get("sources", ())),
                    selection.condition(_conditions(tree["where"])) if "where" in tree else None, tuple(lists.get("include", ())), tuple(lists.get("exclude", ())))
        said = [] if content_hash({"select": tree}) == held.spec_hash else ["the spec does not hash to what was recorded"]
        mark = Mark(**json.loads(held.watermark))
        chosen = self.select(spec, mark)
        members = cut(chosen.members)
        counts = {f"{r.what}:{r.name}" if r.name else r.what: r.n for r in chosen.counts().collect()}
        recorded = json.loads(held.selection or "{}")
        said += [f"{what} was {recorded[what]} and is {n}" for what, n in sorted(counts.items()) if what in recorded and recorded[what] != n]
        if held.disagreeing_inputs:
            members, _, _ = self._settle(members, held.disagreeing_inputs, mark)
        frozen = self.now.read("dataset_member").where(F.col("dataset_id") == dataset).select(F.col("sample_id").alias("id"))
        for what, extra in (("no longer selected", frozen.exceptAll(members)), ("selected but not frozen", members.exceptAll(frozen))):
            if n := extra.count():
                said.append(f"{n} {what}")
        return said

    def materialise(self, dataset: int, path: str, features: dict[str, tuple[str, str]] | None = None, blobs: str | None = None, cache: str | None = None) -> bool:
        """Write a version's members with sides, current answers and features as Parquet, a manifest beside them, and with ``blobs`` their files; whether it was there already.

        A folder with the manifest of this catalog, version and features is left as it is. Else all is written beside it and moved there. Members with an open conflict over an answer are
        left out. Of an example its first input's fields stand among its metadata.
        """
        at, held = self.now, self.dataset(dataset)
        features = features or {}
        if inputs := {k for t in self.types.held.values() for k in t.inputs} & set(features):
            raise CatalogError(f"features named like an input: {sorted(inputs)}")
        declared = {k: list(v) for k, v in sorted(features.items())}
        was = json.loads(self.store.text(f"{path}/manifest.json") or "{}")
        if (was.get("catalog"), was.get("dataset"), was.get("features")) == (self.identity(), dataset, declared):
            return True
        said = S.annotations(at).where((F.col("superseded_at").isNull()) & (F.col("label_set_id") == held.label_set_id))
        said = said.groupBy(F.col("sample_id").alias("id")).agg(F.max_by(F.struct("state", "source", "value", "batch"), "id").alias("a"))
        members = at.read("dataset_member").where(F.col("dataset_id") == dataset).select(F.col("sample_id").alias("id"), F.col("side").alias("split"))
        members = members.join(self.disputed_members(dataset, features), "id", "left_anti")
        rows = members.join(S.samples(at).select("id", "checksum", "media", "subtype", "metadata"), "id").join(said, "id", "left")
        answered = F.col("a.state") == "annotated"
        name = F.concat("checksum", F.coalesce(V.suffix(F.get_json_object("metadata", "$.source_path")), F.lit("")))
        rows = rows.select("id", "split", "checksum", F.concat_ws("/", "media", "subtype").alias("type"), "metadata", F.when(answered, F.col("a.value")).alias("value"), F.when(answered, F.col("a.source") == "human").alias("reviewed"), "a.source", "a.batch", name.alias("file"))
        # one file per checksum: that of its least sample
        rows = rows.join(rows.groupBy("checksum").agg(F.min_by("file", "id").alias("path")), "checksum").drop("file")
        if features:
            rows = versions.features(rows, features, S.samples(at), S.annotations(at), at.read("label_set"))
        staging = f"{path}.pending-{uuid.uuid4().hex}"
        rows.write.parquet(f"{staging}/members")
        if blobs:
            from lodestack.sources.blobs import write_out

            written = self.spark.read.parquet(f"{staging}/members").select("checksum", F.col("path").alias("name")).distinct()
            write_out(self.locations().join(written, "checksum"), blobs, f"{staging}/files", cache).write.format("noop").mode("overwrite").save()
        counts = {r.split: r.n for r in self.spark.read.parquet(f"{staging}/members").groupBy("split").agg(F.count("*").alias("n")).collect()}
        manifest = {"catalog": self.identity(), "dataset": dataset, "name": held.name, "version": held.version, "label_set_id": held.label_set_id, "spec_hash": held.spec_hash, "seed": held.seed, "group_by": held.group_by, "val_ratio": held.val_ratio,
                    "val_ratio_achieved": held.val_achieved, "holdout_ratio": held.holdout_ratio, "holdout_ratio_achieved": held.holdout_achieved, "given_split": held.given_split, "disagreeing_inputs": held.disagreeing_inputs, "features": declared, "counts": counts}
        self.store.write_text(f"{staging}/manifest.json", json.dumps(manifest, indent=1))
        self.store.move(staging, path)
        return False

    def start_run(self, kind: str, producer: str) -> str:
        at = self.now
        number = run_id(datetime.datetime.now(datetime.UTC), host_token(os.uname().nodename))
        self._commit(at, {"run": self.spark.createDataFrame([(number, kind, producer)], "id string, kind string, producer string").withColumn("started_at", _now())})
        return number


@F.pandas_udf(StringType())
def _answer_text(sample: pd.Series, state: pd.Series, source: pd.Series, value: pd.Series) -> pd.Series:
    """Answers as they enter a version's digest."""

    def one(sample: int, state: str, source: str, value: str | None) -> str:
        try:
            said = json.loads(value) if value is not None else None
        except ValueError:
            said = value
        return json.dumps([int(sample), state, source, said])

    return pd.Series([one(*x) for x in zip(sample, state, source, value)], dtype=object)


@F.pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())])))
def _pairs(metadata: pd.Series) -> pd.Series:
    """The keys of JSON objects with their values as JSON."""
    return metadata.map(lambda m: [(k, json.dumps(v, sort_keys=True)) for k, v in json.loads(m).items()] if m else [])


def combined(rows: DataFrame) -> DataFrame:
    """(sample_id, metadata): objects of (sample_id, at, metadata) folded key by key, of each the first by ``at``; values keep their kinds."""
    pairs = rows.where("metadata is not null").select("sample_id", "at", F.explode(_pairs("metadata")).alias("p"))
    first = pairs.groupBy("sample_id", F.col("p.key").alias("key")).agg(F.min_by("p.value", "at").alias("value"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda p: F.concat(F.to_json(F.array(p["key"])).substr(F.lit(2), F.length(F.to_json(F.array(p["key"]))) - 2), F.lit(": "), p["value"]))
    return first.groupBy("sample_id").agg(F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}")).alias("metadata"))


def _moved(rows: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Rows (row, old, checksum, value, ..) with the span answers of paired samples moved to the new text."""
    from lodestack.operators.remap import remap

    paired = rows.where("old <> checksum and get_json_object(value, '$.kind') = 'spans'")
    if texts is None:
        return rows
    text = lambda key, name: texts.select(F.col("checksum").alias(key), F.col("text").alias(name))
    both = paired.join(text("old", "old_text"), "old", "left").join(text("checksum", "new_text"), "checksum", "left")
    made = remap(both.select(F.col("row").alias("item"), "value", "old_text", "new_text")).select(F.col("item").alias("row"), F.col("value").alias("moved"))
    return rows.join(made, "row", "left").withColumn("value", F.coalesce("moved", "value")).drop("moved", "row", "old", "checksum")


def _conditions(tree: dict) -> dict:
    """A stored condition with the values of ``in`` as they were."""
    if isinstance(tree, dict):
        out = {k: _conditions(v) if k == "not" else [_conditions(c) for c in v] if k in ("all", "any") else v for k, v in tree.items()}
        if out.get("op") == "in":
            out["value"] = [json.loads(v) for v in out["value"]]
        return out
    return tree
