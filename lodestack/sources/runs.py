"""Prepared corpora and run directories: reading them, and everything that is wrong with one before a row is written."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestack.functions.values import CatalogError, content_hash, split_type
from lodestack.types import Types

#: problems that a refusal names
LISTED = 20
#: fixed values: names and shapes of the files
PREPARED, RUN, OUTPUTS = "prepared.json", "run.json", "outputs.jsonl"
_COPIED = "array<struct<checksum:string,type:string,field:string>>"
GENERATION = f"struct<model_host:string,model_run:string,checkpoint:string,checkpoint_digest:string,template_digest:string,system_digest:string,settings_digest:string,values:string,copied_from:{_COPIED},seed:bigint>"
ORIGINS = "array<struct<checksum:string,type:string,role:string,position:int,metadata:string>>"
OUTPUT = f"file string, origins {ORIGINS}, generation {GENERATION}"
KINDS = ("derive", "generate")


def refuse(problems: DataFrame, what: str) -> None:
    """Raise with the first of (problem) and their number, if there is any."""
    if said := [r.problem for r in problems.orderBy("problem").take(LISTED)]:
        raise CatalogError(f"{problems.count()} problems with {what}; nothing was written:\n" + "\n".join(said))


def _text(spark: SparkSession, path: str) -> str:
    try:
        return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except Exception as absent:  # the reader's own error names classes, not what is missing
        raise CatalogError(f"no {path}") from absent


# prepared corpora ------------------------------------------------------------------------------------------------


def _checked(types: Types, name: str):
    """(path, content, value..) -> the same with ``canonical`` bytes, ``facts`` and ``fault``."""
    t = types.resolve(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, facts, faults = [], [], []
            for content in batch.column(1).to_pylist():
                try:
                    data = t.form(content)
                    made.append(data)
                    facts.append(json.dumps(t.known(data), sort_keys=True))
                    faults.append(None)
                except CatalogError as bad:
                    made.append(None)
                    facts.append(None)
                    faults.append(f"cannot be stored: {bad}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(facts, pa.string()), pa.array(faults, pa.string())], ["path", "canonical", "facts", "fault"])

    return run


def canonical_files(files: DataFrame, types: Types, name: str) -> DataFrame:
    """(path, canonical, facts, fault) of files (path, content) as a type stores them; ``fault`` says why one cannot be."""
    return files.select("path", "content").mapInArrow(_checked(types, name), "path string, canonical binary, facts string, fault string")


def kind_of(value: Column) -> Column:
    """The kind of a JSON value as metadata declarations name it."""
    shape = F.schema_of_variant(F.try_parse_json(value))
    return F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(shape == "VOID", "null").otherwise("other")


def key_faults(rows: DataFrame, declared: dict[str, str]) -> DataFrame:
    """(name, problem): metadata values of (name, metadata) of another kind than declared."""
    checks = [
        F.when(F.array_contains(F.json_object_keys("metadata"), key) & ~kind_of(F.to_json(F.try_variant_get(F.try_parse_json("metadata"), f'$["{key}"]', "variant"))).isin(kind, "null"), F.lit(f"{key} is not a {kind}"))
        for key, kind in sorted(declared.items())
    ]
    if not checks:
        return rows.select("name", F.lit("").alias("problem")).limit(0)
    return rows.where("metadata is not null").select("name", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def admit(spark: SparkSession, root: str, type_name: str, types: Types) -> tuple[DataFrame, dict]:
    """The prepared corpus under a folder: (path, content, metadata, value) of its files in stored form, and what its index says of it.

    Refused as a whole, with every shortfall counted: an index that is absent, unreadable or of another type; a named file that is absent; bytes that cannot be stored; metadata of
    another kind than declared; a candidate answer on bytes that are not in stored form. Files the index does not name are counted only.
    """
    from lodestack.sources.files import files_under

    types.refuse_generated(type_name, "a prepared corpus")
    try:
        index = json.loads(_text(spark, f"{root}/{PREPARED}"))
        said = {k: index[k] for k in ("version", "type", "produced_by")}
        samples = dict(index["samples"].items())
    except (ValueError, KeyError, TypeError, AttributeError) as bad:
        raise CatalogError(f"{root}/{PREPARED} is not a prepared index: {bad}") from bad
    if said["type"] != type_name:
        raise CatalogError(f"{root} was prepared as {said['type']}, not as {type_name}")
    named = spark.read.json(f"{root}/{PREPARED}", schema="samples map<string,struct<metadata:string,value:string>>", multiLine=True).select(F.explode("samples").alias("path", "s"))
    named = named.select("path", "s.metadata", "s.value")
    files = files_under(spark, root).where(F.col("path") != PREPARED)
    joined = named.join(files, "path", "left")
    stored = canonical_files(files.join(named.select("path"), "path", "left_semi"), types, type_name)
    absent = joined.where("content is null").select(F.concat("path", F.lit(" is not there")).alias("problem"))
    faults = stored.where("fault is not null").select(F.concat_ws(" ", "path", "fault").alias("problem"))
    other = joined.where("value is not null").join(stored, "path").where("canonical <> content").select(F.concat("path", F.lit(" carries an answer and is not in the form it is stored in")).alias("problem"))
    wrong = key_faults(named.select(F.col("path").alias("name"), "metadata"), types.declared([type_name])).select(F.concat_ws(": ", "name", "problem").alias("problem"))
    refuse(absent.union(faults).union(other).union(wrong), root)
    said["unindexed"] = files.join(named.select("path"), "path", "left_anti").count()
    said["samples"] = len(samples)
    rows = named.join(stored, "path").withColumn("source", F.to_json(F.struct(F.col("path").alias("source_path"))))
    return rows.select("path", F.col("canonical").alias("content"), merged("metadata", "facts", "source").alias("metadata"), "value"), said


@F.pandas_udf(StringType())
def _merged(objects: pd.Series) -> pd.Series:
    def one(row) -> str | None:
        out: dict = {}
        for o in row:
            out |= json.loads(o) if o else {}
        return json.dumps(out, sort_keys=True) if out else None

    return objects.map(one)


def merged(*columns: str | Column) -> Column:
    """JSON objects laid over one another, the last on top; of nulls only, null."""
    return _merged(F.array(*columns))


# runs that derive or generate --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """What a run says of itself, apart from its outputs."""

    kind: str
    type: str
    collections: tuple[str, ...]
    producer: str
    spec: dict
    code: dict | None = None
    left_out: dict = field(default_factory=dict)

    def check(self, types: Types) -> None:
        if self.kind not in KINDS:
            raise CatalogError(f"a {self.kind} run is not committed; derive and generate runs are")
        split_type(self.type)
        if self.kind == "generate" and not types.resolve(self.type).generated:
            raise CatalogError(f"{self.type} is not generated; a generate run writes only types that are")
        if self.kind == "derive":
            types.refuse_generated(self.type, "a derive run")
        if not self.collections or any(not c or c.strip("/") != c for c in self.collections):
            raise CatalogError(f"into which collections? {list(self.collections)}")
        if not self.spec:
            raise CatalogError("the spec of a run names everything it read; this one is empty")
        if any(not isinstance(n, int) or isinstance(n, bool) or n < 0 for n in self.left_out.values()):
            raise CatalogError("what was left out is counted by reason, in whole numbers")

    def digests(self) -> dict[str, list[str]]:
        """The digests of the templates, system prompts and settings that the spec holds, a list being several variants."""
        each = lambda v: [] if v is None else v if isinstance(v, list) else [v]
        return {name: [content_hash(v) for v in each(self.spec.get(key))] for name, key in (("template_digest", "template"), ("system_digest", "system_prompt"), ("settings_digest", "settings"))}


def read_directory(spark: SparkSession, root: str) -> tuple[Run, DataFrame]:
    """The run of a folder and its outputs (file, origins, generation, content); a file outside the folder, absent or of other shape refuses the whole."""
    from lodestack.sources.files import files_under

    try:
        said = json.loads(_text(spark, f"{root}/{RUN}"))
        run = Run(said.pop("kind"), said.pop("type"), tuple(said.pop("collections")), said.pop("producer"), said.pop("spec"), said.pop("code", None), said.pop("left_out", None) or {})
    except (ValueError, KeyError, TypeError, AttributeError) as bad:
        raise CatalogError(f"{root}/{RUN} is not a run: {bad}") from bad
    if said:
        raise CatalogError(f"{root}/{RUN} says more than a run does: {sorted(said)}")
    outputs = spark.read.schema(OUTPUT).option("mode", "FAILFAST").json(f"{root}/{OUTPUTS}")
    outside = outputs.where(F.col("file").startswith("/") | F.array_contains(F.split("file", "/"), "..") | F.col("file").isNull())
    refuse(outside.select(F.concat(F.coalesce("file", F.lit("an output without a file")), F.lit(" is not under the folder")).alias("problem")), root)
    held = files_under(spark, root).select(F.col("path").alias("file"), "content")
    return run, outputs.join(held, "file", "left")


def output_problems(run: Run, outputs: DataFrame, stored: DataFrame, types: Types) -> DataFrame:
    """(problem): what is wrong with outputs (file, origins, generation, content), given their stored forms (file, fault)."""
    where = lambda text: F.concat(F.col("file"), F.lit(f": {text}"))
    origins = F.coalesce("origins", F.array().cast(ORIGINS))
    keys = F.transform(origins, lambda o: F.concat_ws("|", o["checksum"], o["type"], F.coalesce(o["role"], F.lit(""))))
    checks = [
        F.when(F.col("content").isNull(), where("cannot be read")),
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), where("names an input twice in one role")),
        F.when(F.exists(origins, lambda o: ~F.coalesce(o["checksum"].rlike("^[0-9a-f]{64}$"), F.lit(False))), where("names an input by no sha256")),
        F.when(F.exists(origins, lambda o: ~F.coalesce(o["type"].rlike("^[^/]+/.*[^/]$"), F.lit(False))), where("names an input of no sample type")),
    ]
    if run.kind == "derive":
        checks += [
            F.when(F.size(origins) == 0, where("names no input")),
            F.when(F.exists(origins, lambda o: o["role"].isNotNull() | o["position"].isNotNull()), where("gives an input a role or position")),
            F.when(F.col("generation").isNotNull(), where("has a record of a generation")),
        ]
    else:
        checks += [F.when(F.exists(origins, lambda o: o["role"].isNull()), where("names an input in no role")), F.when(F.col("generation").isNull(), where("has no record of what generated it"))]
        for name, known in run.digests().items():
            given = F.col(f"generation.{name}")
            checks.append(F.when(given.isNotNull() & ~(given.isin(known) if known else F.lit(False)), where(f"names a {name} that the spec does not hold")))
    found = outputs.select(F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    unstored = stored.where("fault is not null").select(F.concat_ws(": ", "file", "fault").alias("problem"))
    facts = outputs.select("file", F.explode("origins").alias("o")).join(stored.select("file", "facts"), "file").select(F.col("file").alias("name"), merged(F.col("o.metadata"), F.col("facts")).alias("metadata"))
    wrong = key_faults(facts, types.declared([run.type])).select(F.concat_ws(": ", "name", "problem").alias("problem"))
    return found.union(unstored).union(wrong)
