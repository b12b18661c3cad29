"""Command line: ``python -m lodestack.cli --catalog ROOT VERB``, or ``--config FILE --catalog NAME``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import functions as F

from lodestack import store
from lodestack.catalog import Catalog
from lodestack.config import Named, find
from lodestack.functions.values import CatalogError, parse_ref
from lodestack.operators.selection import Compare, Group, Spec, literal
from lodestack.session import local_session, ship
from lodestack.sources import answers, files


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestack")
    parser.add_argument("--catalog", help="a folder, or with --config a name")
    parser.add_argument("--config", help="a TOML file of named catalogs")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, *arguments: tuple, **flags: dict) -> argparse.ArgumentParser:
        made = verbs.add_parser(name)
        for a in arguments:
            made.add_argument(a)
        for flag, how in flags.items():
            made.add_argument(f"--{flag.replace('_', '-')}", **how)
        return made

    many, yes, number = {"action": "append", "default": []}, {"action": "store_true"}, {"type": int}
    verb("list")
    verb("create", identity={})
    verb("types")
    verb("stats")
    verb("probe")
    verb("copy", to={"required": True})
    verb("merge", apply=yes).add_argument("--from", dest="source", required=True)
    verb("repack", to={"required": True}, dry_run=yes, shard_mb=number, verify=number | {"default": 64}, seed=number | {"default": 0})
    verb("ingest", "root", collection=many | {"required": True}, type={}, files={}, prepared=yes, label_set={})
    verb("prepare", "spec", files={"required": True}, stages={"required": True, "help": "module:function that makes the stages of a spec"}, allow_missing=yes, continues={})
    verb("commit", "directory")
    raw = verbs.add_parser("raw").add_subparsers(dest="raw", required=True)
    raw.add_parser("ls").add_argument("--collection")
    verb("export-answers", "label_set", to={"required": True}, source=many)
    verb("import-answers", "path", into={}, pairs={}, dry_run=yes)
    verb("runs", kind={})
    verb("verify", run={"required": True}, deep=yes)
    dataset = verbs.add_parser("dataset").add_subparsers(dest="dataset", required=True)
    dataset.add_parser("verify").add_argument("number", type=int)
    freeze = dataset.add_parser("freeze")
    freeze.add_argument("name")
    freeze.add_argument("--spec", required=True)
    for flag, kind, default in (("--val", float, 0.1), ("--holdout", float, 0.0), ("--seed", int, 0)):
        freeze.add_argument(flag, type=kind, default=default)
    freeze.add_argument("--group-by")
    freeze.add_argument("--disagreeing", default="drop")
    freeze.add_argument("--afresh", action="store_true")
    lists = verbs.add_parser("lists").add_subparsers(dest="lists", required=True)
    put = lists.add_parser("put")
    put.add_argument("name")
    put.add_argument("--file", required=True)
    put.add_argument("--type")
    lists.add_parser("show").add_argument("ref")
    lists.add_parser("ls")
    verb("remove", collection=many, checksum=many, where=many | {"help": "key=value"}, type={})
    return parser


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _arguments().parse_args(argv)
    spark = spark or local_session()
    ship(spark)
    try:
        if args.verb == "list":
            from lodestack.config import load_catalogs

            said = {n: c.root for n, c in load_catalogs(args.config or "").items()}
        else:
            if not args.catalog:
                raise CatalogError("which catalog?")
            said = run(args, spark, find(args.config, args.catalog) if args.config else Named("", args.catalog))
    except CatalogError as refused:
        print(refused, file=sys.stderr)
        return 1
    print(json.dumps(said, default=str))
    return 0


def run(args: argparse.Namespace, spark, place: Named) -> object:
    if args.verb == "create":
        return Catalog.create(spark, place.root, args.identity).identity()
    catalog = Catalog(spark, place.root)
    rows = lambda df: [r.asDict() for r in df.collect()]

    def blobs() -> str:
        if not place.blobs:
            raise CatalogError("the configuration names no blobs of this catalog")
        return place.blobs

    match args.verb:
        case "stats":
            return _stats(catalog, rows)
        case "types":
            return rows(catalog.samples().where("deleted_at is null").groupBy("media", "subtype").count().orderBy("media", "subtype"))
        case "probe":
            return catalog.probe(place.blobs)
        case "runs":
            held = catalog.now.read("run").select("id", "kind", "producer", "counts").orderBy("id")
            return rows(held.where(F.col("kind") == args.kind) if args.kind else held)
        case "copy":
            return store.copy_index(catalog.now, store.Store(spark, args.to))
        case "merge":
            return rows(catalog.merge(Catalog(spark, args.source), dry_run=not args.apply).groupBy("verdict").count())
        case "repack":
            return catalog.repack(blobs(), args.to, args.shard_mb * 1024 * 1024 if args.shard_mb else None, args.dry_run, args.verify, args.seed)
        case "ingest" if args.prepared:
            return catalog.intake(args.root, _type(args), args.collection, args.label_set)
        case "ingest" if args.type:
            return {"samples": catalog.ingest_files(args.root, args.type, args.collection, listed=_lines(spark, args.files), blobs=place.blobs).select("id").distinct().count()}
        case "ingest":
            return [catalog.ingest_raw(files.files_under(spark, args.root, _lines(spark, args.files)).select("path", "checksum", "length"), c) for c in args.collection]
        case "prepare":
            return _prepare(args, spark, catalog, blobs())
        case "commit":
            return catalog.commit_directory(args.directory)
        case "raw":
            held = catalog.now.read("raw")
            return rows((held.where(F.col("collection") == args.collection) if args.collection else held).select("collection", "path", "checksum").orderBy("collection", "path"))
        case "export-answers":
            at = catalog.now
            answers.write_answers(answers.export_answers(catalog.samples(), catalog.annotations(), at.read("label_set"), args.label_set, catalog.identity(), args.source or None), args.to)
            return args.to
        case "import-answers":
            pairs = files.read_pairs(spark, args.pairs) if args.pairs else None
            return rows(catalog.import_answers(answers.read_answers(spark, args.path), args.dry_run, args.into, pairs).groupBy("verdict").count())
        case "verify":
            return catalog.verify_run(args.run, blobs() if args.deep else None)
        case "dataset" if args.dataset == "verify":
            return catalog.verify_dataset(args.number)
        case "dataset":
            with open(args.spec) as f:
                spec = Spec.from_toml(f.read())
            number, reused = catalog.freeze(args.name, spec, args.val, args.holdout, args.seed, args.group_by, disagreeing=args.disagreeing, inherit=not args.afresh)
            return {"dataset": number, "reused": reused}
        case "lists" if args.lists == "put":
            version, reused = catalog.put_list(args.name, files.read_lines(spark, args.file).withColumnRenamed("item", "checksum"), args.type)
            return {"list": f"{args.name}@{version}", "reused": reused}
        case "lists" if args.lists == "show":
            parse_ref(args.ref)
            return [r.checksum for r in catalog.lists([args.ref])[args.ref].orderBy("checksum").toLocalIterator()]
        case "lists":
            return rows(catalog.now.read("list_version").select("name", "version", "size", "digest").orderBy("name", "version"))
        case "remove":
            where = [Compare(key, "==", literal(value)) for key, _, value in (w.partition("=") for w in args.where)]
            return catalog.remove(args.collection, Group("all", tuple(where)) if where else None, args.checksum, args.type)


def _type(args: argparse.Namespace) -> str:
    if not args.type:
        raise CatalogError("of which type?")
    return args.type


def _lines(spark, path: str | None) -> list[str] | None:
    return [r.item for r in files.read_lines(spark, path).collect()] if path else None


def _stats(catalog: Catalog, rows) -> dict:
    """All samples, memberships by collection, samples in none, and per label set how many are answered, skipped and await a person, and how many assert each class."""
    from lodestack.functions.values import asserted

    at = catalog.now
    samples, held = catalog.samples(), at.read("sample_collection")
    live = samples.where("deleted_at is null").select(F.col("id").alias("sample_id"))
    said = catalog.annotations().where("superseded_at is null").join(live, "sample_id", "left_semi").join(F.broadcast(at.read("label_set").select(F.col("id").alias("label_set_id"), "name")), "label_set_id")
    answered = F.col("state") == "annotated"
    n = lambda c: F.countDistinct(F.when(c, F.col("sample_id")))
    return {
        "samples": samples.count(),
        "collections": rows(held.groupBy("collection").count().orderBy("collection")),
        "uncollected": samples.join(held.select(F.col("sample_id").alias("id")), "id", "left_anti").count(),
        "label_sets": rows(said.groupBy("name").agg(n(answered).alias("annotated"), n(~answered).alias("skipped"), n(answered & (F.col("source") == "import")).alias("awaiting")).orderBy("name")),
        "classes": rows(said.where(answered).select("name", "sample_id", F.explode(asserted(F.col("value"))).alias("class")).groupBy("name", "class").agg(F.countDistinct("sample_id").alias("n")).orderBy("name", "class")),
    }


def _prepare(args: argparse.Namespace, spark, catalog: Catalog, root: str) -> dict:
    """Run the chain of a spec over the raw files that a list of names or checksums resolves to."""
    import tomllib

    from lodestack.operators.views import longest_collection
    from lodestack.sources.blobs import fetch

    with open(args.spec, "rb") as f:
        spec = tomllib.load(f)
    module, _, name = args.stages.partition(":")
    stages = getattr(importlib.import_module(module), name)(spec)
    named, raw = files.read_lines(spark, args.files).withColumnRenamed("item", "name"), catalog.now.read("raw")
    plain = named.where(F.col("name").rlike("^[0-9a-f]{64}$")).select("name", F.col("name").alias("checksum"))
    inside = longest_collection(named, raw).withColumn("path", F.substr("name", F.length("collection") + 2))
    found = plain.join(raw.select("checksum").distinct(), "checksum", "left_semi").select("name", "checksum").union(inside.join(raw.select("collection", "path", "checksum"), ["collection", "path"]).select("name", "checksum"))
    missing = [r.name for r in named.join(found, "name", "left_anti").orderBy("name").take(20)]
    if missing and not args.allow_missing:
        raise CatalogError(f"not there: {missing}")
    located = catalog.locations().join(found.select("checksum"), "checksum", "left_semi")
    return catalog.prepare(fetch(located, root), spec, stages, spec["output"]["collection"], args.continues)


if __name__ == "__main__":
    sys.exit(main())
