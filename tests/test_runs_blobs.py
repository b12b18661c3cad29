"""Prepared corpora, derive and generate runs, blobs, versions with lists and given splits, stages, configuration."""

import hashlib
import json

import pytest
from conftest import frame

from lodestack import stages
from lodestack.catalog import Catalog
from lodestack.config import find, load_catalogs
from lodestack.functions.values import CatalogError
from lodestack.operators.selection import Spec, condition
from lodestack.operators.versions import GivenSplit
from lodestack.sources import blobs, runs
from lodestack.types import SampleType, Types

CHOICE = '{"kind":"choices","values":["k"]}'


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def types():
    return Types(
        SampleType("text/plain"), SampleType("text/email"), SampleType("image/plain"),
        SampleType("text/made", generated=True, keys={"score": "number"}, facts=lambda b: {"bytes": len(b)}),
        SampleType("text/pair", example=True, inputs=("question",), keys={"question": "string"}),
    )


def catalog(spark, path, n=24):
    cat = Catalog.create(spark, f"file://{path}/cat", "me")
    cat.types = types()
    rows = [(f"p{k:02d}", f"{k:064x}", 3, json.dumps({"n": k, "who": f"a{k // 2}", "bench": "h" if k < 4 else "t"})) for k in range(n)]
    cat.ingest(frame(spark, "path string, checksum string, length bigint, metadata string", *rows), "text", "email", ["a"])
    cat.add_label_set("x", {"label_type": "classification", "classes": ["k", "l"]})
    cat.annotate(frame(spark, "item bigint, sample_id bigint, value string", *[(k, k + 1, CHOICE) for k in range(n)]), "x", "human")
    return cat


def sides(cat, number):
    return {r.sample_id: r.side for r in cat.now.read("dataset_member").where(f"dataset_id = {number}").collect()}


def test_versions_with_lists_and_given_splits(spark, tmp_path):
    cat = catalog(spark, tmp_path)
    assert cat.now.read("annotation_class").count() == 24
    for bad in ('{"kind":"choices","values":["z"]}', '{"kind":"spans","values":[]}'):
        with pytest.raises(CatalogError):
            cat.annotate(frame(spark, "item bigint, sample_id bigint, value string", (1, 1, bad)), "x", "human")
    sums = lambda *ks: spark.createDataFrame([(f"{k:064x}",) for k in ks], "checksum string")
    cat.put_list("out", sums(0, 1))
    cat.put_list("hold", sums(8, 9))
    spec = Spec(("text/email",), "x", ("a",), where=condition({"key": "n", "op": "<", "value": 20}), exclude=("out@1",))
    number, _ = cat.freeze("v", spec, 0.2, 0.1, 3, "who")
    assert set(sides(cat, number)) == set(range(3, 21)) and cat.verify_dataset(number) == []
    assert cat.freeze("v", spec, 0.2, 0.1, 3, "who") == (number, True)
    with pytest.raises(CatalogError):
        cat.freeze("v", Spec(("text/email",), "x", where=condition({"key": "nope", "op": "==", "value": 1})))
    for wrong in ({}, {"spec": spec, "ids": spark.range(1)}, {"spec": spec, "label_set": "y"}, {"ids": spark.range(900, 901), "label_set": "x"}):
        with pytest.raises(CatalogError):
            cat.freeze("w", **wrong)

    ids = spark.range(1, 25)
    given, _ = cat.freeze("g", ids=ids, label_set="x", val_ratio=0.2, seed=1, given=GivenSplit("bench", ("h",)), given_lists={"holdout": ["hold@1"]})
    got = sides(cat, given)
    assert {i for i, s in got.items() if s == "holdout"} == {1, 2, 3, 4, 9, 10}
    with pytest.raises(CatalogError):
        cat.freeze("g", ids=ids, label_set="x", val_ratio=0.2, seed=1, given=GivenSplit("bench", ("t",)))
    with pytest.raises(CatalogError):
        cat.verify_dataset(given)
    fresh, reused = cat.freeze("g", ids=ids, label_set="x", val_ratio=0.2, seed=2, given=GivenSplit("bench", ("h",)), inherit=False)
    assert not reused and cat.freeze("g", ids=ids, label_set="x", val_ratio=0.2, seed=2, given=GivenSplit("bench", ("h",)), inherit=False) == (fresh, True)

    said = stages.materialise(cat, number, f"{tmp_path}/out", features={"tag": ("label_set", "x")})
    assert (said["samples"], said["skipped"], said["reused"]) == (18, 0, False)
    assert stages.materialise(cat, number, f"{tmp_path}/out", features={"tag": ("label_set", "x")})["reused"]
    assert not stages.materialise(cat, number, f"{tmp_path}/out")["reused"]
    kept = stages.split(cat, f"{tmp_path}/out")
    assert not kept.drawn and sum(kept.counts.values()) == 18
    drawn = stages.split(cat, f"{tmp_path}/out", seed=4, val_ratio=0.3, group_by="who")
    assert drawn.drawn and drawn.path.startswith(f"{tmp_path}/out-split-") and sum(drawn.counts.values()) == 18 and drawn.counts["holdout"] == 0
    assert stages.split(cat, f"{tmp_path}/out", seed=4, val_ratio=0.3, group_by="who") == drawn
    with pytest.raises(CatalogError):
        stages.apply_sides(cat, f"{tmp_path}/out", spark.createDataFrame([(3, "val")], "id bigint, side string"), "few")
    assert stages.dataset(cat, "v", spec, pinned=1) == {"dataset": number, "reused": True, "groups_cut": 0}
    with pytest.raises(CatalogError):
        stages.dataset(cat, "v", spec, pinned=9)


def test_conflicts_open_and_end(spark, tmp_path):
    from lodestack import store as ST

    cat = catalog(spark, tmp_path, 4)
    cat.put_list("l", spark.createDataFrame([(f"{1:064x}",)], "checksum string"))
    ST.copy_index(cat.now, ST.Store(spark, f"file://{tmp_path}/copy"))
    copy = Catalog(spark, f"file://{tmp_path}/copy", types())
    copy.annotate(frame(spark, "item bigint, sample_id bigint, value string", (1, 1, '{"kind":"choices","values":["l"]}')), "x", "human")
    copy.put_list("l", spark.createDataFrame([(f"{2:064x}",)], "checksum string"))
    cat.merge(copy)
    assert [(r.sample_id, r.kept_value, r.other_origin) for r in cat.conflicts().collect()] == [(1, CHOICE, "merge")]
    assert cat.lists(["l@2"])["l@2"].count() == 1
    number, _ = cat.freeze("v", ids=spark.range(1, 5), label_set="x", val_ratio=0.3)
    assert [r.id for r in cat.disputed_members(number).collect()] == [1]
    cat.annotate(frame(spark, "item bigint, sample_id bigint, value string", (1, 1, CHOICE)), "x", "human")
    assert cat.conflicts().count() == 0 and cat.disputed_members(number).count() == 0
    cat.put_list("l", spark.createDataFrame([(f"{3:064x}",)], "checksum string"))
    copy.put_list("l", spark.createDataFrame([(f"{1:064x}",)], "checksum string"))
    with pytest.raises(CatalogError):
        cat.merge(copy)


def output(file, origins, generation, content):
    return (file, origins, generation, content)


def test_derive_and_generate_runs(spark, tmp_path):
    cat = catalog(spark, tmp_path, 4)
    schema = f"{runs.OUTPUT}, content binary"
    one = lambda k, role=None, meta=None: (f"{k:064x}", "text/email", role, None, meta)
    derive = runs.Run("derive", "text/note", ("notes",), "cutter", {"rule": 1}, left_out={"short": 2})
    rows = [output("a", [one(0, meta='{"part":1}'), one(1)], None, b"first"), output("b", [one(0, meta='{"part":2}')], None, b"second\r\n"), output("c", [one(2)], None, b"first")]
    said = cat.commit_run(derive, frame(spark, schema, *rows))
    assert (said["outputs"], said["samples"], said["new_samples"], said["origins"]) == (3, 2, 2, 4) and cat.verify_run(said["run"]) == []
    notes = {r.checksum: r.metadata for r in cat.samples().where("subtype = 'note'").collect()}
    assert {k: json.loads(v) if v else v for k, v in notes.items()} == {sha("first"): {"part": 1}, sha("second\n"): {"part": 2}}
    again = cat.commit_run(derive, frame(spark, schema, output("z", [one(3, meta='{"more":"x\\"y"}')], None, b"first")))
    assert again["new_samples"] == 0
    assert json.loads(cat.by_checksum(sha("first")).metadata) == {"part": 1, "more": 'x"y'}
    before = cat.now.version
    bad = [output("a", [], None, b"x"), output("b", [one(0, "r")], None, b"y"), output("c", [one(0), one(0)], None, b"\xff"), output("d", [one(0)], None, None)]
    for run, outputs in (
        (derive, bad), (derive, [output("a", [("f" * 64, "text/email", None, None, None)], None, b"x")]), (runs.Run("derive", "text/made", ("n",), "p", {"a": 1}), rows), (runs.Run("generate", "text/note", ("n",), "p", {"a": 1}), rows),
        (runs.Run("derive", "text/note", (), "p", {"a": 1}), rows), (runs.Run("derive", "text/note", ("n",), "p", {}), rows), (runs.Run("derive", "text/note", ("n",), "p", {"a": 1}), []), (runs.Run("import", "text/note", ("n",), "p", {"a": 1}), rows),
    ):
        with pytest.raises(CatalogError):
            cat.commit_run(run, frame(spark, schema, *outputs) if outputs else spark.createDataFrame([], schema))
    assert cat.now.version == before

    spec = {"template": ["say {x}", "tell {x}"], "settings": {"heat": 1}}
    generate = runs.Run("generate", "text/made", ("made",), "model", spec)
    made = lambda **kw: tuple(kw.get(k) for k in ("model_host", "model_run", "checkpoint", "checkpoint_digest", "template_digest", "system_digest", "settings_digest", "values", "copied_from", "seed"))
    digest = generate.digests()["template_digest"][1]
    good = [output("o1", [one(1, "x")], made(template_digest=digest, seed=1, copied_from=[(f"{2:064x}", "text/email", "who")]), b"out"), output("o2", [one(1, "x")], made(template_digest=digest, seed=2), b"out"), output("o3", [], made(), b"alone")]
    said = cat.commit_run(generate, frame(spark, schema, *good))
    assert (said["samples"], said["origins"], said["generations"]) == (2, 1, 3) and cat.verify_run(said["run"]) == []
    assert json.loads(cat.by_checksum(sha("out")).metadata) == {"bytes": 3}
    for wrong in (made(template_digest="0" * 64), made(copied_from=[(f"{2:064x}", "text/email", "none")]), None):
        with pytest.raises(CatalogError):
            cat.commit_run(generate, frame(spark, schema, output("o", [one(1, "x")], wrong, b"out")))
    with pytest.raises(CatalogError):
        cat.commit_run(generate, frame(spark, schema, output("o", [one(1, "x", '{"score":"high"}')], made(), b"out")))
    with pytest.raises(CatalogError):
        cat.ingest(frame(spark, "path string, checksum string, length bigint, metadata string", ("p", "a" * 64, 1, None)), "text", "made")

    # a run of a folder
    folder = tmp_path / "run"
    (folder / "out").mkdir(parents=True)
    (folder / "out" / "n.txt").write_text("third")
    (folder / "run.json").write_text(json.dumps({"kind": "derive", "type": "text/note", "collections": ["notes"], "producer": "p", "spec": {"a": 1}}))
    (folder / "outputs.jsonl").write_text(json.dumps({"file": "out/n.txt", "origins": [{"checksum": f"{0:064x}", "type": "text/email", "metadata": {"k": True}}]}))
    assert cat.commit_directory(str(folder))["new_samples"] == 1 and json.loads(cat.by_checksum(sha("third")).metadata) == {"k": True}
    (folder / "outputs.jsonl").write_text(json.dumps({"file": "../n.txt", "origins": []}))
    with pytest.raises(CatalogError):
        cat.commit_directory(str(folder))
    with pytest.raises(CatalogError):
        cat.commit_directory(str(tmp_path / "none"))


def test_examples_whose_inputs_disagree(spark, tmp_path):
    cat = catalog(spark, tmp_path, 4)
    schema = f"{runs.OUTPUT}, content binary"
    one = lambda k, q: (f"{k:064x}", "text/email", None, None, json.dumps({"question": q}))
    run = runs.Run("derive", "text/pair", ("pairs",), "p", {"a": 1})
    cat.commit_run(run, frame(spark, schema, output("a", [one(0, "same  thing"), one(1, "same thing")], None, b"agreed"), output("b", [one(0, "this"), one(1, "that")], None, b"disputed"), output("c", [one(2, "only")], None, b"single")))
    ids = cat.samples().where("subtype = 'pair'").select("id")
    number, _ = cat.freeze("e", ids=ids, label_set="x", val_ratio=0.4, disagreeing="drop")
    assert len(sides(cat, number)) == 2 and cat.dataset(number).disagreeing_inputs == "drop"
    number, _ = cat.freeze("f", ids=ids, label_set="x", val_ratio=0.4, disagreeing="first")
    assert len(sides(cat, number)) == 3 and json.loads(cat.dataset(number).selection) == {"inputs:disagreeing": 1, "inputs:kept_first": 1}
    with pytest.raises(CatalogError):
        cat.freeze("e", ids=cat.samples().where(f"checksum = '{sha('disputed')}'").select("id"), label_set="x")
    with pytest.raises(CatalogError):
        stages.materialise(cat, number, f"{tmp_path}/o", features={"question": ("metadata", "question")})


def test_prepared_corpus(spark, tmp_path):
    cat = catalog(spark, tmp_path, 2)
    root = tmp_path / "corpus"
    (root / "d").mkdir(parents=True)
    for name, text in (("a.txt", "one\n"), ("d/b.txt", "two\r\n"), ("extra.txt", "more")):
        (root / name).write_bytes(text.encode())
    index = {"version": 1, "type": "text/email", "produced_by": "preparer 2", "samples": {"a.txt": {"metadata": {"lang": "en"}, "value": json.loads(CHOICE)}, "d/b.txt": {"metadata": {}}}}
    (root / "prepared.json").write_text(json.dumps(index))
    assert cat.intake(str(root), "text/email", ["in"], "x") == {"samples": 2, "unindexed": 1, "answers": 1}
    assert json.loads(cat.by_checksum(sha("one\n")).metadata) == {"lang": "en", "source_path": "a.txt"} and cat.by_checksum(sha("two\n"))
    row = cat.annotations().where("source = 'import'").first()
    assert row.batch == "preparer 2" and json.loads(row.value) == json.loads(CHOICE)
    before = cat.now.version
    index["samples"]["d/b.txt"]["value"] = json.loads(CHOICE)  # its bytes are not in stored form
    (root / "prepared.json").write_text(json.dumps(index))
    for change in (None, {"type": "text/plain"}, {"samples": {"gone.txt": {"metadata": {}}}}, {"samples": 3}):
        if change:
            (root / "prepared.json").write_text(json.dumps(index | change))
        with pytest.raises(CatalogError):
            cat.intake(str(root), "text/email", ["in"])
    (root / "prepared.json").unlink()
    with pytest.raises(CatalogError):
        cat.intake(str(root), "text/email", ["in"])
    with pytest.raises(CatalogError):
        cat.intake(str(root), "text/made", ["in"])
    assert cat.now.version == before


def test_blobs_repack_and_files_of_a_version(spark, tmp_path):
    cat = Catalog.create(spark, f"file://{tmp_path}/cat", "me")
    source, shards, cache = f"{tmp_path}/blobs", f"{tmp_path}/shards", f"{tmp_path}/cache"
    root = tmp_path / "in"
    root.mkdir()
    for k in range(12):
        (root / f"f{k:02d}.TXT").write_bytes(b"\xef\xbb\xbf" * (k == 3) + f"text {k} ".encode() * (k * 40 + 1))
    ids = cat.ingest_files(str(root), "text/email", ["a"], blobs=source)
    assert ids.count() == 12
    third = next(json.loads(r.metadata) for r in cat.samples().collect() if "f03" in r.metadata)
    assert third["canonicalised"] is True and third["source_checksum"] == hashlib.sha256((root / "f03.TXT").read_bytes()).hexdigest()
    hashed = {r.path: r.checksum for r in blobs.hash_files(spark.createDataFrame([("f01.TXT",)], "path string"), str(root)).collect()}
    assert hashed == {"f01.TXT": hashlib.sha256((root / "f01.TXT").read_bytes()).hexdigest()}
    assert cat.probe(source)["reads_back"]
    plan = cat.repack(source, shards, shard_bytes=8192, dry_run=True)
    assert plan["blobs"] == 12 and plan["shards"] > 1 and cat.locations().where("container like 'shard-%'").count() == 0
    done = cat.repack(source, shards, shard_bytes=8192, verify=5, batch=2)
    assert done["blobs"] == 12 and done["verified"] >= done["shards"]
    assert cat.locations().where("container like 'shard-%'").count() == 12 and cat.repack(source, shards)["blobs"] == 0
    with pytest.raises(CatalogError):
        cat.repack(source, shards, shard_bytes=1 << 31)
    cached = cat.ensure_cached(cat.samples().select("checksum").union(spark.createDataFrame([("0" * 64,)], "checksum string")), shards, cache)
    assert {hashlib.sha256(open(r.path, "rb").read()).hexdigest() == r.checksum for r in cached.collect()} == {True}
    cat.add_label_set("x", {})
    cat.annotate(cat.samples().selectExpr("id as item", "id as sample_id", "'v' as value"), "x", "human")
    number, _ = cat.freeze("v", ids=cat.samples().select("id"), label_set="x", val_ratio=0.25)
    assert not cat.materialise(number, f"{tmp_path}/out", blobs=shards, cache=cache)
    rows = spark.read.parquet(f"{tmp_path}/out/members").collect()
    assert all(r.path == f"{r.checksum}.txt" and hashlib.sha256(open(f"{tmp_path}/out/files/{r.path}", "rb").read()).hexdigest() == r.checksum for r in rows)
    assert cat.find(rows[0].checksum, "text/email") == rows[0].id and cat.identities(ids.select("id")).where("container is not null").count() == 12
    assert cat.values_of(ids.select("id"), "x").count() == 12
    with pytest.raises(CatalogError):
        cat.remove()
    cat.remove(where=condition({"key": "source_path", "op": "==", "value": "f01.TXT"}))
    assert cat.samples().where("deleted_at is null").count() == 11
    open(f"{shards}/shard-00000000.tar", "r+b").write(b"x" * 2000)
    with pytest.raises(Exception, match="is not"):
        blobs.fetch(cat.locations(), shards).collect()


def test_answers_move_with_paired_texts(spark, tmp_path):
    from lodestack.sources.answers import SCHEMA

    cat = catalog(spark, tmp_path, 3)
    cat.add_label_set("s", {"label_type": "span", "classes": ["T"]})
    value = '{"kind":"spans","values":[{"labels":["T"],"start":4,"end":7,"text":"cat"}]}'
    exported = spark.createDataFrame([(1, "them", "other", "e" * 64, None, [("annotated", value, "human", "b", "2025-01-01 00:00:00", None)])], SCHEMA)
    pairs = spark.createDataFrame([("e" * 64, f"{0:064x}")], "old string, new string")
    texts = spark.createDataFrame([("e" * 64, "the cat sat"), (f"{0:064x}", "so the cat sat")], "checksum string, text string")
    assert [r.verdict for r in cat.import_answers(exported, into="s", pairs=pairs, texts=texts).collect()] == ["copied"]
    held = cat.values_of(spark.range(1, 2), "s").first()
    assert json.loads(held.value)["values"][0]["start"] == 7
    with pytest.raises(CatalogError):
        cat.import_answers(exported, into="nothing")


def test_types_and_configuration(tmp_path, monkeypatch):
    held = types()
    assert held.resolve("text/email/old").name == "text/email" and held.resolve("text/x").name == "text/plain" and held.resolve("audio/x").name == "audio/x"
    assert held.declared(["text/plain"]) == {"score": "number", "question": "string"}
    for bad in (lambda: held.example("text/pair/old"), lambda: held.register(SampleType("text/b", keys={"score": "string"}))):
        with pytest.raises(CatalogError):
            bad()
    path = tmp_path / "c.toml"
    path.write_text('[catalogs.main]\nroot = "file:///c"\ncache = "/k"\n')
    assert find(str(path), "main").cache == "/k"
    monkeypatch.setenv("LODESTACK_SECRET_MAIN", "s")
    assert find(str(path), "main").secret == b"s"
    with pytest.raises(CatalogError):
        find(str(path), "other")
    for text in ('[catalogs.main]\ncache = "x"\n', '[catalogs.main]\nroot = "x"\nsecret = "y"\n', "nothing", '[catalogs.main]\nroot = "x"\nspeed = 1\n'):
        path.write_text(text)
        with pytest.raises(CatalogError):
            load_catalogs(str(path))


def stages_of(spec):
    return [lambda data, meta: [(data.upper(), meta)]]


def test_command_line(spark, tmp_path, capsys):
    from lodestack.cli import main

    config, stock = tmp_path / "c.toml", tmp_path / "stock"
    config.write_text(f'[catalogs.one]\nroot = "file://{tmp_path}/cat"\nblobs = "{stock}"\n')
    (tmp_path / "in").mkdir()
    for n in range(6):
        (tmp_path / "in" / f"f{n}.txt").write_text(f"text {n}")

    def call(*argv, fails=False):
        assert main(["--config", str(config), "--catalog", "one", *argv], spark) == int(fails)
        out = capsys.readouterr()
        return out.err if fails else json.loads(out.out)

    assert call("list") == {"one": f"file://{tmp_path}/cat"} and call("create", "--identity", "me") == "me"
    assert call("ingest", str(tmp_path / "in"), "--type", "text/plain", "--collection", "a") == {"samples": 6}
    assert call("ingest", str(tmp_path / "in"), "--collection", "r")[0]["added"] == 6 and len(call("raw", "ls", "--collection", "r")) == 6
    cat = Catalog(spark, f"file://{tmp_path}/cat")
    cat.add_label_set("x", {})
    cat.annotate(cat.samples().selectExpr("id as item", "id as sample_id", "'v' as value"), "x", "human")
    said = call("stats")
    assert said["samples"] == 6 and said["uncollected"] == 0 and said["label_sets"] == [{"name": "x", "annotated": 6, "skipped": 0, "awaiting": 0}]
    assert call("probe")["reads_back"] and call("types")[0]["count"] == 6
    (tmp_path / "l.txt").write_text("\n".join(r.checksum for r in cat.samples().orderBy("id").limit(2).collect()))
    assert call("lists", "put", "l", "--file", str(tmp_path / "l.txt")) == {"list": "l@1", "reused": False} and len(call("lists", "show", "l@1")) == 2 and len(call("lists", "ls")) == 1
    (tmp_path / "s.toml").write_text('[select]\ntypes = ["text/plain"]\nlabel_set = "x"\n[select.lists]\nexclude = ["l@1"]\n')
    number = call("dataset", "freeze", "v", "--spec", str(tmp_path / "s.toml"), "--val", "0.3")["dataset"]
    assert call("dataset", "verify", str(number)) == []
    (tmp_path / "p.toml").write_text('name = "up"\n[[stage]]\nname = "upper"\n[output]\ntype = "text/note"\ncollection = "n"\n')
    (tmp_path / "names.txt").write_text("r/f0.txt\nr/none.txt\n")
    wanted = ("prepare", str(tmp_path / "p.toml"), "--files", str(tmp_path / "names.txt"), "--stages", "test_runs_blobs:stages_of")
    assert "none.txt" in call(*wanted, fails=True) and call(*wanted, "--allow-missing")["produced"] == 1
    run = call("runs", "--kind", "prepare")[0]["id"]
    assert call("verify", "--run", run) == [] and "nowhere" in call("verify", "--run", run, "--deep")[0]
    assert call("repack", "--to", str(tmp_path / "sh"), "--dry-run")["blobs"] == 6
    assert call("copy", "--to", f"file://{tmp_path}/two") and call("merge", "--from", f"file://{tmp_path}/two") == [{"verdict": "agreed", "count": 6}]
    assert call("export-answers", "x", "--to", str(tmp_path / "ans")) and "this catalog" in call("import-answers", str(tmp_path / "ans"), fails=True)
    call("remove", fails=True)
    assert call("remove", "--where", "source_path=f1.txt") and cat.samples().where("deleted_at is not null").count() == 1
    call("commit", str(tmp_path / "none"), fails=True)
