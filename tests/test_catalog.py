import json

import pytest
from conftest import frame

from lodestack.catalog import Catalog
from lodestack.cli import main
from lodestack.functions.values import CatalogError
from lodestack.operators.selection import Spec, condition


def files(spark, *rows):
    return frame(spark, "path string, checksum string, length bigint, metadata string", *rows)


def test_a_catalogs_life(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    cat = Catalog.create(spark, root, "me")
    rows = [(f"p{n:02d}", f"{n:064x}", 3, json.dumps({"n": n, "who": f"a{n // 2}"})) for n in range(12)]
    ids = {r.path: r.id for r in cat.ingest(files(spark, *rows, ("p99", f"{0:064x}", 3, '{"n":99}')), "text", "email", ["a/b", "a"]).collect()}
    assert ids["p00"] == ids["p99"] and len(set(ids.values())) == 12
    assert cat.samples().where("metadata = '{\"n\":99}'").count() == 1
    again = {r.path: r.id for r in cat.ingest(files(spark, ("p01", f"{1:064x}", 3, None)), "text", "email").collect()}
    assert again["p01"] == ids["p01"] and cat.samples().where(f"id = {ids['p01']}").first().metadata is None
    cat.add_label_set("x", {"label_type": "classification", "classes": ["k"]})
    value = '{"kind":"choices","values":["k"]}'
    batch = frame(spark, "item bigint, sample_id bigint, value string", *[(n, i, value if n % 4 else None) for n, i in enumerate(sorted(set(ids.values())))])
    assert {r.verdict for r in cat.annotate(batch, "x", "human").collect()} == {"annotated", "skipped"}
    assert {r.verdict for r in cat.annotate(batch, "x", "model").collect()} == {"kept"}
    spec = Spec(("text/plain",), "x", ("a",), where=condition({"not": {"key": "n", "op": "in", "value": [5, "z"]}}))
    number, reused = cat.freeze("v", spec, 0.25, 0.2, 3, "who")
    assert not reused and cat.freeze("v", spec, 0.25, 0.2, 3, "who") == (number, True)
    members = {r.sample_id: r.side for r in cat.now.read("dataset_member").where(f"dataset_id = {number}").collect()}
    assert len(members) == 8 and cat.verify_dataset(number) == []
    # later changes do not touch the replay
    gone = spark.createDataFrame([(next(iter(members)),)], "id bigint")
    cat.tombstone(gone)
    cat.unskip(spark.createDataFrame([(i, 1) for i in ids.values()], "sample_id bigint, label_set_id bigint"))
    assert cat.verify_dataset(number) == []
    second, reused = cat.freeze("v", spec, 0.25, 0.2, 3, "who")
    assert not reused
    kept = {r.sample_id: r.side for r in cat.now.read("dataset_member").where(f"dataset_id = {second}").collect()}
    assert kept == {i: s for i, s in members.items() if i != next(iter(members))}
    cat.materialise(number, f"{tmp_path}/out", {"n": ("metadata", "n"), "tag": ("label_set", "x")})
    out = spark.read.parquet(f"{tmp_path}/out/members").collect()
    assert len(out) == 8 and all(r.reviewed and r.tag == value for r in out)
    with pytest.raises(CatalogError):
        cat.freeze("w", Spec(("text/plain",), "x", ("nowhere",)), 0.1, 0.1, 1)
    with pytest.raises(CatalogError):
        cat.annotate(batch, "none", "human")


def test_merging_a_copy(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/a"
    cat = Catalog.create(spark, root, "me")
    cat.ingest(files(spark, *[(f"p{n}", f"{n:064x}", 1, None) for n in range(3)]), "text", "plain")
    cat.add_label_set("x", {})
    cat.annotate(frame(spark, "item bigint, sample_id bigint, value string", (1, 1, "a")), "x", "human")
    assert main(["--catalog", root, "copy", "--to", f"file://{tmp_path}/b"], spark) == 0
    copy = Catalog(spark, f"file://{tmp_path}/b")
    copy.annotate(frame(spark, "item bigint, sample_id bigint, value string", (1, 1, "b"), (2, 2, "c")), "x", "human")
    verdicts = {r.sample_id: r.verdict for r in cat.merge(copy).collect()}
    assert verdicts == {1: "conflicted", 2: "copied"}
    assert cat.annotations().where("superseded_at is null").count() == 2 and cat.now.read("annotation_conflict").count() == 1
    other = Catalog.create(spark, f"file://{tmp_path}/o", "other")
    with pytest.raises(CatalogError):
        cat.merge(other)
    assert main(["--catalog", root, "types"], spark) == 0 and '"count": 3' in capsys.readouterr().out
    assert main(["--catalog", root, "remove"], spark) == 1
    assert main(["--catalog", root, "remove", "--checksum", f"{2:064x}"], spark) == 0
    assert cat.samples().where("deleted_at is null").count() == 2
    assert main(["--catalog", f"file://{tmp_path}/none", "probe"], spark) == 1


def test_imports_lists_and_runs(spark, tmp_path):
    from lodestack.sources.answers import SCHEMA

    cat = Catalog.create(spark, f"file://{tmp_path}/i", "me")
    cat.ingest(files(spark, *[(f"p{n}", f"{n:064x}", 1, None) for n in range(4)]), "text", "plain")
    cat.add_label_set("x", {})
    cat.annotate(frame(spark, "item bigint, sample_id bigint, value string", (1, 1, "a"), (2, 2, "b")), "x", "human")
    day = "2025-01-0{} 00:00:00".format
    rows = [("annotated", "q", "model", "b", day(1), day(2)), ("annotated", "z", "human", "b", day(2), None)]
    other = spark.createDataFrame([(1, "them", "x", f"{n:064x}", None, rows) for n in (0, 2, 3, 9)], SCHEMA)
    dry = {r.sample_id: r.verdict for r in cat.import_answers(other, dry_run=True).collect()}
    assert dry == {1: "conflicted", 3: "copied", 4: "copied"}
    cat.import_answers(other)
    log = cat.annotations()
    assert {(r.sample_id, r.value) for r in log.where("superseded_at is null").collect()} == {(1, "a"), (2, "b"), (3, "z"), (4, "z")}
    assert log.where("sample_id = 3").count() == 2  # its history came along
    assert {r.verdict for r in cat.import_answers(other).collect()} == {"conflicted", "already"}
    assert cat.annotations().count() == log.count()
    with pytest.raises(CatalogError):
        cat.import_answers(spark.createDataFrame([(1, "me", "x", "0", None, rows)], SCHEMA))

    sums = spark.createDataFrame([(f"{n:064x}",) for n in (0, 1)], "checksum string")
    assert cat.put_list("l", sums) == (1, False) and cat.put_list("l", sums) == (1, True) and cat.put_list("l", sums.limit(1), "text/plain") == (2, False)
    assert cat.lists(["l@1"])["l@1"].count() == 2
    with pytest.raises(CatalogError):
        cat.lists(["l@3"])

    found = spark.createDataFrame([("a", "1" * 64, 1), ("b", "2" * 64, 1), ("c", "1" * 64, 1)], "path string, checksum string, length bigint")
    assert cat.ingest_raw(found, "drop")["added"] == 3 and cat.ingest_raw(found, "drop")["held"] == 3
    for r in cat.now.read("run").where("kind = 'ingest'").collect():
        assert cat.verify_run(r.id) == []

    def halves(data, meta):
        return [(part, {"half": n}) for n, part in enumerate(data.split(b"|"))]

    spec = {"name": "halves", "stage": [{"name": "halves"}], "output": {"type": "text/note", "collection": "notes"}}
    inputs = spark.createDataFrame([("1" * 64, b"a|b"), ("2" * 64, b"b|c")], "checksum string, content binary")
    said = cat.prepare(inputs, spec, [halves], "notes")
    assert (said["inputs"], said["produced"], said["outputs"], said["samples"]) == (2, 2, 4, 3) and cat.verify_run(said["run"]) == []
    again = cat.prepare(inputs, spec, [halves], "notes")
    assert (again["already"], again["produced"]) == (2, 0)
    changed = spec | {"stage": [{"name": "halves", "v": 2}]}
    with pytest.raises(CatalogError):
        cat.prepare(inputs, changed, [halves], "notes")
    assert cat.samples().where("subtype = 'note'").count() == 3
