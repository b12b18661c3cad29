import hashlib
import io
import json
import tarfile

import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack import store as ST
from lodestack.functions import signing
from lodestack.functions.values import CatalogError
from lodestack.operators import lineage, versions
from lodestack.operators.components import components
from lodestack.operators.remap import remap_spans
from lodestack.sources import answers, blobs, files


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1, 1), (None, 3), (500, 501), (501, 502)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "x bigint, node bigint").repartition(7)
    # a chunk of two edges forces every level to be spread over tasks
    for chunk in (400_000, 2):
        got = {r.node: r.root for r in components(df, chunk).collect()}
        assert got == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0


def test_ascending_chain_is_contracted_in_few_rounds(spark, monkeypatch):
    from lodestack.operators import components as module

    rounds, once = [], module.contraction
    monkeypatch.setattr(module, "contraction", lambda pairs, step: rounds.append(step) or once(pairs, step))
    n, chunk = 12_000, 400
    monkeypatch.setattr(module, "CHUNK", chunk)
    chain = spark.range(n).selectExpr("id + 5 as a", "id + 6 as b").repartition(30)
    found = components(chain, chunk).groupBy("root").count().collect()
    assert [(r.root, r["count"]) for r in found] == [(5, n + 1)]
    # by halves on average, three quarters at the worst expected
    assert 2 <= len(rounds) <= 12


@given(st.lists(st.integers(1, 9), min_size=3, max_size=40), st.integers(0, 5), st.sampled_from([0.0, 0.1, 0.3]), st.sampled_from([0.1, 0.25]))
@settings(max_examples=60, deadline=None)
def test_draw_keeps_units_whole_and_comes_near(sizes, seed, holdout, val):
    units = list(enumerate(sizes))
    total = sum(sizes)
    drawn = versions.draw(units, total, {}, val, holdout, seed)
    assert set(drawn) == {u for u, _ in units}
    assert drawn == versions.draw(units, total, {}, val, holdout, seed)
    of = lambda side: sum(s for u, s in units if drawn[u] == side)
    assert of("val") > 0
    assert (of("holdout") > 0) if holdout else (of("holdout") == 0)
    assert abs(of("val") - round(total * val)) <= max(sizes)


def test_a_side_is_forced_by_all_units_not_given():
    # one unit is left to draw; with two others inherited there are three, so an empty holdout takes it
    assert versions.draw([(7, 1)], 100, {"val": 10}, 0.1, 0.001, 3) == {7: "train"}
    assert versions.draw([(7, 1)], 100, {"val": 10}, 0.1, 0.001, 3, units=3) == {7: "holdout"}


def test_ranked_sides(spark, monkeypatch):
    monkeypatch.setattr(versions, "STREAM_UNITS", 10)
    members = spark.range(2000).selectExpr("id", "concat('g', id div 2) as grp", "cast(id as string) as checksum")
    rows = {r.id: r.side for r in versions.assign_sides(members, 0.2, 0.1, 5).collect()}
    count = lambda side: sum(s == side for s in rows.values())
    assert len(rows) == 2000 and abs(count("val") - 400) <= 2 and abs(count("holdout") - 200) <= 2
    assert all(rows[n] == rows[n + 1] for n in range(0, 2000, 2))


def test_versions_drawn_together(spark, monkeypatch):
    members = spark.createDataFrame([(d, n, f"g{n // 3}", f"c{n}") for d in (1, 2) for n in range(90)], "dataset_id bigint, id bigint, grp string, checksum string")
    got = {(r.dataset_id, r.id): r.side for r in versions.assign_many(members, {1: (0.2, 0.1, 7), 2: (0.3, 0.0, 8)}).collect()}
    for d, (val, holdout, seed) in {1: (0.2, 0.1, 7), 2: (0.3, 0.0, 8)}.items():
        alone = versions.assign_sides(members.where(f"dataset_id = {d}").drop("dataset_id"), val, holdout, seed)
        assert {(d, r.id): r.side for r in alone.collect()} == {k: v for k, v in got.items() if k[0] == d}
    with pytest.raises(versions.SplitError):
        versions.assign_many(members.where("id < 2"), {1: (0.0, 0.0, 1)})
    monkeypatch.setattr(versions, "STREAM_UNITS", 5)
    assert versions.assign_many(members, {1: (0.2, 0.1, 7), 2: (0.3, 0.0, 8)}).count() == 180
    assert versions.assign_many(members, {}).count() == 0


def test_span_labels_go_back_only_if_single(spark):
    from lodestack import migrations

    one = '{"kind":"spans","values":[{"labels":["a"],"start":0,"end":1,"text":"x"}]}'
    rows = frame(spark, "id bigint, value string", (1, one), (2, None), (3, '{"kind":"choices","values":["a"]}'))
    old = {r.id: r.value for r in migrations.single_labels(rows).collect()}
    assert json.loads(old[1])["values"][0]["label"] == "a" and old[2] is None and old[3] == '{"kind":"choices","values":["a"]}'
    back = spark.createDataFrame(list(old.items()), "id bigint, value string").select("id", migrations.label_lists(ST.F.col("value")).alias("value"))
    assert json.loads({r.id: r.value for r in back.collect()}[1]) == json.loads(one)
    with pytest.raises(CatalogError):
        migrations.single_labels(frame(spark, "value string", (one.replace('["a"]', '["a","b"]'),)))


def test_answers_document(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"format": 1, "catalog_id": "c", "label_set": "x", "samples": [{"checksum": "a", "rows": [{"state": "skipped"}]}, {"checksum": "b", "type": "text/plain", "rows": []}]}, indent=1))
    assert [(r.checksum, r.type, len(r.rows)) for r in answers.read_document(spark, str(path)).orderBy("checksum").collect()] == [("a", None, 1), ("b", "text/plain", 0)]
    path.write_text('{"format": 2, "samples": [{"checksum": "a"}]}')
    with pytest.raises(Exception, match="format 1"):
        answers.read_document(spark, str(path)).collect()


def test_set_digests_in_pieces(spark, monkeypatch):
    from lodestack.functions import values

    monkeypatch.setattr(values, "DIGEST_BYTES", 40)
    rows = spark.createDataFrame([(n % 2, f"item {n * 7 % 50}") for n in range(100)] + [(2, None)], "g bigint, item string").repartition(5)
    want = {g: sorted({f"item {n * 7 % 50}" for n in range(100) if n % 2 == g}) for g in (0, 1)}
    got = {r.g: (r["size"], r.digest) for r in values.set_digests(rows, "g", "item").collect()}
    assert got == {g: (len(w), hashlib.sha256("".join(f"{x}\n" for x in w).encode()).hexdigest()) for g, w in want.items()}


def test_assign_sides(spark):
    members = spark.createDataFrame([(n, f"g{n // 3}", f"c{n}") for n in range(60)] + [(60, None, "c0"), (61, None, "c61")], "id bigint, grp string, checksum string")
    sided = versions.assign_sides(members, 0.2, 0.1, 7)
    rows = {r.id: r.side for r in sided.collect()}
    assert len(rows) == 62 and rows[60] == rows[0]  # shared bytes
    assert all(len({rows[3 * g + k] for k in range(3)}) == 1 for g in range(20))
    kept = versions.assign_sides(members, 0.2, 0.1, 8, inherited=sided)
    assert {r.id: r.side for r in kept.collect()} == rows
    given = spark.createDataFrame([(0, "holdout")], "id bigint, side string")
    assert {r.id: r.side for r in versions.assign_sides(members, 0.2, 0.1, 7, given=given).collect()}[0] == "holdout"
    with pytest.raises(versions.SplitError):
        versions.assign_sides(members.where("id < 2"), 0.0, 0.0, 1)
    with pytest.raises(CatalogError):
        versions.GivenSplit("k", ("a",), ("a",))


def test_every_version_is_split(spark, tmp_path):
    from lodestack.plans.catalog import QUERIES

    rows = [(d, n, f"c{n}", json.dumps({"author": f"a{n // 3}", "lang": f"l{d}"})) for d in (1, 2, 3) for n in range(30)]
    frame(spark, "dataset_id bigint, sample_id bigint, checksum string, metadata string", *rows).write.parquet(f"{tmp_path}/manifest_sample.parquet")
    recorded = [(1, 0.1, 0.1, "author", 41), (2, 0.3, 0.0, "author", 42), (3, 0.2, 0.2, None, 43), (4, 0.1, 0.1, "author", 44)]
    frame(spark, "id bigint, val_ratio double, holdout_ratio double, group_by string, seed bigint", *recorded).write.parquet(f"{tmp_path}/dataset_version.parquet")
    frame(spark, "id bigint, metadata string", *[(n, '{"lang":"fr"}') for n in range(30)]).write.parquet(f"{tmp_path}/sample_row.parquet")
    frame(spark, "id bigint, sample_id bigint, label_set_id bigint, state string, value string, superseded_at timestamp", (1, 4, 6, "annotated", "warm", None)).write.parquet(f"{tmp_path}/annotation.parquet")
    frame(spark, "id bigint, name string", (6, "tone")).write.parquet(f"{tmp_path}/label_set.parquet")
    got = [tuple(r) for r in QUERIES["split_assign"](spark, str(tmp_path)).collect()]
    assert {(d, n) for d, n, _ in got} == {(d, n) for d, n, *_ in rows} and len(got) == 90
    count = lambda d, side: sum(x == d and s == side for x, _, s in got)
    assert (count(1, "val"), count(1, "holdout")) == (3, 3) and (count(2, "val"), count(2, "holdout")) == (9, 0) and (count(3, "val"), count(3, "holdout")) == (6, 6)
    assert [(r.dataset_id, r.members, r.groups, r.cut) for r in QUERIES["split_group_integrity"](spark, str(tmp_path)).orderBy("dataset_id").collect()] == [(1, 30, 10, 0), (2, 30, 10, 0), (3, 30, 0, 0)]
    made = {(r.dataset_id, r.id): (r.lang, r.tone) for r in QUERIES["features_of_versions"](spark, str(tmp_path)).collect()}
    assert len(made) == 90 and all(v == ("fr", "warm" if n == 4 else None) for (_, n), v in made.items())


def test_inputs_and_combination(spark):
    origins = frame(spark, "id bigint, sample_id bigint, input string, metadata string", (2, 1, "b  c", '{"x":2,"y":null}'), (1, 1, "b c", '{"x":1}'), (3, 2, "p", None), (4, 2, "q", '{"z":"s"}'))
    settled, kept = versions.settle_inputs(origins, "drop")
    assert {(r.sample_id, r.input, r.inputs) for r in settled.collect()} == {(1, "b c", 1), (2, "p", 2)}
    assert [r.sample_id for r in kept.collect()] == [1]
    assert {r.sample_id: r.metadata for r in versions.combine(origins).collect()} == {1: {"x": "1", "y": None}, 2: {"z": "s"}}


def test_store_commits_and_races(spark, tmp_path):
    store = ST.Store(spark, f"file://{tmp_path}/cat")
    with pytest.raises(CatalogError):
        store.snapshot()
    at = store.create("cat-1")
    sample = spark.createDataFrame([(1, "c", 0, 3, "ab", "text", "plain", '{"a":1}', None, None)], ST.TABLES["sample"])
    log = spark.createDataFrame([(1, 1, 1, "annotated", "x", "model", None, None, None, None), (2, 1, 1, "annotated", "y", "human", None, None, None, None)], ST.TABLES["annotation"])
    log = log.withColumn("created_at", ST.F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    first = store.commit({"sample": sample, "annotation": log}, at)
    with pytest.raises(ST.Lost):
        store.commit({"sample": sample}, at)
    old = store.snapshot()
    event = spark.createDataFrame([(1, "described", 1, None, '{"metadata":{"a":1}}', '{"metadata":{"a":2}}', None), (2, "withdrawn", 1, 2, None, None, None)], ST.TABLES["event"])
    event = event.withColumn("at", ST.F.lit("2025-02-01 00:00:00").cast("timestamp_ntz"))
    store.commit({"event": event}, first)
    assert ST.samples(old).first().metadata == '{"a":1}' and ST.samples(store.snapshot()).first().metadata == '{"a":2}'
    assert {r.id: r.superseded_at is None for r in ST.annotations(old).collect()} == {1: False, 2: True}
    assert {r.id: r.superseded_at is None for r in ST.annotations(store.snapshot()).collect()} == {1: False, 2: False}
    copy = ST.Store(spark, f"file://{tmp_path}/copy")
    ST.copy_index(store.snapshot(), copy)
    assert copy.snapshot().read("catalog_identity").first().id == "cat-1"
    with pytest.raises(CatalogError):
        ST.copy_index(store.snapshot(), copy)
    ids = ST.with_ids(spark.createDataFrame([(f"n{k:03d}",) for k in range(50)], "name string"), 11, "name").orderBy("name").collect()
    assert [r.id for r in ids] == list(range(11, 61))


def test_files_raw_ingest_and_shards(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b/c.txt", "two"), ("b/d.txt", "one")):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = files.files_under(spark, f"{tmp_path}/in")
    assert {(r.path, r.checksum) for r in found.collect()} == {(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in (("a.txt", "one"), ("b/c.txt", "two"), ("b/d.txt", "one"))}
    for bad in (["x"], ["../y"]):
        with pytest.raises(CatalogError):
            files.files_under(spark, f"{tmp_path}/in", bad)
    raw = spark.createDataFrame([("col", "a.txt", hashlib.sha256(b"one").hexdigest())], "collection string, path string, checksum string")
    added, counts = files.raw_ingest(found, raw, "col")
    assert {r.path for r in added.collect()} == {"b/c.txt", "b/d.txt"}
    assert counts.first().asDict() == {"files": 3, "added": 2, "held": 1, "checksums": 2, "blobs": 1}
    with pytest.raises(CatalogError):
        files.raw_ingest(found, raw.selectExpr("collection", "path", "'0' as checksum"), "col")

    content = [(n, bytes([n % 251]) * (n * 37 % 1500)) for n in range(40)]
    stock = spark.createDataFrame([(hashlib.sha256(c + bytes([n])).hexdigest(), n, c + bytes([n])) for n, c in content], "checksum string, first_id bigint, content binary").selectExpr("*", "length(content) as length")
    plan = files.shard_plan(stock.select("checksum", "length", "first_id"), 8192)
    rows = sorted((r.shard, r.offset, r.length) for r in plan.collect())
    assert len(rows) == 40 and len({r[0] for r in rows}) > 3 and all(b[0] > a[0] or b[1] >= a[1] + a[2] for a, b in zip(rows, rows[1:]))
    root = f"{tmp_path}/shards"
    located = blobs.write_shards(plan.join(stock.select("checksum", "content"), "checksum"), root)
    made = spark.createDataFrame(located.collect(), located.schema)
    planned = {r.checksum: r.offset for r in plan.collect()}
    assert {r.checksum: r.offset for r in made.collect()} == planned
    assert {(r.checksum, bytes(r.content)) for r in blobs.fetch(made, root).collect()} == {(r.checksum, bytes(r.content)) for r in stock.collect()}
    with tarfile.open(fileobj=io.BytesIO(open(f"{root}/{made.first().container}", "rb").read())) as tar:
        assert tar.getnames()


def test_answers_file_round_trip(spark, tmp_path):
    samples = frame(spark, "id bigint, checksum string, media string, subtype string, deleted_at timestamp", (1, "x", "text", "plain", None), (2, "y", "text", "plain", None))
    log = frame(spark, "id bigint, sample_id bigint, label_set_id bigint, state string, value string, source string, batch string, created_at string, superseded_at string", (1, 1, 1, "annotated", "v", "human", None, "2", None), (2, 1, 1, "skipped", None, "model", "b", "1", "2"))
    sets = frame(spark, "id bigint, name string", (1, "s"))
    made = answers.export_answers(samples, log, sets, "s", "cat")
    answers.write_answers(made, f"{tmp_path}/a")
    back = answers.read_answers(spark, f"{tmp_path}/a").collect()
    assert [(r.checksum, r.type, [x.source for x in r["rows"]]) for r in back] == [("x", "text/plain", ["model", "human"])]


def test_signing():
    s = signing.sign(b"k", "ab" * 32, 7200)
    assert len(s) == 32 and signing.verify(b"k", "ab" * 32, 7200, s, 7000) and not signing.verify(b"k", "ab" * 32, 7200, s, 7300) and not signing.verify(b"q", "ab" * 32, 7200, s, 0)
    assert signing.verify(b"k", "ab" * 32, 7200, s, 7200)
    with pytest.raises(CatalogError):
        signing.sign(b"", "ab" * 32, 7200)
    assert signing.window_expiry(10, 100) == 3600 and signing.window_expiry(3600, 3600) == 7200
    assert signing.checksum_from(f"https://h/blob/{'ab' * 32}.txt?exp=1&sig=2") == "ab" * 32 and signing.checksum_from("https://h/x") is None


def test_span_remap():
    value = '{"kind":"spans","values":[{"labels":["A"],"start":4,"end":7,"text":"cat"},{"labels":["B"],"start":0,"end":3,"text":"the"}]}'
    moved, lost = remap_spans(value, "the cat sat", "Note. the big cat sat")
    assert lost == 0 and '"start":14' in moved and '"start":6' in moved
    assert remap_spans(value, "the cat sat", "dog")[1] == 2
    assert remap_spans(None, "a", "b") == (None, 0)
    # without an old text a span is carried by its own
    alone = '{"kind":"spans","values":[{"labels":["x"],"start":4,"end":7,"text":"cat"},{"labels":["y"],"start":0,"end":3}]}'
    moved, lost = remap_spans(alone, None, "a big cat, one cat")
    assert [(v["start"], v["end"]) for v in json.loads(moved)["values"]] == [(6, 9)] and lost == 1
    # a start that no block holds: nearest to where it was, not to where another block went
    moved, lost = remap_spans('{"kind":"spans","values":[{"labels":["x"],"start":8,"end":11}]}', "........end", "end....xend")
    assert json.loads(moved)["values"][0]["start"] == 8 and lost == 0


def test_lists_and_lines(spark):
    sums = spark.createDataFrame([("a" * 64,), ("b" * 64,), ("a" * 64,)], "checksum string")
    digest, *rest = lineage.put_list(None, sums)
    assert rest == [2, 1, False] and digest == hashlib.sha256(("a" * 64 + "\n" + "b" * 64 + "\n").encode()).hexdigest()
    held = spark.createDataFrame([(1, "x"), (4, digest)], "version int, digest string")
    assert lineage.put_list(held, sums) == (digest, 2, 4, True)
    assert lineage.put_list(held, sums.limit(1))[2:] == (5, False)
    assert lineage.put_list(None, sums.limit(0))[:2] == (hashlib.sha256(b"").hexdigest(), 0)
    with pytest.raises(CatalogError):
        lineage.put_list(None, spark.createDataFrame([("x",)], "checksum string"))
    runs = spark.createDataFrame([("r3", "r2"), ("r2", "r1"), ("r1", None), ("c", "c")], "id string, continues string")
    assert lineage.line_of(runs, "r3") == ["r3", "r2", "r1"]
    for bad in ("c", "none"):
        with pytest.raises(CatalogError):
            lineage.line_of(runs, bad)
    assert lineage.verify_counts("prepare", {"inputs": 5, "produced": 3, "already": 1, "emptied": 1, "samples": 3, "live_samples": 3}) == []
    assert lineage.verify_counts("prepare", {"inputs": 5, "produced": 3})


def test_prepare_chain(spark):
    def split(data, meta):
        return [(part, meta | {"n": n}) for n, part in enumerate(data.split(b"|"))]

    def drop(data, meta):
        if data == b"EMPTY":
            raise lineage.Drop("nothing in it")
        return [(data, meta)]

    inputs = spark.createDataFrame([("1", b"a|b"), ("2", b"EMPTY"), ("1", b"a|b"), ("3", b"a")], "checksum string, content binary")
    out = lineage.prepare(inputs, [drop, split], spark.createDataFrame([("3",)], "checksum string"))
    assert {(r.input, r.position, r.dropped) for r in out.collect()} == {("1", 0, None), ("1", 1, None), ("2", None, "nothing in it")}
    assert lineage.prepare_counts(out, 1).first().asDict() == {"inputs": 3, "produced": 1, "already": 1, "emptied": 1, "outputs": 2, "samples": 2}


def test_given_lists(spark):
    members = frame(spark, "id bigint, checksum string, metadata string", (1, "a", '{"k":"h"}'), (2, "b", None), (3, "b", '{"k":"t"}'), (4, "c", '{"k":"t"}'))
    given = versions.GivenSplit("k", ("h",), ())
    lists = frame(spark, "checksum string, side string", ("b", "val"), ("z", "holdout"))
    assert {r.id: r.side for r in given.with_lists(members, lists).collect()} == {1: "holdout", 2: "val", 3: "val", 4: "train"}
    for bad in ([("b", "val"), ("b", "holdout")], [("a", "val")]):
        with pytest.raises(CatalogError):
            given.with_lists(members, frame(spark, "checksum string, side string", *bad))


def test_text_sources(spark, tmp_path):
    (tmp_path / "l").write_text("a\n\n b \na\n")
    (tmp_path / "p").write_text("o1 n1\no2  n2\n\n")
    (tmp_path / "q").write_text("o1 n1\no1 n2\n")
    (tmp_path / "r").write_text("o1\n")
    assert {r["item"] for r in files.read_lines(spark, f"{tmp_path}/l").collect()} == {"a", "b"}
    assert {tuple(r) for r in files.read_pairs(spark, f"{tmp_path}/p").collect()} == {("o1", "n1"), ("o2", "n2")}
    for bad in ("q", "r"):
        with pytest.raises(CatalogError):
            files.read_pairs(spark, f"{tmp_path}/{bad}")
