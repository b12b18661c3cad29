import json

import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.functions import values as V
from lodestack.operators import selection as S
from lodestack.operators.selection import Compare, Mark, Spec, compile_condition, condition

ROWS = [
    {"k": 2000}, {"k": "2000"}, {"k": True}, {}, {"k": 2000.0}, {"k": None}, {"k": [1]}, {"k": 1e3}, {"k": ""}, {"k": -5}, {"k": {"a": 1}}, {"k": 2000.5}, {"k": "x"}, {"k": False}, {"k": 0},
]
CONDITIONS = [
    *({"key": "k", "op": op, "value": v} for op in ("==", "!=") for v in (2000, 2000.0, "2000", True, False, 0, 1, "", 2000.5)),
    *({"key": "k", "op": op, "value": v} for op in ("<", "<=", ">", ">=") for v in (2000, 1000.5, "2000", "")),
    {"key": "k", "op": "in", "value": [2000, "x", True]},
    {"key": "k", "op": "exists"},
    {"not": {"key": "k", "op": "==", "value": 2000}},
    {"all": [{"key": "k", "op": "exists"}, {"not": {"key": "k", "op": ">", "value": 0}}]},
    {"any": [{"key": "k", "op": "==", "value": "x"}, {"key": "missing", "op": "==", "value": 1}]},
]


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "null" if v is None else "other"


def plain(row: dict, c: dict) -> bool:
    """The reading in plain Python."""
    if "not" in c:
        return not plain(row, c["not"])
    if "all" in c:
        return all(plain(row, x) for x in c["all"])
    if "any" in c:
        return any(plain(row, x) for x in c["any"])
    has, v = c["key"] in row, row.get(c["key"])
    same = lambda w: kind(v) == kind(w) and v == w
    if c["op"] == "exists":
        return has
    if c["op"] == "==":
        return has and same(c["value"])
    if c["op"] == "!=":
        return has and not same(c["value"])
    if c["op"] == "in":
        return has and any(map(same, c["value"]))
    w = c["value"]
    return has and kind(v) == kind(w) and kind(w) in ("number", "string") and {"<": v < w, "<=": v <= w, ">": v > w, ">=": v >= w}[c["op"]]


def test_conditions_are_two_valued_and_typed(spark):
    df = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(ROWS)] + [(99, None)], "id bigint, metadata string")
    got = df.select("id", *[compile_condition(condition(c), df.metadata).alias(f"c{n}") for n, c in enumerate(CONDITIONS)]).collect()
    for r in got:
        row = ROWS[r.id] if r.id < 99 else {}
        assert [r[f"c{n}"] for n in range(len(CONDITIONS))] == [plain(row, c) for c in CONDITIONS], row


@pytest.mark.parametrize("bad", [
    {"key": "k", "op": "exists", "value": 1}, {"key": "k", "op": "in", "value": []}, {"key": "k", "op": "in", "value": 1}, {"key": "k", "op": "<", "value": True}, {"key": "k", "op": "~", "value": 1}, {"key": "k", "op": "==", "value": None}, {"what": 1},
])
def test_malformed_conditions_are_refused(bad):
    with pytest.raises(V.CatalogError):
        condition(bad)


def test_spec_hash_ignores_order():
    a = Spec.from_toml('[select]\ntypes=["text/email","text/plain"]\nlabel_set="x"\n[[select.where.all]]\nkey="a"\nop="exists"\n[[select.where.all]]\nkey="b"\nop="=="\nvalue=1\n')
    b = Spec(("text/plain", "text/email"), "x", where=condition({"all": [{"key": "b", "op": "==", "value": 1}, {"key": "a", "op": "exists"}]}))
    assert a.hash() == b.hash()
    assert a.hash() != Spec(("text/plain",), "x").hash()
    with pytest.raises(V.CatalogError):
        Spec.from_toml("select = 1 =")
    with pytest.raises(V.CatalogError):
        Spec(("text/plain",), "x", include=("unversioned",))


@given(st.text(max_size=20))
@settings(max_examples=50, deadline=None)
def test_literals(text):
    assert isinstance(S.literal(text), (bool, int, float, str))


def test_answers_as_of_a_mark(spark):
    log = frame(spark, "id bigint, sample_id bigint, label_set_id bigint, state string, value string, source string, batch string, created_at string",
                (1, 1, 1, "annotated", "a", "model", None, "1"), (2, 1, 1, "annotated", "b", "human", None, "2"), (3, 2, 1, "skipped", None, "human", None, "3"), (4, 3, 1, "annotated", "z", "import", None, "0"))
    events = frame(spark, "id bigint, kind string, sample_id bigint, annotation_id bigint", (1, "withdrawn", 2, 3), (2, "arrived", 3, 4))
    now = {(r.sample_id, r.value) for r in S.answers_asof(log, Mark(), events).collect()}
    assert now == {(1, "b")}  # a withdrawn skip leaves no answer, arrived history is none
    assert {(r.sample_id, r.value) for r in S.answers_asof(log, Mark(annotation=1, event=0), events).collect()} == {(1, "a")}


def test_candidates_undo_later_events(spark):
    samples = frame(spark, "id bigint, media string, subtype string, metadata string, checksum string, deleted_at timestamp", (1, "text", "email", '{"a":2}', "x", None), (2, "text", "plain", None, "y", None), (3, "image", "plain", None, "z", None))
    held = frame(spark, "id bigint, sample_id bigint, collection string", (1, 1, "a/b"), (2, 2, "ab"), (3, 1, "a"))
    events = frame(spark, "id bigint, kind string, sample_id bigint, annotation_id bigint, before string", (1, "described", 1, None, '{"subtype":"note","metadata":{"a":1}}'), (2, "tombstoned", 2, None, None))
    then = S.candidates_asof(samples, held, ["text/plain"], None, Mark(event=0), events).collect()
    assert {(r.id, r.subtype, r.metadata) for r in then} == {(1, "note", '{"a":1}'), (2, "plain", None)}
    now = S.candidates_asof(samples, held, ["text/plain"], ["a"], Mark(event=2), events).collect()
    assert {(r.id, r.subtype) for r in now} == {(1, "email")}  # in two collections, yet once; "ab" is not under "a"
    with pytest.raises(V.CatalogError):
        S.candidates_asof(samples, held, ["text/plain"], [])


def test_counts_and_typed_lists(spark):
    samples = frame(spark, "id bigint, media string, subtype string, metadata string, checksum string, deleted_at timestamp", *[(n, "text", "email" if n % 2 else "plain", json.dumps({"n": n}), f"c{n}", None) for n in range(6)])
    held = frame(spark, "id bigint, sample_id bigint, collection string")
    sets = frame(spark, "id bigint, name string", (1, "x"))
    log = frame(spark, "id bigint, sample_id bigint, label_set_id bigint, state string, value string, source string, batch string, created_at string", *[(n, n, 1, "annotated", '{"kind":"choices","values":["k"]}', "human", None, "t") for n in range(6)])
    lists = {"l@1": frame(spark, "checksum string, media string, subtype string", ("c1", "text", "plain"), ("c2", None, None), ("c3", "text", "email"))}
    spec = Spec(("text/plain",), "x", where=condition({"all": [{"key": "n", "op": ">", "value": 0}, {"asserts": "k", "label_set": "x"}]}), exclude=("l@1",))
    made = S.run_selection(spec, samples, held, log, sets, lists)
    assert sorted(r.id for r in made.members.collect()) == [1, 4, 5]
    counts = {(r.what, r.name): r.n for r in made.counts().collect()}
    assert counts == {("pool", ""): 6, ("selected", ""): 3, ("rejected", "0"): 1, ("rejected", "1"): 0, ("missing", "n"): 0, ("removed", "l@1"): 2, ("candidates", ""): 6}


def test_value_functions(spark):
    df = frame(spark, "v string, s string",
               ('{"kind":"spans","values":[{"labels":["A","B"],"start":0,"end":3,"text":"x"},{"labels":["A"],"start":2,"end":5,"text":"y"}]}', '{"label_type":"span","classes":["A"]}'),
               ('{"kind":"choices","values":["p","q"]}', '{"label_type":"classification","classes":["p","q"]}'),
               ('{"kind":"boxes","values":[{"label":"c","x":1,"y":2,"width":3,"height":4}]}', '{"label_type":"bbox","classes":["c"]}'), (None, '{"label_type":"span","classes":[]}'))
    got = df.select(V.asserted(df.v).alias("a"), V.faults(df.v, df.s).alias("f")).collect()
    assert [r.a for r in got] == [["A", "B"], ["p", "q"], ["c"], []]
    assert [r.f for r in got] == [["class", "overlap"], ["multiple"], [], []]


@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_canonical_text_is_idempotent(text):
    once = V.canonical_text(text.encode("utf-8", "replace"))
    again = V.canonical_text(once)
    assert b"\r" not in once and (again == once or once.startswith(b"\xef\xbb\xbf"))


def test_refs_and_names():
    assert V.parse_ref("a@2") == ("a", 2)
    for bad in ("a", "a@0", "@1", "a@x"):
        with pytest.raises(V.CatalogError):
            V.parse_ref(bad)
    assert V.host_token("My.Host_01!") == "my-host-01"
    assert V.content_hash({"b": 1, "a": [1]}) == V.content_hash({"a": [1], "b": 1})
    with pytest.raises(V.CatalogError):
        V.split_type("text")


def test_compare_is_a_value():
    assert Compare("a", "==", 1) == Compare("a", "==", 1)


def test_key_check(spark):
    df = frame(spark, "id bigint, metadata string", (1, '{"a":1,"b":null}'), (2, None))
    S.check_keys(condition({"all": [{"key": "a", "op": ">", "value": 0}, {"not": {"key": "b", "op": "exists"}}]}), df, {})
    S.check_keys(condition({"key": "c", "op": "==", "value": "x"}), df, {"c": "string"})
    for cond, declared in (({"key": "z", "op": "exists"}, {}), ({"key": "a", "op": "==", "value": "x"}, {"a": "number"})):
        with pytest.raises(V.CatalogError):
            S.check_keys(condition(cond), df, declared)
