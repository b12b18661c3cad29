import pytest
from conftest import frame

from lodestack.functions.values import CatalogError
from lodestack.operators import history as H
from lodestack.operators import sync

LOG = "id bigint, sample_id bigint, label_set_id bigint, state string, value string, source string, batch string, created_at string, superseded_at string"


def test_write_answers_respects_authority(spark):
    log = frame(spark, LOG, (1, 1, 1, "annotated", "a", "human", "b1", "1", None), (2, 2, 1, "annotated", "a", "model", "b2", "1", None))
    batch = frame(spark, "item bigint, sample_id bigint, label_set_id bigint, value string", (1, 1, 1, "x"), (2, 2, 1, "x"), (3, 3, 1, None), (4, 3, 1, "y"))
    got = {r["item"]: (r.verdict, r.batch, r.current) for r in H.write_answers(log, batch, "import").collect()}
    assert got == {1: ("kept", "b1", False), 2: ("annotated", "b2", True), 3: ("skipped", None, False), 4: ("annotated", None, True)}
    with pytest.raises(CatalogError):
        H.write_answers(log, batch, "robot")


def test_second_looks_and_reviews(spark):
    log = frame(spark, LOG,
                (1, 1, 1, "annotated", "a", "import", "b", "1", "2"), (2, 1, 1, "annotated", "a", "human", None, "2", "3"), (3, 1, 1, "annotated", "a", "human", None, "3", None),
                (4, 2, 1, "annotated", "a", "import", None, "1", None), (5, 3, 1, "annotated", "a", "import", "b", "1", "2"), (6, 3, 1, "annotated", "z", "human", None, "2", None))
    assert [(r.sample_id, r.agreed) for r in H.second_looks(log).collect()] == [(1, True)]
    got = {r.batch: (r.pending, r.accepted, r.corrected) for r in H.review_counts(log).collect()}
    assert got == {"b": (0, 1, 1), "": (1, 0, 0)}


SOURCES = ["model", "import", "human"]


def merge_rule(state, value, source, held):
    r = SOURCES.index
    if state == "skipped":
        return "skipped" if held is None else None
    if held is None:
        return "copied"
    hs, hv, hsrc = held
    if hs == "skipped":
        return "copied" if r(source) >= r(hsrc) else "outranked"
    if value == hv:
        return "confirmed" if r(source) > r(hsrc) else "agreed"
    return "superseded" if r(source) > r(hsrc) else "outranked" if r(source) < r(hsrc) else "conflicted"


def import_rule(state, value, source, held):
    r = SOURCES.index
    if state == "skipped":
        if held is None:
            return "copied"
        if held[0] == "annotated":
            return "skips_ignored"
        return "confirmed" if r(source) > r(held[2]) else "outranked" if r(source) < r(held[2]) else "agreed"
    return merge_rule(state, value, source, held)


def test_every_row_of_both_verdict_tables(spark):
    cases, inc, log = [], [], []
    for state, value in (("annotated", "a"), ("annotated", "b"), ("skipped", None)):
        for source in SOURCES:
            for held in (None, *[(s, v, src) for s, v in (("annotated", "a"), ("skipped", None)) for src in SOURCES]):
                n = len(cases)
                cases.append((state, value, source, held))
                inc.append((n, 1, state, value, source, "new"))
                if held:
                    log.append((n, n, 1, held[0], held[1], held[2], None, "old", None))
    incoming = frame(spark, "sample_id bigint, label_set_id bigint, state string, value string, source string, created_at string", *inc)
    standing = frame(spark, LOG, *log)
    merged = {r.sample_id: (r.verdict, r.writes) for r in sync.merge_verdicts(incoming, standing).collect()}
    imported = {r.sample_id: r for r in sync.import_verdicts(incoming, standing).collect()}
    for n, c in enumerate(cases):
        want = merge_rule(*c)
        assert merged[n] == (want, want in ("skipped", "copied", "confirmed", "superseded")), c
        assert imported[n].verdict == import_rule(*c), c
    again = frame(spark, "sample_id bigint, label_set_id bigint, state string, value string, source string, created_at string", *[(r[1], 1, r[3], r[4], r[5], "old") for r in log[:3]])
    assert {r.verdict for r in sync.import_verdicts(again, standing).collect()} == {"already"}


def test_imports_match_by_type(spark):
    held = frame(spark, "id bigint, checksum string, media string, subtype string, deleted_at timestamp", (1, "x", "text", "plain", None), (2, "x", "text", "email", None), (3, "y", "text", "plain", None))
    incoming = frame(spark, "item bigint, checksum string, type string", (1, "x", None), (2, "x", "text/email"), (3, "y", None), (4, "z", None), (5, "y", "text/email"))
    got = {r["item"]: (r.sample_id, r.matched) for r in sync.match_samples(incoming, held).collect()}
    assert got == {1: (None, "ambiguous"), 2: (2, "matched"), 3: (3, "matched"), 4: (None, "unmatched"), 5: (None, "unmatched")}
