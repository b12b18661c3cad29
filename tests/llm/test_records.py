"""Record operators against brute force."""

import json
import random
from collections import Counter, defaultdict

import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import fingerprints, near_duplicates, split_groups, split_overlap
from lodestack.llm.fingerprints import ALIKE
from lodestack.llm.rolling import WORD


def triple_set(text):
    w = WORD.findall((text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def alike(a, b):
    x, y = triple_set(a), triple_set(b)
    return a == b or bool(x & y) and len(x & y) >= ALIKE * len(x | y) - 1e-9


def families(seed=4, n=40, copies=4):
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.randrange(30, 80))]
        for _ in range(rng.randrange(1, copies + 1)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def groups_of(rows):
    parent = {i: i for i, t in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if alike(s, t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    count = Counter(find(i) for i in parent)
    return {(i, find(i)) for i in parent if count[find(i)] > 1}


@pytest.mark.parametrize("crowd,tree,spread", [(64, 4096, 100_000), (2, 3, 100_000), (2, 3, 5)])
def test_near_duplicate_groups(spark, monkeypatch, crowd, tree, spread):
    monkeypatch.setattr(near_duplicates, "CROWD", crowd)
    monkeypatch.setattr(near_duplicates, "hot_blocks", lambda codes: fingerprints.hot_blocks(codes, spread))
    monkeypatch.setattr(near_duplicates, "TREE", tree)
    rows = families(copies=9 if crowd == 2 else 4) + [(900, "a b"), (901, "a b"), (902, ""), (903, ""), (904, "a c")]
    want = groups_of(rows)
    df = frame(spark, "id bigint, text string, key int, rep string", *[(i, t, 1, "x") for i, t in [*rows, (905, None), (None, "a b"), (900, "a b")]])
    got = {tuple(r) for r in near_duplicates.alike_groups(df).collect()}
    assert len(want ^ got) <= 0.01 * len(want), (want - got, got - want)
    assert got <= want and near_duplicates.alike_groups(df.limit(0)).count() == 0


def test_a_crowded_family_moves_once(spark, monkeypatch):
    """One block holds a tenth of all rows: what its second round moves grows with its rows, not with their square."""
    monkeypatch.setattr(near_duplicates, "CROWD", 8)
    monkeypatch.setattr(near_duplicates, "TREE", 16)
    moved, across = [], near_duplicates._across
    monkeypatch.setattr(near_duplicates, "_across", lambda *a: moved.append(across(*a)) or moved[-1])
    rng = random.Random(8)
    template = [f"t{n}" for n in range(120)]
    family = [(n, " ".join(w if rng.random() > 0.004 else f"e{rng.randrange(10**6)}" for w in template)) for n in range(60)]
    rest = [(1000 + n, " ".join(f"u{n}x{k}" for k in range(30))) for n in range(540)]
    df = frame(spark, "id bigint, text string", *family, *rest)
    got = {tuple(r) for r in near_duplicates.alike_groups(df).collect()}
    assert got == {(n, 0) for n, _ in family}
    # the block is one group after the first round, so no round over its trees is needed
    assert moved == [(None, None)]


def test_a_passage_that_many_share_costs_in_proportion(spark, monkeypatch):
    """Texts that differ but for one passage share blocks: no tree has to hold them, and the pairs looked at grow with the rows."""
    monkeypatch.setattr(near_duplicates, "CROWD", 8)
    monkeypatch.setattr(near_duplicates, "TREE", 16)
    walked, seen, across, walk = [], [], near_duplicates._across, near_duplicates._walk
    monkeypatch.setattr(near_duplicates, "_walk", lambda rows, nearest, nodes: walked.append(nodes) or walk(rows, nearest, nodes))
    monkeypatch.setattr(near_duplicates, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
    footer = " ".join(f"f{n}" for n in range(40))
    for n in (60, 120):
        rows = [(k, " ".join(f"u{k}x{j}" for j in range(50)) + " " + footer) for k in range(n)]
        rows += [(1000 + k, rows[k][1].replace(f"u{k}x3 ", "edited ")) for k in range(5)]
        got = {tuple(r) for r in near_duplicates.alike_groups(frame(spark, "id bigint, text string", *rows)).collect()}
        assert got == {(i, k) for k in range(5) for i in (k, 1000 + k)}
    assert set(walked) == {"held"} and len(seen) == 4
    assert all(pairs.count() <= 250 and rest is None for pairs, rest in seen)


def test_symbol_trees_leave_families_out():
    rng = random.Random(5)
    words = lambda tag: [f"{tag}{n}" for n in range(150)]
    edited = lambda base, share: " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base)
    family = [edited(words("t"), 0.01) for _ in range(400)]
    half = [" ".join(words("t")[:40] + words(f"u{n}x")[:80]) for n in range(30)]
    of = lambda texts: [int.from_bytes(c, "little") for c in fingerprints.symbols(texts)]
    tree = near_duplicates.BKTree(near_duplicates.symbols_apart)
    for code in of(family):
        tree.add(code)
    for code in of(half):
        assert list(tree.within(code, near_duplicates.SYMBOL_RADIUS)) == []
    assert tree.visited < 0.05 * 400 * len(half)
    member = of([edited(words("t"), 0.01)])[0]
    assert len(list(tree.within(member, near_duplicates.SYMBOL_RADIUS))) == 400


def test_equal_bytes_join_groups(spark):
    df = frame(spark, "id bigint, text string", (1, "a b c d"), (2, "p q r s"), (3, "p q r s"), (4, None), (5, "z"))
    rows = frame(spark, "id bigint, checksum string, text string", (1, "x", ""), (2, "x", ""), (4, "y", ""), (9, "y", ""), (5, "z", ""), (None, "z", ""), (6, None, ""), (7, None, ""), (1, "x", ""))
    got = {tuple(r) for r in near_duplicates.alike_groups(df, also=near_duplicates.equal_bytes(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4)}
    assert near_duplicates.equal_bytes(rows.limit(0)).count() == 0


def test_hot_blocks(spark):
    df = spark.range(500).selectExpr("id as rep", "0L as f1", "0L as f2", "array(id, id % 3, -7L) as keys").repartition(7)
    assert {(r.key, r.parts) for r in fingerprints.hot_blocks(df, 160).collect()} == {(-7, 4), (0, 2), (1, 2), (2, 2)}
    assert fingerprints.hot_blocks(df, 1000).count() == 0 and fingerprints.hot_blocks(df.limit(0), 10).count() == 0


@given(st.lists(st.integers(0, 2**20 - 1), max_size=60), st.integers(0, 2**20 - 1), st.integers(0, 20))
@settings(max_examples=80, deadline=None)
def test_bk_tree(codes, query, radius):
    tree = near_duplicates.BKTree()
    for c in codes:
        tree.add(c)
    assert sorted(tree.within(query, radius)) == [k for k, c in enumerate(codes) if (c ^ query).bit_count() <= radius]


@pytest.mark.parametrize("spread", [100_000, 3])
def test_overlaps_across_splits(spark, monkeypatch, spread):
    monkeypatch.setattr(split_overlap, "SPREAD", spread)
    rows = families(7)
    rng = random.Random(1)
    versions = frame(spark, "id bigint, given_split string", (1, '{"key":"bench","holdout":["h"],"val":["v","7"]}'), (2, None), (3, '{"key":"none","holdout":["x"],"val":[]}'))
    entries = []
    for i, _ in rows:
        for d in (1, 2, 3):
            entries.append((d, i, json.dumps({"bench": rng.choice(["h", "v", "t", "H", 7, None]), "collection": f"c{i % 3}"}) if i % 9 else None))
    entries += [(1, 5000, '{"bench":"h"}'), (1, None, '{"bench":"h"}'), (9, 1, '{"bench":"h"}')]
    side = {(d, i): "train" for d, i, _ in entries if d == 1}
    for d, i, m in entries:
        v = json.loads(m).get("bench") if m else None
        side[d, i] = "holdout" if d == 1 and v == "h" else "val" if d == 1 and v in ("v", 7) else "train"
    want = {(1, min(i, j), max(i, j)) for k, (i, s) in enumerate(rows) for j, t in rows[:k] if (side[1, i] == "train") != (side[1, j] == "train") and alike(s, t)}
    exported = frame(spark, "export_id bigint, sample_id bigint, text string, side string", *[(n, i, t, "x") for n, (i, t) in enumerate([*rows, rows[0], (4000, "no entry"), (4001, None)])])
    manifest = frame(spark, "dataset_id bigint, sample_id bigint, metadata string, split string", *[(*e, None) for e in entries])
    pairs = split_overlap.overlaps(manifest, versions, exported)
    got = {tuple(r) for r in split_overlap.found(pairs).collect()}
    assert want and got <= want and len(want - got) <= 0.01 * len(want)
    report = split_overlap.report(pairs, manifest).collect()
    assert sum(r.pairs for r in report) == len(got) and {r.side for r in report} <= {"holdout", "val"}
    for empty in ((manifest.limit(0), versions, exported), (manifest, versions.limit(0), exported), (manifest, versions, exported.limit(0))):
        assert split_overlap.overlaps(*empty).count() == 0


def test_a_pair_that_shares_only_a_crowded_block(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "SPREAD", 3)
    rng = random.Random(11)
    base = [f"t{n}" for n in range(90)]
    edited = [list(base) for _ in range(20_000)]
    for words in edited:
        for k in rng.sample(range(90), 8):
            words[k] = f"e{rng.randrange(10**6)}"
    edited = [t for w in edited if alike(t := " ".join(w), " ".join(base)) and len(triple_set(t) & triple_set(" ".join(base))) < 70]
    keys = [set(k.tolist()) for k in fingerprints.fingerprints([" ".join(base), *edited])[0]]
    far, shared = next((t, keys[0] & k) for t, k in zip(edited, keys[1:]) if len(keys[0] & k) == 1)
    near = [" ".join([*base, f"u{n}"]) for n in range(60)]
    near = [t for t, k in zip(near, fingerprints.fingerprints(near)[0]) if shared <= set(k.tolist())]
    assert len(near) > 30
    rows = list(enumerate([" ".join(base), far, *near]))
    versions = frame(spark, "id bigint, given_split string", (1, '{"key":"bench","holdout":["h"],"val":[]}'))
    manifest = frame(spark, "dataset_id bigint, sample_id bigint, metadata string", *[(1, i, '{"bench":"h"}' if i == 1 else None) for i, _ in rows])
    exported = frame(spark, "sample_id bigint, text string", *rows)
    got = {tuple(r) for r in split_overlap.found(split_overlap.overlaps(manifest, versions, exported)).collect()}
    assert got == {(1, min(i, 1), max(i, 1)) for i, t in rows if i != 1 and alike(t, far)} and (1, 0, 1) in got


def test_alike_texts_meet_by_their_rarest_triples(spark):
    footer = " ".join(f"f{n}" for n in range(20))
    rows = families(9) + [(1000 + n, " ".join(f"u{n}x{k}" for k in range(40)) + " " + footer) for n in range(100)]
    rows = [(i, t) for i, t in rows if triple_set(t)]
    crowd = frame(spark, "rep bigint, train boolean, held boolean", *[(i, i % 2 == 0, i % 2 == 1 or i % 6 == 0) for i, _ in rows])
    keys = defaultdict(set)
    for r in split_overlap._rarest(crowd, frame(spark, "id bigint, text string", *rows), ALIKE).collect():
        keys[r.rep].add(r.key)
    pairs = [(i, j) for i, s in rows for j, t in rows if i != j and i % 2 == 0 and (j % 2 == 1 or j % 6 == 0) and alike(s, t) and s != t]
    assert pairs and all(keys[i] & keys[j] for i, j in pairs)
    # a footer that different texts share brings none of them together
    assert not any(keys[i] for i, _ in rows if i >= 1000)


def entry_groups(rows):
    parent, seen = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e, d, m in rows:
        parent.setdefault(e, e)
        for key, v in (json.loads(m) if m else {}).items():
            for x in v if isinstance(v, list) else [v]:
                if key in split_groups.RELATING_KEYS and x is not None and (x := str(x).strip().lower()) not in ("", "unknown", "n/a"):
                    a, b = find(e), find(seen.setdefault((d, key, x), e))
                    parent[max(a, b)] = min(a, b)
    count = Counter(find(e) for e in parent)
    return {(e, find(e)) for e in parent if count[find(e)] > 1}


def test_related_entries_and_their_sides(spark):
    rng = random.Random(3)
    rows = []
    for e in range(300):
        meta = {"author": rng.choice([None, "", " Unknown", "N/A", f"A{rng.randrange(200)} ", f"a{rng.randrange(200)}"]), "source_file": rng.choice(["n/a", f"f{rng.randrange(400)}"]), "other": "same"}
        meta["entity"] = rng.choice([None, [], [f"x{rng.randrange(300)}", None], f"X{rng.randrange(300)}", "a1"])
        rows.append((e, rng.randrange(1, 4), json.dumps(meta) if e % 20 else None))
    rows += [(n, 4, '{"author":"hot"}') for n in range(400, 600)] + [(599, 4, '{"author":"hot"}')]
    df = frame(spark, "entry_id bigint, dataset_id bigint, metadata string, group_id string, node int", *[(*r, "x", 1) for r in rows])
    assert {tuple(r) for r in split_groups.related(df).collect()} == entry_groups(rows)
    versions = frame(spark, "id bigint, seed bigint, val_ratio double, holdout_ratio double", (1, 5, 0.1, 0.2), (2, None, 0.2, 0.0), (3, 1, None, None))
    sided = split_groups.assign(df, versions).collect()
    assert sorted(r.entry_id for r in sided) == sorted({r[0] for r in rows})
    sides = defaultdict(set)
    for r in sided:
        sides[r.dataset_id, r.group_id].add(r.side)
    assert all(len(s) == 1 for s in sides.values())
    count = Counter((r.dataset_id, r.side) for r in sided)
    total = Counter(r.dataset_id for r in sided)
    largest = Counter((r.dataset_id, r.group_id) for r in sided)
    for d, (val, hold) in {1: (0.1, 0.2), 2: (0.2, 0.0)}.items():
        most = max(n for (x, _), n in largest.items() if x == d)
        assert abs(count[d, "val"] - val * total[d]) <= most and abs(count[d, "holdout"] - hold * total[d]) <= most
    assert count[3, "train"] == total[3] and count[4, "train"] == total[4]
    assert split_groups.related(df.limit(0)).count() == 0 and split_groups.assign(df.limit(0), versions).count() == 0


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 300)), min_size=1, max_size=5, unique_by=lambda x: x[0]))
@settings(max_examples=60, deadline=None)
def test_dealing_in_strides_equals_one_by_one(sized):
    total = sum(s * n for s, n in sized)
    fast, slow = ([total * 0.8, total * 0.1, total * 0.1] for _ in range(2))
    for size, n in sorted(sized, reverse=True):
        took = split_groups._fill(fast, size, n)
        one = [0, 0, 0]
        for _ in range(n):
            best = max(range(3), key=lambda i: (slow[i], -i))
            one[best] += 1
            slow[best] -= size
        assert sum(took) == n and max(abs(a - b) for a, b in zip(took, one)) <= 1
