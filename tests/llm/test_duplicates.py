"""Exact and near duplicates and spot signatures against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.llm import exact_dedup, shingle_join, spot_signatures

EXTRA = "id string, words int, chunk long, copies int, bucket long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 2, 3, 4, 5) for k, t in rows], f"doc_id long, text string, {EXTRA}").repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "tree", "river", "stone", "and", "cloud", "bird", "light", "in", "winter", "road"]) + rng.choice(["", "s", "ing", str(rng.randrange(50))]) for _ in range(n))


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    base = [prose(rng, 300) for _ in range(6)]
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", "a\u0001 b\u0001", "a\u0002b", "a\u0002a b", "b" * 100_000]
    texts += [rng.choice(base).replace(" ", rng.choice([" ", "\n", " \t"])) for _ in range(60)] + [" " + base[0], base[0] + "!"]
    rows = [*enumerate(texts)]
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    for every in (1, 4, 64):
        got = exact_dedup.exact_duplicates(frame(spark, rows), every=every).collect()
        assert len(got) == len(rows)
        for r in got:
            t = norm(rows[r.doc_id][1])
            assert (r.keep_id, r.group_size, r.kept) == (min(groups[t]), len(groups[t]), r.doc_id == min(groups[t]))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_repeated_and_missing_ids(spark):
    got = exact_dedup.exact_duplicates(frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "z")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup.exact_duplicates(frame(spark, []).where("doc_id > 0")).count() == 0


def test_colliding_identifiers_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * 0)
    got = exact_dedup.exact_duplicates(frame(spark, [(1, "aa"), (2, "bb"), (3, "aa")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    links, root = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (find(k), links[k]) for k, _ in rows}


def near_rows(seed):
    rng = random.Random(seed)
    rows = [None, "", "one two", "One  two", "a b c d e", "a b c d e", prose(rng, 20_000)]
    for _ in range(8):
        words = prose(rng, rng.choice([60, 150])).split()
        for _ in range(rng.choice([1, 2, 15])):
            copy = words[:]
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
            rows.append(" ".join(copy))
    return [(k * 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 3])
def test_near_against_brute_force(spark, block):
    rows = near_rows(block)
    wanted = brute_near(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in shingle_join.near_duplicates(frame(spark, rows), block=block).collect()}
    assert got == wanted


def test_near_edges(spark):
    assert shingle_join.near_duplicates(frame(spark, []).where("doc_id > 0")).count() == 0
    got = shingle_join.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "z")])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]


def test_prefixes_are_shortened_until_the_recall_is_met():
    one = np.ones(1)
    for likeness in (0.8, 0.9, 0.97):
        d = shingle_join.depth_for(np.array([likeness]), one)
        chance = lambda k: 1 - (1 - likeness**k) ** shingle_join.TREES  # noqa: E731, B023
        assert chance(d) >= shingle_join.RECALL and (d == shingle_join.DEEPEST or chance(d + 1) < shingle_join.RECALL)
    assert shingle_join.depth_for(np.array([0.97]), one) == shingle_join.DEEPEST
    assert shingle_join.depth_for(np.array([0.3]), one) == shingle_join.SHALLOWEST


def test_depth_is_measured_on_the_corpus(spark):
    rng, depth = random.Random(9), {}
    for edits in (1, 9):
        rows = []
        for k in range(40):
            words = prose(rng, 400).split()
            copy = words[:]
            for e in range(edits):
                copy[20 + e * 40] = f"edit{k}x{e}"
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        signed = shingle_join.signatures(frame(spark, rows), 5, shingle_join.TREES)
        leaves = signed.select(F.col("doc_id").alias("node"), "labels", F.posexplode("labels").alias("tree", "label"))
        depth[edits] = shingle_join.measured_depth(leaves, 0.8, shingle_join.TREES, shingle_join.RECALL)
    assert depth[1] > depth[9] >= shingle_join.SHALLOWEST


def rows_with_a_hard_pair():
    """Many pairs with one edit, and as ids 1 and 2 one at the threshold that shares 5 MinHash values at most."""
    rng = random.Random(1344)
    words = prose(rng, 94).split()
    copy = words[:]
    copy[30] = copy[60] = "edited"
    rows = [(1, " ".join(words)), (2, " ".join(copy))]
    for k in range(150):
        words = prose(rng, 300).split()
        copy = words[:]
        copy[150] = f"edit{k}"
        rows += [(2 * k + 10, " ".join(words)), (2 * k + 11, " ".join(copy))]
    return rows


def test_a_hard_pair_is_not_averaged_away(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in shingle_join.near_duplicates(frame(spark, rows_with_a_hard_pair())).collect()}
    assert len(got) == 302 and got[1] == got[2] == (1, 1)
    assert all(got[k] == (k - k % 2, 1) for k in range(10, 310))


def test_the_pipeline_drops_the_copy_of_a_hard_pair(spark):
    import corpus_pipeline

    left = corpus_pipeline.drop_near_copies(spark, frame(spark, rows_with_a_hard_pair()), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, *range(10, 310, 2)]


@pytest.mark.parametrize("edits", [1, 3])
def test_longer_prefixes_lose_no_candidate(spark, edits):
    rng, rows = random.Random(edits), []
    for k in range(60):
        words = prose(rng, 300).split()
        for c in range(3):
            copy = words[:]
            for e in range(edits):
                copy[(c * edits + e) * 30] = f"edit{k}x{c}x{e}"
            rows.append((3 * k + c, " ".join(copy)))
    signed = shingle_join.signatures(frame(spark, rows), 5, shingle_join.TREES)
    leaves = signed.select(F.col("doc_id").alias("node"), "labels", F.posexplode("labels").alias("tree", "label"))
    depth = shingle_join.measured_depth(leaves, 0.8, shingle_join.TREES, shingle_join.RECALL)
    met = {d: set() for d in (shingle_join.SHALLOWEST, depth)}
    labels = {r.doc_id: np.array(r.labels, np.int64).view(np.uint64) for r in signed.collect()}
    for d, pairs in met.items():
        keys = {k: x >> np.uint64(8 * (shingle_join.DEEPEST - d)) for k, x in labels.items()}
        pairs |= {(a, b) for a in keys for b in keys if a < b and (keys[a] == keys[b]).any()}
    assert met[depth] == met[shingle_join.SHALLOWEST] and len(met[depth]) >= 180


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(7, 9)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in shingle_join.components(edges).collect()}
    assert {got[k] for k in range(101, 161)} == {100} and got[9] == 7


def spots(text):
    """The signatures as word tuples."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    common = {*spot_signatures.ANCHORS}
    out = []
    for i, w in enumerate(words):
        if w in common:
            out.append((w, *[x for x in words[i + 1 : i + 1 + spot_signatures.SPAN] if x not in common][: spot_signatures.CHAIN]))
    if len(out) < spot_signatures.FEW:
        out += [(1, w, *words[i + 1 : i + 3]) for i, w in enumerate(words)] if words else ([(2, text)] if text else [])
    return {*out}


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([0, 3, 40, 200])) for _ in range(40)] + [None, "", "!!!", "été 中文", "x" * 50_000]
    for ids in (range(len(texts)), [k * 10**15 - 7 for k in range(len(texts))], [5 if k == 0 else 2**62 + k for k in range(len(texts))]):
        rows = sorted(zip(ids, texts))
        got = {r.doc_id: r for r in spot_signatures.edited_fingerprints(frame(spark, rows)).collect()}
        assert len(got) == len(rows)
        for k, (key, text) in enumerate(rows):
            text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            r = got[key]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(r.near_edited - alike(spots(text), spots(edited))) < 1e-6 and abs(r.near_next - alike(spots(text), spots(after))) < 1e-6


def test_fingerprints_edges(spark):
    assert spot_signatures.edited_fingerprints(frame(spark, []).where("doc_id > 0")).count() == 0
    one = spot_signatures.edited_fingerprints(frame(spark, [(4, "the cat sat on the mat")])).first()
    assert one.near_next == 1.0
    got = spot_signatures.edited_fingerprints(frame(spark, [(None, "a"), (1, "b"), (1, "b"), (2, None)])).collect()
    assert len(got) == 4
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(8)
    base = [[w for w in prose(rng, 120).split()] for _ in range(5)]
    rows = []
    for k in range(30):
        words = rng.choice(base)[:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((k, " ".join(words)))
    signed = spot_signatures.fingerprints(frame(spark, rows).select("doc_id", "text"), "text", "f")
    got = {(r.a, r.b) for r in spot_signatures.similar_pairs(signed, "doc_id", "f", 0.7).collect()}
    first = {}
    for k, t in rows:
        first.setdefault(frozenset(spots(t)), k)
    kept = sorted(first.items(), key=lambda x: x[1])
    wanted = {(a, b) for i, (x, a) in enumerate(kept) for y, b in kept[i + 1 :] if alike(x, y) >= 0.7}
    assert got == wanted and wanted


def test_minhash_recall_of_planted_pairs():
    rng = np.random.default_rng(3)
    depth, hit = shingle_join.depth_for(np.array([0.8]), np.ones(1)), 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 90, np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 11, np.uint64)])) for _ in range(2))
        keys = shingle_join.labels_of([a, b], shingle_join.TREES).view(np.uint64) >> np.uint64(8 * (shingle_join.DEEPEST - depth))
        hit += bool((keys[0] == keys[1]).any())
    assert hit == 200


def test_near_rows_of_one_id_and_of_none(spark):
    rng = random.Random(12)
    base, other = prose(rng, 120), prose(rng, 120)
    near = base.replace(base.split()[60], "edited", 1)
    rows = [(1, base), (5, near), (5, other), (5, other), (None, near + " tail"), (None, other), (None, "zz"), (None, "zz"), (9, None), (9, "")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in shingle_join.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([(1, 1, 2), (5, 1, 2), (5, 5, 2), (5, 5, 2), (0, 1, 2), (0, 5, 2), (0, 0, 1), (0, 0, 1), (9, 9, 0), (9, 9, 0)])
    left = sorted((r.doc_id or 0, r.text or "") for r in shingle_join.keep_first(frame(spark, rows)).collect())
    assert left == sorted([(1, base), (5, other), (0, "zz"), (9, "")])


def test_blocks_are_bounded_by_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_BYTES", 2000)
    rows = near_rows(77)
    wanted = brute_near(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in shingle_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == wanted


def test_unsettled_components_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        shingle_join.components(edges, most_rounds=1)


def test_rows_that_stay_after_exact_dedup(spark):
    rows = [(1, "alpha beta"), (5, "alpha beta"), (5, "only here"), (5, "only here"), (None, "q"), (None, "q"), (None, "alpha  beta"), (7, None), (8, "")]
    left = exact_dedup.keep_first(frame(spark, rows))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "q"), (1, "alpha beta"), (5, "only here"), (7, "")]
    assert left.columns == frame(spark, rows).columns and exact_dedup.keep_first(frame(spark, rows).where("doc_id > 99")).count() == 0
