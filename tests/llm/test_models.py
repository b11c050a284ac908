"""Toxicity, context mixing, URL filter, packing and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyweft.llm import context_mixing, exact_dedup, packing, shingle_join, toxicity, url_filter

SF = "/root/testdata/sf0.001"
EXTRA = "label int, host string, kind int, length int, block long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "h", 2, 3, 4) for k, t in rows], f"doc_id long, text string, {EXTRA}").repartition(3)


# toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = [a + b for a in ("mar", "tol", "sen", "vil", "gor", "pad") for b in ("an", "is", "ole", "ut", "em", "iri")]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 60, 400]))]
        bad = rng.random() < 0.3
        for _ in range(2 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["stupidface", "wretchling", "scumball"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy_and_misspellings(spark):
    rows, labels = toxic_rows(600, 1)
    rows += [(9001, "maran tolis stupidfacee senole"), (9002, ""), (9003, None), (None, "maran"), (9004, "tolis " * 50_000)]
    got = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(by[k].predicted, t) for k, t in labels if by[k].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert by[9001].predicted == 1 and by[9002].predicted == by[9003].predicted == by[9004].predicted == 0
    kept = toxicity.keep_clean(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in by.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    rows = frame(spark, [(1, "a"), (2, None)])
    for labels in ([], [(1, 0)], [(7, None)]):
        got = toxicity.score(rows, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 2 and all(r.predicted == 0 for r in got)
    assert toxicity.score(rows.where("doc_id > 5"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def plain_features(word):
    raw = b"<" + word + b">"
    parts = [raw] + [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
    one = lambda p: int(toxicity.slice_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0])
    return [one(p) % toxicity.BUCKETS for p in parts]


def plain_words(text):
    return bytes(toxicity.CLEANED[b] for b in text.encode()).split()


def plain_passages(words):
    return [words[i : i + toxicity.WINDOW] for i in range(max(1, len(words) - toxicity.WINDOW + 1))]


def test_score_against_plain_python():
    flat = np.random.default_rng(4).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = ["", "  ", "Word", "one two, THREE four five!", "same same same same same", "été 中文 a", "x" * 3000, "a b c " * 700]
    raw = [t.encode() for t in texts]
    got = toxicity.score_texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), flat.tobytes(), -0.3, 1.7)
    for text, p in zip(texts, got):
        value = lambda w: float(np.mean([flat[f] for f in plain_features(w)]))
        top = max(sum(map(value, ws)) / max(1, len(ws)) for ws in plain_passages(plain_words(text)))
        assert abs(p - 1 / (1 + np.exp(0.3 - 1.7 * top))) < 1e-6


def test_one_epoch_against_plain_python(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 8)
    texts, toxic = ["bad bad thing here now", "good thing", "some good words here", "bad one", ""], np.array([1, 0, 0, 1, 0])
    bags, n, dim = toxicity.Bags(texts), 1 << 8, toxicity.DIM
    got, bias = toxicity.learnt(bags, toxic, np.ones(5, bool), 3)
    rng = np.random.default_rng(3)
    vectors, softmax = rng.normal(0, 0.01, (n, dim)), rng.normal(0, 0.1, (2, dim))
    # odds of buckets, from the distinct words of each text
    count = [Counter(f for t, c in zip(texts, toxic) if c == k for w in {*plain_words(t)} for f in plain_features(w)) for k in (0, 1)]
    total = [sum(c.values()) for c in count]
    share = total[1] / sum(total)
    rate = lambda c, part, f: (count[c][f] + toxicity.PRIOR * part) / (total[c] + toxicity.PRIOR)
    for f in range(n):
        vectors[f, 0] = np.log(rate(1, share, f) / rate(0, 1 - share, f) * (1 - share) / share)
    softmax[:, 0] = (-0.5, 0.5)
    to_vectors, to_softmax, to_bias = np.zeros((n, dim)), np.zeros((2, dim)), np.zeros(2)
    sizes = [(toxic == k).sum() for k in (0, 1)]
    absolute = 0.0
    of = lambda w: np.mean([vectors[f] for f in plain_features(w)], axis=0)
    for text, c in zip(texts, toxic):
        means = [(np.sum([of(w) for w in ws], axis=0) / len(ws) if ws else np.zeros(dim), ws) for ws in plain_passages(plain_words(text))]
        mean, ws = max(means, key=lambda m: round(float(m[0] @ (softmax[1] - softmax[0])), 6))
        chance = np.exp(softmax @ mean) / np.exp(softmax @ mean).sum()
        error = (chance - np.eye(2)[c]) * 0.5 / sizes[c]
        absolute += np.abs(error).sum()
        to_softmax += np.outer(error, mean)
        to_bias += error
        for w in ws:
            for f in plain_features(w):
                to_vectors[f] += error @ softmax / len(ws) / len(plain_features(w))
    vectors -= toxicity.RATE * to_vectors / np.abs(to_vectors).max()
    softmax -= 0.2 * toxicity.RATE * to_softmax / np.abs(to_softmax).max()
    b = -0.2 * toxicity.RATE * to_bias / absolute
    assert np.allclose(got, vectors @ (softmax[1] - softmax[0]), atol=1e-4) and abs(bias - (b[1] - b[0])) < 1e-6


def test_calibration_never_turns_the_score_round():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(40)]  # nothing to learn
    for seed in range(3):
        _, _, slope = toxicity.train(texts, np.random.default_rng(seed).permutation(np.arange(40) % 2), seed)
        assert slope > 0
    flat, bias, slope = toxicity.train(["foul word", "fine text", "fair line"], np.array([1, 0, 0]))  # too few for folds
    assert slope == 1.0
    flat, bias, slope = toxicity.train(["same text"] * 8, np.arange(8) % 2)  # tied passages of both classes
    assert slope > 0 and np.isfinite(flat).all()


def test_training_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 400)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, seed=11: seen.append((texts, toxic)) or (np.zeros(toxicity.BUCKETS, np.float32), 0.0, 1.0))
    rows = [(k, "vile " * 20 if k % 2 else "mild " * 15) for k in range(40)] + [(99, "long " * 1000)]
    toxicity.fit(frame(spark, rows + rows), spark.createDataFrame([(k, k % 2) for k in range(40)] + [(99, 1)], "doc_id long, toxic int"))
    texts, toxic = seen[0]
    for c in (0, 1):
        assert 0 < sum(len(t) for t, x in zip(texts, toxic) if x == c) <= 400


def test_passages_cover_each_text():
    counts = np.array([0, 0, 2, 12])
    first, end, text = toxicity.passages(counts)
    assert first[text == 0].tolist() == end[text == 0].tolist() == [0]
    assert {*np.concatenate([np.arange(a, b) for a, b, t in zip(first, end, text) if t == 2])} == {*range(2, 12)}
    assert (end - first <= toxicity.WINDOW).all()


# context mixing


def brute_base(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    left = lambda k: zlib.crc32(str(k).encode()) % 10
    c = Counter(w for k, t in rows if left(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {k: (left(k) == 0, len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for k, t in rows}


def test_base_score_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("the", "Ing", "é", "tion")]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice(["", "\n\t", " Rare" + str(k)])) for k in range(80)]
    rows += [(500, None), (501, ""), (502, "  "), (503, "long " * 30_000)]
    wanted = brute_base(rows)
    for most in (1 << 19, 5, 0):
        monkeypatch.setattr(context_mixing.frequent, "__defaults__", (most,))
        got = context_mixing.score(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            held, n, known, total, base = wanted[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    mean = lambda rs, of: sum(getattr(r, of) for r in rs) / sum(r.n_tokens for r in rs)
    held = [r for r in got if r.held_out]
    assert mean(held, "score") > -6  # random bytes would be below -10


def test_mixing_is_a_probability(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = (np.uint64(int.from_bytes(b"the c", "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    t = pa.table({"window": keys.astype(np.int64), "near": (keys >> np.uint64(8)).astype(np.int64) & 0xFFFFFF, **{f"n{k}": rng.integers(0, 4, 256) for k in range(3)}})
    short = context_mixing.short_paths(spark.createDataFrame(t.select(["window", "n0", "n1", "n2"]).to_pandas()))
    weights, stage = context_mixing.fresh()
    weights += rng.normal(0, 0.2, weights.shape).astype(np.float32)
    bits = context_mixing.said_bits(context_mixing.said_of(t, short)[:, :, 0], (keys & np.uint64(255)).astype(np.int64), weights, stage)
    assert abs((2.0**-bits).sum() - 1) < 1e-6


def plain_bits(texts, training, weights, stage):
    """Bits of each byte of each text, decision by decision, contexts as byte strings."""
    end, counts = context_mixing.END, {}

    def seen(before):
        word = b""
        for c in before[: -context_mixing.WINDOW : -1]:
            if c in (32, end):
                break
            word = bytes([c]) + word
        return [before[-k:] for k in range(1, context_mixing.WINDOW)] + [b"w" + word]

    def steps(text):
        padded = bytes([end]) * context_mixing.WINDOW + text
        for i, byte in enumerate(text):
            yield seen(padded[: i + context_mixing.WINDOW]), byte

    for text, learn in zip(texts, training):
        for contexts, byte in steps(text) if learn else ():
            for order, context in enumerate(contexts):
                for bit in range(8):
                    key = (order, context, (256 | byte) >> (8 - bit))
                    counts.setdefault(key, [0, 0])[(byte >> (7 - bit)) & 1] += 1
    out = []
    for text in texts:
        out.append([])
        for contexts, byte in steps(text):
            total = 0.0
            for bit in range(8):
                logit, longest = 0.0, 0
                for order, context in enumerate(contexts):
                    zeros, ones = counts.get((order, context, (256 | byte) >> (8 - bit)), (0, 0))
                    n = zeros + ones
                    q = np.clip(np.rint(16 * np.log((ones + 0.02 + 0.2 * (n == 0)) / (zeros + 0.02 + 0.2 * (n == 0)))), -127, 127) / 16
                    confidence = 0 if n == 0 else min(context_mixing.CONFIDENCES - 1, 1 + int(np.log2(n)))
                    logit += float(weights[bit, order, confidence]) * q
                    longest += order < context_mixing.WINDOW - 1 and confidence > 0
                place = min(max(logit, -7.999), 7.999) * 2 + context_mixing.BINS // 2
                low = int(place)
                refined = stage[longest, low] * (1 - place + low) + stage[longest, low + 1] * (place - low)
                chance = min(max((refined + 1 / (1 + np.exp(-logit))) / 2, 1e-6), 1 - 1e-6)
                total -= np.log2(chance if (byte >> (7 - bit)) & 1 else 1 - chance)
            out[-1].append(total)
    return out


def plain_scores(rows, weights, stage):
    """log10 probabilities of all rows by the definition, chunks as tuples of words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    training = [k is not None and zlib.crc32(str(k).encode()) % 10 > 0 for k, _ in rows]
    texts = [" ".join(w).encode() + bytes([context_mixing.END]) for w in words]
    hashed = lambda w: int(context_mixing.slice_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    cuts = {w: (hashed(w.encode()) >> 20) % context_mixing.EVERY == 0 for ws in words for w in ws}
    chunks = []
    for ws in words:
        chunks.append([[]])
        for w in ws:
            if chunks[-1][-1] and cuts[chunks[-1][-1][-1]]:
                chunks[-1].append([])
            chunks[-1][-1].append(w)
        chunks[-1] = [tuple(c) for c in chunks[-1]]
    pairs = [Counter(zip(c, c[1:])) for c in chunks]
    heads = [Counter(c[:-1]) for c in chunks]
    add = lambda counters: sum((c for c, learn in zip(counters, training) if learn), Counter())
    every_pair, every_head = add(pairs), add(heads)
    seen_of = lambda i, head: every_head[head] - (heads[i][head] if training[i] else 0)
    hits_of = lambda i, pair: every_pair[pair] - (pairs[i][pair] if training[i] else 0)
    gates, weight = {}, lambda g: (gates[g][1] + 0.5) / (gates[g][0] + 1) if g in gates else 0.5
    gate = lambda n: min(15, n.bit_length() - 1)
    for i, c in enumerate(chunks):
        for pair in zip(c, c[1:]) if training[i] else ():
            if seen := seen_of(i, pair[0]):
                cell = gates.setdefault(gate(seen), [0, 0])
                cell[0] += 1
                cell[1] += hits_of(i, pair) > 0
    out = []
    for i, (c, bits) in enumerate(zip(chunks, plain_bits(texts, training, weights, stage))):
        total, at, used = 0.0, 0, 0
        for j, chunk in enumerate(c):
            size = max(1, sum(len(w.encode()) + 1 for w in chunk))
            one, at = sum(bits[at : at + size]), at + size
            seen = seen_of(i, c[j - 1]) if j else 0
            if seen:
                w, hits = weight(gate(seen)), hits_of(i, (c[j - 1], chunk))
                one = -np.log2((1 - w) * 2.0**-one + w * hits / seen) if hits else one - np.log2(1 - w)
                used += hits > 0
            total += one
        out.append((-total * np.log10(2), used))
    return out


def mixing_rows():
    rng = random.Random(17)
    words = [f"{a}{b}" for a in ("cat", "Dog", "bird", "é", "long", "x") for b in ("", "s", "ing", "tionary", ".")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, copy = prose(90), prose(70)
    rows = [(k, prose(rng.randrange(40))) for k in range(20)] + [(k, prose(5) + "  " + passage + "\n" + prose(8)) for k in range(20, 26)]
    rows += [(k, copy) for k in (30, 31, 32, 33, 40)] + [(50, None), (51, ""), (52, " \t"), (None, copy), (None, None), (53, "w" * 3000)]
    return rows + [(60, prose(30)), (60, prose(30)), (60, rows[0][1]), (61, copy + " " + copy + " " + copy), (61, copy + " " + copy + " " + copy)]


@pytest.mark.parametrize("top", [1 << 20, 40])
def test_score_against_a_plain_byte_by_byte_model(spark, monkeypatch, top):
    learnt, train = [], context_mixing.trained
    monkeypatch.setattr(context_mixing, "trained", lambda *a: learnt.append(train(*a)) or learnt[-1])
    rows = mixing_rows()
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in context_mixing.score(frame(spark, rows), top).collect())
    plain = plain_scores(rows, *learnt[0])
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    wanted = sorted((str(k), tokens(t), s) for (k, t), (s, _) in zip(rows, plain))
    assert sum(used for _, used in plain) > 8
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    for g, w in zip(got, wanted):
        assert abs(g[2] - w[2]) < 1e-4 * max(1, abs(w[2])), (g, w)


def test_gathering_holds_little_beside_the_pending_windows(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Docs:  # takes the function that workers run
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    for name, value in (("STEP", 1 << 15), ("PENDING", 1 << 18), ("ROWS", 1 << 12)):
        monkeypatch.setattr(context_mixing, name, value)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij    ", k=2000)) for _ in range(250)] + ["aaaaaaaa " * 9, None]
    keys = [*range(250), 4, None]
    run = context_mixing.gather(Docs())
    context_mixing._unpacked("earlier", type("Holder", (), {"value": (np.zeros(0, np.uint64), np.zeros(1), np.zeros(0, np.uint64), np.zeros(1), np.zeros(1, np.uint64))}))
    batch, got, most = pa.record_batch([pa.array(keys, pa.int64()), pa.array(texts)], ["doc_id", "text"]), Counter(), 0
    tracemalloc.start()
    for part in run([batch]):
        most = max(most, tracemalloc.get_traced_memory()[1])
        assert part.num_rows <= context_mixing.ROWS
        tracemalloc.stop()
        for r in part.filter(pa.compute.equal(part["kind"], 1)).to_pylist():
            got.update({(r["key"], k): r[f"n{k}"] for k in range(3)} | {(r["key"], "rows"): 1})
        tracemalloc.start()
    tracemalloc.stop()
    assert context_mixing._unpacked.cache_info().currsize == 0  # what an earlier query left is gone
    wanted = Counter()
    for k, t in zip(keys, texts):
        left = 0 if k is None else zlib.crc32(str(k).encode()) % 10
        padded = bytes([context_mixing.END]) * 5 + " ".join((t or "").split(" ")).encode()
        padded = padded[:5] + re.sub(rb" +", b" ", padded[5:]).strip() + bytes([context_mixing.END])
        for i in range(len(padded) - 5):
            key = int.from_bytes(padded[i : i + 6], "big")
            wanted[key, "rows"] = 1
            if left:
                wanted[key, (left - 1) // 3] += 1
    assert {k: n for k, n in got.items() if n and k[1] != "rows"} == {k: n for k, n in wanted.items() if k[1] != "rows"}
    assert {k[0] for k in got} == {k[0] for k in wanted}
    assert most < 8 * 8 * context_mixing.PENDING  # 24 MB, when all windows were counted by fold at once


def test_texts_that_occur_twice_are_scored_apart(spark):
    rng = random.Random(3)
    words = [a + b for a in ("mar", "tol", "sen", "vil", "gor", "pad") for b in ("an", "is", "ole", "ut", "em", "iri")]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[k]) for k in range(10)]
    got = {r.doc_id: r.score / r.n_tokens for r in context_mixing.score(frame(spark, rows)).collect()}
    left = lambda k: zlib.crc32(str(k).encode()) % 10
    twice = [got[a] for k in range(10) for a, b in ((k, 100 + k), (100 + k, k)) if left(b)]
    assert min(twice) > max(got[k] for k in range(10, 60))


def test_mixing_edges(spark):
    assert context_mixing.score(frame(spark, []).where("doc_id > 0")).count() == 0
    got = context_mixing.score(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert len(got) == 2 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in got)


def test_contexts_are_counted_exactly_however_many(spark):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(97, 123, (300_000, 6)).astype(np.uint64) @ (np.uint64(256) ** np.arange(6, dtype=np.uint64)))
    near = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF)
    counts = {"n0": np.ones(len(keys), np.int64), "n1": np.zeros(len(keys), np.int64), "n2": np.zeros(len(keys), np.int64)}
    new = len(keys) // 2
    counts["n0"][new] = 0  # a window of a held-out text only
    t = pa.table({"window": keys.astype(np.int64), "near": near.astype(np.int64), **counts})
    said = context_mixing.said_of(t, context_mixing.short_paths(spark.createDataFrame(t.select(["window", "n0", "n1", "n2"]).to_pandas())))
    node = [(int(keys[new]) & 255 | 256) >> (8 - bit) for bit in range(8)]
    for order in (2, 3, 4):
        mask = (1 << (8 * (order + 1))) - 1
        of = [int(k) & 255 for k in keys[(keys >> np.uint64(8)) & np.uint64(mask) == (keys[new] >> np.uint64(8)) & np.uint64(mask)] if k != keys[new]]
        for bit in range(8):
            ones, zeros = (sum((256 | b) >> (7 - bit) == 2 * node[bit] + k for b in of) for k in (1, 0))
            assert said[new, order, 0, bit] == context_mixing.quantised(np.array([zeros]), np.array([ones]))[0]


def test_texts_of_remainder_1_are_in_the_model(spark):
    left = lambda k: zlib.crc32(str(k).encode()) % 10
    rows = [(k, "zyxwvu qponml kjihgf" if left(k) == 1 else "abcde fghij klmno") for k in range(400) if left(k)]
    held = [k for k in range(400, 500) if left(k) == 0][:2]
    rows += [(held[0], "zyxwvu qponml kjihgf"), (held[1], "vyzuwx mqnolp fkgjhi")]
    got = {r.doc_id: r.score for r in context_mixing.score(frame(spark, rows)).collect()}
    assert got[held[0]] > got[held[1]] / 4


# URL filter


def test_rules(spark):
    urls = [None, "", "no scheme", "http://A.ORG/x?y#z", "https://example.org/es/1", "https://m.example.org/en/12", "https://m.example.org/EN/12", "http://com/fr/", "http://x.com/de/1#a", "http://notcom.net/fr/", "http://a.org", "http://b.org?q", "x://y://z/p"]
    rows = spark.createDataFrame([(k, u, None, 1, "r") for k, u in enumerate(urls)], "page_id long, url string, html string, src int, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "/x", "org/", "allow")
    assert got[4] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[5] == ("m.example.org", "/en/12", "example.org/en/1", "block")
    assert got[6][2:] == ("org/", "allow") and got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block")
    assert got[9][2] is None and got[10] == ("a.org", "", None, "allow") and got[11] == ("b.org", "", None, "allow") and got[12][:2] == ("y:", "//z/p")
    assert url_filter.judge(rows.where("page_id > 99")).count() == 0


def test_repeated_and_long_pages_and_tied_rules(spark):
    long = "http://a.net/" + "p" * 100_000
    rows = [(1, "http://hot.net/x", None)] * 30 + [(None, long, "<a href=http://b.net/>" + "x" * 100_000), (2, "http://b.net/aa/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    rules = (("allow", "b.net/aa"), ("block", "b.net/aa"), ("block", "hot.net/"), ("allow", "c.net/"))
    got = url_filter.judge(pages, rules).collect()
    assert Counter((r.page_id, r.host, r.verdict) for r in got) == Counter({(1, "hot.net", "block"): 30, (None, "a.net", "block"): 1, (2, "b.net", "block"): 1})
    assert max(len(r.path) for r in got) == 100_001


def test_propagation_against_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"h{k}" for k in range(8)]
    edges = {(a, b): rng.randrange(1, 4) for a in hosts for b in hosts if a != b and rng.random() < 0.3}
    seeds = {h: (rng.random() if k < 2 else 0.0, rng.random() if k > 5 else 0.0) for k, h in enumerate(hosts)}
    wanted = {}
    for kind in (0, 1):
        graph = edges if kind == 0 else {(b, a): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in graph.items():
            out[a] += n
        rank = {h: s[kind] for h, s in seeds.items()}
        for _ in range(url_filter.ROUNDS):
            new = {h: 0.15 * s[kind] for h, s in seeds.items()}
            for (a, b), n in graph.items():
                new[b] += 0.85 * n / out[a] * rank[a]
            rank = new
        wanted[kind] = rank
    got = url_filter.propagate(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, links long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good double, bad double"))
    for r in got.collect():
        assert abs(r.trust - wanted[0][r.host]) < 1e-9 and abs(r.distrust - wanted[1][r.host]) < 1e-9


def test_links_decide_where_no_rule_does(spark):
    link = lambda h: f'<p><a class="x" href="http://{h}/1">l</a> <a href="/own">o</a></p>'
    rows = [(1, "http://good.org/a", link("near.net")), (2, "http://bad.com/de/1", link("good.org")), (3, "http://near.net/1", None), (4, "http://fan.net/1", link("bad.com")), (5, "http://lone.net/", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow"}


def test_faint_distrust_from_far_away_decides(spark):
    edges = [(f"h{k + 1}", f"h{k}", 1) for k in range(20)]
    seeds = spark.createDataFrame([("h0", 0.0, 1e-11)], "host string, good double, bad double")
    got = {r.host: r.distrust for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), seeds).collect()}
    for k in range(21):
        wanted = 0.15 * 1e-11 * 0.85**k
        assert abs(got[f"h{k}"] - wanted) < 1e-9 * wanted


# packing


def plain_best_fit(lengths, sizes):
    """Bins as lists, each choice by a full search."""
    bins, filled = [], []
    for i, x in enumerate(lengths):
        fits = [(size - sum(held), -filled[k], k) for k, (size, held) in enumerate(bins) if size - sum(held) >= x]
        if fits:
            k = min(fits)[2]
            bins[k][1].append(x)
            filled[k] = i
        else:
            rest = sum(lengths[i:])
            bins.append((min((s for s in sizes if s >= x), key=lambda s: (packing.cost(s) / min(s, rest), s)), [x]))
            filled.append(i)
    return bins


def test_best_fit_against_a_full_search():
    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))), reverse=True)
        bins, at, final = packing.best_fit(np.array(lengths), (20, 50, 100))
        plain = plain_best_fit(lengths, (20, 50, 100))
        held = [[x for x, b in zip(lengths, bins) if b == k] for k in range(len(final))]
        assert sorted(map(sorted, held)) == sorted(sorted(h) for _, h in plain)
        for h, size in zip(held, final):
            assert size == min(s for s in (20, 50, 100) if s >= sum(h))
        for k in range(len(final)):
            places = sorted((a, x) for a, x, b in zip(at, lengths, bins) if b == k)
            assert [a for a, _ in places] == [sum(x for _, x in places[:i]) for i in range(len(places))]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_pack_covers_every_token(spark, library):
    rng = random.Random(4)
    rows = [(k, " ".join(["word"] * rng.choice([0, 3, 200, 900, 5000]))) for k in range(60)] + [(100, None), (7, "a b"), (7, "a b"), (None, "x y z"), (101, "\u00a0 z"), (102, "a<|endoftext|>b"), (103, "x" * 9000)]
    docs = frame(spark, rows)
    got = packing.pack(packing.lengths_of(docs), block=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.bin_id, []).append(r)
        assert r.n_tokens >= 1 and r.n_tokens <= max(packing.SIZES)
    for rs in by.values():
        total = 0
        for r in sorted(rs, key=lambda r: r.at):
            assert r.at == total
            total += r.n_tokens
        assert all(r.bin_tokens == total and r.bin_size == min(s for s in packing.SIZES if s >= total) for r in rs)
    length = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    wanted, held = Counter(), Counter()
    for k, t in rows:
        wanted[k] += length(t)
    for r in got:
        held[r.doc_id] += r.n_tokens
    assert held == wanted
    assert packing.pack(packing.lengths_of(docs.where("doc_id > 1000"))).count() == 0


def test_filled_sequences_hold_the_documents(spark, library):
    rows = [(k, "some words of text " * (k * k)) for k in range(30)] + [(40, None)]
    docs = frame(spark, rows)
    placed = packing.pack(packing.lengths_of(docs), sizes=(64, 256))
    bins = {r.bin_id: r for r in packing.filled(docs, placed).collect()}
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for k, t in rows}
    rows = placed.collect()
    for r in rows:
        assert bins[r.bin_id].ids[r.at : r.at + r.n_tokens] == ids[r.doc_id][r.start : r.start + r.n_tokens]
    assert sum(len(b.ids) for b in bins.values()) == sum(map(len, ids.values())) and all(len(b.ids) <= b.bin_size for b in bins.values())


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        seen.append((name, docs, out := out.cache()))
        docs = out
    _, given, left = seen[1]
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in given.collect()}
    first = {}
    for k in sorted(norm):
        first.setdefault(norm[k], k)
    assert {r.doc_id for r in left.collect()} == {*first.values()}
    _, given, left = seen[2]
    classes = shingle_join.near_duplicates(given).collect()
    assert {r.doc_id for r in left.collect()} == {r.class_id for r in classes}
    packed = corpus_pipeline.run(spark, SF)
    lengths = {r.doc_id: r.length for r in packing.lengths_of(left).collect()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == lengths


CLASHING = "sha int, row string, none int, id string, t1 long, node long, label int, size int, text2 string"


def test_pipeline_decides_by_row(spark, tmp_path):
    rows = [(1, "alpha beta"), (5, "alpha beta"), (5, "only here, unique text"), (5, "only here, unique text"), (None, "zz"), (None, "zz"), (None, "alpha  beta"), (7, None), (8, " \t")]
    docs = spark.createDataFrame([(k, t, 1, "r", 2, "i", 3, 4, 5, 6, "x") for k, t in rows], f"doc_id long, text string, {CLASHING}").repartition(3)
    left = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "zz"), (1, "alpha beta"), (5, "only here, unique text"), (7, ""), (8, " \t")]
    left = corpus_pipeline.drop_near_copies(spark, left, SF)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 5, 7, 8]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (5, 0), (None, 1), (9, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0, 1, 5, 7, 8]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], f"doc_id long, text string, {CLASHING}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


QUERY_IDS = {"op9_url_filter": ("pages", "page_id")}


@pytest.mark.parametrize("name", ["op1_spot_signatures", "op2_near_duplicates", "op3_token_files", "op4_bpe_codec", "op5_exact_dedup", "op6_token_counts", "op7_context_mixing", "op8_toxicity", "op9_url_filter", "op10_packing"])
def test_queries_run(spark, name):
    import __spark_entry__

    table, key = QUERY_IDS.get(name, ("documents", "doc_id"))
    given = Counter(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    got = __spark_entry__.queries()[name](spark, SF)
    if name == "op10_packing":
        got = got.where("piece = 0")
    assert Counter(r[0] for r in got.select(key).collect()) == given


@pytest.mark.parametrize("name", ["op2_near_duplicates", "op5_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
