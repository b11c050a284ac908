import datetime
import math
import random

import pytest

from storyweft.operators import burst, pooling, tfidf
from storyweft.operators.pooling import mean_pool
from storyweft.plans import file_queries

START = datetime.datetime(2020, 1, 1)


def plain_bursts(rows, hours, strict):
    """df and largest share of each token; every window is counted from its start."""
    first, df, share = 0, {}, {}
    for r, (sec, words) in enumerate(rows):
        for w in words:
            df[w] = df.get(w, 0) + 1
        window = rows[first : r + 1]
        for w in {*words}:
            inside = sum(ws.count(w) for _, ws in window)
            if any(w in ws for _, ws in rows[:first]):
                share[w] = max(share.get(w, 0), inside / len(window))
        passed = sec - rows[first][0]
        if (passed if strict else passed % 86400) >= 3600 * hours:
            first += 1
    return df, share


@pytest.mark.parametrize("steps", [(60, 1800, 7200), (60, 1800, 7200, 100_000, -300), (0, 0, 5, 40_000)])
@pytest.mark.parametrize("strict", [False, True])
def test_bursts_equal_the_rule(spark, steps, strict):
    rng = random.Random(len(steps))
    for hours in (1, 12):
        seconds, rows = 0, []
        for _ in range(120):
            seconds = max(0, seconds + rng.choice(steps))
            rows.append((seconds, [rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(5))]))
        posts = spark.createDataFrame([(r, START + datetime.timedelta(seconds=t), " ".join(ws)) for r, (t, ws) in enumerate(rows)], "r long, ts timestamp, text string").repartition(3)
        got = {x.token: x for x in burst.burst_scores(posts, hours, strict).collect()}
        df, share = plain_bursts(rows, hours, strict)
        assert set(got) == set(df)
        for token in df:
            bg, fg = df[token] / len(rows), share.get(token, 0)
            assert got[token].df == df[token] and abs(got[token].idf - (math.log((len(rows) + 1) / (df[token] + 1)) + 1)) < 1e-12
            assert abs(got[token].jlh_max - ((fg - bg) * fg / bg if fg > bg else 0)) < 1e-12


def test_tfidf_small(spark):
    docs = spark.createDataFrame([(0, "aa bb bb"), (1, "aa"), (2, None), (3, "")], "doc_id long, text string")
    w = {(r.idx, r.token): r.w for r in tfidf.tfidf(docs, min_df=0).collect()}
    a, b = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert abs(w[0, "bb"] - b / math.hypot(a, b)) < 1e-12 and w[1, "aa"] == 1.0
    counts = tfidf.term_counts(tfidf.token_rows(docs), binary=False)
    assert counts.where("token = 'bb'").first().tf == 2
    weighted = tfidf.tfidf(docs, min_df=0)
    assert sorted(r.idx for r in tfidf.zero_rows(docs, weighted).collect()) == [2, 3]
    assert {r.idx: r.seed for r in tfidf.seed_mask(weighted).collect()} == {0: True, 1: True}


def test_stop_words_and_history(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "aa cc")], "doc_id long, text string")
    stop = spark.createDataFrame([("aa",)], "token string")
    rows = tfidf.token_rows(docs, stop_words=stop)
    assert {r.token for r in rows.collect()} == {"bb", "cc"}
    history = spark.createDataFrame([("bb", 4), ("zz", 2)], "token string, df long")
    assert {r.token: r.df for r in tfidf.document_frequency(rows, history).collect()} == {"bb": 5, "cc": 1, "zz": 2}
    assert {r.token for r in tfidf.new_terms(rows, history).collect()} == {"cc"}
    assert "the" in tfidf.default_stop_words(spark, "english")


def test_svd_keeps_cosines_at_full_rank(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "bb cc"), (2, "aa cc dd")], "doc_id long, text string")
    weighted = tfidf.tfidf(docs, min_df=0).cache()
    vec = {r.idx: r.vec for r in tfidf.svd_project(weighted, 10).collect()}
    w = {}
    for r in weighted.collect():
        w.setdefault(r.idx, {})[r.token] = r.w
    for a, b in ((0, 1), (0, 2), (1, 2)):
        exact = sum(x * w[b].get(t, 0) for t, x in w[a].items())
        assert abs(sum(p * q for p, q in zip(vec[a], vec[b])) - exact) < 1e-9


def test_svd_query_has_all_components(spark):
    from storyweft.plans import catalogue

    assert {len(r.vec) for r in catalogue.svd_project(spark, "/root/testdata/sf0.001").collect()} == {100}


def test_mean_pool(spark):
    docs = spark.createDataFrame([(0, "aa bb zz"), (1, ""), (2, None), (3, "zz")], "doc_id long, text string")
    vectors = spark.createDataFrame([("aa", [3.0, 0.0]), ("bb", [0.0, 6.0])], "token string, vec array<double>")
    got = {r.idx: r.vec for r in mean_pool(docs, vectors, 2).collect()}
    assert got == {0: [1.0, 2.0], 1: [0.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    idf = spark.createDataFrame([("aa", 2.0)], "token string, idf double")
    assert {r.idx: r.vec for r in mean_pool(docs, vectors, 2, idf=idf).collect()}[0] == [2.0, 0.0]


def test_mean_pool_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pooling, "BLOCK", 3)
    monkeypatch.setattr(pooling, "GATHERED", 8)
    texts = [f"common {'aa ' * k}bb{k % 3}" for k in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), (3, "aa aa"), (None, "aa"), (30, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([("aa", [1.0, 0.0]), ("common", [0.0, 2.0]), ("bb1", [4.0, 4.0])], "token string, vec array<double>")
    got = mean_pool(docs, vectors, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "aggregatemetrics" not in plan  # nothing is sorted or summed up per word and document
    bag = lambda k: texts[k].split() + (["aa", "aa"] if k == 3 else [])
    known = {r.token: r.vec for r in vectors.collect()}
    wanted = {k: [sum(known.get(t, [0, 0])[i] for t in bag(k)) / len(bag(k)) for i in (0, 1)] for k in range(20)} | {None: [0.0, 0.0], 30: [0.0, 0.0]}
    rows = got.collect()
    assert len(rows) == 23
    for r in rows:
        assert r.vec == pytest.approx(wanted[r.idx])


def test_word_vector_features_clean_texts_once(spark, monkeypatch):
    times, clean = [], file_queries.T.format_text
    monkeypatch.setattr(file_queries.T, "format_text", lambda *a, **b: times.append(1) or clean(*a, **b))
    plan = file_queries.word_vector_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(times) == 1 and "http" not in plan
