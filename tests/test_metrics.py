import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.operators import metrics as M

LABEL = [0, 0, 0, 0, 0, 1, 1, 2, 2, 2, 2, 2]
GOLDEN = [([0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1], 16 / 21, 1, 32 / 37), ([0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0], 7 / 12, 1, 14 / 19)]


def table(spark, label, pred):
    return spark.createDataFrame([(None if a is None else int(a), int(b)) for a, b in zip(label, pred)], "label long, pred long")


@pytest.mark.parametrize("pred, p, r, f1", GOLDEN)
def test_bcubed_golden(spark, pred, p, r, f1):
    got = M.bcubed(M.contingency(table(spark, LABEL, pred))).first()
    assert np.allclose([got.p, got.r, got.f1], [p, r, f1])


def test_rand_and_mutual_information_of_equal_partitions(spark):
    cells = M.contingency(table(spark, LABEL, [x + 7 for x in LABEL]))
    assert M.adjusted_rand(cells).first().ari == 1.0
    assert abs(M.adjusted_mutual_info(cells).first().ami - 1) < 1e-9


def test_expected_information_against_all_permutations(spark):
    label, pred = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]
    n, total = len(label), []
    for order in itertools.permutations(range(n)):
        cells = {}
        for i, j in enumerate(order):
            cells[label[i], pred[j]] = cells.get((label[i], pred[j]), 0) + 1
        total.append(sum(k / n * math.log(k * n / (label.count(a) * pred.count(b))) for (a, b), k in cells.items()))
    got = M.adjusted_mutual_info(M.contingency(table(spark, label, pred))).first()
    assert abs(got.emi - sum(total) / len(total)) < 1e-9


def test_metrics_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = table(spark, [rng.choice([0, 1, 2, None]) for _ in range(200)], [rng.randrange(-2, 5) for _ in range(200)])
    for f in (lambda d: M.bcubed(M.contingency(d)), lambda d: M.best_match(M.contingency(d)), M.purity, lambda d: M.adjusted_rand(M.contingency(d))):
        a, b = f(rows).first(), f(rows.repartition(7)).first()
        assert np.allclose([x if x is not None else -1 for x in a], [x if x is not None else -1 for x in b])


def test_best_match_ties(spark):
    got = M.best_match(M.contingency(table(spark, [0, 0, 0, 0], [1, 1, 2, 2]))).first()
    assert (got.p, got.r) == (1.0, 0.5)


def test_purity_without_large_clusters_is_null(spark):
    got = M.purity(table(spark, LABEL, range(12))).first()
    assert got.p is None and got.f1 is None


def test_empty(spark):
    cells = M.contingency(table(spark, [None], [1]))
    assert M.bcubed(cells).first().p is None and M.best_match(cells).first().f1 is None
    assert M.adjusted_mutual_info(cells).first().ami is None
    assert M.assigned_accuracy(cells) is None


def test_assignment_against_brute_force():
    rng = np.random.default_rng(5)
    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5), (1, 3)):
        for _ in range(10):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            got = M.assignment(cost)
            best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
            assert len(got) == min(n, m) and sum(cost[i, j] for i, j in got) == best


def test_macro(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (None, 1)], "t int, p int")
    got = M.macro_scores(rows, "t", "p").first()
    assert np.allclose([got.p, got.r, got.f1], [(1 + 1 / 3 + 0) / 3, (0.5 + 1 + 0) / 3, (2 / 3 + 0.5 + 0) / 3])


def test_pearson(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 6.0)], "x double, y double")
    got = M.pearson(rows, "x", "y")
    assert abs(got["pearson"] - 0.8219949365) < 1e-9 and abs(got["p_value"] - 0.0877066) < 1e-4


def test_series_and_spread(spark):
    rows = spark.createDataFrame([("en", "a", "0.7", 2.0), ("en", "a", "0.1", 1.0)], "lang string, model string, t string, f1 double")
    assert [(p.t, p.value) for p in M.series_by_model(rows, "f1").first().series] == [(0.1, 1.0), (0.7, 2.0)]
    assert M.mean_std(rows, "model", "f1").select("mean", "std").first() == (1.5, 0.71)
    assert M.cluster_sizes(rows, "model").select(F.col("max_size")).first()[0] == 2


def test_label_max_distances_copy_rows_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCKS", 3), monkeypatch.setattr(M, "STRIP", (3, 5))
    rng = np.random.default_rng(4)
    x, labels = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    x[7] = 0
    rows = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x))], "idx long, label long, vec array<double>")
    got = M.label_max_distances(rows, block=4)
    assert "sequence(0, 2" in got._jdf.queryExecution().logical().toString() or "[0,1,2]" in got._jdf.queryExecution().optimizedPlan().toString()
    far = 1 - (u := x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ u.T
    wanted = {(a, b): far[np.ix_(labels == a, labels == b)].max() for a in range(4) for b in range(a, 4)}
    assert {(r.a, r.b): pytest.approx(r.max_distance) for r in got.collect()} == wanted
