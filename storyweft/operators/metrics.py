"""Cluster quality from the contingency of labels and predictions; one aggregation serves all.

Rows without a label are left out everywhere. A result that would divide by zero is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n, n_label, n_pred) of labelled rows with a prediction."""
    cells = rows.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    per = lambda c: F.sum("n").over(Window.partitionBy(c))
    return cells.withColumns({"n_label": per("label"), "n_pred": per("pred")})


def _f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def cluster_sizes(rows: DataFrame, pred: str = "pred") -> DataFrame:
    """Count, mean, standard deviation, minimum, median and maximum of cluster sizes."""
    sizes = rows.groupBy(pred).agg(F.count("*").alias("size"))
    return sizes.agg(
        F.count("*").alias("clusters"),
        F.avg("size").alias("mean_size"),
        F.stddev_samp("size").alias("std_size"),
        F.min("size").alias("min_size"),
        F.percentile("size", F.lit(0.5)).alias("median_size"),
        F.max("size").alias("max_size"),
    )


def best_match(cells: DataFrame) -> DataFrame:
    """(p, r, f1): means over labels of those of the cluster with the best f1; of equal f1 the one
    with more of the label, then the smaller prediction."""
    p, r = F.col("n") / F.col("n_pred"), F.col("n") / F.col("n_label")
    scored = cells.select("label", "pred", "n", p.alias("p"), r.alias("r"), _f1(p, r).alias("f1"))
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("f1"), F.desc("n"), "pred"))
    return scored.withColumn("k", first).where("k = 1").agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1"))


def purity(rows: DataFrame, least_rows: int = 5, least_share: float = 0.8, label: str = "label", pred: str = "pred") -> DataFrame:
    """(p, r, f1): share of clusters that are mostly of one label, and of labels such a cluster has.
    Sizes are counted before rows of small labels, of small clusters and of prediction -1 go."""
    rows = rows.where(F.col(pred).isNotNull()).select(F.col(label).alias("label"), F.col(pred).alias("pred"))
    cells = rows.groupBy("label", "pred").agg(F.count("*").alias("n"))
    sized = cells.withColumns({"size_label": F.sum("n").over(Window.partitionBy("label")), "size_pred": F.sum("n").over(Window.partitionBy("pred"))})
    labels = sized.where(F.col("label").isNotNull() & (F.col("size_label") >= least_rows))
    kept = labels.where((F.col("pred") != -1) & (F.col("size_pred") >= least_rows))
    preds = kept.groupBy("pred").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("main"))
    hit = F.col("most") >= least_share * F.col("total")
    got = preds.agg(F.count("*").alias("preds"), F.count_if(hit).alias("hits"), F.count_distinct(F.when(hit, F.col("main"))).alias("found"))
    wanted = labels.agg(F.count_distinct("label").alias("labels"))
    both = got.withColumn("one", F.lit(1)).join(F.broadcast(wanted.withColumn("one", F.lit(1))), "one")  # a row each
    both = both.select(F.try_divide("hits", "preds").alias("p"), F.try_divide("found", "labels").alias("r"))
    return both.select("p", "r", _f1(F.col("p"), F.col("r")).alias("f1"))


def bcubed(cells: DataFrame) -> DataFrame:
    sums = cells.agg(F.sum(F.col("n") * F.col("n") / F.col("n_pred")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("n_label")).alias("b"), F.sum("n").alias("m"))
    out = sums.select(F.try_divide("a", "m").alias("p"), F.try_divide("b", "m").alias("r"))
    return out.select("p", "r", F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(_f1(F.col("p"), F.col("r"))).alias("f1"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def adjusted_rand(cells: DataFrame) -> DataFrame:
    one = cells.select(F.lit(1).alias("one"), "label", "pred", "n", "n_label", "n_pred")
    margin = lambda c, n: F.sum(_pairs(F.col(n)) * F.col("n") / F.col(n))  # noqa: E731  each margin once: its cells add up to it
    s = one.agg(F.sum(_pairs(F.col("n"))).alias("s"), margin("label", "n_label").alias("sl"), margin("pred", "n_pred").alias("sp"), _pairs(F.sum("n")).alias("c"))
    expected = F.try_divide(F.col("sl") * F.col("sp"), F.col("c"))
    same = (F.col("s") == F.col("sl")) & (F.col("s") == F.col("sp"))
    return s.select(F.when(same, 1.0).otherwise(F.try_divide(F.col("s") - expected, (F.col("sl") + F.col("sp")) / 2 - expected)).alias("ari"))


#: ln(k!) of 0 to 9; beyond, Stirling's series is exact to about 1e-13.
SMALL = np.array([float(np.log(np.arange(1, k + 1)).sum()) for k in range(10)])


def ln_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 10, SMALL[np.clip(n, 0, 9)], series)


def expected_information(a: int, b: int, total: int) -> float:
    """Mutual information that two clusters of these sizes have by chance. Overlaps further than 14
    deviations from their mean have no weight in a double and are left out."""
    mean = a * b / total
    wide = 14 * (mean * (1 - a / total) * (total - b) / max(1, total - 1)) ** 0.5 + 40
    k = np.arange(max(1, a + b - total, int(mean - wide)), min(a, b, int(mean + wide) + 1) + 1, dtype=np.int64)
    f = lambda n: ln_factorial(np.asarray(n, np.int64))
    ways = f(a) + f(b) + f(total - a) + f(total - b) - f(total) - f(k) - f(a - k) - f(b - k) - f(total - a - b + k)
    return float((k / total * np.log(total * (k / (a * b))) * np.exp(ways)).sum())


def adjusted_mutual_info(cells: DataFrame) -> DataFrame:
    """(mi, emi, ami), with the mean of the entropies as the norm. Expected information is summed
    per pair of distinct sizes: those of labels are dealt out, those of predictions, of which n rows
    have sqrt(2 n) at most, go to all tasks."""
    total = int(cells.agg(F.sum("n")).first()[0] or 0)
    n = F.lit(float(total))
    mi = F.sum(F.col("n") / n * F.log(F.col("n") * n / (F.col("n_label") * F.col("n_pred"))))
    entropy = lambda size: F.sum(-F.col("n") / n * F.log(F.col(size) / n))
    seen = cells.agg(F.coalesce(mi, F.lit(0.0)).alias("mi"), entropy("n_label").alias("hl"), entropy("n_pred").alias("hp"))
    sizes = lambda key, size: cells.groupBy(key).agg(F.first(size).alias("size")).groupBy("size").agg(F.count("*").alias("times"))
    others = [(r["size"], r["times"]) for r in sizes("pred", "n_pred").collect()]  # sqrt(2 n) rows at most

    def run(batches):
        for batch in batches:
            for a, times in zip(batch.column("size").to_pylist(), batch.column("times").to_pylist()):
                yield pa.record_batch([pa.array([sum(times * k * expected_information(a, b, total) for b, k in others)], pa.float64())], ["emi"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emi = sizes("label", "n_label").repartition(parts, "size").mapInArrow(run, "emi double").agg(F.sum("emi")).first()[0]
    out = seen.withColumn("emi", F.lit(emi).cast("double"))
    return out.select("mi", "emi", F.try_divide(F.col("mi") - F.col("emi"), (F.col("hl") + F.col("hp")) / 2 - F.col("emi")).alias("ami"))


def macro_scores(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(p, r, f1): unweighted means over the classes of either column, 0 where undefined."""
    cells = rows.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    both = cells.select(F.inline(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("of_truth"), F.lit(0).cast("long").alias("of_pred"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("of_truth"), F.col("n").alias("of_pred"), F.lit(0).cast("long").alias("hit")))))
    per = both.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("of_truth").alias("t"), F.sum("of_pred").alias("p"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scores = per.select(zero(F.col("hit"), F.col("p")).alias("p"), zero(F.col("hit"), F.col("t")).alias("r"), zero(2 * F.col("hit"), F.col("p") + F.col("t")).alias("f1"))
    return scores.agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assignment(cost.T))
    row_price, col_price, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], j = i, m
        reach, came, done = np.full(m, np.inf), np.full(m, m), np.zeros(m, bool)
        visited = []
        while owner[j] >= 0:
            if j < m:
                done[j] = True
            visited.append(j)
            r = owner[j]
            slack = cost[r] - row_price[r] - col_price[:m]
            better = ~done & (slack < reach)
            reach[better], came[better] = slack[better], j
            free = np.where(done, np.inf, reach)
            k = int(free.argmin())
            step = free[k]
            for v in visited:
                row_price[owner[v]] += step
                if v < m:
                    col_price[v] -= step
            reach[~done] -= step
            j = k
        while j != m:
            owner[j], j = owner[came[j]], int(came[j])
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def assigned_accuracy(cells: DataFrame, most_classes: int = 5000) -> float | None:
    """Share of rows on the best one-to-one mapping of labels and predictions. The contingency comes
    to the driver, so it is refused above most_classes labels or predictions."""
    size = cells.agg(F.count_distinct("label").alias("l"), F.count_distinct("pred").alias("p")).first()
    if max(size) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    rows = cells.select("label", "pred", "n").collect()
    if not rows:
        return None
    labels, preds = {v: k for k, v in enumerate(sorted({r.label for r in rows}))}, {v: k for k, v in enumerate(sorted({r.pred for r in rows}))}
    table = np.zeros((len(labels), len(preds)))
    for r in rows:
        table[labels[r.label], preds[r.pred]] = r.n
    return float(sum(table[i, j] for i, j in assignment(-table)) / table.sum())


def label_distances(rows: DataFrame, dims: int, label: str = "label", vec: str = "vec") -> DataFrame:
    """(a, b, mean_distance) of each pair of labels, own ones too, by their centroids: the mean of
    1 - cosine over all pairs is 1 - the dot product of the mean unit vectors."""
    from storyweft.functions import vectors as V

    parts = rows.select(F.col(label).alias("label"), F.posexplode(V.unit(V.doubles(F.col(vec)))).alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    a, b = parts.select(F.col("label").alias("a"), "d", F.col("x").alias("xa")), parts.select(F.col("label").alias("b"), "d", F.col("x").alias("xb"))
    return a.join(b, "d").where("a <= b").groupBy("a", "b").agg((1 - F.sum(F.col("xa") * F.col("xb"))).alias("mean_distance"))


#: Blocks that rows are dealt into at most, unless one then has more than LARGEST rows; rows of a matrix product.
BLOCKS, LARGEST, STRIP = 12, 32768, (1024, 4096)


def label_max_distances(rows: DataFrame, label: str = "label", vec: str = "vec", block: int = 2048) -> DataFrame:
    """(a, b, max_distance) of each pair of labels, own ones too. Every two rows have to meet: rows
    are dealt into blocks by a hash of idx, and each pair of blocks is one task. Blocks grow with the
    table from ``block`` to LARGEST rows, so up to BLOCKS * LARGEST rows each is copied BLOCKS times at
    most; products are taken by strips."""
    count = rows.count()
    blocks = max(1, min(BLOCKS, -(-count // block)), -(-count // LARGEST))
    from storyweft.functions import vectors as V

    mine = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")
    unit = rows.select("idx", F.col(label).cast("long").alias("label"), V.unit(V.doubles(F.col(vec))).alias("vec"), mine.alias("mine"))
    dealt = unit.select("label", "vec", "mine", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("label", "vec", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))

    def strips(labels: np.ndarray, x: np.ndarray, rows: int):
        """(label of each run, its begin, vectors) of some rows at a time, in order of labels."""
        order = np.argsort(labels, kind="stable")
        for k in range(0, len(order), rows):
            some = order[k : k + rows]
            found, begins = np.unique(labels[some], return_index=True)
            yield found, begins, x[some]

    def run(group: pa.Table) -> pa.Table:
        labels, flat = group["label"].to_numpy(), group["vec"].combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(labels), -1)
        first = group["mine"].to_numpy() == group["p"].to_numpy()[0]
        second = ~first if group["p"][0] != group["q"][0] else first
        best: dict = {}
        others = [*strips(labels[second], x[second], STRIP[1])]
        for mine, begins, left in strips(labels[first], x[first], STRIP[0]):
            for theirs, starts, right in others:
                near = np.minimum.reduceat(np.minimum.reduceat(left @ right.T, starts, axis=1), begins, axis=0)
                for a, line in zip(mine.tolist(), near.tolist()):
                    for b, s in zip(theirs.tolist(), line):
                        key = (min(a, b), max(a, b))
                        best[key] = max(best.get(key, -1.0), 1 - s)
        return pa.table({"a": pa.array([k[0] for k in best], pa.int64()), "b": pa.array([k[1] for k in best], pa.int64()), "d": pa.array([*best.values()], pa.float64())})

    found = dealt.groupBy("p", "q").applyInArrow(run, "a long, b long, d double")
    return found.groupBy("a", "b").agg(F.max("d").alias("max_distance"))


def pearson(rows: DataFrame, x: str, y: str) -> dict[str, float | None]:
    """Correlation and two-sided p value (Student's t by numerical integration)."""
    r, n = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y), F.count("*")).first()
    if r is None or n < 3 or abs(r) >= 1:
        return {"pearson": r, "p_value": 0.0 if r is not None and abs(r) >= 1 and n > 2 else None}
    k = n - 2
    t = abs(r) * (k / (1 - r * r)) ** 0.5
    angle = np.linspace(np.arctan(t / k**0.5), np.pi / 2, 200_001)
    whole = np.linspace(0, np.pi / 2, 200_001)
    mass = lambda a: float(np.trapezoid(np.cos(a) ** (k - 1), a))
    return {"pearson": float(r), "p_value": mass(angle) / mass(whole)}


def series_by_model(results: DataFrame, measure: str) -> DataFrame:
    """(lang, model, series): (t, measure) of each model by ascending threshold."""
    return results.groupBy("lang", "model").agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col(measure).alias("value")))).alias("series"))


def mean_std(results: DataFrame, by: str, measure: str) -> DataFrame:
    return results.groupBy(by).agg(F.round(F.avg(measure), 2).alias("mean"), F.round(F.stddev_samp(measure), 2).alias("std"))
