"""Whole runs: features, stories and their scores; classification over seeds."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.functions import text as T
from storyweft.functions import vectors as V
from storyweft.operators import learning, metrics, neighbors, pooling, stories, tfidf
from storyweft.plans.options import Options, cleaning
from storyweft.session import cut
from storyweft.sources import datasets


def clean(docs: DataFrame, options: Options) -> DataFrame:
    """docs (idx, text) with texts as the options want them."""
    return docs.select("idx", T.format_text(F.col("text"), **cleaning(options)).alias("text"))


def build_features(docs: DataFrame, options: Options, provider=None, history=None, history_n: int = 0, stop_words=None, vectors=None, cleaned: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(features, sparse) of docs (idx, text): (idx, token, w), or (idx, vec) for other models. Word
    vectors (w2v models) are a table vectors (token, vec); their weights, if asked for, come from the
    document frequencies of history. cleaned: what clean() gives, if the caller has it."""
    cleaned = clean(docs, options) if cleaned is None else cleaned
    if options.model.startswith("tfidf"):
        weighted = tfidf.tfidf(cleaned, "idx", "text", options.min_df, options.binary, stop_words=stop_words, history=history, history_n=history_n)
        return (tfidf.svd_project(weighted), False) if options.svd else (weighted, True)
    if options.model.startswith("w2v"):
        if vectors is None or (options.tfidf_weights and history is None):
            raise ValueError(f"model {options.model} needs a table of word vectors, and for weights a history")
        idf = history.select("token", tfidf.smoothed_idf(F.col("df"), history_n).alias("idf")) if options.tfidf_weights else None
        dims = vectors.select(F.size("vec")).first()
        return pooling.mean_pool(cleaned, vectors, dims[0] if dims else 0, "idx", "text", idf), False
    if provider is None:
        raise ValueError(f"model {options.model} needs an encoder")
    return learning.encode(cleaned, provider, "idx"), False


def cached_features(docs: DataFrame, options: Options, root: str, **more) -> tuple[DataFrame, bool]:
    """build_features() through a cache below root. The key holds every option; a table of
    ``examined`` rows also serves ``annotated`` ones, masked to the rows of docs."""
    spark = docs.sparkSession
    key = asdict(options)
    sparse = options.model.startswith("tfidf") and not options.svd
    wider = [key] + ([key | {"annotation": "examined"}] if options.annotation == "annotated" and not sparse else [])
    for one in wider:
        found = datasets.load_features(spark, datasets.cache_path(root, one), docs if one is not key else None)
        if found is not None:
            return found, sparse
    features, sparse = build_features(docs, options, **more)
    if options.save:
        datasets.save_features(features, datasets.cache_path(root, key))
        features = datasets.load_features(spark, datasets.cache_path(root, key))
    return features, sparse


def cluster(docs: DataFrame, options: Options, provider=None, **more) -> tuple[DataFrame, DataFrame | None]:
    """(predictions (t, idx, pred), scores per t or null without labels) of docs (idx, text, date,
    label if there is one)."""
    features, sparse = build_features(docs, options, provider, **more)
    features = cut(features)
    window = stories.window_rows(docs, "date", options.window, options.batch_size)
    mask = None
    if sparse:
        positions = cut(stories.dense_positions(features))
        rows = features.join(positions, "idx").select("i", "token", "w")
        mask = tfidf.seed_mask(rows.withColumnRenamed("i", "idx")).withColumnRenamed("idx", "i")
        near = neighbors.nearest_sparse(rows, mask, window, options.batch_size)
    else:
        features = features.where(~V.is_zero(F.col("vec")))
        positions = cut(stories.dense_positions(features))
        near = neighbors.nearest_dense(features.join(positions, "idx").select("i", "vec"), window, options.batch_size)
    found = cut(stories.sweep(docs, positions, near, options.threshold, mask, options.batch_size, "idx"))
    if "label" not in docs.columns or docs.where(F.col("label").isNotNull()).isEmpty():
        return found, None
    return found, score_sweep(found.join(docs.select("idx", "label"), "idx"), options.threshold)


def score_sweep(rows: DataFrame, thresholds) -> DataFrame:
    """One row of scores per threshold of rows (t, label, pred)."""
    out = None
    for t in thresholds:
        one = rows.where(F.col("t") == float(t))
        cells = metrics.contingency(one).cache()
        parts = {"": metrics.best_match(cells), "mc_": metrics.purity(one), "bcub_": metrics.bcubed(cells)}
        row = metrics.adjusted_rand(cells).withColumn("t", F.lit(float(t))).join(metrics.adjusted_mutual_info(cells).select("ami").withColumn("t", F.lit(float(t))), "t")
        row = row.join(metrics.cluster_sizes(one).withColumn("t", F.lit(float(t))), "t")
        for prefix, scores in parts.items():
            row = row.join(scores.select(*[F.col(c).alias(prefix + c) for c in scores.columns]).withColumn("t", F.lit(float(t))), "t")
        out = row if out is None else out.unionByName(row)
    return out


def score_pairs(pairs: DataFrame, provider, first: str = "1_text", second: str = "2_text", normalise: bool = False, prompt: str = "") -> DataFrame:
    """pairs with ``cosine``, the distance of their texts' encodings. Each distinct text is encoded
    once, under a number of its own; pairs meet their texts by the texts themselves."""
    texts = pairs.select(F.col(first).alias("_text")).union(pairs.select(F.col(second))).distinct()
    numbered = cut(texts.withColumn("_n", F.monotonically_increasing_id()))
    found = learning.encode(numbered, provider, "_n", "_text", prompt=prompt, normalise=normalise)
    known = cut(numbered.join(found, F.col("_n") == F.col("idx")).select("_text", "vec"))
    out = pairs
    for column, name in ((first, "_x"), (second, "_y")):
        side = known.select(F.col("_text").alias("_key"), F.col("vec").alias(name))
        out = out.join(side, F.col(f"`{column}`").eqNullSafe(F.col("_key"))).drop("_key")
    return out.withColumn("cosine", V.cosine_distance(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def classify(rows: DataFrame, seeds=(11, 22, 33, 44, 55)) -> tuple[DataFrame, DataFrame]:
    """(scores per seed, their mean and deviation) of rows (idx, label, vec)."""
    out = None
    for seed in seeds:
        one = metrics.macro_scores(learning.kernel_classifier(rows, seed), "label", "prediction").withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out, metrics.mean_std(out.withColumn("all", F.lit(1)), "all", "f1").drop("all")
