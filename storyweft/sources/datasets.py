"""Readers and writers of the file formats of the pipeline."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.functions import text as T
from storyweft.session import with_index

REQUIRED = ("id", "label", "text", "created_at")


def _numbered(df: DataFrame) -> DataFrame:
    """df, as read from files, with _line, rising in file and line order: by the file's path, then by
    where its part begins, then inside the part."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias("_line"))


def prepare(df: DataFrame, annotation: str = "no", text_plus: bool = False, images_only: bool = False) -> DataFrame:
    """Documents as every later step takes them: one row per id, the first by _line if there is that
    column; sorted by id as text and numbered from 0 in idx; null texts empty; date and time.

    annotation: "annotated" keeps rows with a label, "examined" those with an event (if there is a
    label column), "no" all."""
    if annotation == "annotated":
        df = df.where(F.col("label").isNotNull())
    elif annotation == "examined" and "label" in df.columns:
        df = df.where(F.col("event").isNotNull())
    if images_only:
        df = df.where(F.col("image").isNotNull())
    if text_plus:
        df = df.drop("text").withColumnRenamed("text+quote+reply", "text")
    df = df.withColumns({"id": F.col("id").cast("string"), "text": T.null_to_empty(F.col("text"))})
    if "_line" in df.columns:
        first = F.row_number().over(Window.partitionBy("id").orderBy("_line"))
        df = df.withColumn("_k", first).where("_k = 1").drop("_k", "_line")
    else:
        df = df.dropDuplicates(["id"])
    if "created_at" in df.columns:
        at = T.parse_created_at(F.col("created_at"))
        df = df.withColumns({"date": T.date_of(at), "time": T.time_of(at)})
    return with_index(df, "id")


def load_dataset(spark: SparkSession, path: str, annotation: str = "no", text_plus: bool = False, images_only: bool = False) -> DataFrame:
    """A TSV with a header, all fields quoted; label is a number or null, all else text."""
    raw = _numbered(spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True))
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"columns missing: {missing}")
    return prepare(raw.withColumn("label", F.col("label").cast("double")), annotation, text_plus, images_only)


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """label and id of a TSV without header, each row once."""
    return spark.read.schema("label string, id string").csv(path, sep="\t").distinct()


def load_posts(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """(r, created_at, ts, text) of CSV files with a header each, numbered on through the files in
    the order of the list."""
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for k, path in enumerate(paths):
        one = _numbered(spark.read.csv(path, sep=sep, header=True, multiLine=True)).select("created_at", "text", "_line", F.lit(k).alias("_file"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("ts", T.parse_created_at(F.col("created_at")))
    return with_index(out, "_file", "_line", name="r").select("r", "created_at", "ts", "text")


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Scored pairs with distance 1 - score / 5 and similarity score / 5."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    score = F.col("Moyenne").cast("double")
    return raw.withColumns({"distance": 1 - score / 5, "similarity": score / 5})


def load_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of image files by ascending name, for encoders that take bytes."""
    return spark.read.format("binaryFile").load(folder).select("path", "content").orderBy("path")


def load_options(path: str, spark: SparkSession | None = None) -> dict:
    """Options of a YAML file, by Spark's readers if a session is given."""
    import yaml

    if spark is not None:
        return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def precomputed_distances(similar: DataFrame) -> DataFrame:
    """(i, j, d) from similarities (i, j, sim)."""
    from storyweft.functions.vectors import similarity_to_distance

    return similar.select("i", "j", similarity_to_distance(F.col("i"), F.col("j"), F.col("sim")).alias("d"))


def hydrate(ids: DataFrame, posts: DataFrame) -> DataFrame:
    """ids with the posts that were found, text on one line."""
    return ids.join(posts, "id").where(F.col("text").isNotNull()).withColumn("text", T.one_line(F.col("text")))


def hydrated_share(ids: DataFrame, posts: DataFrame) -> DataFrame:
    joined = ids.select("id").distinct().join(posts.where(F.col("text").isNotNull()).select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return joined.select(F.round(100 * F.count("hit") / F.count("*"), 0).alias("percent"))


def post_fields(raw: DataFrame) -> DataFrame:
    """id, created_at, text, url_image of nested posts."""
    media = T.media_url(F.col("extended_entities.media"))
    return raw.select(F.col("id_str").alias("id"), "created_at", F.col("full_text").alias("text"), media.alias("url_image"))


def fetch_posts(ids: DataFrame, provider: Callable[[], Callable[[list[str]], list[dict]]], batch: int = 100) -> DataFrame:
    """One JSON text per found post. ``provider()`` gives a client once per task; the client waits
    for rate limits itself. Batches that find nothing do not end the run."""

    def run(batches: Iterable[pa.RecordBatch]):
        client = provider()
        for rows in batches:
            wanted = rows.column(0).to_pylist()
            found = [json.dumps(p) for k in range(0, len(wanted), batch) for p in client(wanted[k : k + batch])]
            yield pa.record_batch([pa.array(found, pa.string())], ["value"])

    return ids.select("id").mapInArrow(run, "value string")


def cache_path(root: str, options: dict) -> str:
    """Where a feature table lies: readable names, and a digest of every option."""
    digest = hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return "/".join([root, str(options.get("dataset", "data")), str(options.get("model", "model")), f"{options.get('annotation', 'no')}-{digest}"])


def save_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame | None:
    """A cached table, null if there is none; keep (idx) masks the rows of a larger one."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return found if keep is None else found.join(keep.select("idx").distinct(), "idx", "left_semi")


def save_history(frequency: DataFrame, n: int, path: str) -> None:
    frequency.select("token", "df").write.mode("overwrite").parquet(f"{path}/df")
    frequency.sparkSession.createDataFrame([(int(n),)], "n_samples long").write.mode("overwrite").parquet(f"{path}/stats")


def load_history(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(f"{path}/df"), int(spark.read.parquet(f"{path}/stats").first()[0])


PREDICTION_COLUMNS = ("date", "time", "label", "pred", "user_id_str", "id")


def save_predictions(rows: DataFrame, path: str, threshold: float | None = None) -> None:
    """TSV of the columns that are there, in fixed order; one folder per threshold."""
    kept = rows.select(*[c for c in PREDICTION_COLUMNS if c in rows.columns])
    kept.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path if threshold is None else f"{path}/t={threshold}")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").option("header", True).csv(path)


#: Writers cut the spaces around values unless told not to.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def save_labelled(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("quoteAll", True).option("escape", '"').options(**KEEP_SPACE).option("header", True).csv(path)


def save_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_bursts(scores: DataFrame, path: str) -> None:
    """Most frequent tokens first; of equal ones the one that occurred first, where scores have that
    (first), else by token."""
    tie = "first" if "first" in scores.columns else "token"
    scores.orderBy(F.desc("df"), tie).select("token", "df", "idf", "jlh_max").write.mode("overwrite").option("header", True).csv(path)
