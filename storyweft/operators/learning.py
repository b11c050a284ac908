"""Splits, classification and encoder hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _hashed(seed: int, idx: str) -> Column:
    """Eight hexadecimal digits of a hash of seed and idx."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")).cast("binary")), 1, 8)


def half_split(rows: DataFrame, seed: int, idx: str = "idx") -> DataFrame:
    """rows with train, true for about half of them: by a hash of seed and idx, so a row's side
    depends on nothing else and no shuffle is needed."""
    return rows.withColumn("train", _hashed(seed, idx) < "80000000")


def share_split(rows: DataFrame, share: float = 0.8, seed: int = 0, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(about the share of rows, the others), by a hash of seed and idx."""
    inside = _hashed(seed, idx) < f"{int(share * (1 << 32)):08x}" if share < 1 else F.lit(True)
    return rows.where(inside), rows.where(~inside)


def exact_half_split(rows: DataFrame, seed: int, idx: str = "idx", groups: int = 64) -> DataFrame:
    """rows with train, true for half of each of ``groups`` hash groups: halves to within groups."""
    group = F.pmod(F.xxhash64(F.col(idx)), F.lit(groups))
    return rows.withColumn("train", F.ntile(2).over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(idx)), idx)) == 1)


def kernel_classifier(rows: DataFrame, seed: int = 0, landmarks: int = 200, c: float = 3.0, idx: str = "idx") -> DataFrame:
    """(idx, label, prediction) of the half of rows (idx, label, vec) that is not trained on.

    An approximation of a kernel SVM with kernel 1 - distance: rows become their kernel values with
    ``landmarks`` training rows, and one machine per class against the rest is the least-squares
    one, whose sums of products come from one pass: landmarks * (landmarks + classes) numbers."""
    split = half_split(rows.where(F.col("label").isNotNull()), seed, idx).select(idx, F.col("label"), "vec", "train")
    chosen = split.where("train").orderBy(F.xxhash64(F.lit(seed + 1), F.col(idx)), idx).limit(landmarks).select("vec").collect()
    classes = [r[0] for r in split.where("train").select("label").distinct().orderBy("label").collect()]
    if not chosen:
        return split.where("NOT train").select(idx, "label", F.lit(None).cast(rows.schema["label"].dataType).alias("prediction"))
    points = np.array([r.vec for r in chosen], np.float64)
    n, place = len(points) + 1, {v: k for k, v in enumerate(classes)}

    def kernel(vectors) -> np.ndarray:
        x = np.stack([np.asarray(v, np.float64) for v in vectors])
        far = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * x @ points.T))
        return np.concatenate([1 - far, np.ones((len(x), 1))], 1)

    def sums(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((n, n + len(classes)))
        for batch in batches:
            if batch.num_rows:
                k, y = kernel(batch.column("vec").to_pylist()), np.full((batch.num_rows, len(classes)), -1.0)
                y[np.arange(batch.num_rows), [place[v] for v in batch.column("label").to_pylist()]] = 1.0
                total += k.T @ np.concatenate([k, y], 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], ["at", "x"])

    found = split.where("train").select("label", "vec").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(n * (n + len(classes)))
    total[found["at"].to_numpy()] = found["x"].to_numpy()
    total = total.reshape(n, -1)
    weights = np.linalg.solve(total[:, :n] + np.eye(n) / c, total[:, n:])

    @F.pandas_udf("int")
    def best(vec: pd.Series) -> pd.Series:
        return pd.Series((kernel(vec) @ weights).argmax(1).astype(np.int32))

    names = F.array(*(F.lit(x) for x in classes))
    return split.where("NOT train").select(idx, "label", F.get(names, best("vec")).cast(rows.schema["label"].dataType).alias("prediction"))


def hashing_encoder(dims: int = 16) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for pretrained encoders, for tests and for runs without models."""
    import hashlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for k, text in enumerate(texts):
            for word in text.split():
                h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                out[k, h % dims] += 1 if h // dims % 2 else -1
        return out

    return encode


def encode(docs: DataFrame, provider: Callable[[], Callable[[list[str]], np.ndarray]], idx: str = "doc_id", text: str = "text", batch: int = 64, prompt: str = "", normalise: bool = False) -> DataFrame:
    """(idx, vec) by a model that ``provider()`` loads once per worker: sentence, contextual word or
    image encoders (pass paths or encoded bytes as text) alike; ``batch`` texts go in at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        model = provider()
        for rows in batches:
            texts = [prompt + (t or "") for t in rows.column(1).to_pylist()]
            found = np.concatenate([np.asarray(model(texts[k : k + batch]), np.float64) for k in range(0, len(texts), batch)]) if texts else np.zeros((0, 0))
            if normalise and len(texts):
                found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([rows.column(0).cast(pa.int64()), pa.array([v.tolist() for v in found], pa.list_(pa.float64()))], ["idx", "vec"])

    return docs.select(F.col(idx).cast("long").alias("idx"), text).mapInArrow(run, "idx long, vec array<double>")


def generate(docs: DataFrame, provider: Callable[[], Callable[[list[str]], list[str]]], text: str = "text", out: str = "generated", limit: int | None = None) -> DataFrame:
    """docs with a text that a generator made for each; ``limit`` rows at most, where given."""
    docs = docs.limit(limit) if limit else docs
    schema = StructType([*docs.schema.fields, StructField(out, StringType())])

    def run(batches):
        model = provider()
        for rows in batches:
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model([t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]), pa.string())], [*rows.schema.names, out])

    return docs.mapInArrow(run, schema)
