"""Mean pooling of word vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.functions import text as T

#: Documents of a block, and numbers that are gathered at a time.
BLOCK, GATHERED = 1024, 1 << 22


def _pooled(docs: pa.Table, words: pa.Table, dims: int) -> np.ndarray:
    """Vectors of the rows of docs (idx, tokens), by words (token, vec)."""
    known = words["token"].combine_chunks().dictionary_encode()
    table = np.zeros((len(known.dictionary), dims))
    np.add.at(table, known.indices.to_numpy(), words["vec"].combine_chunks().flatten().to_numpy().reshape(len(known), dims))
    ids, lists = docs["idx"].combine_chunks().dictionary_encode(), docs["tokens"].combine_chunks()
    size = lists.value_lengths().to_numpy()
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known.dictionary), -1).to_numpy()
    owner = np.repeat(np.arange(len(size)), size)[at >= 0]
    at = at[at >= 0]
    sums, step = np.zeros((len(size), dims)), max(1, GATHERED // max(1, dims))
    for a in range(0, len(at), step):
        some, begins = np.unique(owner[a : a + step], return_index=True)
        sums[some] += np.add.reduceat(table[at[a : a + step]], begins)
    one = pc.fill_null(ids.indices, len(ids.dictionary)).to_numpy()
    total, whole = np.zeros((len(ids.dictionary) + 1, dims)), np.bincount(one, size, len(ids.dictionary) + 1)
    np.add.at(total, one, sums)
    total /= np.maximum(whole, 1)[:, None]
    total[-1] = 0  # rows without an idx
    return total[one]


def mean_pool(docs: DataFrame, vectors: DataFrame, dims: int, idx: str = "doc_id", text: str = "text", idf: DataFrame | None = None) -> DataFrame:
    """(idx, vec): the sum of the tokens' vectors (times their idf, if given) over the number of
    all tokens. Words without a vector, or without an idf, add nothing but count; a document
    without tokens is a zero vector. vectors: (token, vec).

    Documents are dealt into blocks of about BLOCK. The distinct words of a block meet the vectors, so
    a frequent word has a row per block, and what they find is summed up in the block."""
    found = vectors.select("token", F.col("vec").cast("array<double>").alias("vec"))
    if idf is not None:
        scaled = found.withColumn("key", F.lower(T.to_ascii(F.col("token")))).join(idf.select(F.col("token").alias("key"), "idf"), "key").where("idf is not null")
        found = scaled.select("token", F.transform("vec", lambda x: x * F.col("idf")).alias("vec"))
    blocks = -(-docs.count() // BLOCK)
    parts = max(blocks, 1) if blocks < 200 else 200 * (-(-blocks // (200 * 64)))
    block = F.pmod(F.xxhash64(F.col(idx)), F.lit(max(1, blocks))).cast("int")
    bags = docs.select(F.col(idx).alias("idx"), T.tokens(T.null_to_empty(F.col(text))).alias("tokens"), block.alias("block")).repartition(parts, "block")
    # both sides take the same rows and columns, so that Spark deals the documents out once
    of_rows = F.when(F.col("idx").isNotNull(), F.array_distinct("tokens"))
    words = bags.select(F.col("block").alias("within"), F.explode_outer(of_rows).alias("token")).distinct().join(found, "token").select("within", "token", "vec")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _pooled(left, right, dims)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dims).cast(pa.list_(pa.float64())) if dims else pa.array([[]] * len(out), pa.list_(pa.float64()))
        return pa.table({"idx": left["idx"], "vec": lists})

    kind = docs.schema[idx].dataType.simpleString()
    return bags.groupBy("block").cogroup(words.groupBy("within")).applyInArrow(run, f"idx {kind}, vec array<double>")
