"""Best-fit packing of documents into training sequences of several permitted lengths.

A document's length is its number of tokens, as the tokenizers library gives them, and one end mark.
Documents longer than the longest sequence are cut into full sequences and a rest; every token is packed once.
Pieces are dealt into blocks of about BLOCK pieces by a hash of doc_id, so a block is bounded
however large the corpus is; inside a block, pieces go by falling length, then id, each into the
open bin with the least room that still takes it, of equal ones the one filled last. If none does, a bin is opened whose size has the
least cost for what can still come to fill it; in the end each bin is downsized to the smallest
permitted length that holds its contents. A sequence of length c costs ``OVERHEAD + c + c * c /
QUADRATIC``, that is a fixed part, one that grows with its tokens and one for attention.

Null or empty text: one token, its end mark. Texts of any length are packed whole. Rows without
doc_id are packed like others, repeated rows as often as they occur; equal lengths and ids are equal
items, so their order changes nothing but which row is named. An empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm import byte_pairs, token_counts
from storyweft.llm.columns import cut, pieces_of_batch, table
from storyweft.llm.token_files import END_ID, encode_texts

SIZES = (512, 1024, 2048, 4096)
BLOCK = 8192
#: Of the counts that a worker keeps.
CACHE_BYTES = 96 << 20
OVERHEAD, QUADRATIC = 64.0, 16384.0
SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_size long, bin_tokens long, at long"


def cost(size: int) -> float:
    return OVERHEAD + size + size * size / QUADRATIC


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, place of each item in its bin, final size of each bin) for items by
    falling length, none above the largest size."""
    sizes = tuple(sorted(sizes))
    to_come = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])
    bins, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    having: dict[int, list[int]] = {}
    for i, x in enumerate(lengths.tolist()):
        k = bisect_left(rooms, x)
        if k < len(rooms):
            room = rooms[k]
            b = having[room].pop()
            if not having[room]:
                del having[room], rooms[k]
        else:
            b, room = len(used), min((s for s in sizes if s >= x), key=lambda s: (cost(s) / min(s, int(to_come[i])), s))
            used.append(0)
        bins[i], at[i] = b, used[b]
        used[b] += x
        if room - x:
            if room - x not in having:
                insort(rooms, room - x)
                having[room - x] = []
            having[room - x].append(b)
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return bins, at, final


@lru_cache(1)
def _library_counts(path: str, limit: int):
    """Counts of pre-tokens by the tokenizers library, of which limit bytes are kept, the special strings."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    encode = lambda words: [len(e) for e in library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
    return byte_pairs.CountCache(encode, limit), token_counts.specials_of(path)


def lengths_of(docs: DataFrame, tokenizer: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id and length, the number of tokens and one end mark, of each row of docs."""
    path, counter = tokenizer or byte_pairs.default_json(), partial(_library_counts, limit=cache_bytes)

    def run(batches):
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch):
                yield pa.record_batch([keys, pa.array(token_counts.count_texts(data, offsets, path, counter) + 1)], ["doc_id", "length"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, length long")


def filled(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """bin_id, bin_size, ids: the training sequences themselves, each document's token ids and end_id
    behind them, for docs of distinct ids placed by pack()."""
    path = tokenizer or byte_pairs.default_json()

    def run(batches):
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch):
                lists = [np.append(x, np.uint32(end_id)).astype(np.int32) for x in encode_texts(data, offsets, path)]
                ends = np.cumsum([0, *map(len, lists)])
                yield pa.record_batch([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], ["doc_id", "ids"])

    encoded = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
    part = F.slice("ids", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))
    pieces = placed.join(encoded, "doc_id").select("bin_id", "bin_size", F.struct("at", part.alias("part")).alias("piece"))
    each = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["part"])
    return pieces.groupBy("bin_id", "bin_size").agg(F.flatten(each).alias("ids"))


def pack(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, block: int = BLOCK) -> DataFrame:
    """Packs (doc_id, length): a row per piece with its bin, the bin's size and tokens, and the
    piece's place in it."""
    largest = max(sizes)
    arrow = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in re.findall(r"(\w+) (?:int|long)", SCHEMA)])
    lengths = cut(lengths)
    pieces = lengths.select("doc_id", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(largest).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(largest).cast("long"), F.col("length") - F.col("start")).alias("n_tokens"))
    total = lengths.agg(F.sum(F.ceil(F.col("length") / largest))).first()[0] or 0
    blocks = max(1, -(-int(total) // block))

    def run(group: pa.Table) -> pa.Table:
        length, ids = group["n_tokens"].to_numpy(), group["doc_id"].fill_null(-(1 << 63)).to_numpy()
        group = group.take(pa.array(np.lexsort((group["piece"].to_numpy(), ids, -length))))
        length = group["n_tokens"].to_numpy()
        bins, at, final = best_fit(length, sizes)
        held = np.bincount(bins, length, len(final)).astype(np.int64)
        first = group["block"][0].as_py() << 32
        columns = [group[c] for c in ("doc_id", "piece", "start", "n_tokens")]
        return pa.table([*columns, pa.array(first + bins), pa.array(final[bins]), pa.array(held[bins]), pa.array(at)], schema=arrow)

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(lengths_of(table(spark, sf_dir, "documents")))
