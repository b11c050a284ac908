"""Token-id files: ids ranked by frequency, in byte-aligned codes with separate control bytes.

A file is a sequence of blocks in ascending document order. A block holds, little-endian:

    4 x uint32   documents d, ids n, distinct ids r, data bytes m
    d x int64    document ids
    d x uint32   ids per document
    r x uint32   id of each rank; ranks go by falling frequency in the block, then by id
    ceil(n / 4)  control bytes: two bits per id, the length of its rank less one, first id lowest
    m            the ranks' bytes, lowest first

Ranking inside a block covers all its ids and needs one pass over the corpus. A reader takes the
lengths of four ids at once from a table of 256 rows.

Documents are dealt by ranges of doc_id, so files and rows are in ascending order; repeated ids
are ordered by text, and rows without an id come first. Null text: as empty, which still has the
end id. A file is written under
another name and then moved, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm import byte_pairs, pretokens
from storyweft.llm.columns import cut, partitions, pieces_of_batch, release, shared_dir, steps, table

END_ID = 2
#: Text bytes of a block; one longer document is a block by itself.
BLOCK_BYTES = 4 << 20
#: Of the ids of long pre-tokens that a worker keeps, beside the table of short ones.
CACHE_BYTES = 120 << 20
#: What stands in a file for a missing document id.
NO_ID = -(1 << 63)


@lru_cache(1)
def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    specials = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
    encode = lambda texts: [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    return encode, byte_pairs.IdTable(lambda words: encode([w.decode() for w in words]), CACHE_BYTES), specials


def encode_texts(data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    """Ids of each text as the tokenizers library gives them: each distinct pre-token is encoded
    by it once per worker; a text with a special string goes through it whole."""
    encode, known, specials = _library(path)
    starts, ends, counts = pretokens.boundaries(data, offsets)
    ids, number = known.of(data, starts, ends)
    raw, at, place = data.tobytes(), np.concatenate([[0], np.cumsum(number)])[counts].tolist(), offsets.tolist()
    out = [ids[a:b] for a, b in zip(at, at[1:])]
    if any(s in raw for s in specials):
        for i, (a, b) in enumerate(zip(place, place[1:])):
            if any(s in raw[a:b] for s in specials):
                out[i] = np.frombuffer(encode([raw[a:b].decode()])[0], np.uint32)
    return out


def encode_block(data: np.ndarray, offsets: np.ndarray, path: str):
    """encode_texts of a block, in steps: pre-tokens take far more room than the ids that are kept."""
    for a, b in steps(offsets):
        yield from encode_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path)


def pack_block(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    count = np.bincount(ids)
    distinct = np.flatnonzero(count)
    order = np.argsort(-count[distinct], kind="stable")
    rank = np.zeros(len(count), np.uint32)
    rank[distinct[order]] = np.arange(len(order), dtype=np.uint32)
    ranks = rank[ids]
    size = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    control = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    control[: len(ids)] = size - 1
    control = control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        data[at[has] + k] = (ranks[has] >> (8 * k)) & 255
    head = struct.pack("<4I", len(keys), len(ids), len(distinct), len(data))
    return b"".join([head, keys.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), distinct[order].astype("<u4").tobytes(), np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()])


#: Lengths of the four ids of each control byte.
LENGTHS = np.array([[((c >> s) & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack_blocks(stream):
    """(document ids, ids per document, ids) of each block of an open file."""
    while head := stream.read(16):
        d, n, r, m = struct.unpack("<4I", head)
        keys, sizes = np.frombuffer(stream.read(8 * d), "<i8"), np.frombuffer(stream.read(4 * d), "<u4").astype(np.int64)
        distinct = np.frombuffer(stream.read(4 * r), "<u4")
        size = LENGTHS[np.frombuffer(stream.read(-(-n // 4)), np.uint8)].ravel()[:n]
        data = np.zeros(m + 3, np.uint8)
        data[:m] = np.frombuffer(stream.read(m), np.uint8)
        at = np.cumsum(size) - size
        words = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
        yield keys, sizes, distinct[words[at] & MASKS[size]] if n else np.empty(0, np.uint32)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all documents below folder and returns a row per file: shard, path, n_docs,
    n_tokens. An empty table gives no file."""
    path = tokenizer or byte_pairs.default_json()
    schema = "shard int, path string, n_docs long, n_tokens long"

    def run(batches):
        shard, out = TaskContext.get().partitionId(), None
        store, top = fs.FileSystem.from_uri(folder)
        name, draft = f"{top}/part-{shard:06d}.ids", f"{top}/.draft-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch, limit=BLOCK_BYTES):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(draft)
                lists = [np.append(x, np.uint32(end_id)) for x in encode_block(data, offsets, path)]
                sizes = np.array([len(x) for x in lists], np.int64)
                out.write(pack_block(keys.fill_null(NO_ID).to_numpy(), sizes, np.concatenate(lists).astype(np.uint32)))
                n_docs, n_tokens = n_docs + len(keys), n_tokens + int(sizes.sum())
        release()
        if out is not None:
            out.close()
            store.move(draft, name)
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_tokens])], ["shard", "path", "n_docs", "n_tokens"])

    dealt = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(dealt.mapInArrow(run, schema))


def read(files: DataFrame, folder: str) -> DataFrame:
    """Documents of files as write() gave them: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("ahead").to_pylist()):
                with store.open_input_stream(name) as stream:
                    for keys, sizes, ids in unpack_blocks(stream):
                        ends = np.cumsum(sizes)
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                        yield pa.record_batch([pa.array(keys, pa.int64(), mask=keys == NO_ID), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])
        release()

    return placed.select("path", "ahead").repartition(partitions(spark), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder), folder)
