"""Byte-level BPE encoding and decoding by a rank file.

Pre-tokens are located by ``pretokens.boundaries`` (code-point classes and a prefix scan of
transition functions, no regular expression); each distinct slice is merged once per worker
through a bounded cache; the ids keep the byte offsets of their tokens, by which they decode.

Null text: as empty. Empty text: no ids. Texts of any length are encoded whole; repeated rows
give repeated results, a missing id stays missing, and an empty table gives no rows. Only the key
and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from storyweft.llm import byte_pairs, pretokens
from storyweft.llm.columns import pieces_of_batch, table


def encode_texts(data: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit bytes."""
    starts, _, counts = pretokens.boundaries(data, offsets)
    ids, at = byte_pairs.rank_cache(path).of(pretokens.slices(data, starts)), counts.tolist()
    return [b"".join(ids[a:b]) for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """One row per row of docs: key, ids array<int>, token_ends array<long> (byte offsets in the
    UTF-8 text at which each token ends)."""
    path = ranks or byte_pairs.default_ranks()

    def run(batches):
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch, key, text):
                blobs = encode_texts(data, offsets, path)
                flat = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
                _, at = byte_pairs.decode(flat, path)
                sizes = np.cumsum([0, *(len(b) // 4 for b in blobs)])
                ends = at[1:] - np.repeat(at[sizes[:-1]], np.diff(sizes))
                lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, kind))
                yield pa.record_batch([keys, lists(flat, pa.int32()), lists(ends, pa.int64())], [key, "ids", "token_ends"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>, token_ends array<long>")


def decode(encoded: DataFrame, key: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """key and data (binary: the bytes that the ids stand for) from rows with ids."""
    path = ranks or byte_pairs.default_ranks()

    def run(batches):
        for batch in batches:
            out = [byte_pairs.decode(np.asarray(ids or [], np.int64), path)[0].tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column(key), pa.array(out, pa.binary())], [key, "data"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, data binary")


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Encodes, decodes and hashes each text in one pass: doc_id, n_tokens, ids_sha256,
    decoded_sha256."""
    path = ranks or byte_pairs.default_ranks()

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch):
                blobs = encode_texts(data, offsets, path)
                flat = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64)
                decoded, at = byte_pairs.decode(flat, path)
                sizes = np.array([len(b) // 4 for b in blobs], np.int64)
                place = at[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                decoded = decoded.tobytes()
                yield pa.record_batch(
                    [keys, pa.array(sizes), pa.array([sha(b) for b in blobs]), pa.array([sha(decoded[a:b]) for a, b in zip(place, place[1:])])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
