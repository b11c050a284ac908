"""Token counts by a compiled finite-state transducer.

Two deterministic machines run over the bytes. The first finds pre-tokens: chunks of text become
maps from state to state, which compose through a parallel prefix scan (``pretokens.scan``); every
pre-token begins in a known state, so the second machine needs no maps at chunk borders. The
second turns a pre-token's bytes into a count. Its state is the longest suffix that begins some
token, and, for each position from which the text so far begins some token, the last token of the
text up to there and the count relative to now; a transition is annotated with the tokens it adds (it may take some back).
The last token up to a position is the only token ending there whose pair with the last token
before it stays unmerged, so states need nothing else. States are compiled when first met.

Special strings are cut out first, one token each, as the library does. Null text: as empty.
Empty text: 0 tokens. Texts of any length are counted whole, also a single pre-token of any length:
the machine forgets states on the way. Repeated rows repeat, a missing id stays missing, an empty
table gives no rows, and only the key and text columns are read.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from storyweft.llm import byte_pairs, pretokens
from storyweft.llm.columns import pieces_of_batch, table

#: States a worker keeps (1.3 kB each); beyond it the machine is compiled anew from the states that
#: are being run through, SLICES of them at most.
MAX_STATES, SLICES = 130_000, 8192


class Transducer:
    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.rank_of = lambda a, b: merges.get((a, b))
        self.tokens = [*vocabulary]
        self.paired: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # trie of the tokens, with the suffix links and the tokens that end at each node
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.ends = [0], [-1]
        for k, token in enumerate(self.tokens):
            node = 0
            for b in token:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = k
        self.link, queue = [0] * len(self.child), deque(self.child[0].values())
        while queue:
            node = queue.popleft()
            for b, nxt in self.child[node].items():
                self.link[nxt] = self.step(self.link[node], b)
                queue.append(nxt)
        self.reset()

    def step(self, node: int, b: int) -> int:
        while b not in self.child[node]:
            if node == 0:
                return 0
            node = self.link[node]
        return self.child[node][b]

    def reset(self) -> None:
        #: A state: node, and for it and the nodes its suffix links lead to, (last token, count less
        #: the present count) at the position where that suffix begins.
        self.states: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.next = np.full((1024, 256), -1, np.int32)
        self.adds = np.zeros((1024, 256), np.int8)

    def fits(self, a: int, b: int) -> bool:
        """Whether token a and then token b is how their bytes together are encoded."""
        if a < 0:
            if b not in self.whole:
                self.whole[b] = len(byte_pairs.merge(self.tokens[b], self.rank_of)) == 1
            return self.whole[b]
        key = (a, b)
        if key not in self.paired:
            x, y = self.tokens[a], self.tokens[b]
            self.paired[key] = self.fits(-1, b) and byte_pairs.merge(x + y, self.rank_of) == [x, y]
        return self.paired[key]

    def compile(self, state: int, b: int) -> None:
        node, seen = self.states[state]
        known, at = {}, node
        for entry in seen:
            known[self.depth[at]] = entry
            at = self.link[at]
        to = at = self.step(node, b)
        kept, found = [], None
        while at:
            entry, k = known[self.depth[at] - 1], self.ends[at]
            kept.append(entry)
            if found is None and k >= 0 and self.fits(entry[0], k):
                found = (k, entry[1] + 1)
            at = self.link[at]
        added = found[1]
        made = (to, (*((t, c - added) for t, c in kept), (found[0], 0)))
        to = self.numbered(made)
        self.next[state, b], self.adds[state, b] = to, added

    def restart(self, state: np.ndarray) -> np.ndarray:
        """Forgets all states but these; their new numbers."""
        kept, place = np.unique(state, return_inverse=True)
        kept = [self.states[k] for k in kept.tolist()]
        self.reset()
        return np.array([self.numbered(made) for made in kept], np.int64)[place]

    def numbered(self, made: tuple) -> int:
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
            if len(self.states) > len(self.next):
                more = min(len(self.next), 16384)
                self.next = np.concatenate([self.next, np.full((more, 256), -1, np.int32)])
                self.adds = np.concatenate([self.adds, np.zeros((more, 256), np.int8)])
        return self.number[made]

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each slice, SLICES at a time."""
        parts = [self._count(data, starts[a : a + SLICES], ends[a : a + SLICES]) for a in range(0, len(starts), SLICES)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each slice; all slices advance together, the longest first."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        first, left = starts[order], np.sort(size)
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = len(left) - np.searchsorted(left, np.arange(1, int(left[-1]) + 1 if len(left) else 1), "left")
        for k, n in enumerate(active.tolist()):
            if len(self.states) > MAX_STATES:
                state[:n] = self.restart(state[:n])
            where = (state[:n] << 8) | data[first[:n] + k]
            to = self.next.ravel()[where]
            if (new := np.flatnonzero(to < 0)).size:
                for w in np.unique(where[new]).tolist():
                    self.compile(w >> 8, w & 255)
                to = self.next.ravel()[where]
            total[:n] += self.adds.ravel()[where]
            state[:n] = to
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def specials_of(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        return [t["content"].encode() for t in json.load(f)["added_tokens"]]


@lru_cache(1)
def compiled(path: str) -> tuple[byte_pairs.WordCache, list[bytes]]:
    """The counts of the pre-tokens that the compiled machine has run over, the special strings."""
    machine = Transducer(*byte_pairs.vocabulary_of(path))

    def run(words: list[bytes]) -> list[int]:
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        return machine.count(np.frombuffer(b"".join(words), np.uint8), starts, ends).tolist()

    return byte_pairs.CountCache(run), specials_of(path)


def _without_specials(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]):
    """Texts cut at special strings: bytes, offsets, the text of each part, specials per text."""
    n = len(offsets) - 1
    raw, found = data.tobytes(), np.zeros(n, np.int64)
    if not any(s in raw for s in specials):
        return data, offsets, np.arange(n), found
    parts, owner = [], []
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        pieces = [raw[a:b]]
        for s in specials:
            pieces = [x for p in pieces for x in p.split(s)]
        cut = sum(map(len, pieces))
        found[i] = (b - a - cut) // len(specials[0]) if len(specials) == 1 else len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array(owner), found


def count_texts(data: np.ndarray, offsets: np.ndarray, path: str, counter=compiled) -> np.ndarray:
    """Tokens of each text; counter(path) gives a cache of pre-tokens' counts and the special strings."""
    cache, specials = counter(path)
    data, cuts, owner, out = _without_specials(data, offsets, specials)
    starts, _, counts = pretokens.boundaries(data, cuts)
    sums = np.concatenate([[0], np.cumsum(cache.of(pretokens.slices(data, starts)))])
    return out + np.bincount(owner, sums[counts[1:]] - sums[counts[:-1]], len(offsets) - 1).astype(np.int64)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit."""
    path = tokenizer or byte_pairs.default_json()

    def run(batches):
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch, key, text):
                n = count_texts(data, offsets, path)
                yield pa.record_batch([keys, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
