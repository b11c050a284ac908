"""Byte-pair merging of single pre-tokens, with a bounded cache."""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from itertools import repeat

import numpy as np

from storyweft.llm.columns import tokenizer_path
from storyweft.llm.words import mix

#: Bytes that a worker's cache may hold, by estimate; beyond it the cache starts anew. Pre-tokens
#: longer than KEPT bytes are not kept.
CACHE_BYTES, KEPT = 240 << 20, 256


@lru_cache(2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones as themselves, the
    other bytes, in order, as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def vocabulary_of(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """(token bytes to id, merge of two byte strings to its rank) of a byte-level JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return {raw(t): i for t, i in model["vocab"].items()}, {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}


def merge(word: bytes, rank_of) -> list[bytes]:
    """Token bytes of a pre-token: the adjacent pair of lowest rank, the leftmost of equals, is
    joined until no pair has a rank. rank_of(a, b) is a number, or None."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(parts, rank_of)
    ranks = [rank_of(a, b) for a, b in zip(parts, parts[1:])]
    while True:
        best = at = None
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at < len(ranks):
            ranks[at] = rank_of(parts[at], parts[at + 1])
        if at:
            ranks[at - 1] = rank_of(parts[at - 1], parts[at])


def _merge_long(parts: list[bytes], rank_of) -> list[bytes]:
    """The same for long pre-tokens, with a heap over a linked list: n log n."""
    import heapq

    n = len(parts)
    after, ahead, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[j] >= 0:
            ahead[after[j]] = i
        for x in (ahead[i], i):
            if x >= 0 and (y := after[x]) >= 0 and (r := rank_of(parts[x], parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [p for p, live in zip(parts, alive) if live]


class WordCache(dict):
    """Pre-token to the bytes of its ids; unknown ones are encoded together. It holds limit bytes, by an
    estimate of an entry's own bytes and of those that each byte of a pre-token brings."""

    ENTRY, BYTE = 200, 5

    def __init__(self, encode_many, limit: int | None = None):
        super().__init__()
        self.encode_many, self.held, self.limit = encode_many, 0, limit or CACHE_BYTES
        self.unknown: list[bytes] = []

    def __missing__(self, word: bytes) -> bytearray:
        """A place that is filled when all words have been looked up."""
        self.unknown.append(word)
        place = self[word] = bytearray()
        return place

    def room(self) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0

    def learn(self, found: dict) -> None:
        """Keeps what short pre-tokens are encoded as."""
        short = {w: x for w, x in found.items() if len(w) <= KEPT}
        self.update(short)
        self.held += sum(map(len, short)) * self.BYTE + self.ENTRY * len(short)

    def of(self, words: list[bytes]) -> list:
        self.room()
        got = [*map(self.__getitem__, words)]
        if self.unknown:
            unknown, self.unknown = self.unknown, []
            found = dict(zip(unknown, self.encode_many(unknown)))
            for w, x in found.items():
                self.pop(w).extend(x)
            self.learn(found)
        return got


class CountCache(WordCache):
    """Pre-token to a number, given as an array."""

    ENTRY, BYTE = 110, 1

    def of(self, words: list[bytes]) -> np.ndarray:
        self.room()
        got = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            some = [words[i] for i in missing.tolist()]
            unknown = [*{*some}]
            found = dict(zip(unknown, self.encode_many(unknown)))
            self.learn(found)
            got[missing] = [found[w] for w in some]
        return got


#: A 64-bit word's lowest bytes, by their number.
LOWEST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class IdTable:
    """Pre-tokens to ids, without an object for each one that is looked up. A pre-token of up to SHORT bytes
    is told, exactly, by two 64-bit words that hold its bytes and their number; rows of an open hash table
    have these words and the place and number of its ids. Longer ones go through a WordCache. It starts
    anew beyond ``most`` pre-tokens, which is just before it would take more than 2^21 rows."""

    SHORT = 15

    def __init__(self, encode_many, limit: int | None = None, most: int = 15 << 16):
        self.encode_many, self.most, self.long = encode_many, most, WordCache(encode_many, limit)
        self.clear()

    def clear(self) -> None:
        self.rows, self.n = np.zeros((1 << 12, 3), np.uint64), 0
        self.ids, self.used = np.empty(1 << 14, np.uint32), 0

    def _slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mix(one * np.uint64(0x9E3779B97F4A7C15) + two) >> np.uint64(65 - len(self.rows).bit_length())).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(third word of the row of each, whether there is one)."""
        slot, last = self._slots(one, two), len(self.rows) - 1
        got = self.rows.take(slot, axis=0)
        value, known = got[:, 2].copy(), (got[:, 0] == one) & (got[:, 1] == two)
        open_ = np.flatnonzero(~known & (got[:, 1] != 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & last
            got = self.rows.take(slot[open_], axis=0)
            same = (got[:, 0] == one[open_]) & (got[:, 1] == two[open_])
            value[open_[same]], known[open_[same]] = got[same, 2], True
            open_ = open_[~same & (got[:, 1] != 0)]
        return value, known

    def _put(self, new: np.ndarray) -> None:
        """Takes up rows of pre-tokens that are not there; half of the table stays empty."""
        self.n += len(new)
        if 2 * self.n > len(self.rows):
            new = np.concatenate([self.rows[self.rows[:, 1] != 0], new])
            self.rows = np.zeros((1 << (2 * self.n - 1).bit_length(), 3), np.uint64)
        slot, last, left = self._slots(new[:, 0], new[:, 1]), len(self.rows) - 1, np.arange(len(new))
        while len(left):
            at = slot[left]
            free = np.flatnonzero(self.rows[at, 1] == 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.rows[at[first]] = new[left[first]]
            left = np.delete(left, first)
            slot[left] = slot[left] + 1 & last

    def _placed(self, blobs: list, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the ids of each; those not to be kept are overwritten by the next ones."""
        found, number = np.frombuffer(b"".join(blobs), np.uint32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        end = self.used + len(found)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(2 * end - self.used, np.uint32)])
        self.ids[self.used : end] = found
        place = self.used + np.cumsum(number) - number
        self.used = end if keep else self.used
        return place, number

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens data[start:end] in a row, number of each one's)."""
        if self.n > self.most:
            self.clear()
        size = ends - starts
        words = np.ndarray(len(data) + 9, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        one, two = words[starts] & LOWEST[np.minimum(size, 8)], words[np.minimum(starts + 8, len(data))] & LOWEST[np.clip(size - 8, 0, 7)]
        two |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        value, known = self._find(one, two)
        cut = lambda at: [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        new = np.flatnonzero(~known & (size <= self.SHORT))
        if len(new):
            new = new[np.lexsort((one[new], two[new]))]
            a, b = one[new], two[new]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            place, number = self._placed([*self.encode_many(cut(new[first]))], True)
            learnt = place.astype(np.uint64) << np.uint64(8) | number.astype(np.uint64)
            self._put(np.stack([a[first], b[first], learnt], 1))
            value[new] = learnt[np.cumsum(first) - 1]
        place, number = (value >> np.uint64(8)).astype(np.int64), (value & np.uint64(255)).astype(np.int64)
        long = np.flatnonzero(size > self.SHORT)
        if len(long):
            place[long], number[long] = self._placed(self.long.of(cut(long)), False)
        upto = np.cumsum(number)
        return self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(place - upto + number, number)], number


@lru_cache(1)
def rank_cache(path: str) -> WordCache:
    ranks = ranks_of(path)
    rank_of = lambda a, b: ranks.get(a + b)
    pack = {t: i.to_bytes(4, "little") for t, i in ranks.items()}

    def encode_many(words):
        for w in words:
            yield pack[w] if w in pack else b"".join(pack[p] for p in merge(w, rank_of))

    return WordCache(encode_many)


@lru_cache(1)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes in a row, where each id's begin; one end more) of a rank file."""
    ranks = ranks_of(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def decode(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the ids in a row, where each id's bytes begin and the end)."""
    flat, at = token_bytes(path)
    first, size = at[ids], at[ids + 1] - at[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)], ends


RANKS_FILE, JSON_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def default_ranks() -> str:
    return tokenizer_path(RANKS_FILE)


def default_json() -> str:
    return tokenizer_path(JSON_FILE)
