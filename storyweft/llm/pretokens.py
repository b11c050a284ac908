"""Boundaries of the byte-level BPE pre-tokens, found without a regular expression.

Every code point becomes one of nine symbols; a symbol is a function from the eight states of a
small automaton to its states. Functions compose associatively, so the states before all code
points come from a prefix scan over function numbers (the composition table of the functions'
closure), first inside columns of a block matrix, then over the blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Symbols: letter, number, other, white space with more behind it, last white space before
#: text (not U+0020), last U+0020 before text, apostrophe of a short ending, of a long one, end.
L, N, O, W, WL, SL, Q1, Q2, Z = range(9)
#: States: nothing open, in letters, in numbers, in others, after a joining space, in white
#: space, one letter of an ending to come, two letters to come.
STATES = 8
WIDTH = 128


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, by state and symbol."""
    nxt, begins = np.zeros((STATES, 9), np.uint8), np.ones((STATES, 9), bool)
    for s in range(STATES):
        nxt[s] = [1, 2, 3, 5, 0, 4, 6, 7, 0]
        for symbol, inside in ((L, (1, 4)), (N, (2, 4)), (O, (3, 4)), (W, (5,))):
            begins[s, symbol] = s not in inside
        if s in (3, 4):
            nxt[s, Q1] = nxt[s, Q2] = 3
            begins[s, Q1] = begins[s, Q2] = False
    nxt[6, L], begins[6, L] = 0, False
    nxt[7, L], begins[7, L] = 6, False
    return nxt, begins


@lru_cache(1)
def _monoid():
    """(functions, composition table, number of each symbol's function)."""
    nxt, begins = _transitions()
    made = {tuple(range(STATES)): 0}
    for c in range(9):
        made.setdefault(tuple(int(x) for x in nxt[:, c]), len(made))
    grown = True
    while grown:
        grown = False
        for f in list(made):
            for g in list(made):
                h = tuple(g[x] for x in f)
                if h not in made:
                    made[h] = len(made)
                    grown = True
    functions = np.array(list(made), np.uint8)
    assert len(made) <= 16
    compose = np.zeros(256, np.uint8)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i * 16 + j] = made[tuple(int(x) for x in g[f])]
    symbols = np.array([made[tuple(int(x) for x in nxt[:, c])] for c in range(9)], np.uint8)
    return functions, compose, symbols, begins


def scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of function numbers (under 16); compose[f * 16 + g] is f, then g."""
    n = len(functions)
    if n <= WIDTH:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[(int(out[i - 1]) << 4) | int(out[i])]
        return out
    rows = -(-n // WIDTH)
    block = np.zeros(rows * WIDTH, np.uint8)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, WIDTH).T)
    for j in range(1, WIDTH):
        np.take(compose, (block[j - 1] << 4) | block[j], out=block[j])
    ahead = np.zeros(rows, np.uint8)
    ahead[1:] = scan(block[-1][:-1], compose)
    block = np.take(compose, (ahead << 4)[None, :] | block)
    return np.ascontiguousarray(block.T).reshape(-1)[:n]


@lru_cache(1)
def class_table() -> np.ndarray:
    """Letter, number, other or white space by code point, as the tokenizer engine has them."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        got = bytes(engine.encode_ordinary(every)).decode()
        out[np.frombuffer(got.encode("utf-32-le"), np.uint32)] = code
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points, with end marks standing at the places ends."""
    kind = class_table()[points]
    kind[ends] = Z
    n = len(points)
    out = np.array([L, N, O, W, 4, 5, 6, 7, Z], np.uint8)[kind]
    nxt = np.full(n, Z, np.uint8)
    nxt[:-1] = kind[1:]
    last = (kind == SPACE) & (nxt != SPACE) & (nxt != Z)
    out[last] = np.where(points[last] == 32, SL, WL)
    at = np.flatnonzero((points == 39) & (kind == OTHER))
    if len(at):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[at + 1], padded[at + 2]
        real = np.concatenate([kind, [Z, Z]])
        ok1, ok2 = real[at + 1] != Z, (real[at + 1] != Z) & (real[at + 2] != Z)
        short = ok1 & np.isin(one, [ord(c) for c in "stmd"])
        long = ok2 & ~short & np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (one < 256) & (two < 256)
        out[at[short]], out[at[long]] = Q1, Q2
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens of the texts data[offsets[i]:offsets[i + 1]], and
    for each text the number of pre-tokens before it (n + 1 values). Empty texts have none."""
    n_docs = len(offsets) - 1
    if n_docs == 0 or len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n_docs + 1, np.int64)
    points = code_points(data)
    if len(points) == len(data):
        at_byte = np.arange(len(data) + 1)
    else:  # the bytes that begin a code point
        at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(at_byte, offsets)  # offsets in code points
    marks = first[1:] + np.arange(n_docs)  # place of each text's end mark
    total = len(points) + n_docs
    real = np.ones(total, bool)
    real[marks] = False
    stream = np.zeros(total, np.uint32)
    stream[real] = points
    symbols = symbols_of(stream, marks)
    functions, compose, number, begins = _monoid()
    reached = scan(number[symbols], compose)
    before = np.zeros(total, np.uint8)
    before[1:] = functions[:, 0][reached[:-1]]
    start = begins.ravel()[before * 9 + symbols]
    place = np.flatnonzero(start & real)
    text = np.searchsorted(marks, place)
    starts = at_byte[place - text]
    counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_docs))])
    ends = np.append(starts[1:], at_byte[-1])
    has = counts[1:] > counts[:-1]
    ends[counts[1:][has] - 1] = offsets[1:][has]
    return starts, ends, counts


def slices(data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The pre-tokens themselves. They are cut at a byte that UTF-8 never has, put before each."""
    if len(starts) == 0:
        return []
    apart = np.full(len(data) + len(starts), 255, np.uint8)
    text = np.ones(len(apart), bool)
    text[starts + np.arange(len(starts))] = False
    apart[text] = data
    return apart.tobytes()[1:].split(b"\xff")
