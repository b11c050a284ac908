"""Language-model scores by logistic mixing of context bit predictors.

A text is its tokens (words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased) with a space between and a
line end behind, byte for byte; a byte is eight binary decisions. ORDERS contexts, the last 1 to 5
bytes and the bytes of the word so far (its last 5), each know how often a decision came out 0 and 1
in all training texts. A context predicts a logit; the logits are added with weights gated by the
decision's place in the byte and by how much the context has seen. A stage behind it refines the
mixed probability by the longest context seen.

A last predictor knows long contexts. Texts are cut into chunks behind tokens chosen by their hash,
one in EVERY; a chunk's context is the whole chunk before it. It predicts the chunks that followed
this context in other texts, by their share. Its probability of a chunk and that of the chunk's bits
are averaged; its weight is gated by how often the context was seen, and is the share of training
chunks that it foretold. Minus log2 of the chunks' probabilities is the text's bits.

Training texts are those whose crc32(doc_id as text) mod 10 is not 0; all of them are counted and
all of them train the weights. Remainders 1 to 3, 4 to 6 and 7 to 9 are FOLDS; while the weights
and the stage behind them learn from a fold, its own counts are left out, so that they see contexts
as a new text does. The scored texts see the bit predictors with all counts. The chunk predictor
always leaves a text's own chunks out: a text is foretold by other training texts only, those of
equal content included. A score does not depend on held-out texts.

Contexts are counted exactly, in tables that grow with the corpus. Distinct windows (a byte and the
5 before it) are summed up in a shared table; contexts of 3 bytes and more are counted where the
windows of the same last 3 bytes meet, shorter ones (2^24 pairs at most) go to all workers. Weights
are learnt per part of that table, from all its windows, and averaged by how often each was used. A
window's bits are worked out once in the corpus; bits of the TOP_WINDOWS windows at most that occur
most often go to the workers, all others are joined. Chunks and their contexts are 64-bit hashes in
a table of those that occur twice and more; a filter of FILTER_BITS bits spares most of the others a
join, and changes no result however full it is.

The base score uses token counts of all training texts (remainders 1 to 9). Tokens are told apart
by 64-bit hashes. Counts of the TOP tokens at most that occur most often go to the workers; all
others are joined in Spark.

Null text: as empty; an empty text has one token, the end. A text of any length is scored whole. A
row without doc_id is held out. Rows are scored one by one: those that repeat an id, or an id and
text, each have their own score. With no training texts every count is 0 and each decision has
probability 1/2. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.columns import partitions, pieces_of_batch, release, stored, table
from storyweft.llm.words import LOWERED, mix, run_hashes, slice_hashes

WINDOW, ORDERS = 6, 6  # bytes of a window with its last one; contexts of 1 to 5 bytes and the word
CONFIDENCES, BINS = 16, 33
TOP, TOP_WINDOWS = 1 << 19, 1 << 20
#: Parts of the training texts, and counts without each of them beside the whole ones.
FOLDS = 3
VARIANTS = FOLDS + 1
#: Rounds of learning and averaging, passes over a part in each, windows of a part.
LEARNING, PASSES, PART = 2, 3, 1 << 16
#: Tokens of a chunk, on average, and the size of the filter of contexts that occur twice.
EVERY, FILTER_BITS = 32, 1 << 26
#: Text bytes handled at once, distinct windows or tokens gathered before they are merged, and rows of
#: a batch on its way to Spark.
STEP, PENDING, ROWS = 1 << 20, 1 << 21, 1 << 16
END = 10
END_TOKEN = np.uint64(0x5EED0E2D)


def remainder(keys: pa.Array) -> np.ndarray:
    """crc32 of each id as text, mod 10; 0, held out, for a missing id."""
    return np.array([0 if k is None else zlib.crc32(str(k).encode()) % 10 for k in keys.to_pylist()], np.int64)


def canonical(data: np.ndarray, offsets: np.ndarray):
    """(bytes of the canonical texts, where each begins and the end, token hashes, tokens before
    each text), without the end tokens, and the texts' entries: hashes, ends in the bytes, entries
    before each text. Entries are the tokens, or one of hash 0 for a text without any."""
    apart = np.insert(LOWERED[data], offsets[1:], 32)  # a space behind each text
    tails = offsets[1:] + np.arange(len(offsets) - 1)
    inside = apart != 32
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    words = np.cumsum(keep & ~inside, dtype=np.int32)[tails] if len(tails) else np.zeros(0, np.int32)
    n = np.diff(words, prepend=0).astype(np.int64)
    keep[tails[n == 0]] = True
    out = apart[keep]
    to = np.flatnonzero(out == 32) + 1
    before = np.concatenate([[0], np.cumsum(np.maximum(n, 1))])
    hashes = slice_hashes(out, np.concatenate([[0], to[:-1]]).astype(np.int64), to - 1) if len(to) else np.zeros(0, np.uint64)
    real = np.ones(len(to), bool)
    real[before[:-1][n == 0]] = False
    hashes[~real] = 0
    begins = np.concatenate([[0], to[before[1:] - 1]])
    out[begins[1:] - 1] = END
    return out, begins, hashes[real], np.concatenate([[0], np.cumsum(n)]), (hashes, to, before)


def chunks_of(entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each chunk, text of each chunk, its context's key, its own key behind that context);
    the first chunk of a text has no context, and keys 0."""
    hashes, to, before = entries
    last = (hashes >> np.uint64(20)) % np.uint64(EVERY) == 0
    last[before[1:] - 1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    ahead = np.searchsorted(ends, before, "right")
    own = run_hashes(hashes, starts, ends)
    context = np.concatenate([np.zeros(1, np.uint64), own[:-1]])
    pair = mix(context * np.uint64(0x9E3779B97F4A7C15) + own)
    context, pair = mix(context + np.uint64(EVERY)), pair
    context[ahead[:-1]] = pair[ahead[:-1]] = 0
    return np.diff(np.concatenate([[0], to[ends - 1]])), np.repeat(np.arange(len(before) - 1), np.diff(ahead)), context, pair


def windows(text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each byte, itself (lowest) and the WINDOW - 1 before it in its text, line ends ahead of it."""
    out = text.astype(np.uint64)
    for k in range(1, WINDOW):
        before = np.full(len(text), END, np.uint8)
        before[k:] = text[:-k]
        for j in range(k):
            at = begins[:-1] + j
            before[at[at < begins[1:]]] = END
        before = before.astype(np.uint64)
        before <<= np.uint64(8 * k)
        out |= before
    return out


def contexts(keys: np.ndarray) -> list[np.ndarray]:
    """What each context holds of windows: the last 1 to 5 bytes, and the word so far; the byte
    itself is not in it."""
    before = keys >> np.uint64(8)
    out = [before & np.uint64((1 << (8 * k)) - 1) for k in range(1, WINDOW)]
    word, inside = np.zeros_like(before), np.ones(len(keys), bool)
    for k in range(WINDOW - 1):
        b = (before >> np.uint64(8 * k)) & np.uint64(255)
        inside &= (b != 32) & (b != END)
        word |= np.where(inside, b << np.uint64(8 * k), np.uint64(0))
    return [*out, word]


def merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    times = times[order]
    del order  # not held while the counts are summed up
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts in one array; the list is empty after it."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def fold_counts(packed: np.ndarray, times: np.ndarray):
    """(windows, (n, FOLDS) counts) of ascending distinct windows with their fold in the low two bits, about
    ROWS at a time: the counts of all of them take several times the room of packed."""
    a = 0
    while a < len(packed):
        b = int(np.searchsorted(packed, packed[min(a + ROWS, len(packed)) - 1] | np.uint64(3), "right"))
        keys = packed[a:b] >> np.uint64(2)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        cell = (np.cumsum(new) - 1) * VARIANTS + (packed[a:b] & np.uint64(3)).astype(np.int64)
        counts = np.bincount(cell, times[a:b], int(new.sum()) * VARIANTS).astype(np.int64).reshape(-1, VARIANTS)
        yield keys[new], counts[:, :FOLDS]
        a = b


def _quantised(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n = zeros.astype(np.float64) + ones
    logit = np.log((ones + 0.02 + 0.2 * (n == 0)) / (zeros + 0.02 + 0.2 * (n == 0)))
    confidence = np.where(n == 0, 0, np.minimum(CONFIDENCES - 1, 1 + np.log2(np.maximum(n, 1)).astype(np.int64)))
    return (np.clip(np.rint(logit * 16), -127, 127).astype(np.int8).view(np.uint8).astype(np.uint16) << 8) | confidence.astype(np.uint16)


#: The same for counts below 256.
FEW = _quantised(np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255)


def quantised(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A context's logit in sixteenths (high byte, signed) and confidence (low byte)."""
    many = (zeros | ones) >> 8 != 0
    out = FEW.take(np.where(many, 0, zeros << 8 | ones))
    out[many] = _quantised(zeros[many], ones[many])
    return out


FOLD_NAMES = [f"n{k}" for k in range(FOLDS)]
GATHERED = "kind int, key long, n long, " + ", ".join(f"{c} long" for c in FOLD_NAMES)


def gather(docs: DataFrame) -> DataFrame:
    """kind 0: a token's hash and count in the training texts of a task; kind 1: a window of a
    task's texts with its counts by fold, which are 0 if only held-out texts have it; kinds 2 and 3:
    a chunk's context, and a chunk behind its context, with counts in training texts (n) and all (n0)."""
    names = [c.split()[0] for c in GATHERED.split(", ")]

    def rows(kind, keys, *counts):
        counts = [*map(pa.array, counts)]
        return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), *counts, *[pa.nulls(len(keys), pa.int64())] * (1 + FOLDS - len(counts))], names)

    def run(batches):
        _unpacked.cache_clear()  # what the tasks of an earlier query left in this worker
        words, n_words, seen, n_seen, long = [], [], [], [], {2: [], 3: []}

        def tokens():
            return rows(0, *merged(joined(words), joined(n_words)))

        def found():
            for keys, counts in fold_counts(joined(seen), joined(n_seen)):
                yield pa.record_batch([pa.array(np.ones(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64()), *(pa.array(counts[:, k]) for k in range(FOLDS))], names)

        def whole():
            release()  # the steps' arrays, which lay between the parts, leave room for the merged ones
            keys, n = merged(joined(seen), joined(n_seen))
            seen.append(keys), n_seen.append(n)

        def passages():
            for kind, held in long.items():
                if held:
                    packed = joined(held)
                    keys, where = np.unique(packed >> np.uint64(1), return_inverse=True)
                    learn = np.bincount(where, packed & np.uint64(1), len(keys)).astype(np.int64)
                    yield rows(kind, keys, learn, np.bincount(where, minlength=len(keys)))

        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch, limit=STEP):
                text, begins, hashes, at, entries = canonical(data, offsets)
                left = remainder(keys)
                learn = np.repeat(left != 0, np.diff(at))
                distinct, n = np.unique(hashes[learn], return_counts=True)
                words += [distinct, np.array([END_TOKEN])]
                n_words += [n, np.array([int((left != 0).sum())])]
                fold = np.where(left == 0, FOLDS, (left - 1) // 3).astype(np.uint64)
                packed = windows(text, begins)
                packed <<= np.uint64(2)
                packed |= np.repeat(fold, np.diff(begins))
                distinct, n = np.unique(packed, return_counts=True)
                seen.append(distinct), n_seen.append(n)
                del packed
                _, text_of, context, pair = chunks_of(entries)
                has = context != 0
                learn = (left[text_of[has]] != 0).astype(np.uint64)
                for kind, hashed in ((2, context), (3, pair)):  # 63 bits of a key, whether it is of a training text
                    long[kind].append(hashed[has] << np.uint64(1) | learn)
                if sum(map(len, seen)) > PENDING:
                    whole()
                    if len(seen[0]) > PENDING // 2:
                        yield from found()
                if sum(map(len, words)) > PENDING:
                    yield tokens()
                if sum(map(len, long[2])) > PENDING // 4:
                    yield from passages()
        if words:
            yield tokens()
        if seen:
            whole()
            yield from found()
        yield from passages()

    def in_parts(batches):
        for batch in run(batches):
            for a in range(0, batch.num_rows, ROWS):
                yield batch.slice(a, ROWS)
        release()

    return docs.select("doc_id", "text").mapInArrow(in_parts, GATHERED)


def paths(pair: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(n, VARIANTS, 8): what the context says at each decision of the byte, quantised, by all counts
    and by those without each fold. pair, ascending, has the context above the lowest byte."""
    total = counts.sum(1, keepdims=True)
    every = np.concatenate([total, total - counts], 1)
    out = np.empty((len(pair), VARIANTS, 8), np.uint16)

    def sums(group):
        first = np.concatenate([[True], group[1:] != group[:-1]])
        return np.add.reduceat(every, np.flatnonzero(first), axis=0)[np.cumsum(first) - 1]

    if len(pair):
        above = sums(pair >> np.uint64(8))
        for bit in range(8):
            here = pair >> np.uint64(7 - bit)
            same, one = sums(here), (here & np.uint64(1)).astype(bool)[:, None]
            out[:, :, bit] = quantised(np.where(one, above - same, same), np.where(one, same, above - same))
            above = same
    return out


def grouped(batches, name: str, limit: int):
    """Batches sorted by a column, joined to tables of some limit rows that end where it changes."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            whole = pa.Table.from_batches(held)
            column = whole[name].to_numpy()
            cut_at = int(np.searchsorted(column, column[-1]))
            if cut_at:
                yield whole.slice(0, cut_at)
                held, rows = whole.slice(cut_at).to_batches(), whole.num_rows - cut_at
    if rows:
        yield pa.Table.from_batches(held)


def _fold_counts(of) -> np.ndarray:
    return np.stack([of[c].to_numpy() for c in FOLD_NAMES], 1)


def window_table(gathered: DataFrame) -> DataFrame:
    """window, near (its last 3 bytes) and n0 .. of each distinct window."""
    found = gathered.where("kind = 1").groupBy(F.col("key").alias("window")).agg(*(F.sum(c).alias(c) for c in FOLD_NAMES))
    return stored(found.withColumn("near", F.shiftright("window", 8).bitwiseAND(0xFFFFFF)), "windows")


def short_words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word so far and byte of each window, whether the word has less than 3 bytes)."""
    word = contexts(keys)[ORDERS - 1]
    return word << np.uint64(8) | keys & np.uint64(255), word < np.uint64(1 << 16)


def short_paths(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pairs, paths) of the contexts of 1 and 2 bytes and of words of less than 3; from the windows'
    last 4 bytes with all but the place of a separator left out, some 2^24 whatever the input."""
    last, before = F.col("window").bitwiseAND(0xFFFFFF), F.shiftright("window", 24).bitwiseAND(255)
    split = F.when(before.isin(32, END), 32 << 24).when(before == 0, 0).otherwise(F.lit(65 << 24)).cast("long")
    got = table.groupBy((last + split).alias("pair")).agg(*(F.sum(c).alias(c) for c in FOLD_NAMES)).toArrow()
    pair, counts, out = got["pair"].to_numpy().astype(np.uint64), _fold_counts(got), []
    word, short = short_words(pair)
    for here, some in ((pair & np.uint64(0xFFFF), slice(None)), (pair & np.uint64(0xFFFFFF), slice(None)), (word, short)):
        here, n = here[some], counts[some]
        order = np.argsort(here)
        distinct, first = np.unique(here[order], return_index=True)
        out.append((distinct, paths(here[order], n[order])[first]))
    return out


def said_of(t: pa.Table, short) -> np.ndarray:
    """(n, ORDERS, VARIANTS, 8) quantised of the windows of a table that has all windows of their last 3 bytes."""
    keys, counts = t["window"].to_numpy().astype(np.uint64), _fold_counts(t)
    out = np.empty((len(keys), ORDERS, VARIANTS, 8), np.uint16)
    word, is_short = short_words(keys)
    for k in range(ORDERS):
        pair = word if k == ORDERS - 1 else keys & np.uint64((1 << (8 * (k + 2))) - 1)
        if k < 2:
            out[:, k] = short[k][1][np.searchsorted(short[k][0], pair)]
        else:
            order = np.argsort(pair)
            out[order, k] = paths(pair[order], counts[order])
    out[is_short, ORDERS - 1] = short[2][1][np.searchsorted(short[2][0], word[is_short])]
    return out


def _without_own(t: pa.Table, said: np.ndarray):
    """(quantised (n, ORDERS, 8), times, byte) of a part's windows in each fold, without the fold's counts."""
    counts, byte = _fold_counts(t), t["window"].to_numpy() & 255
    rows = [np.flatnonzero(counts[:, k]) for k in range(FOLDS)]
    return np.concatenate([said[r, :, k + 1] for k, r in enumerate(rows)]), np.concatenate([counts[r, k] for k, r in enumerate(rows)]).astype(np.float64), np.concatenate([byte[r] for r in rows])


def _of_bit(said: np.ndarray, byte: np.ndarray, bit: int):
    """(logits (ORDERS, n), confidences (ORDERS, n), outcomes) of one decision."""
    got = np.ascontiguousarray(said[:, :, bit].T)
    return (got >> 8).astype(np.uint8).view(np.int8).astype(np.float32) / 16, (got & 255).astype(np.int64), (byte >> (7 - bit)) & 1


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def taught(said: np.ndarray, times: np.ndarray, byte: np.ndarray, start: np.ndarray):
    """(weights, how often each was used) after PASSES damped Newton steps over all windows of a part."""
    weights, used, cells = start.astype(np.float64), np.zeros(start.shape), ORDERS * CONFIDENCES
    for bit in range(8):
        logits, confidences, out = _of_bit(said, byte, bit)
        flat = np.arange(ORDERS)[:, None] * CONFIDENCES + confidences
        used[bit] = np.bincount(flat.ravel(), np.broadcast_to(times, flat.shape).ravel(), cells).reshape(ORDERS, CONFIDENCES)
        for _ in range(PASSES):
            chance = _chance(_mixed(logits, confidences, weights, bit))
            slope = np.bincount(flat.ravel(), (times * (out - chance) * logits).ravel(), cells)
            bend = np.bincount(flat.ravel(), (times * (chance * (1 - chance) + 0.01) * logits * logits).ravel(), cells)
            weights[bit] += np.clip(slope / (ORDERS * bend + 1), -0.3, 0.3).reshape(ORDERS, CONFIDENCES)
    return weights, used


def stage_sums(said: np.ndarray, times: np.ndarray, byte: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(2, contexts seen, bin): how often the last stage's cells were met and came out 1."""
    stage, sums = fresh()[1], np.zeros((2, WINDOW * (BINS + 1)))
    for bit in range(8):
        logits, confidences, out = _of_bit(said, byte, bit)
        longest = _longest(confidences)
        _, low, part = _refined(_mixed(logits, confidences, weights, bit), stage, longest)
        for where, share in ((low, 1 - part), (low + 1, part)):
            cell = longest * (BINS + 1) + where
            sums[0] += np.bincount(cell, share * times, stage.size)
            sums[1] += np.bincount(cell, share * times * out, stage.size)
    return sums.reshape(2, *stage.shape)


def said_bits(said: np.ndarray, byte: np.ndarray, weights: np.ndarray, stage: np.ndarray) -> np.ndarray:
    """Bits of each window's byte by (n, ORDERS, 8) quantised."""
    total = np.zeros(len(byte))
    for bit in range(8):
        logits, confidences, out = _of_bit(said, byte, bit)
        chance, _, _ = _refined(_mixed(logits, confidences, weights, bit), stage, _longest(confidences))
        total -= np.log2(np.where(out == 1, chance, 1 - chance))
    return total


def trained(windows: DataFrame, short) -> tuple[np.ndarray, np.ndarray]:
    """Weights and last stage from all windows of all training texts; the stage is counted with the
    weights that a part has just learnt. Parts come to the driver as sums, one row (some 15 KB) a
    task."""
    spark = windows.sparkSession
    held = spark.sparkContext.broadcast(short)

    def over_parts(work, size):
        def run(batches):
            total = np.zeros(size)
            for t in grouped(batches, "near", PART):
                some = _without_own(t, said_of(t, held.value))
                if len(some[1]):
                    total += work(*some)
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])
            release()

        return sum((np.frombuffer(r.sums) for r in windows.mapInArrow(run, "sums binary").collect()), np.zeros(size))

    weights, stage = fresh()
    for _ in range(LEARNING):

        def work(said, times, byte, start=weights):
            learnt, used = taught(said, times, byte, start)
            return np.concatenate([(learnt * used).ravel(), used.ravel(), stage_sums(said, times, byte, learnt).ravel()])

        sums = over_parts(work, 2 * weights.size + 2 * stage.size)
        total, used = sums[: 2 * weights.size].reshape(2, *weights.shape)
        weights = np.where(used > 0, total / np.maximum(used, 1), weights).astype(np.float32)
        hits, ones = sums[2 * weights.size :].reshape(2, *stage.shape)
    return weights, ((ones + 20 * stage) / (hits + 20)).astype(np.float32)


def bits_table(windows: DataFrame, short, weights: np.ndarray, stage: np.ndarray) -> DataFrame:
    """key (the mixed window), n, bits of each distinct window."""
    held = windows.sparkSession.sparkContext.broadcast((short, weights, stage))

    def run(batches):
        for t in grouped(batches, "near", PART):
            short, weights, stage = held.value
            bits = said_bits(said_of(t, short)[:, :, 0], t["window"].to_numpy() & 255, weights, stage)
            yield pa.record_batch([pa.array(mix(t["window"].to_numpy().astype(np.uint64)).view(np.int64)), pa.array(_fold_counts(t).sum(1)), pa.array(bits)], ["key", "n", "bits"])

    return windows.mapInArrow(run, "key long, n long, bits double")


class Lookup:
    """Places of 64-bit hashes among sorted distinct ones."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(63 - max(1, len(keys).bit_length()))
        buckets, short = (1 << (64 - int(self.shift))) + 1, keys >> self.shift
        self.starts = np.empty(buckets, np.int32)
        for a in range(0, buckets, 1 << 17):
            some = self.starts[a : a + (1 << 17)]
            some[:] = np.searchsorted(short, np.arange(a, a + len(some), dtype=np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for one that is not there."""
        return np.concatenate([self._places(hashes[a : a + (1 << 17)]) for a in range(0, len(hashes), 1 << 17)] or [np.zeros(0, np.int32)])

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end, out = self.starts.take(bucket), self.starts.take(bucket + 1), np.full(len(hashes), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.keys.take(at[open_]) == hashes[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _mixed(logits, confidences, weights, bit):
    chosen = weights[bit][np.arange(ORDERS)[:, None], confidences]
    return (chosen * logits).sum(0)


def _longest(confidences: np.ndarray) -> np.ndarray:
    """How many of the contexts of 1 to 5 bytes have been seen."""
    return (confidences[: WINDOW - 1] > 0).sum(0)


def _refined(logit: np.ndarray, stage: np.ndarray, longest: np.ndarray):
    """(probability of 1, lower bin, share of the upper bin) after the last stage."""
    place = np.clip(logit, -7.999, 7.999) * 2 + BINS // 2
    low = place.astype(np.int64)
    part = place - low
    refined = stage[longest, low] * (1 - part) + stage[longest, low + 1] * part
    return np.clip((refined + 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) / 2, 1e-6, 1 - 1e-6), low, part


def fresh() -> tuple[np.ndarray, np.ndarray]:
    """Weights (decision, order, confidence) and last stage (contexts seen, bin) before learning."""
    weights = np.full((8, ORDERS, CONFIDENCES), 0.3, np.float32)
    weights[:, :, 0] = 0
    stage = np.tile(1 / (1 + np.exp(-(np.arange(BINS + 1) - BINS // 2) / 2)), (WINDOW, 1)).astype(np.float32)
    return weights, stage


@lru_cache(1)
def _unpacked(name: str, holder) -> tuple:
    tokens, counts, keys, bits, again = holder.value
    return Lookup(tokens), counts, Lookup(keys), bits, again


def _frequent(counts: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, values) of all rows above the least count that leaves ``most`` of them at most."""
    sizes = sorted(counts.groupBy("n").count().groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.sum("count").alias("of")).collect(), key=lambda r: -r["n"])
    least, total = None, 0
    for r in sizes:
        if total + r["of"] > most:
            break
        least, total = r["n"], total + r["of"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    got = counts.where(F.col("n") >= least).select("key", F.col(value).alias("value")).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["value"].to_numpy()[order].astype(np.float64)


def frequent(counts: DataFrame, most: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent tokens."""
    return _frequent(counts, "n", most)


def _rare(hashes: np.ndarray, owner: np.ndarray):
    """(hash, owner, times) of each distinct pair."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], owner[first], np.diff(np.append(first, len(hashes)))


def repeats(gathered: DataFrame) -> DataFrame:
    """kind, key, n of the contexts and chunks that occur twice and more, once in a training text."""
    found = gathered.where("kind > 1").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n0").alias("every"))
    return stored(found.where("n > 0 AND every > 1").select("kind", "key", "n"), "chunks")


def filter_of(twice: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, in 64-bit words; the bits of the contexts that occur twice are set."""
    place = F.col("key").bitwiseAND(FILTER_BITS - 1)
    one = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    got = twice.where("kind = 2").groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each key occurs in its text."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, np.int64)
    size, out = np.diff(np.append(first, len(keys))), np.empty(len(keys), np.int64)
    out[order] = np.repeat(size, size)
    return out


def foretold(scored: DataFrame, twice: DataFrame, rest: DataFrame) -> DataFrame:
    """uid and bits of each text's chunks whose context was seen (kind 3 of scored), after the last
    predictor; rest has the bits of their rarer windows by uid and no."""
    of = lambda kind, name: twice.where(f"kind = {kind}").select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"))
    rows = scored.where("kind = 3").select("uid", "no", "key", "pair", "n", "known", "bits")
    rows = rows.join(of(2, "key"), "key", "left").join(of(3, "pair"), "pair", "left").join(rest.where("no >= 0"), ["uid", "no"], "left")
    seen = F.coalesce("n_key", F.lit(0)) - F.col("n")
    hits = F.coalesce("n_pair", F.lit(0)) - F.col("known")
    rows = rows.select("uid", (F.col("n") > 0).alias("learn"), F.greatest(seen, F.lit(0)).alias("seen"), F.greatest(hits, F.lit(0)).alias("hits"), (F.col("bits") + F.coalesce("rest_bits", F.lit(0.0))).alias("bits"))
    rows = stored(rows, "foretold")
    gate = F.least(F.lit(15), F.floor(F.log2("seen"))).cast("int")
    got = rows.where("learn AND seen > 0").groupBy(gate.alias("gate")).agg(F.count("*").alias("n"), F.count_if(F.col("hits") > 0).alias("right")).collect()
    weight = {r["gate"]: (r["right"] + 0.5) / (r["n"] + 1) for r in got}
    of_gate = F.lit(0.5)
    for g, w in sorted(weight.items()):
        of_gate = F.when(gate == g, F.lit(float(w))).otherwise(of_gate)
    mixed = (1 - F.col("weight")) * F.pow(F.lit(2.0), -F.col("bits")) + F.col("weight") * F.col("hits") / F.col("seen")
    said = F.when(F.col("seen") == 0, F.col("bits")).when(F.col("hits") == 0, F.col("bits") - F.log2(1 - F.col("weight"))).otherwise(-F.log2(mixed))
    return rows.withColumn("weight", of_gate).groupBy("uid").agg(F.sum(said).alias("chunk_bits"))


def score(docs: DataFrame, top_windows: int = TOP_WINDOWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    gathered = stored(gather(docs), "gathered")
    counts = stored(gathered.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, token_counts = frequent(counts)
    found = window_table(gathered)
    short = short_paths(found)
    parts = found.repartition(partitions(spark), "near").sortWithinPartitions("near")
    bits_of = stored(bits_table(parts, short, *trained(parts, short)), "window_bits")
    twice = repeats(gathered)
    often, their_bits = _frequent(bits_of, "bits", top_windows)
    nothing = lambda x: np.append(x, 0.0)  # noqa: E731  what place -1 counts
    holder, name = spark.sparkContext.broadcast((tokens, nothing(np.log10(token_counts + 0.1)), often, nothing(their_bits), filter_of(twice))), uuid.uuid4().hex
    scale = np.log10(total + 0.1 * (distinct + 1))
    ends = counts.where(F.col("key") == int(END_TOKEN)).first()
    end_count = float(ends["n"]) if ends else 0.0
    schema = "kind int, uid long, no int, doc long, key long, pair long, n long, known long, base double, bits double"
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(count, **columns):
        kinds = {"kind": pa.int32(), "no": pa.int32(), "base": pa.float64(), "bits": pa.float64()}
        made = lambda x, kind: pa.nulls(count, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind)
        return pa.record_batch([made(columns.get(c), kinds.get(c, pa.int64())) for c in names], names)

    def run(batches):
        known_tokens, log_counts, lookup, window_bits, again = _unpacked(name, holder)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch, limit=STEP):
                text, begins, hashes, at, entries = canonical(data, offsets)
                uids, uid = np.arange(uid, uid + len(keys)), uid + len(keys)
                size, text_of, context, pair = chunks_of(entries)
                no = np.arange(len(size)) - np.searchsorted(text_of, text_of)
                open_ = (context != 0) & ((again[(context & np.uint64(FILTER_BITS - 1)) >> np.uint64(6)] >> (context & np.uint64(63)) & np.uint64(1)) != 0)
                ids, chunk = mix(windows(text, begins)), np.repeat(np.arange(len(size)), size)
                where = lookup(ids)
                missed = np.flatnonzero(where < 0)
                bits = np.add.reduceat(window_bits.take(where), np.cumsum(size) - size) if len(size) else np.zeros(0)
                owner = np.repeat(np.arange(len(keys)), np.diff(at))
                place = known_tokens(hashes)
                hit = place >= 0
                base = np.bincount(owner, log_counts.take(place), len(keys)) + np.log10(end_count + 0.1)
                known = np.bincount(owner, hit, len(keys)).astype(np.int64) + int(end_count > 0)
                closed = np.bincount(text_of[~open_], bits[~open_], len(keys)).astype(np.float64)
                yield rows(len(keys), kind=np.zeros(len(keys), np.int32), uid=uids, doc=keys, n=np.diff(at) + 1, known=known, base=base, bits=closed)
                what, whose, times = _rare(hashes[~hit], owner[~hit])
                yield rows(len(what), kind=np.full(len(what), 1), uid=uids[whose], key=what.view(np.int64), n=times)
                part = np.where(open_, np.arange(len(size)), len(size) + text_of)  # windows of closed chunks go to their text
                what, whose, times = _rare(ids[missed], part[chunk[missed]])
                of_text = whose >= len(size)
                whose_chunk = np.where(of_text, 0, whose)
                yield rows(len(what), kind=np.full(len(what), 2), uid=uids[np.where(of_text, whose - len(size), text_of[whose_chunk])], no=np.where(of_text, -1, no[whose_chunk]), key=what.view(np.int64), n=times)
                learn = (remainder(keys) != 0)[text_of]
                own, own_pair = (np.where(learn, _own(x, text_of), 0)[open_] for x in (context, pair))
                short = lambda x: (x[open_] & np.uint64((1 << 63) - 1)).astype(np.int64)
                yield rows(int(open_.sum()), kind=np.full(int(open_.sum()), 3), uid=uids[text_of[open_]], no=no[open_], key=short(context), pair=short(pair), n=own, known=own_pair, bits=bits[open_])
        release()

    scored = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "scored")
    of_kind = lambda kind: scored.where(F.col("kind") == kind).select("uid", "no", "key", F.col("n").alias("times"))
    rest = of_kind(1).join(counts, "key", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    rest_bits = of_kind(2).join(bits_of.select("key", F.col("bits").alias("each")), "key").groupBy("uid", "no").agg(F.sum(F.col("times") * F.col("each")).alias("rest_bits"))
    rest_bits = stored(rest_bits, "rest_bits")
    whole = scored.where("kind = 0").select("uid", "doc", "n", "known", "base", "bits").join(rest, "uid", "left")
    whole = whole.join(rest_bits.where("no < 0").select("uid", "rest_bits"), "uid", "left").join(foretold(scored, twice, rest_bits), "uid", "left")
    bits = F.col("bits") + F.coalesce("rest_bits", F.lit(0.0)) + F.coalesce("chunk_bits", F.lit(0.0))
    return whole.select(
        F.col("doc").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc").cast("string").cast("binary")) % 10 == 0, F.lit(True)).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n") * F.lit(float(scale))).alias("base_score"),
        (bits * F.lit(-float(np.log10(2)))).alias("score"),
    )


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
