"""Toxicity by subword-bag embeddings averaged into a linear softmax, in numpy.

A word is the bag of its own hash and those of its byte n-grams of 3 to 5 with its borders, so a
misspelling unseen in training shares vectors with what it imitates. A passage of WINDOW words is
the mean of its words' mean vectors; a softmax over two classes is trained jointly with the
vectors. A text's score is that of its most toxic passage, so a few words in a long text count;
each epoch of training takes, text by text, the passage that scores highest so far.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0: TRAIN_TOXIC toxic and
TRAIN_CLEAN other ones at most, those of the smallest hash of doc_id, TRAIN_BYTES of text of each
class at most (fewer if there are fewer); neither labels, lang, source nor doc_id is an input of a
score. The score is calibrated by margins of texts that their model has not seen, and always rises
with the margin.

Without labels of both classes every text scores the share of toxic ones (0 without any). Null
text: as empty; a text without words has a passage without words, which scores by the bias. Of
passages that score alike the first counts, which changes no score. A text of any length is scored
whole. A row without doc_id counts as held out. Repeated rows repeat, an empty table gives no rows,
and other columns are not looked at. Since the model is linear, a trained one is a number per
bucket, BUCKETS in all, whatever the corpus.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.columns import pieces_of_batch, steps, table, text_bytes
from storyweft.llm.words import LOWERED, slice_hashes, word_places

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1500, 3000, 16 << 20
BUCKETS, DIM, WINDOW, STRIDE = 1 << 17, 8, 3, 1
EPOCHS, RATE, PRIOR, FOLDS = 40, 2.0, 30.0, 2
CACHE_WORDS = 250_000

#: Lower case, with white space and the marks around words as separators.
CLEANED = LOWERED.copy()
CLEANED[[ord(c) for c in ".,;:!?\"()[]{}<>*&#/\\|_~`=+"]] = 32


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features in a row, where each word's begin and the end)."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    ends = np.cumsum([len(w) + 2 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    at, owner = [starts], [np.arange(len(words))]
    to = [ends]
    place, word = np.arange(len(raw)), np.repeat(np.arange(len(words)), ends - starts)
    for n in (3, 4, 5):
        fits = place + n <= ends[word]
        at.append(place[fits]), to.append(place[fits] + n), owner.append(word[fits])
    at, to, owner = map(np.concatenate, (at, to, owner))
    order = np.argsort(owner, kind="stable")
    buckets = (slice_hashes(raw, at, to) & np.uint64(BUCKETS - 1)).astype(np.int64)[order]
    return buckets, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of the passages of texts whose words end at counts[1:]; the last
    passage of a text ends with it, and a text without words has one empty passage."""
    n = np.diff(counts)
    number = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = counts[:-1][text] + np.minimum(k * STRIDE, np.maximum(0, n[text] - WINDOW))
    return first, np.minimum(first + WINDOW, counts[1:][text]), text


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    clean = CLEANED[data]
    _, _, counts = word_places(clean, offsets)
    apart = np.insert(clean, offsets[1:-1], 32) if len(offsets) > 2 else clean
    return apart.tobytes().split(), counts


def best_passages(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean of the best passage of each text, its first word, its end), given each word's value."""
    first, end, text = passages(counts)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    means = (sums[end] - sums[first]) / np.maximum(1, end - first)
    begins = np.searchsorted(text, np.arange(len(counts) - 1))
    top = np.maximum.reduceat(means, begins)
    at = np.flatnonzero(means == top[text])
    at = at[np.searchsorted(text[at], np.arange(len(counts) - 1))]
    return top, first[at], end[at]


def _calibrated(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(shift, slope) of a logistic regression on one score, by Newton steps."""
    spread, middle = max(1e-6, float(top.std())), float(top.mean())
    x, w = np.stack([(top - middle) / spread, np.ones(len(top))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(curve, x.T @ (p - toxic) + 1e-2 * w), -2, 2)
    return float(w[1] - w[0] * middle / spread), float(w[0] / spread)


class Bags:
    """The words of some texts as bags of buckets: ids number the distinct words, counts says where
    each text's words begin and end."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        parts, sizes = [], []
        for k in range(0, len(texts), 100):
            raw = [t.encode() for t in texts[k : k + 100]]
            words, n = split_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
            parts.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
            sizes.append(np.diff(n))
        self.ids, self.counts = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        known, found = [*number], []
        for k in range(0, len(known), 20_000):
            found.append(subwords(known[k : k + 20_000]))
        self.buckets = np.concatenate([f.astype(np.int32) for f, _ in found]) if found else np.zeros(0, np.int32)
        self.begins = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in found]))]) if found else np.zeros(1, np.int64)
        self.n_features = np.diff(self.begins)

    def values(self, margin: np.ndarray) -> np.ndarray:
        """The mean margin of each distinct word's buckets."""
        return np.add.reduceat(margin[self.buckets], self.begins[:-1]) / self.n_features if len(self.begins) > 1 else np.zeros(0)

    def best(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return best_passages(self.values(margin)[self.ids], self.counts)


def odds(bags: Bags, toxic: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Per bucket, the log of how much larger its share of the toxic texts' distinct words is than of
    the others'; counts are drawn towards no difference by PRIOR words."""
    text = np.repeat(np.arange(len(toxic)), np.diff(bags.counts))
    pair = np.unique(text * np.int64(max(1, len(bags.n_features))) + bags.ids)
    text, word = pair // max(1, len(bags.n_features)), pair % max(1, len(bags.n_features))
    owner = np.repeat(np.arange(len(bags.n_features)), bags.n_features)
    sums = []
    for c in (0, 1):
        of_word = np.bincount(word[learn[text] & (toxic[text] == c)], minlength=len(bags.n_features)).astype(np.float64)
        sums.append(np.bincount(bags.buckets, of_word[owner], BUCKETS))
    plain, bad = sums
    share = bad.sum() / max(1.0, bad.sum() + plain.sum())
    rate = lambda n, part: (n + PRIOR * part) / (n.sum() + PRIOR)
    return np.log(np.maximum(rate(bad, share), 1e-12) / np.maximum(rate(plain, 1 - share), 1e-12) * max(1 - share, 1e-12) / max(share, 1e-12))


def learnt(bags: Bags, toxic: np.ndarray, learn: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """(a number per bucket, the bias) of the two-class softmax over averaged vectors, learnt from the
    texts marked in learn. One dimension of the vectors begins at the buckets' odds, so the first
    passages taken are those of words that toxic texts have and others have not."""
    mass = np.where(toxic == 1, 0.5 / max(1, int(toxic[learn].sum())), 0.5 / max(1, int((1 - toxic[learn]).sum()))) * learn
    rng = np.random.default_rng(seed)
    vectors, softmax, bias = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.1, (2, DIM)), np.zeros(2)
    vectors[:, 0], softmax[:, 0] = odds(bags, toxic, learn), (-0.5, 0.5)
    for epoch in range(EPOCHS):
        _, first, end = bags.best((vectors @ (softmax[1] - softmax[0])).astype(np.float32))
        size = end - first
        text = np.repeat(np.arange(len(toxic)), size)
        used, word = np.unique(bags.ids[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)], return_inverse=True)
        n = bags.n_features[used]
        feature = bags.buckets[np.arange(int(n.sum())) + np.repeat(bags.begins[used] - (np.cumsum(n) - n), n)]
        bag = np.repeat(np.arange(len(used)), n)
        gather = lambda key, rows, at, m: np.stack([np.bincount(key, rows[at, d], m) for d in range(DIM)], 1)
        of_word = gather(bag, vectors, feature, len(used)) / n[:, None]
        mean = gather(text, of_word, word, len(toxic)) / np.maximum(1, size)[:, None]
        logits = mean @ softmax.T + bias
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        error = (chance - np.eye(2)[toxic]) * mass[:, None]
        to_word = gather(word, (error @ softmax) / np.maximum(1, size)[:, None], text, len(used)) / n[:, None]
        to_vectors = gather(feature, to_word, bag, BUCKETS)
        to_softmax = error.T @ mean
        rate = RATE * (1 - epoch / EPOCHS)
        vectors -= rate * to_vectors / (np.abs(to_vectors).max() + 1e-12)
        softmax -= 0.2 * rate * to_softmax / (np.abs(to_softmax).max() + 1e-12)
        bias -= 0.2 * rate * error.sum(0) / (np.abs(error).sum() + 1e-12)
    return (vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0])


def train(texts: list[str], toxic: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float, float]:
    """(a number per bucket, shift, slope) learnt from all texts. Shift and slope come from the
    margins that models without a text's own fold give it. If these do not rise with toxicity, or a
    class has fewer than FOLDS texts, the softmax stays as it is: its bias, and a slope of 1."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), 20.0 * (2 * share - 1), 1.0
    bags = Bags(texts)
    flat, bias = learnt(bags, toxic, np.ones(len(toxic), bool), seed)
    if min(int(toxic.sum()), int((1 - toxic).sum())) < FOLDS:
        return flat, bias, 1.0
    fold, top = np.zeros(len(toxic), np.int64), np.zeros(len(toxic))
    for c in (0, 1):
        fold[toxic == c] = np.arange(int((toxic == c).sum())) % FOLDS
    for k in range(FOLDS):
        margin, _ = learnt(bags, toxic, fold != k, seed + 1 + k)
        top[fold == k] = bags.best(margin)[0][fold == k]
    shift, slope = _calibrated(top, toxic)
    return (flat, shift, slope) if slope > 0 else (flat, bias, 1.0)


@lru_cache(1)
def _values(model: bytes) -> tuple[np.ndarray, dict[bytes, float]]:
    return np.frombuffer(model, np.float32), {}


def score_texts(data: np.ndarray, offsets: np.ndarray, model: bytes, bias: float, slope: float) -> np.ndarray:
    flat, cache = _values(model)
    words, counts = split_words(data, offsets)
    got = [*map(cache.get, words)]
    if None in got:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        unknown = [*(set(words).difference(cache))]
        for a in range(0, len(unknown), 50_000):
            some = unknown[a : a + 50_000]
            buckets, begins = subwords(some)
            cache.update(zip(some, (np.add.reduceat(flat[buckets].astype(np.float64), begins[:-1]) / np.diff(begins)).tolist()))
        got = [*map(cache.__getitem__, words)]
    top, _, _ = best_passages(np.array(got, np.float64), counts)
    return 1 / (1 + np.exp(-np.clip(bias + slope * top, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, float, float]:
    """A model as train() gives it, from the bounded sample of labelled texts."""
    learn = labels.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "toxic").distinct()
    order, chosen = [F.xxhash64("doc_id"), "doc_id"], None
    for sign, n in (("=", TRAIN_TOXIC), ("<>", TRAIN_CLEAN)):
        some = learn.where(f"toxic {sign} 1").orderBy(*order).limit(n)
        found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # n rows at most
        found = found.where(F.octet_length("text") <= TRAIN_BYTES).orderBy(*order, F.xxhash64("text"), "toxic").limit(n)
        chosen = found if chosen is None else chosen.union(found)
    ahead = Window.partitionBy(F.col("toxic") == 1).orderBy(*order, F.xxhash64("text"), "toxic").rowsBetween(Window.unboundedPreceding, 0)
    chosen = chosen.withColumn("size", F.sum(F.octet_length("text").cast("long")).over(ahead)).where(F.col("size") <= TRAIN_BYTES).drop("size")
    rows = sorted(chosen.toPandas().itertuples(index=False), key=lambda r: (r.doc_id, r.text, r.toxic))  # TRAIN_BYTES per class at most
    flat, bias, slope = train([r.text for r in rows], np.array([int(r.toxic == 1) for r in rows], np.int64))
    return flat.tobytes(), bias, slope


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model, bias, slope = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            for keys, data, offsets in pieces_of_batch(batch):
                chance = score_texts(data, offsets, shared.value, bias, slope)
                held = [k is None or zlib.crc32(str(k).encode()) % 5 == 0 for k in keys.to_pylist()]
                yield pa.record_batch([keys, pa.array(held), pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, whole, whose text scores below threshold."""
    model, bias, slope = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            clean = [score_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value, bias, slope) < threshold for a, b in steps(offsets)]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
