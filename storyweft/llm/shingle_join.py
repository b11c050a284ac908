"""Near duplicates: word n-gram Jaccard join by a MinHash LSH forest, then exact verification.

Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased; a document is the set of its WIDTH-word
shingles, as 64-bit hashes (a document of fewer words is one shingle of all its words; one without
words has none, is in a class by itself and has no links). Documents with equal sets are
one node, whatever their number.

A node has TREES labels of DEEPEST MinHash values, a byte each, first value highest: labels in order
are the leaves of a prefix trie, and nodes below one prefix are candidates. The matched prefix has
DEEPEST values at first and is shortened by one value at a time until the recall reaches the target
(``depth_for``). The recall is measured on the whole corpus and for its least alike candidates, not for
the mean: of all sets of nodes below common prefixes of SHALLOWEST values, the one that the fewest trees
show sets the likeness, which is the threshold at least. A longer prefix is taken only if each of these
sets is below one as a whole, so it loses no candidate that SHALLOWEST values find. Without any set, and
in most corpora, the threshold itself counts.

Prefixes with the same members in several trees are one candidate group. Each group's sets meet in
one task and are compared exactly; a group of more than BLOCK members or BLOCK_BYTES of sets is dealt
into blocks, and pairs of blocks meet, so no task holds an unbounded group and no pair is ever
written as a row. A pair counts in the first tree in which it shares a prefix, and so once. From a
group come, for each member, how many rows it is linked with, and a spanning forest of its links.
Classes are the connected components of these, found by star contraction.

The result has a row per row of docs: doc_id, class_id (smallest doc_id of the component), n_links
(other rows whose set has a Jaccard likeness of at least the threshold, equal sets included).
Repeated rows are rows of an equal set; one id may stand on several texts. A row without doc_id is
compared like others; a class without any id has none. Null text: as empty. A text of any length is
compared whole, and may be a block by itself. An empty table gives no rows. Only doc_id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from storyweft.llm.columns import cut, partitions, steps, table, text_bytes
from storyweft.llm.words import LOWERED, mix, slice_hashes, word_places

WIDTH, THRESHOLD = 5, 0.8
TREES, DEEPEST, SHALLOWEST, RECALL = 28, 8, 4, 0.99999
#: Members and bytes of sets of a block.
BLOCK, BLOCK_BYTES = 256, 8 << 20


def recall_at(depth: int, likeness: np.ndarray, weight: np.ndarray, trees: int = TREES) -> float:
    """The weighted share of pairs of these likenesses that share a prefix of depth values in some tree."""
    return float(((1 - (1 - likeness**depth) ** trees) * weight).sum() / weight.sum())


def depth_for(likeness: np.ndarray, weight: np.ndarray, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix that meets the recall; SHALLOWEST if none does."""
    depth = DEEPEST
    while depth > SHALLOWEST and recall_at(depth, likeness, weight, trees) < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = LOWERED[data]
    starts, ends, counts = word_places(low, offsets)
    words = slice_hashes(low, starts, ends)
    step = 0x9FB21C651E98DF25
    powers = np.cumprod(np.full(width, step, np.uint64))
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width if len(rolled) else 0):
        rolled += words[j : j + len(rolled)] * powers[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(counts.tolist(), counts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = (words[a:b] * powers[: b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(whole + np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def labels_of(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """(n, trees) labels: DEEPEST MinHash values of 8 bits each, the first in the highest byte."""
    rng = np.random.Generator(np.random.PCG64(7))
    factor = (rng.integers(0, 1 << 32, trees * DEEPEST, np.uint64) | np.uint64(1)).astype(np.uint32)
    shift = rng.integers(0, 1 << 32, trees * DEEPEST, np.uint64).astype(np.uint32)
    least = np.full((len(sets), trees * DEEPEST), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        values = (s >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(values), 512):
            np.minimum(least[i], (values[a : a + 512, None] * factor + shift).min(0), out=least[i])
    short = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint64).reshape(len(sets), trees, DEEPEST)
    return np.bitwise_or.reduce(short << np.arange(8 * (DEEPEST - 1), -1, -8, np.uint64), axis=2).view(np.int64)


def _prefix(label, depth: int):
    return F.shiftrightunsigned(label, 8 * (DEEPEST - depth))


def _set_key(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two 64-bit hashes of the text, by which it is found again."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def signatures(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """doc_id, t1, t2, set_key (binary), shingles, labels."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in steps(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * trees)
                yield pa.record_batch(
                    [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "t1", "t2")), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(at, pa.array(labels_of(sets, trees).ravel()))],
                    ["doc_id", "t1", "t2", "set_key", "shingles", "labels"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, set_key binary, shingles int, labels array<long>")


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts with the shingle set, as little-endian 64-bit bytes, in place of the text."""
    kept = [c for c in texts.columns if c != "text"]
    schema = StructType([*(texts.schema[c] for c in kept), StructField("shingle_set", BinaryType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in steps(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in kept), pa.array([s.tobytes() for s in sets], pa.binary())], [*kept, "shingle_set"])

    return texts.select(*kept, "text").mapInArrow(run, schema)


def prefix_groups(leaves: DataFrame, depth: int, *more: Column) -> DataFrame:
    """tree, key, members, h1, h2 (by which equal member sets are told) and more of each prefix of depth
    values with two members or more."""
    h = F.xxhash64("node")
    told = [F.count("*").alias("members"), F.bit_xor(h).alias("h1"), F.sum(F.shiftright(h, 16)).alias("h2")]
    return leaves.groupBy("tree", _prefix(F.col("label"), depth).alias("key")).agg(*told, *more).where("members > 1")


def measured_depth(leaves: DataFrame, threshold: float, trees: int, recall: float, short: DataFrame | None = None) -> int:
    """depth_for the least likeness of the corpus, that of the member set which prefixes of SHALLOWEST
    values (short) show in the fewest trees, or the threshold; then shortened while one of these sets,
    and so maybe a pair, is below no prefix of the depth as a whole."""
    told = ["members", "h1", "h2"]
    short = cut(prefix_groups(leaves, SHALLOWEST)) if short is None else short
    fewest = short.groupBy(*told).count().agg(F.min("count")).first()[0]
    likeness = max(threshold, ((fewest or 0) / trees) ** (1 / SHALLOWEST))
    depth = depth_for(np.array([likeness]), np.ones(1), trees, recall)
    while depth > SHALLOWEST and not short.join(prefix_groups(leaves, depth), told, "left_anti").isEmpty():
        depth -= 1
    return depth


def verify_group(tree: int, sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, threshold: float, across: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, at the threshold whose first tree with equal keys (prefixes) is ``tree``;
    if two blocks meet (side 0, then 1), only pairs across them."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if across and (side[0] or not side[-1]):
        return
    if n == 2:
        if not (keys[0, :tree] == keys[1, :tree]).any():
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if both >= threshold * (size[0] + size[1] - both):
                yield 0, 1
        return
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    mask = np.zeros(len(every), np.uint8)
    for i in range(n - 1):
        if across and side[i]:
            break
        begin = int(np.searchsorted(side, 1)) if across else i + 1
        mine = place[ends[i] - size[i] : ends[i]]
        mask[mine] = 1
        base = ends[begin] - size[begin]
        both = np.add.reduceat(mask[place[base:]], ends[begin:] - size[begin:] - base, dtype=np.int64)
        mask[mine] = 0
        hit = both >= threshold * (size[i] + size[begin:] - both)
        for j in (np.flatnonzero(hit) + begin).tolist():
            if not (keys[i, :tree] == keys[j, :tree]).any():
                yield i, j


def _verified(rows: DataFrame, depth: int, threshold: float) -> DataFrame:
    """rows: (group key columns tree, key, one, two), side, node, copies, labels, shingle_set, sorted
    by group and side. Gives (node, links) counts and (node, to) spanning links."""
    unmatched = np.uint64(8 * (DEEPEST - depth))

    def finish(group, members):
        tree, _, one, two = group
        nodes = [m[1] for m in members]
        side = np.array([m[0] for m in members])
        copies = [m[2] for m in members]
        keys = np.array([m[3] for m in members], np.int64).view(np.uint64) >> unmatched
        sets = [np.frombuffer(m[4], np.uint64) for m in members]
        root, links = list(range(len(nodes))), [0] * len(nodes)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        span = []
        for i, j in verify_group(tree, sets, keys, side, threshold, one != two):
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                span.append((nodes[i], nodes[j]))
        return [(n, x, None) for n, x in zip(nodes, links) if x] + [(a, 0, b) for a, b in span]

    def run(batches):
        group, members = None, []
        names = ["node", "links", "to"]
        pack = lambda out: pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("tree", "key", "one", "two", "side", "node", "copies")]
            labels, sets, out = batch.column("labels"), batch.column("shingle_set"), []
            for k, (tree, key, one, two, side, node, copies) in enumerate(zip(*cols)):
                if group != (tree, key, one, two):
                    if len(members) > 1:
                        out += finish(group, members)
                    group, members = (tree, key, one, two), []
                members.append((side, node, copies, labels[k].values.to_numpy(), sets[k].as_py()))
            yield pack(out)
        yield pack(finish(group, members) if len(members) > 1 else [])

    return rows.mapInArrow(run, "node long, links long, to long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b) but the roots themselves: the smallest node of its
    component, by alternating large-star and small-star contraction until nothing changes. The least neighbours are
    cut off before they are joined: both sides of the join are then dealt out by themselves, and the
    many rows of a node with many neighbours can be split at run time."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(near.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.withColumnRenamed("u", "node")


def _row_key() -> list[Column]:
    """What tells a row from others: no id, id (0 for none) and the text's hashes."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("t1"), F.col("t2")]


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows; set_key, links and first, the row key of the class's first row, of
    each distinct set with words)."""
    spark = docs.sparkSession
    signed = cut(signatures(docs, width, trees))
    full = signed.where("shingles > 0")
    nodes = full.groupBy("set_key").agg(F.min(F.struct(*_row_key())).alias("first"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("labels").alias("labels"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    leaves = nodes.select("node", "shingles", "labels", F.posexplode("labels").alias("tree", "label"))
    size = F.sum("shingles").alias("shingles")
    short = cut(prefix_groups(leaves, SHALLOWEST, size))
    depth = measured_depth(leaves, threshold, trees, recall, short)
    groups = short if depth == SHALLOWEST else prefix_groups(leaves, depth, size)
    leaves = leaves.select("node", "tree", _prefix(F.col("label"), depth).alias("key"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    chosen = groups.groupBy("members", "h1", "h2").agg(F.min(F.struct("tree", "key", blocks.alias("blocks"))).alias("g")).select("g.*")
    mine = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    member = F.struct("tree", "key", "blocks", mine.alias("mine"))
    member = leaves.select("node", "tree", "key").join(chosen, ["tree", "key"]).groupBy("node").agg(F.collect_list(member).alias("groups"))  # a group per tree at most
    wanted = member.join(nodes.select("node", "copies", "labels", "first.t1", "first.t2"), "node")
    once = _keyed(docs).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    known = with_sets(once.join(wanted, ["t1", "t2"]).drop("t1", "t2"), width)
    # the pairs of blocks that a member takes part in
    dealt = known.select("node", "copies", "labels", "shingle_set", F.inline("groups"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("tree", "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies", "labels", "shingle_set")
    rows = rows.repartition(partitions(spark), "tree", "key", "one", "two").sortWithinPartitions("tree", "key", "one", "two", "side", "node")
    verified = cut(_verified(rows, depth, threshold))
    roots = components(verified.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    roots = cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    links = verified.where("to is null").groupBy("node").agg(F.sum("links").alias("links"))
    heads = cut(roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("head")))
    heads = cut(roots.join(heads, "root").select("node", "head"))  # both sides cut: a hot root can be split
    placed = nodes.join(links, "node", "left").join(heads, "node", "left")
    return signed, placed.select("set_key", F.coalesce("head", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs."""
    signed, placed = classes(docs, width, threshold, trees, recall, block)
    class_id = F.when(~F.col("first.none"), F.col("first.id"))
    with_words = signed.where("shingles > 0").select("doc_id", "set_key").join(placed, "set_key").select("doc_id", class_id.alias("class_id"), F.col("links").alias("n_links"))
    return with_words.union(signed.where("shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, whole, that stay: of each class one row, that of the smallest doc_id (rows
    without one come last; of several texts of one id, that of the least hash). Rows are told by
    doc_id and text: repeated ones are one row, another text of the same id has its own class."""
    signed, placed = classes(docs, **options)
    alone = signed.where("shingles = 0").select(*_row_key())
    stay = placed.select("first.*").union(alone).distinct()
    rows = ["none", "id", "t1", "t2"]
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    told_by = F.xxhash64(*(F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    return whole.groupBy(*rows).agg(F.min_by("row", told_by).alias("row")).join(stay, rows, "left_semi").select("row.*")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
head AS (SELECT a, min(b) AS b FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(head.b, doc_id)) AS class_id, coalesce(links.n, 0) AS n_links
FROM documents LEFT JOIN head ON head.a = doc_id LEFT JOIN links ON links.a = doc_id
"""
