"""SpotSigs fingerprints: chains of content words that follow common words, in DataFrame operations.

A word is a run of letters or digits, lower-cased. At each common word (an anchor) the next CHAIN
content words among the SPAN words behind it, other common words skipped, form a chain; anchor and
chain are one signature, kept as a 32-bit hash. A fingerprint is the ascending list of distinct
signatures; two are compared by their Jaccard likeness. A text with fewer than FEW signatures
also has those of each word with the two behind it, and a text without words that of itself, so
texts in other languages are told apart too. Equal texts have equal fingerprints.

Null text: as empty; an empty text has an empty fingerprint, which is like another empty one (1)
and unlike all others (0). Texts of any length are fingerprinted whole. Repeated rows repeat. Rows of
one id are ordered by text; rows without an id come before all others, and the row after the last is
the first with an id. An empty table gives no rows. Only doc_id and text are read.

A row's two likenesses are of given pairs and so exact, whatever the lengths; partitions by length
and the pruned comparison serve ``similar_pairs``, which looks for the pairs itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.columns import table

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an the and or of to in on at by for from with as is are was were be been it this that not but have has had will can "
    "le la les un une des du de et en est que qui dans pour par sur au aux avec ne pas ce se il elle "
    "der die das den dem ein eine einen und ist in im mit von zu auf für nicht sich auch als wie bei er sie es "
    "el los las una y que es por con para del al lo su como más o"
).split()
CHAIN, SPAN, FEW = 2, 8, 8
#: Buckets of neighbouring ids: this many at most, of about so many rows.
MOST_BUCKETS, BUCKET_ROWS, SLOTS = 1 << 20, 128, 256


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fingerprints(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a column out, the ascending distinct signatures of the column text. Words and spots
    are columns of their own, so that neither is computed again inside the other's lambdas."""
    words, spots = F.col("_words"), F.col("_spots")
    common = lambda w: w.isin(*sorted({*ANCHORS}))
    behind = lambda i, n: F.slice(words, i + 2, n)
    chain = lambda i: F.slice(F.filter(behind(i, SPAN), lambda x: ~common(x)), 1, CHAIN)
    runs = F.transform(words, lambda w, i: F.hash(F.lit(1), w, behind(i, 2)))
    rest = F.when(F.size(words) > 0, runs).when(F.col(text) != "", F.array(F.hash(F.lit(2), text))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_words", words_of(F.col(text)))
    df = df.withColumn("_spots", F.transform(words, lambda w, i: F.when(common(w), F.hash(w, chain(i)))))
    df = df.withColumn("_spots", F.array_compact(spots))
    df = df.withColumn("_all", F.when(F.size(spots) >= FEW, spots).otherwise(F.concat(spots, rest)))
    return df.withColumn(out, F.sort_array(F.array_distinct("_all"))).drop("_words", "_spots", "_all")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two fingerprints; 0, without comparing them, where their lengths alone
    keep it below least."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * least), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(fingerprint: Column) -> Column:
    """Signatures as hexadecimal numbers with dots between."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)))), ".")


def similar_pairs(signed: DataFrame, key: str, fingerprint: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of the pairs of distinct fingerprints at the threshold, each stood for by
    its smallest key: rows meet by length partition and rare signature, and are then compared.

    A fingerprint of n signatures belongs to the partition of n and probes the one above, whose
    lengths are larger by up to 1 / threshold; two at the threshold share one of the rarest
    ``n - ceil(threshold * n) + 1`` signatures of each."""
    rows = signed.groupBy(F.col(fingerprint).alias("f")).agg(F.min(key).alias("k")).where(F.size("f") > 0)
    count = rows.select(F.explode("f").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    n = F.size("f")
    rare = rows.select("k", n.alias("n"), F.explode("f").alias("s")).join(count, "s").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("df", "s")))
    rare = rare.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))).cast("int")
    mine = rare.select("s", part.alias("part"), F.col("k").alias("a"), F.col("n").alias("na"))
    other = rare.select("s", F.explode(F.array(part, part - 1)).alias("part"), F.col("k").alias("b"), F.col("n").alias("nb"))
    fits = "na <= nb AND na >= nb * {0} AND a <> b AND (na < nb OR a < b)".format(threshold)
    pairs = mine.join(other, ["s", "part"]).where(fits).select("a", "b").distinct()
    pairs = pairs.join(rows.select(F.col("k").alias("a"), F.col("f").alias("fa")), "a").join(rows.select(F.col("k").alias("b"), F.col("f").alias("fb")), "b")
    compared = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("fa"), F.col("fb"), threshold).alias("likeness"))
    return compared.where(F.col("likeness") >= threshold)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by ascending doc_id (after the last:
    the first). Rows are dealt into buckets of neighbouring ids, at most MOST_BUCKETS, by
    quantiles and equal steps between them; a bucket's first row is also sent, as a guest, to the
    bucket before it. So only the buckets' first ids are broadcast."""
    ids = docs.select("doc_id")
    slots = [i / SLOTS for i in range(SLOTS)]
    low, high, count, cuts = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.percentile_approx("doc_id", slots, 10_000)).first()
    if not count:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    low, high = (0, 0) if low is None else (low, high)
    buckets = min(MOST_BUCKETS, max(1, count // BUCKET_ROWS))
    bounds = sorted({low, *(cuts if buckets > SLOTS else [])})
    each = max(1, buckets // len(bounds))
    step = [max(1, -(-(b - a) // each)) for a, b in zip(bounds, [*bounds[1:], high + 1])]
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))

    def dealt(df):
        known = F.coalesce("doc_id", F.lit(low))
        slot = F.size(F.filter(longs(bounds), lambda b: b <= known))
        inside = F.floor((known - F.element_at(longs(bounds), slot)) / F.element_at(longs(step), slot)).cast("long")
        return df.withColumn("bucket", slot.cast("long") * (1 << 40) + inside)

    heads = dealt(ids).groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))  # MOST_BUCKETS rows at most
    every = Window.orderBy("bucket")
    last = F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("doc_id", F.coalesce(F.lag("bucket").over(every), last).alias("guest_of"))
    rows = dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).join(F.broadcast(heads), "doc_id", "left")
    places = F.when(F.col("guest_of").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("bucket"), F.lit(1).alias("guest")))
    )
    placed = rows.select("doc_id", "text", F.inline(places))
    return placed.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs)
    if "bucket" not in rows.columns:
        rows = rows.withColumns({"bucket": F.lit(0), "guest": F.lit(0)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("bucket", "guest", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(F.col("guest") == 0, edited).otherwise("").alias("edited"))
    rows = fingerprints(fingerprints(rows, "text", "f"), "edited", "e")
    rows = rows.select("bucket", "guest", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "e")
    rows = rows.withColumn("next_f", F.lead("f").over(_order())).where("guest = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).cast("double").alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).cast("double").alias("near_next"),
    )


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
