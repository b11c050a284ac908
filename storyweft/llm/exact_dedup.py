"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Texts are equal when they are identical after each run of white space ([\\x20\\x09-\\x0D]+)
became one space. A normalised text is cut behind every word whose hash is 0 modulo ``every``, so
equal passages are cut alike wherever they stand. A chunk's identifier is its 64-bit hash; all
distinct chunks are grouped by their whole content once, which verifies that no identifier stands
for two contents. Documents are then compared by their ordered lists of identifiers: the long
texts move once, each distinct chunk once per task, and copies in any number only as lists.
Documents whose list holds an identifier of two contents are told apart by the hash of their text.

A null text is empty. Empty texts equal each other. Rows that repeat an id and its text are all
kept or dropped alike (``keep_first`` leaves one of them); one without an id stays only where no
equal text has one. One id may stand on several texts. Only the key and text columns are read, so
others cannot clash. A text without white space is one chunk, however long. An empty table gives an
empty result. A hot group is summed up before the
shuffle; the join back is a plain sort-merge join whose large partitions can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.columns import cut, table

WHITE = r"[\x20\x09-\x0D]+"
#: Words between cuts, on average.
EVERY = 64
#: The mark behind a chunk, and what keeps marks that a text itself holds apart from it.
MARK, KEEP = "\u0001", "\u0002"


def _marked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(KEEP), F.lit(KEEP + "b")), F.lit(MARK), F.lit(KEEP + "a"))


def _unmarked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(KEEP + "a"), F.lit(MARK)), F.lit(KEEP + "b"), F.lit(KEEP))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(documents with sha, recipe and how often the row occurs; identifiers of two contents)."""
    words = docs.select(F.col(key).alias("id"), F.split(_marked(F.coalesce(F.col(text), F.lit(""))), WHITE, -1).alias("words"))
    ends = lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(every)) == 0, F.concat(w, F.lit(MARK))).otherwise(w)
    chunks = words.select(
        "id",
        F.sha2(_unmarked(F.array_join("words", " ")), 256).alias("sha"),
        F.split(F.array_join(F.transform("words", ends), " "), MARK, -1).alias("chunks"),
    )
    named = chunks.select("id", "sha", F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("chunk"), c.alias("content"))).alias("chunks"))
    document = F.struct(
        F.lit(None).cast("long").alias("chunk"),
        F.lit(None).cast("string").alias("content"),
        F.col("id").alias("id"),
        F.col("sha").alias("sha"),
        F.col("chunks.chunk").alias("recipe"),
    )
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("sha", "string"), ("recipe", "array<bigint>"))]
    rows = F.concat(F.array(document), F.transform("chunks", lambda c: F.struct(c["chunk"].alias("chunk"), c["content"].alias("content"), *nothing)))
    distinct = named.select(F.inline(rows)).groupBy("chunk", "content", "id", "sha", "recipe").agg(F.count("*").alias("copies"))
    known = cut(distinct.select("chunk", "id", "sha", "recipe", "copies"))
    twice = known.where("chunk is not null").groupBy("chunk").count().where("count > 1").select("chunk")
    return known.where("chunk is null").drop("chunk"), twice


def decided(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """id, sha, copies, keep_id, group_size of each distinct key and text of docs."""
    known, twice = recipes(docs, key, text, every)
    if twice.isEmpty():
        known = known.withColumn("apart", F.lit(""))
    else:
        met = known.select("id", F.explode("recipe").alias("chunk")).join(twice, "chunk", "left_semi").select("id").distinct()
        known = known.join(met.withColumnRenamed("id", "met"), F.col("id").eqNullSafe(F.col("met")), "left_semi").withColumn("apart", F.col("sha")).unionByName(
            known.join(met.withColumnRenamed("id", "met"), F.col("id").eqNullSafe(F.col("met")), "left_anti").withColumn("apart", F.lit(""))
        )
    groups = known.groupBy("recipe", "apart").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return known.join(groups, ["recipe", "apart"]).select("id", "sha", "copies", "keep_id", "group_size")


def _stays() -> Column:
    return F.col("id").eqNullSafe(F.col("keep_id"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 for each row of docs."""
    rows = decided(docs, key, text, every).select("id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(F.col("id").alias(key), "keep_id", "group_size", _stays().alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, whole, that stay: of equal texts one row, that of the smallest key. Rows that
    share key and text are equal too, one of them stays; so does one of equal texts without a key.
    Rows are told by key and text, so another text of the same key is not touched. Repeated rows are
    put together inside each task, before anything moves."""
    sha = F.coalesce(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " "), 256), F.lit(""))
    named = lambda id: (F.coalesce(id, F.lit(0)).alias("id"), id.isNull().alias("none"))
    rows = docs.select(*named(F.col(key).cast("long")), sha.alias("sha"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    told_by = F.xxhash64(*(F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    once = rows.groupBy("id", "none", "sha").agg(F.min_by("row", told_by).alias("row"))
    stay = decided(docs, key, text).where(_stays()).select(*named(F.col("id")), "sha")
    return once.join(stay, ["id", "none", "sha"], "left_semi").select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
