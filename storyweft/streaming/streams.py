"""The stateful operators over streams.

The window of posts or rows is one for the whole stream, so state cannot be keyed inside a stateful
operator without all of it in one task. Instead each trigger's rows meet the state as tables: what
the next trigger needs is written, trigger by trigger, below a folder, and the batch operators run
over the rows of the window and the new ones. A trigger that runs again overwrites its own tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyweft.functions import text as T
from storyweft.functions import vectors as V
from storyweft.operators import burst, neighbors, stories
from storyweft.session import cut, with_index


def vocabulary_counts(docs: DataFrame, idx: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, df), growing with the stream: documents that hold each token. Output mode: update or
    complete."""
    distinct = F.array_distinct(T.lower_tokens(T.null_to_empty(F.col(text))))
    return docs.select(F.explode(distinct).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


class Tables:
    """State of a stream: tables and numbers by trigger. Subclasses say what they are at first and
    how a trigger's rows change them."""

    def __init__(self, folder: str):
        self.folder = folder

    def read(self, spark: SparkSession, trigger: int) -> tuple[dict[str, DataFrame], dict]:
        if trigger < 0:
            return {name: spark.createDataFrame([], schema) for name, schema in self.schemas().items()}, self.numbers()
        at = f"{self.folder}/state/{trigger}"
        tables = {name: spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in self.schemas().items()}
        return tables, json.loads(spark.read.text(f"{at}/numbers").first()[0])

    def __call__(self, rows: DataFrame, trigger: int) -> None:
        spark, at = rows.sparkSession, f"{self.folder}/state/{trigger}"
        tables, numbers = self.read(spark, trigger - 1)
        out, numbers = self.advance(cut(rows), tables, numbers, trigger)
        for name, table in out.items():
            table.write.mode("overwrite").parquet(f"{at}/{name}")
        spark.createDataFrame([(json.dumps(numbers),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/numbers")

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        """The running query; trigger as DataStreamWriter.trigger takes it, by default all that is there."""
        writer = rows.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def last(self, spark: SparkSession) -> tuple[dict[str, DataFrame], dict]:
        """State after the last whole trigger."""
        names = spark.read.text(f"{self.folder}/state/*/numbers").select(F.col("_metadata.file_path").alias("path"))
        done = names.agg(F.max(F.regexp_extract("path", r"/state/(\d+)/numbers", 1).cast("int"))).first()[0]
        return self.read(spark, -1 if done is None else done)


class StoryTables(Tables):
    """First-story detection: state is the last rows that can still be neighbours, with their stories.
    Rows (idx, vec) have to come in the order of idx, from trigger to trigger."""

    def __init__(self, folder: str, threshold: float, window: int = 200, batch: int = 8):
        super().__init__(folder)
        self.threshold, self.window, self.batch = threshold, window, batch

    def schemas(self):
        return {"tail": "i long, vec array<double>, pred long"}

    def numbers(self):
        return {"rows": 0, "stories": 0}

    def advance(self, rows, tables, numbers, trigger):
        tail, begin, named = tables["tail"], numbers["rows"], numbers["stories"]
        full = rows.where(~V.is_zero(F.col("vec")))
        new = with_index(full.select("idx", "vec"), "idx", name="n").select("idx", (F.col("n") + begin).alias("i"), "vec")
        new = cut(new)
        near = neighbors.nearest_dense(tail.select("i", "vec").union(new.select("i", "vec")), self.window, self.batch)
        joins = near.where((F.col("i") >= max(begin, self.batch)) & (F.col("d") < self.threshold)).select("i", F.col("j").alias("p"))
        parents = new.select("i").join(joins, "i", "left").unionByName(tail.select("i", F.lit(None).cast("long").alias("p")))
        found = cut(stories.roots(parents))
        heads = found.where((F.col("i") == F.col("root")) & (F.col("i") >= begin))
        fresh = with_index(heads.select("i"), "i", name="n").select(F.col("i").alias("root"), (F.col("n") + named).alias("pred"))
        known = cut(fresh.unionByName(tail.select(F.col("i").alias("root"), "pred")))
        labelled = cut(new.join(found, "i").join(known, "root").select("idx", "i", "vec", "pred"))
        out = rows.select("idx").join(labelled.select("idx", "pred"), "idx", "left").select(F.col("idx").cast("long").alias("idx"), F.coalesce("pred", F.lit(-1)).cast("long").alias("pred"))
        out.write.mode("overwrite").parquet(f"{self.folder}/stories/trigger={trigger}")
        end = begin + labelled.count()
        kept = tail.unionByName(labelled.select("i", "vec", "pred")).where(F.col("i") >= end - self.window - self.batch)
        return {"tail": kept}, {"rows": end, "stories": named + heads.count()}

    def found(self, spark: SparkSession) -> DataFrame:
        """(idx, pred) of all triggers so far."""
        return spark.read.schema("idx long, pred long, trigger int").parquet(f"{self.folder}/stories").select("idx", "pred")


class BurstTables(Tables):
    """Burst shares: state is the window's posts, their tokens, and totals per token. Posts (r, ts,
    text) are numbered on from 0 through the triggers."""

    def __init__(self, folder: str, hours: float = 12, strict: bool = False):
        super().__init__(folder)
        self.hours, self.strict = hours, strict

    def schemas(self):
        return {"posts": "r long, sec long", "held": "token string, r long, k long", "tokens": "token string, df long, began long, fg double"}

    def numbers(self):
        return {"posts": 0, "start": 0}

    def advance(self, rows, tables, numbers, trigger):
        since, start = numbers["posts"], numbers["start"]
        times = cut(tables["posts"].unionByName(burst.seconds_of(rows)))
        words = burst.occurrences(rows.select("r", T.tokens(T.format_text(F.col("text"))).alias("tokens")), F.col("tokens")).select("token", "r", "k")
        counted = cut(tables["held"].unionByName(words))
        placed = cut(burst.window_starts(times, self.hours, self.strict, start, since))
        new = counted.where(F.col("r") >= since).groupBy("token").agg(F.sum("k").alias("df"), F.min("r").alias("began"), F.lit(None).cast("double").alias("fg"))
        sums = cut(tables["tokens"].unionByName(new).groupBy("token").agg(F.sum("df").alias("df"), F.min("began").alias("began"), F.max("fg").alias("fg")))
        inside = burst.window_counts(counted, placed).join(sums.select("token", "began"), "token").where("began < s")
        share = inside.groupBy("token").agg(F.max(F.col("inside") / (F.col("r") - F.col("s") + 1)).alias("share"))
        totals = sums.join(share, "token", "left").select("token", "df", "began", F.greatest("fg", "share").alias("fg"))
        end = placed.agg(F.max_by("after", "r"), F.max("r")).first()
        start, seen = (start, since) if end[1] is None else (end[0], end[1] + 1)
        held = lambda df: df.where(F.col("r") >= start)
        return {"posts": held(times), "held": held(counted), "tokens": totals}, {"posts": seen, "start": start}

    def found(self, spark: SparkSession) -> DataFrame:
        """(token, df, idf, jlh_max) of the posts so far."""
        tables, numbers = self.last(spark)
        return tables["tokens"].select("token", "df", *burst.score_columns(F.lit(numbers["posts"])))
