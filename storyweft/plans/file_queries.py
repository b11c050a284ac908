"""Queries that write tables in the pipeline's file formats and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions import text as T
from storyweft.functions import vectors as V
from storyweft.operators import learning, pooling, tfidf
from storyweft.plans import options as O
from storyweft.plans import runs
from storyweft.plans import text_sql as S
from storyweft.plans.registry import query
from storyweft.session import read, scratch, stored, with_index
from storyweft.sources import datasets

TIMES = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "files")


def _dated(spark, d) -> DataFrame:
    """Documents with the time and kind of the event of their number, and a label."""
    events = read(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.when(F.col("value") > 50, F.col("event_type")).alias("event"))
    labels = read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = read(spark, d, "documents").select("doc_id", "text").join(events, "doc_id").join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").cast("string").alias("id"), "label", "text", "created_at", "event")


DATED = f"dated AS (SELECT doc_id::VARCHAR AS id, quality::DOUBLE AS label, text, {TIMES} AS created_at, strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H:%M:%S') AS time, CASE WHEN value > 50 THEN event_type END AS event FROM documents JOIN events ON event_id = doc_id LEFT JOIN labels USING (doc_id))"


@query(f"WITH {DATED} SELECT id, label, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, date, time, row_number() OVER (ORDER BY id) - 1 AS idx FROM dated")
def dataset_file(spark, d):
    """Labelled documents as a TSV with all fields quoted, and back; line ends come back as one kind."""
    folder = _folder(spark)
    datasets.save_labelled(_dated(spark, d), folder)
    found = datasets.load_dataset(spark, folder)
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return found.select("id", "label", text.alias("text"), "date", "time", F.col("idx").cast("long").alias("idx"))


@query(f"WITH {DATED} SELECT id, event FROM dated WHERE event IS NOT NULL")
def examined_rows(spark, d):
    return datasets.prepare(_dated(spark, d), "examined").select("id", "event")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS text FROM events")
def first_row_of_files(spark, d):
    """Of an id in several files the row of the first file stays, whatever the files' sizes."""
    folder, events = _folder(spark), read(spark, d, "events")
    rows = lambda where, text: events.where(where).select(F.col("event_id").cast("string").alias("id"), F.lit(None).cast("double").alias("label"), F.lit(text).alias("text"), F.lit("2020-01-01 00:00:00").alias("created_at"))
    datasets.save_labelled(rows("event_id % 3 = 0", "a").coalesce(1), f"{folder}/a")
    datasets.save_labelled(rows("true", "b"), f"{folder}/b")
    return datasets.load_dataset(spark, f"{folder}/*").select("id", "text")


@query("SELECT DISTINCT quality::VARCHAR AS label, doc_id::VARCHAR AS id FROM labels")
def id_file(spark, d):
    folder, labels = _folder(spark), read(spark, d, "labels")
    labels.union(labels).select("quality", "doc_id").write.option("sep", "\t").csv(folder)
    return datasets.load_ids(spark, folder)


@query(f"SELECT event_id + k * (SELECT count(*) FROM events) AS r, {TIMES} AS created_at, event_type || k AS text FROM events, (SELECT unnest([0, 1]) AS k)")
def post_files(spark, d):
    """Posts of two files, numbered on through them."""
    folders, events = [_folder(spark), _folder(spark)], read(spark, d, "events")
    for k, folder in enumerate(folders):
        rows = events.orderBy("event_id").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.concat("event_type", F.lit(str(k))).alias("text"))
        rows.coalesce(1).write.option("header", True).csv(folder)
    return datasets.load_posts(spark, folders).select(F.col("r").cast("long").alias("r"), "created_at", "text")


@query("SELECT vec_id AS idx, round(embedding[1]::DOUBLE, 6) AS x0 FROM embeddings WHERE vec_id % 2 = 0")
def feature_cache(spark, d):
    path = datasets.cache_path(_folder(spark), {"dataset": "e", "model": "m", "annotation": "examined"})
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), V.doubles(F.col("embedding")).alias("vec"))
    datasets.save_features(rows, path)
    return datasets.load_features(spark, path, rows.where("idx % 2 = 0")).select("idx", F.round(F.col("vec")[0], 6).alias("x0"))


@query(r"SELECT token, count(*) AS df, (SELECT count(*) FROM documents) AS n_samples FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents) GROUP BY token")
def history_files(spark, d):
    folder, docs = _folder(spark), read(spark, d, "documents")
    datasets.save_history(tfidf.document_frequency(tfidf.token_rows(docs)), docs.count(), folder)
    frequency, n = datasets.load_history(spark, folder)
    return frequency.select("token", "df", F.lit(n).cast("long").alias("n_samples"))


@query(f"WITH {DATED} SELECT date, time, label::VARCHAR AS label, (id::BIGINT % 7)::VARCHAR AS pred, id FROM dated")
def prediction_file(spark, d):
    folder = _folder(spark)
    at = T.parse_created_at(F.col("created_at"))
    rows = _dated(spark, d).select("*", T.date_of(at).alias("date"), T.time_of(at).alias("time"), (F.col("id").cast("long") % 7).alias("pred"))
    datasets.save_predictions(rows, folder, 0.65)
    return spark.read.csv(f"{folder}/t=0.65", sep="\t", header=True)


@query("SELECT source AS model, k, avg(n_chars)::VARCHAR AS f1 FROM documents, (SELECT unnest(['a', 'b']) AS k) GROUP BY ALL")
def result_file(spark, d):
    """Results of two runs, the second appended to the first."""
    folder = _folder(spark)
    results = read(spark, d, "documents").groupBy(F.col("source").alias("model")).agg(F.avg("n_chars").alias("f1"))
    for k in ("a", "b"):
        datasets.append_results(results.select("model", F.lit(k).alias("k"), "f1"), folder)
    return spark.read.csv(folder, header=True)


@query("SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn, text FROM conversations")
def json_line_file(spark, d):
    folder, rows = _folder(spark), read(spark, d, "conversations").select("conv_id", "turn", "text")
    for _ in range(2):
        datasets.save_json_lines(rows, folder)
    return spark.read.schema("conv_id long, turn long, text string").json(folder)


@query(r"WITH t AS (SELECT doc_id AS r, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS l FROM documents)), s AS (SELECT token, count(*) AS df, min((r, pos)) AS first FROM t GROUP BY token) SELECT row_number() OVER (ORDER BY df DESC, first) - 1 AS place, token, df::VARCHAR AS df FROM s")
def burst_file(spark, d):
    """Most frequent tokens first, of equal ones the one that occurred first."""
    folder = _folder(spark)
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.lower_tokens(F.col("text"))).alias("pos", "token"))
    scores = rows.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct(F.col("doc_id").alias("r"), "pos")).alias("first"))
    datasets.save_bursts(scores.select("*", F.lit(0.0).alias("idf"), F.lit(0.0).alias("jlh_max")), folder)
    found = datasets._numbered(spark.read.csv(folder, header=True, quote='"', escape='"'))
    return with_index(found, "_line", name="place").select(F.col("place").cast("long").alias("place"), "token", "df")


BENCH_PAIRS = "p AS (SELECT item_id, text AS a, 'so ' || left(text, 20) AS b, (item_id % 6)::DOUBLE AS score FROM benchmark)"


def _bench_pairs(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("text").alias("1_text"), F.concat(F.lit("so "), F.substring("text", 1, 20)).alias("2_text"), (F.col("item_id") % 6).cast("double").alias("Moyenne"))


@query(f"WITH {BENCH_PAIRS} SELECT a AS first, b AS second, round(1 - score / 5, 9) AS distance, round(score / 5, 9) AS similarity FROM p")
def pair_file(spark, d):
    folder = _folder(spark)
    _bench_pairs(spark, d).write.option("header", True).option("quoteAll", True).option("escape", '"').options(**datasets.KEEP_SPACE).csv(folder)
    found = datasets.load_pairs(spark, folder)
    return found.select(F.col("1_text").alias("first"), F.col("2_text").alias("second"), F.round("distance", 9).alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(f"""WITH {BENCH_PAIRS}, {S.hashed('va', 'p', 'item_id', 'a', 16)}, {S.hashed('vb', 'p', 'item_id', 'b', 16)},
s AS (SELECT item_id, sum(va.x * vb.x) AS s FROM va JOIN vb USING (item_id, d) GROUP BY item_id)
SELECT a AS first, b AS second, round(1 - coalesce(s, 0), 6) AS cosine FROM p LEFT JOIN s USING (item_id)""")
def pair_cosines(spark, d):
    """The pairs with the distance of their encodings."""
    found = runs.score_pairs(_bench_pairs(spark, d), learning.hashing_encoder)
    return found.select(F.col("1_text").alias("first"), F.col("2_text").alias("second"), F.round("cosine", 6).alias("cosine"))


@query("SELECT item_id, length(text) || ':' || substr(text, 1, 5) AS generated FROM benchmark")
def generated_texts(spark, d):
    provider = lambda: lambda texts: [f"{len(t)}:{t[:5]}" for t in texts]
    return learning.generate(read(spark, d, "benchmark"), provider).select("item_id", "generated")


@query("SELECT vec_id AS idx, substr(md5('3:' || vec_id), 1, 8) < 'cccccccc' AS train FROM embeddings")
def share_split_rows(spark, d):
    a, b = learning.share_split(read(spark, d, "embeddings").select(F.col("vec_id").alias("idx")), 0.8, 3)
    return a.withColumn("train", F.lit(True)).unionByName(b.withColumn("train", F.lit(False)))


@query("SELECT 'tfidf_dataset' AS model, 'fr' AS lang, 0.7 AS threshold, 16::BIGINT AS batch UNION ALL SELECT 'sbert', 'en', 0.4, 8")
def resolved_options(spark, d):
    """Standard options, those of a model, and the caller's, later ones winning."""
    document = {"standard": {"batch_size": 16, "threshold": 0.7}, "sbert_nli_sts": {"lang": "en", "threshold": [0.4]}}
    found = [O.merged("tfidf_dataset", document), O.merged("sbert_nli_sts", document, {"batch_size": 8})]
    return spark.createDataFrame([(o.model, o.lang, float(o.threshold[0]), o.batch_size) for o in found], "model string, lang string, threshold double, batch long")


def _letters(words: DataFrame) -> DataFrame:
    return words.select("token", F.array(F.length("token").cast("double"), F.when(F.startswith("token", F.lit("t")), 1.0).otherwise(0.5)).alias("vec"))


W2V = rf"""{S.formatted('cleaned', 'documents')}, t AS (SELECT doc_id AS idx, unnest(regexp_extract_all(text, '[{S.WORD}]{{2,}}')) AS token FROM cleaned),
v AS (SELECT DISTINCT token, length(token)::DOUBLE AS x0, CASE WHEN starts_with(token, 't') THEN 1.0 ELSE 0.5 END::DOUBLE AS x1 FROM t WHERE length(token) <= 6)"""


def _w2v(spark, d, weighted: bool) -> DataFrame:
    docs, chosen = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text"), O.Options(model="w2v_twitter_fr", tfidf_weights=weighted)
    cleaned = stored(runs.clean(docs, chosen))
    words = stored(tfidf.document_frequency(tfidf.token_rows(cleaned, "idx", tokenizer=T.tokens, once=True), once=True))
    vectors = _letters(words.where(F.length("token") <= 6))
    found, _ = runs.build_features(docs, chosen, vectors=vectors, history=words if weighted else None, history_n=docs.count() if weighted else 0, cleaned=cleaned)
    return found.select("idx", F.round(F.col("vec")[0], 9).alias("x0"), F.round(F.col("vec")[1], 9).alias("x1"))


@query(f"WITH {W2V}, m AS (SELECT idx, coalesce(sum(x0), 0) / count(*) AS x0, coalesce(sum(x1), 0) / count(*) AS x1 FROM t LEFT JOIN v USING (token) GROUP BY idx) SELECT doc_id AS idx, round(coalesce(x0, 0), 9) AS x0, round(coalesce(x1, 0), 9) AS x1 FROM documents LEFT JOIN m ON m.idx = doc_id")
def word_vector_features(spark, d):
    return _w2v(spark, d, False)


@query(f"""WITH {W2V}, i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT idx) + 1)) + 1 AS idf FROM t GROUP BY token),
m AS (SELECT idx, coalesce(sum(x0 * idf), 0) / count(*) AS x0, coalesce(sum(x1 * idf), 0) / count(*) AS x1 FROM t LEFT JOIN v USING (token) LEFT JOIN i USING (token) GROUP BY idx)
SELECT doc_id AS idx, round(coalesce(x0, 0), 9) AS x0, round(coalesce(x1, 0), 9) AS x1 FROM documents LEFT JOIN m ON m.idx = doc_id""")
def weighted_word_vector_features(spark, d):
    return _w2v(spark, d, True)
