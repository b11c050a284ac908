import json

from pyspark.sql import functions as F

from storyweft.operators import learning
from storyweft.plans import options as O
from storyweft.plans import runs
from storyweft.session import with_index
from storyweft.sources import datasets as D

TSV = '"id"\t"label"\t"text"\t"created_at"\t"event"\n"10"\t"1"\t"a ""q"" b"\t"2018-07-16 05:00:56"\t"e"\n"9"\t""\t""\t"Mon Jul 16 05:00:56 +0000 2018"\t""\n"10"\t"2"\t"again"\t"2018-07-16 05:00:56"\t""\n'


def test_load_dataset(spark, tmp_path):
    (tmp_path / "d.tsv").write_text(TSV)
    rows = D.load_dataset(spark, str(tmp_path / "d.tsv")).orderBy("idx").collect()
    assert [(r.id, r.text, r.date, r.time, r.idx) for r in rows] == [("10", 'a "q" b', "20180716", "05:00:56", 0), ("9", "", "20180716", "05:00:56", 1)]
    assert [r.id for r in D.load_dataset(spark, str(tmp_path / "d.tsv"), "annotated").collect()] == ["10"]
    assert [r.id for r in D.load_dataset(spark, str(tmp_path / "d.tsv"), "examined").collect()] == ["10"]


def test_posts_continue_across_files(spark, tmp_path):
    for name, texts in (("b", ["one", "two"]), ("a", ["three"])):
        (tmp_path / f"{name}.csv").write_text("text,created_at\n" + "".join(f"{t},2020-01-01 00:00:00\n" for t in texts))
    rows = D.load_posts(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]).orderBy("r").collect()
    assert [(r.r, r.text) for r in rows] == [(0, "one"), (1, "two"), (2, "three")]


def test_ids_hydration_and_fields(spark, tmp_path):
    (tmp_path / "ids.tsv").write_text("1\t11\n1\t11\n2\t12\n")
    ids = D.load_ids(spark, str(tmp_path / "ids.tsv"))
    assert ids.count() == 2

    def client():
        return lambda wanted: [{"id_str": i, "full_text": "x\ty", "created_at": "c", "extended_entities": {"media": [{"media_url": "u"}]}} for i in wanted if i == "11"]

    fetched = D.fetch_posts(ids, client, 1)
    schema = "id_str string, full_text string, created_at string, extended_entities struct<media array<struct<media_url string>>>"
    posts = D.post_fields(fetched.select(F.from_json("value", schema).alias("v")).select("v.*"))
    got = D.hydrate(ids, posts).collect()
    assert [(r.id, r.label, r.text, r.url_image) for r in got] == [("11", "1", "x y", "u")]
    assert D.hydrated_share(ids, posts).first().percent == 50.0


def test_caches_and_sinks(spark, tmp_path):
    path = D.cache_path(str(tmp_path), {"dataset": "d", "model": "m", "lang": "fr"})
    assert path != D.cache_path(str(tmp_path), {"dataset": "d", "model": "m", "lang": "en"})
    assert D.load_features(spark, path) is None
    features = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "idx long, token string, w double")
    D.save_features(features, path)
    assert D.load_features(spark, path, spark.range(1).withColumnRenamed("id", "idx")).count() == 1
    D.save_history(spark.createDataFrame([("a", 3)], "token string, df long"), 7, str(tmp_path / "h"))
    history, n = D.load_history(spark, str(tmp_path / "h"))
    assert n == 7 and history.first().df == 3
    D.save_predictions(spark.createDataFrame([("9", 1, 2)], "id string, pred long, other long"), str(tmp_path / "p"), 0.6)
    assert spark.read.csv(str(tmp_path / "p/t=0.6"), sep="\t", header=True).columns == ["pred", "id"]
    for _ in range(2):
        D.append_results(spark.createDataFrame([(0.5,)], "f1 double"), str(tmp_path / "r"))
        D.save_json_lines(spark.createDataFrame([("x",)], "a string"), str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2 and spark.read.json(str(tmp_path / "j")).count() == 2
    D.save_labelled(spark.createDataFrame([("x",)], "a string"), str(tmp_path / "l"))
    D.save_bursts(spark.createDataFrame([("x", 1, 1.0, 0.0)], "token string, df long, idf double, jlh_max double"), str(tmp_path / "b"))
    assert spark.read.csv(str(tmp_path / "b"), header=True).first().token == "x"


def test_pairs_and_images(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1_text,2_text,Moyenne\na,b,4\n")
    got = D.load_pairs(spark, str(tmp_path / "p.csv")).first()
    assert abs(got.distance - 0.2) < 1e-12 and got.similarity == 0.8
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"123")
    assert bytes(D.load_images(spark, str(tmp_path / "img")).first().content) == b"123"


def test_options_do_not_leak(tmp_path):
    (tmp_path / "o.yaml").write_text("standard:\n  batch_size: 8\n  text+: false\n  threshold: 0.5\na:\n  remove_mentions: true\n  threshold: [0.1, 0.2]\nb: {}\n")
    doc = D.load_options(str(tmp_path / "o.yaml"))
    a, b = O.merged("a", doc), O.merged("b", doc, {"window": 12})
    assert a.threshold == (0.1, 0.2) and a.remove_mentions and b.remove_mentions is None and b.threshold == (0.5,) and b.window == 12
    assert O.merged("sbert_nli_sts", doc).model == "sbert"
    assert O.cleaning(O.Options(model="use"))["ascii_only"] is False and O.cleaning(O.Options(model="w2v_gnews_en", lang="en"))["lower"] is False
    assert O.cleaning(O.Options(model="w2v_twitter_en", lang="en", remove_mentions=True)) == {"remove_mention": False, "ascii_only": False, "lower": False, "hashtag_split": True}
    assert O.cleaning(O.Options(model="w2v_afp_fr"))["ascii_only"]


def test_index_is_consecutive(spark):
    rows = with_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(5), "id")
    assert rows.where("id <> idx").count() == 0 and rows.count() == 1000
    assert with_index(spark.range(0), "id").count() == 0


def test_cluster_run(spark):
    words = ["red fox", "red fox", "blue sky", "green tea", "red fox jumps", "blue sky"]
    rows = [(k, w, "20200101", float(len(w))) for k, w in enumerate(words * 4)]
    docs = spark.createDataFrame(rows, "idx long, text string, date string, label double")
    found, scores = runs.cluster(docs, O.Options(min_df=0, batch_size=2, threshold=(0.5, 0.7)))
    assert found.count() == 48 and scores.count() == 2 and scores.where("ari > 0.5").count() == 2
    found, scores = runs.cluster(docs.drop("label"), O.Options(model="sbert", batch_size=2), learning.hashing_encoder)
    assert scores is None and found.count() == 24


def test_cached_features(spark, tmp_path):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "aa cc")], "idx long, text string")
    options = O.Options(min_df=0)
    for _ in range(2):
        features, sparse = runs.cached_features(docs, options, str(tmp_path))
        assert sparse and features.count() == 4
    calls = []

    def provider():
        calls.append(1)
        return learning.hashing_encoder()

    for annotation in ("examined", "annotated"):
        one = docs.where("idx = 1") if annotation == "annotated" else docs
        found, sparse = runs.cached_features(one, O.Options(model="sbert", annotation=annotation), str(tmp_path), provider=provider)
        assert not sparse and found.count() == one.count()


def test_score_pairs(spark):
    pairs = spark.createDataFrame([("a b", "a b", 5.0), ("a b", "c d", 0.0), ("a b", "a b", 4.0)], "1_text string, 2_text string, Moyenne double")
    got = runs.score_pairs(pairs, learning.hashing_encoder).orderBy("Moyenne").collect()
    assert [round(r.cosine, 9) for r in got][1:] == [0.0, 0.0] and got[0].cosine > 0.3 and len(got) == 3


def test_learning(spark):
    rows = spark.range(400).select(F.col("id").alias("idx"), (F.col("id") % 2).cast("string").alias("label"), F.array(F.col("id") % 2 * 1.0, F.rand(1) * 0.1).alias("vec"))
    assert learning.kernel_classifier(rows, 3, 20).where("label = prediction").count() > 150
    halves = learning.exact_half_split(rows, 5).groupBy("train").count().collect()
    assert abs(halves[0]["count"] - halves[1]["count"]) <= 64
    a, b = learning.share_split(rows, 0.8, 1)
    assert a.count() + b.count() == 400
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert [r.generated for r in learning.generate(texts, lambda: lambda xs: [x.upper() for x in xs]).orderBy("doc_id").collect()] == ["ABC", ""]
    scores, summary = runs.classify(rows, seeds=(1, 2))
    assert scores.count() == 2 and summary.first()["mean"] > 0.8
