import datetime

import pytest
from pyspark.sql import functions as F

from storyweft.functions import text as T
from storyweft.functions import vectors as V


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


CASES = [
    ("see http://t.co/x now", "see  now"),
    ("mail foo@bar.com", "mail foo"),
    ("c'est", "c est"),
    ("1234 12345 12345,", "1234 12345,"),
    ("#FollowFriday (#FollowFriday", "follow friday (#followfriday"),
    ("#FollowFridayNOWThen", "follow friday now then"),
    ("looooool", "loool"),
    ("LOooo", "loooo"),
    ("a\nb", "ab"),
    (None, ""),
    ("", ""),
    ("Straße l’été œuvre", "strasse l ete oeuvre"),
]


@pytest.mark.parametrize("given, wanted", CASES)
def test_format_text(spark, given, wanted):
    assert one(spark, lambda c: T.format_text(c, remove_mention=True), given) == wanted


def test_hashtag_kept_without_split(spark):
    assert one(spark, lambda c: T.format_text(c, hashtag_split=False), "#AbCd") == "#abcd"


def test_tokens(spark):
    assert one(spark, T.lower_tokens, "A bc d_e été 12 x") == ["bc", "d_e", "été", "12"]
    assert one(spark, T.white_split, "  a \t b ") == ["a", "b"]
    assert one(spark, T.white_split, "  ") == []


def test_social_tokens(spark):
    assert one(spark, lambda c: T.social_tokens(c, ("the",)), "The @user said &amp; #BigNews été") == ["@user", "said", "big", "news", "ete"]


def test_dates(spark):
    wanted = datetime.datetime(2018, 7, 16, 5, 0, 56)
    for given in ("Mon Jul 16 05:00:56 +0000 2018", "2018-07-16 05:00:56"):
        assert one(spark, lambda c: F.date_format(T.parse_created_at(c), "yyyy-MM-dd HH:mm:ss"), given) == str(wanted)
    assert one(spark, T.parse_created_at, "yesterday") is None
    assert one(spark, T.parse_created_at, None) is None


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = rows.select(V.cosine_distance(F.col("a"), F.col("b")).alias("d"), V.cosine_distance(F.col("a"), F.col("z")).alias("e"), V.unit(F.col("z")).alias("u"), V.is_zero(F.col("z")).alias("q")).first()
    assert abs(got.d - 0.04) < 1e-12 and got.e == 1.0 and got.u == [0.0, 0.0] and got.q


def test_transliterate_keeps_every_row(spark, tmp_path):
    import unicodedata

    from storyweft.functions import text as T
    from storyweft.plans import catalogue

    texts = [None, "", "caf\u00e9", "\u201cquoted\u201d \u2014 \u20ac5\u2026", "\u043f\u0440\u0438\u0432\u0435\u0442 ok", "\u4e2d\u6587 a", "\U0001f600!", "stra\u00dfe \u00e6"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(c):
        known = {**T.single_letters(), **T.SEVERAL}
        base = known.get(c, unicodedata.normalize("NFD", c)[0])
        return base if base.isascii() else ""

    wanted = {k: None if t is None else "".join(map(plain, t)) for k, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in catalogue.transliterate(spark, str(tmp_path)).collect()} == wanted


def test_other_scripts_become_ascii(spark):
    assert one(spark, T.to_ascii, "\u041f\u0440\u0438\u0432\u0435\u0442, \u0449\u0443\u043a\u0430 \u0439\u043e\u0434") == "Privet, shchuka iod"
    assert one(spark, T.to_ascii, "\u039a\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1 \u03c8\u03c5\u03c7\u03ae") == "Kalemera psukhe"
    assert one(spark, T.to_ascii, "\u4e2d caf\u00e9") == " cafe"
