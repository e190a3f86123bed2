import datetime

import pytest
from pyspark.sql import functions as F

from evigraph.functions import normalize as N
from evigraph.functions import similarity as S
from evigraph.runtime import spread_join

NORMALIZED = [
    (N.norm_text, "  Ça  va\tÉTÉ ", "ca va ete"), (N.norm_text, "Straße ﬁn", "strasse fin"), (N.norm_text, None, ""),
    (N.norm_name, "Dr. José O'Brien-Smith Jr.", "jose o'brien-smith"), (N.norm_name, "Bob Smith", "robert smith"), (N.norm_name, "Henry V", "henry"),
    (N.norm_org, "The Acme Co., S.A.", "acme"), (N.norm_org, "Meridian Holdings Ltd", "meridian holdings"), (N.norm_org, "Limited", "limited"),
    (N.norm_email, "J.Doe+spam@GoogleMail.com", "jdoe@gmail.com"), (N.norm_email, "A.B+c@x.org", "a.b@x.org"), (N.norm_email, "+x@gmail.com", ""), (N.norm_email, "plain", "plain"),
    (N.norm_phone, "+1 (212) 555-0199", "2125550199"), (N.norm_phone, "12-34", "1234"), (N.norm_phone, None, ""),
    (N.norm_id, "AB-12 34/x", "ab1234x"), (N.norm_address, "12 Main St., Apt 4 N", "12 main street apartment 4 north"),
    (N.soundex, "Robert", "R163"), (N.soundex, "Rupert", "R163"), (N.soundex, "Ashcraft", "A261"), (N.soundex, "Tymczak", "T522"), (N.soundex, "123", ""),
]
DATES = [("1974-03-08", "1974-03-08"), ("08/03/1974", "1974-03-08"), ("12/25/1999", "1999-12-25"), ("8 Mar 1974", "1974-03-08"), ("March 8, 1974", "1974-03-08"), ("19740308", "1974-03-08"), ("1974/03/08", "1974-03-08"), ("31/02/2000", None), ("08/03/74", None), ("1974-03-08 x", None), ("", None)]


def test_normalizers(spark):
    for function, raw, want in NORMALIZED:
        row = spark.createDataFrame([(raw,)], "x string").select(function(F.col("x")).alias("y")).first()
        assert row.y == want, (function.__name__, raw, row.y)


def test_dates(spark):
    rows = spark.createDataFrame(DATES, "x string, want string").select("x", N.norm_date(F.col("x")).alias("d"), "want").collect()
    assert [(r.x, r.d) for r in rows] == [(r.x, r.want and datetime.date.fromisoformat(r.want)) for r in rows]


def test_registration(spark):
    N.register_normalizer("shout", lambda c: F.upper(c))
    S.register_comparator("shout", lambda a, b: (F.length(a) == F.length(b)).cast("double"))
    row = spark.createDataFrame([("ab", "cd")], "a string, b string").select(N.normalize("shout", F.col("a")).alias("n"), S.compare("shout", F.col("a"), F.col("b")).alias("s"), N.normalize("never heard of", F.lit(" É ")).alias("t")).first()
    assert (row.n, row.s, row.t) == ("AB", 1.0, "e")
    many = spark.range(1).select(N.normalize_all("phone", F.array(F.lit("+1 212 555 0199"), F.lit("none"))).alias("p")).first()
    assert many.p == ["2125550199"]


@pytest.mark.parametrize(("function", "a", "b", "want"), [
    (S.jaro_winkler_value, "martha", "marhta", 0.9611), (S.jaro_winkler_value, "dwayne", "duane", 0.84), (S.jaro_value, "dixon", "dicksonx", 0.7667), (S.jaro_value, "", "", 0.0), (S.jaro_value, "abc", "xyz", 0.0),
    (S.name_value, "robert j whitlock", "robert whitlock", 0.95), (S.name_value, "smith john", "john smith", 1.0), (S.name_value, "j smith", "john smith", 0.95),
    (S.org_value, "meridian holdings", "meridian", 0.5), (S.org_value, "acme", "acme", 1.0), (S.org_value, "", "x", 0.0),
])
def test_word_similarity(function, a, b, want):
    assert function(a, b) == pytest.approx(want, abs=1e-4) and function(b, a) == pytest.approx(want, abs=1e-4)


def test_column_similarity(spark):
    d = lambda x: F.lit(x).cast("date")
    row = spark.range(1).select(
        S.edit_ratio(F.lit("kitten"), F.lit("sitting")), S.edit_ratio(F.lit(""), F.lit("")), S.token_jaccard(F.lit("a b c"), F.lit("b c d")), S.token_jaccard(F.lit(""), F.lit("a")),
        S.date_similarity(d("2000-03-08"), d("2000-08-03")), S.date_similarity(d("2000-03-08"), d("2000-03-10")), S.date_similarity(d("2000-01-01"), d("2000-03-01")), S.date_similarity(d("2000-01-01"), d("2010-01-01")), S.date_similarity(d(None), d("2010-01-01")),
        S.exact(F.lit("a"), F.lit("a")), S.exact(F.lit(""), F.lit("")), S.numeric_similarity(F.lit(3.0), F.lit(3.5), 2.0), S.numeric_similarity(F.lit(3.0), F.lit(3.0), 0),
    ).first()
    assert list(row) == pytest.approx([1 - 3 / 7, 0, 0.5, 0, 0.92, 0.8, 0.525, 0, 0, 1, 0, 0.75, 1])


def test_spread_join_is_an_inner_join(spark):
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i, None if i % 7 == 0 else i) for i in range(300)], "k long, v long").cache()
    facts = rows.where("k % 5 < 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")).cache()
    want = sorted(map(tuple, rows.join(facts.drop("n"), "k").select("k", "v", "least").collect()), key=str)
    assert sorted(map(tuple, spread_join(rows, facts, ["k"], "n").select("k", "v", "least").collect()), key=str) == want
