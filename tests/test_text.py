import pytest
from pyspark.sql import functions as F

from sparkcred.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, spaced, compact",
    [
        ("<b>충격!</b> 100% Always", "충격 100 always", "b충격b 100 always"),
        ("A&amp;B x", "a amp b x", None),
        ("Shocking:NEVER-again", "shocking never again", "shockingneveragain"),
        ("   ", "", "   "),
        (None, "", ""),
    ],
)
def test_clean(spark, value, spaced, compact):
    assert one(spark, value, T.clean_text("x")) == spaced
    if compact is not None:
        assert one(spark, value, T.clean_text_compact("x")) == compact


def test_flags(spark):
    lex = T.L.ETL_LEXICON
    rows = spark.createDataFrame([("100 sure",), ("nevertheless",), ("Shocking",), (None,)], "x string")
    got = [tuple(r) for r in rows.select(*T.flags("x", lex)).collect()]
    assert got[0] == (0, 0, 0, 0, 0)  # the % is gone from cleaned text
    assert got[1][0] == 1  # substring, not word
    assert got[2][2] == 1 and got[3] == (0,) * 5
    assert one(spark, "Shocking", T.flags("x", T.L.FACTCHECK_LEXICON, True)[2]) == 0
    assert one(spark, "shocking", T.flags("x", T.L.FACTCHECK_LEXICON, True)[2]) == 1
    # one alternation and a scan per keyword agree
    for words in lex.values():
        for w in words:
            assert one(spark, f"a {w} b", F.col("x").rlike("(?i)" + T.keyword_regex(words)))


@pytest.mark.parametrize("raw", ["March 5, 2017", "Mar 5, 2017", "2017-03-05", "3/5/2017", "march 5, 2017"])
def test_dates(spark, raw):
    assert one(spark, raw, T.parse_date("x")) == "2017-03-05"


@pytest.mark.parametrize("raw, want", [("sometime in 2016", "2016-01-01"), ("", ""), (None, "")])
def test_odd_dates(spark, raw, want):
    assert one(spark, raw, T.parse_date("x")) == want


def test_language(spark):
    assert [one(spark, x, T.detect_language("x")) for x in ("nine char", "abcdefghi가", "abcdefgh가나", "")] == ["korean", "english", "korean", "korean"]


def test_trigrams_and_jaccard(spark):
    assert one(spark, "가나", T.trigrams("x")) == ["가나"] and one(spark, "!!", T.trigrams("x")) == []
    pair = spark.createDataFrame([([], [], ["a"])], "a array<string>, b array<string>, c array<string>")
    r = pair.select(T.jaccard(F.col("a"), F.col("b")).alias("e"), T.jaccard(F.col("a"), F.col("c")).alias("o")).first()
    assert (r.e, r.o) == (1.0, 0.0)


@pytest.mark.parametrize(
    "raw, want", [("오후 1:05", (1, 785)), ("오후 12:30", (1, 750)), ("오전 12:30", (1, 750)), ("9:10", (1, 550)), ("2026.06.08", (0, 20260608)), ("x", (0, 0)), (None, (0, 0))]
)
def test_time(spark, raw, want):
    k, v = T.time_key("x")
    assert (one(spark, raw, k), one(spark, raw, v)) == want


@pytest.mark.parametrize(
    "raw, want", [("판정: 대체로 사실 아님", ("대체로 사실 아님", 1)), ("this is mostly false", ("false", 1)), ("사실입니다", ("사실입니다", 0)), ("abc", ("", -1)), (None, ("", -1))]
)
def test_verdict(spark, raw, want):
    v, label = T.verdict("x")
    assert (one(spark, raw, v), one(spark, raw, label)) == want


def test_meta_of_nulls(spark):
    r = spark.createDataFrame([(None, None)], "t string, c string").select(*T.meta_features("t", "c")).first()
    assert set(r.asDict().values()) == {0, 0.0}
