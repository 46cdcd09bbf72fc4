import math

import pytest

from sparkcred.functions import lexicons as L
from sparkcred.operators import evaluate, features

SCORES = "key string, label int, model string, score double"


@pytest.mark.parametrize(
    "cells, f1, acc",
    [
        ((22034, 8867, 8562, 24184), 0.7258, 0.7262), ((1949, 964, 845, 2242), 0.6978, 0.6985), ((21895, 9006, 9410, 23336), 0.7105, 0.7107),
        ((18710, 12191, 11495, 21251), 0.6273, 0.6279), ((10636, 4815, 4521, 11852), 0.7062, 0.7066), ((18299, 12602, 1121, 31625), 0.7745, 0.7844), ((18185, 12716, 1006, 31740), 0.7742, 0.7844),
    ],
)
def test_metrics(spark, cells, f1, acc):
    m = evaluate.metrics(spark.createDataFrame([("m", *cells)], "model string, tn long, fp long, fn long, tp long"), ["model"]).first()
    assert m.macro_f1 == pytest.approx(f1, abs=5e-5) and m.accuracy == pytest.approx(acc, abs=5e-5)


def test_auc_with_ties(spark):
    rows = [(str(i), y, "m", s) for i, (y, s) in enumerate(zip([0, 0, 1, 1, 1], [0.1, 0.5, 0.5, 0.8, 0.4]))]
    assert evaluate.roc_auc(spark.createDataFrame(rows, SCORES)).first().auc == 0.75
    assert evaluate.roc_auc(spark.createDataFrame([("1", 1, "m", 0.4)], SCORES)).first().auc is None


def test_vote(spark):
    rows = [("a", 1, "logistic", 0.8), ("a", 1, "nb", 0.4), ("a", 1, "nbsvm", 0.6), ("b", 0, "logistic", 0.8), ("b", 0, "nbsvm", 0.6), ("b", 0, "other", 0.0)]
    got = {r.key: r.score for r in evaluate.soft_vote(spark.createDataFrame(rows, SCORES)).collect()}
    assert got["a"] == pytest.approx(0.608047, abs=1e-6) and got["b"] == pytest.approx(0.698639, abs=1e-6)


def test_threshold_strictness(spark):
    df = spark.createDataFrame([("a", 1, "m", 0.5)], SCORES)
    assert evaluate.predicted(df, 0.5).first().pred == 1 and evaluate.predicted(df, 0.5, True).first().pred == 0
    rows = [("a", 1, "m", 0.5), ("b", 0, "m", 0.3), ("c", 1, "m", 0.2)]
    swept = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.sweep(spark.createDataFrame(rows, SCORES), [0.5, 0.25]).collect()}
    assert swept == {0.25: (1, 1, 1, 0), 0.5: (1, 0, 1, 1)}


def test_nulls_and_repeats(spark):
    rows = [("a", 1, None, 0.5), ("a", None, "m", 0.5), ("a", 1, "m", None), ("a", 1, "m", 0.5), ("a", 1, "m", 0.5)]
    assert evaluate.rated(spark.createDataFrame(rows, SCORES)).count() == 1


def test_flag_slices(spark):
    cols = "model string, label int, pred int, " + ", ".join(f"{f} int" for f in L.FLAGS)
    rows = [("m", 1, 1, 1, 0, 0, 0, 0), ("m", 0, 1, 1, 0, 0, 0, 0), ("m", 1, 0, 1, None, 0, 0, 0)]
    got = evaluate.flag_slices(spark.createDataFrame(rows, cols)).collect()
    assert len(got) == 1 and (got[0].flagged_positive_rate, got[0].flagged_recall) == (0.666667, 0.5)


def docs(spark):
    return spark.createDataFrame([(0, ["aa", "bb", "aa"], 1), (1, ["bb", "cc"], 0)], "key long, terms array<string>, label int")


def test_tfidf(spark):
    got = {(r.key, r.term): r.weight for r in features.tfidf(docs(spark), "key", "terms").collect()}
    want = {(0, "aa"): 0.921907, (0, "bb"): 0.387411, (1, "bb"): 0.579739, (1, "cc"): 0.814802}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_chi2_and_ratio(spark):
    counts = features.term_counts(docs(spark), "key", "terms").withColumnRenamed("tf", "weight")
    chi = {r.term: r.chi2 for r in features.chi2(counts, docs(spark)).collect()}
    assert chi == {"aa": 2.0, "bb": 0.0, "cc": 1.0}
    ratio = {r.term: round(r.ratio, 6) for r in features.nb_ratio(counts, docs(spark)).collect()}
    assert ratio == {"aa": 0.916291, "bb": -0.182322, "cc": -0.875469}


def test_word_and_char_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "ab c")], "t array<string>, x string")
    r = df.select(features.word_ngrams(features.F.col("t"), 2, ("b",)).alias("w"), features.char_wb(features.F.col("x")).alias("c")).first()
    assert r.w == ["a", "c", "a c"]
    assert sorted(r.c) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def test_vectors_and_scaling(spark):
    vec, index = features.vectors(features.tfidf(docs(spark), "key", "terms"))
    assert {r.term: r["index"] for r in index.collect()} == {"aa": 0, "bb": 1, "cc": 2}
    assert vec.filter("key = 0").first().features.indices.tolist() == [0, 1]
    s = features.scaled(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted(r.a for r in s) == [-1.0, 1.0] and {r.b for r in s} == {0.0}
    assert math.isclose(features.term_counts(spark.createDataFrame([], "key long, terms array<string>"), "key", "terms").count(), 0)
