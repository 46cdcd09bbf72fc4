import random

from pyspark.ml.classification import NaiveBayes

from sparkcred.operators import models


def test_grid_keeps_order_and_validity():
    got = models.grid({"a": [1, 2], "b": ["x", "y"]}, lambda p: not (p["a"] == 2 and p["b"] == "x"), [{"a": 2, "b": "y"}])
    assert got == [{"a": 2, "b": "y"}, {"a": 1, "b": "x"}, {"a": 1, "b": "y"}]


def test_training_search_and_metrics(spark):
    rng = random.Random(1)
    rows = []
    for i in range(90):
        y = i % 2
        words = [rng.choice(["alpha", "beta", "gamma"] if y else ["delta", "eps", "zeta"]) for _ in range(8)] + [rng.choice(["both", "same"]) for _ in range(3)]
        rows.append((i, words, y))
    rows.append((99, None, 1))
    rows.append((98, ["alpha"], None))
    table = models.training_rows(spark.createDataFrame(rows, "id long, tokens array<string>, label int"), "id", "tokens", "label", 20).cache()
    assert table.count() == 90 and {r.split for r in table.select("split").distinct().collect()} == {"train", "test"}
    m = models.evaluated(table, "nb_multinomial").first()
    assert m.macro_f1 > 0.9 and m.tn + m.fp + m.fn + m.tp == table.filter("split = 'test'").count()
    point, f1, log = models.search(table.filter("split = 'train'"), lambda p: NaiveBayes(smoothing=p["s"]), [{"s": -1.0}, {"s": 0.5}])
    assert point == {"s": 0.5} and f1 > 0.9 and log[0][1] is None
