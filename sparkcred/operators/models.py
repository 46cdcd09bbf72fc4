"""Classifiers over sparse term vectors, through MLlib, and their search."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import Binarizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.operators import etl, evaluate, features
from sparkcred.session import cut


def training_rows(docs: DataFrame, key: str, tokens: str, label: str, k: int = 15_000, meta: list[str] | None = None) -> DataFrame:
    """(key, label, split, fold, features): TF-IDF of the terms with the highest chi-square, and the ``meta`` columns.

    The vocabulary, the weights' frequencies, the selection and the scale of the meta columns (to 0..1) are
    fitted on the training part alone.
    """
    meta = meta or []
    base = docs.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(tokens).alias("tokens"), *meta)
    base = cut(etl.kfold(etl.stratified_split(base, {"train": 0.8, "test": 0.2}, "key"), 3, "key"))
    train = base.filter("split = 'train'")
    weights = features.tfidf(base, "key", "tokens", fit_on=train, min_df=2)
    weights = cut(weights)
    top = features.top_terms(features.chi2(weights.join(train.select("key"), "key", "left_semi"), train), "chi2", k)
    vectors, _ = features.vectors(weights.join(F.broadcast(top.select("term")), "term", "left_semi"))  # k terms
    rows = base.drop("tokens").join(vectors, "key")
    if not meta:
        return rows
    reach = train.agg(*[F.max(c).alias(f"_{c}") for c in meta])
    scaled = rows.crossJoin(F.broadcast(reach))  # one row
    scaled = scaled.withColumns({c: F.least(F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0)), F.lit(1.0)) for c in meta})
    both = VectorAssembler(inputCols=["features", *meta], outputCol="_all").transform(scaled)
    return both.select("key", "label", "split", "fold", F.col("_all").alias("features"))


def balanced(rows: DataFrame) -> DataFrame:
    """Rows with ``weight``: n / (2 n of the class)."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    return rows.join(F.broadcast(n.crossJoin(total)), "label").withColumn("weight", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")  # two rows


def estimators(n_rows: int, c: float = 1.0) -> dict:
    """The classifiers by name; ``c`` is the inverse regularisation of the whole data."""
    reg = 1 / (c * max(1, n_rows))
    return {
        "lr_l1": LogisticRegression(elasticNetParam=1.0, regParam=reg, standardization=False, maxIter=60),
        "lr_l2": LogisticRegression(elasticNetParam=0.0, regParam=reg, standardization=False, maxIter=60),
        "nb_multinomial": NaiveBayes(modelType="multinomial", smoothing=0.5),
        "nb_complement": NaiveBayes(modelType="complement", smoothing=0.5),
        "nb_bernoulli": Pipeline(stages=[Binarizer(inputCol="features", outputCol="there"), NaiveBayes(modelType="bernoulli", smoothing=0.5, featuresCol="there")]),
        "linear_svc": LinearSVC(regParam=reg, weightCol="weight", standardization=False, maxIter=40),
        "gbt": GBTClassifier(maxDepth=4, maxIter=12, stepSize=0.2, subsamplingRate=0.8, validationIndicatorCol="held", seed=42),
    }


def of_point(p: dict, n_rows: int):
    """The classifier of a point of a search: family, kind, and smoothing or inverse regularisation."""
    if p["family"] == "lr":
        return LogisticRegression(elasticNetParam=float(p["kind"] == "l1"), regParam=1 / (p["strength"] * max(1, n_rows)), standardization=False, maxIter=60)
    binary = p["kind"] == "bernoulli"
    nb = NaiveBayes(modelType=p["kind"], smoothing=p["strength"], featuresCol="there" if binary else "features")
    return Pipeline(stages=[Binarizer(inputCol="features", outputCol="there"), nb]) if binary else nb


def scores(model: Model, rows: DataFrame) -> DataFrame:
    """(key, label, split, score): probability of class 1, or the margin where there is none."""
    out = model.transform(rows)
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select("key", "label", "split", score.alias("score"))


def evaluated(rows: DataFrame, name: str, c: float = 1.0) -> DataFrame:
    """Metrics on the test part of a classifier fitted on the training part.

    The threshold of the margin classifier is chosen on the first fold of the training part, never on the test part.
    """
    rows = cut(balanced(rows).withColumn("held", F.col("fold") == 0))
    train = rows.filter("split = 'train'")
    model = estimators(train.count(), c)[name].fit(train)
    found = scores(model, rows).withColumn("model", F.lit(name))
    threshold = 0.5
    if name == "linear_svc":
        grid = [round(-0.5 + 0.02 * i, 2) for i in range(51)]
        held = scores(model, train.filter("held")).withColumn("model", F.lit(name))
        threshold = evaluate.best(evaluate.sweep(held, grid, strict=True)).first()["threshold"]
    test = evaluate.predicted(found.filter("split = 'test'"), threshold, strict=name == "linear_svc")
    return evaluate.metrics(evaluate.confusion(test, ["model"]), ["model"])


def grid(space: dict[str, list], valid=lambda p: True, first: list[dict] | None = None) -> list[dict]:
    """All valid combinations, recommended ones first, each once."""
    every = [dict(zip(space, v)) for v in product(*space.values())]
    out: list[dict] = []
    for p in [*(first or []), *every]:
        if valid(p) and p not in out:
            out.append(p)
    return out


def search(rows: DataFrame, make, points: list[dict]) -> tuple[dict, float, list[tuple[dict, float | None]]]:
    """(best point, its macro F1, log): mean F1 over the folds; a point that fails is logged and skipped."""
    rows = cut(rows)
    log: list[tuple[dict, float | None]] = []
    for p in points:
        try:
            got = []
            for k in range(3):
                model = make(p).fit(rows.filter(F.col("fold") != k))
                held = evaluate.predicted(scores(model, rows.filter(F.col("fold") == k)).withColumn("model", F.lit("m")))
                got.append(evaluate.metrics(evaluate.confusion(held, ["model"]), ["model"]).first()["macro_f1"])
            log.append((p, sum(got) / len(got)))
        except Exception:  # noqa: BLE001  a failed point must not end the search
            log.append((p, None))
    done = [(f, i) for i, (_, f) in enumerate(log) if f is not None]
    if not done:
        return {}, 0.0, log
    f, i = max(done, key=lambda x: (x[0], -x[1]))
    return log[i][0], f, log
