"""Saved classifiers: fit once, store, load by language, score batches and streams alike."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L
from sparkcred.functions import text as T
from sparkcred.operators import features
from sparkcred.sources.sinks import _fs

META = ("emo_count", "emo_ratio", "quote_count", "quote_ratio", "ellipsis_count", "ellipsis_ratio", "excl_count", "excl_ratio", "quest_count", "quest_ratio", "title_len", "content_len")
#: The language whose model stands in where a language has none.
FALLBACK = "korean"


def feature_rows(df: DataFrame, n_max: int = 2) -> DataFrame:
    """Rows with what the models read: ``terms`` (word n-grams), ``meta`` and ``language``; null texts are empty ones."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    meta = [F.log1p(c.cast("double")).alias(n) for c, n in zip(T.meta_features("title", "content"), META)]
    return df.withColumns({"_text": text}).select("*", features.word_ngrams(T.tokens("_text"), n_max, L.STOPWORDS).alias("terms"), F.struct(*meta).alias("meta"), T.detect_language("_text").alias("language")).drop("_text")


def assembled(rows: DataFrame, flags: bool = False) -> DataFrame:
    """Rows with the parts the assembler joins to one vector beside the text: twelve meta columns, and flags where wanted."""
    return rows.select("*", *[F.col(f"meta.{c}").alias(f"m_{c}") for c in META], *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f_{f}") for f in L.FLAGS if flags])


def fit(rows: DataFrame, flags: bool = False, max_features: int = 60_000, min_df: int = 3, c: float = 1.0, l1: bool = False) -> PipelineModel:
    """Text, meta features and flags in one vector, and a logistic regression on it; every step works on single rows, so it also scores streams.

    ``rows`` come from ``feature_rows`` with a label of 0 or 1; vocabulary and frequencies are fitted on them.
    """
    train = assembled(rows.filter("label in (0, 1)"), flags).withColumn("label", F.col("label").cast("double"))
    more = [f"m_{c}" for c in META] + [f"f_{f}" for f in L.FLAGS if flags]
    stages = [
        CountVectorizer(inputCol="terms", outputCol="tf", minDF=float(min_df), vocabSize=max_features), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="text_vector"),
        VectorAssembler(inputCols=["text_vector", *more], outputCol="features", handleInvalid="keep"),
        LogisticRegression(elasticNetParam=float(l1), regParam=1 / (c * max(1, train.count())), maxIter=30, standardization=False),
    ]
    return Pipeline(stages=stages).fit(train)


def save(model: PipelineModel, folder: str, language: str, version: str, **facts) -> None:
    """Store a model as ``folder/language/version`` with its facts beside it; the same name is replaced."""
    spark = SparkSession.active()
    at = f"{folder}/{language}/{version}"
    model.write().overwrite().save(f"{at}/model")
    spark.createDataFrame([(version, json.dumps(facts, sort_keys=True))], "version string, facts string").coalesce(1).write.mode("overwrite").parquet(f"{at}/facts")


def load(spark: SparkSession, folder: str, language: str, versions: list[str] | None = None) -> PipelineModel | None:
    """The first of the versions that is there, the newest by name if none is asked for; None where there is none."""
    fs, p, jvm = _fs(spark, f"{folder}/{language}")
    if not fs.exists(p):
        return None
    have = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True)
    # a version counts once its facts, which are written last, are complete
    done = [v for v in have if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{language}/{v}/facts/_SUCCESS"))]
    for v in done if versions is None else [v for v in versions if v in done]:
        return PipelineModel.load(f"{folder}/{language}/{v}/model")
    return None


def scored(df: DataFrame, models: dict[str, PipelineModel | None], flags: bool = False) -> DataFrame:
    """Rows with ``fake_score`` (0 to 100) and ``predicted_label``: each language by its own model, by the fallback's where it has none.

    Where neither is there, both are null. Batches and streams give the same scores.
    """
    rows = assembled(feature_rows(df.drop("fake_score", "predicted_label", "terms", "meta", "language")), flags)
    keep = [c for c in df.columns if c not in ("fake_score", "predicted_label", "terms", "meta", "language")]
    by_model: dict[int, tuple[PipelineModel | None, list[str]]] = {}
    for language in ("korean", "english"):
        model = models.get(language) or models.get(FALLBACK)
        by_model.setdefault(id(model), (model, []))[1].append(language)
    parts = []
    for model, languages in by_model.values():
        own = rows.filter(F.col("language").isin(languages)) if len(by_model) > 1 else rows
        if model is None:
            parts.append(own.select(*keep, F.lit(None).cast("double").alias("fake_score"), F.lit(None).cast("int").alias("predicted_label")))
        else:
            p = vector_to_array("probability")[1]
            parts.append(model.transform(own).select(*keep, F.bround(p * 100, 1).alias("fake_score"), (p >= 0.5).cast("int").alias("predicted_label")))
    return reduce(DataFrame.unionByName, parts)


def coefficients(model: PipelineModel, n: int = 15) -> DataFrame:
    """(side, term, coefficient): the terms with the ``n`` highest positive and lowest negative coefficients."""
    vocabulary, weights = model.stages[0].vocabulary, model.stages[-1].coefficients.toArray()[: len(model.stages[0].vocabulary)]
    terms = SparkSession.active().createDataFrame(list(zip(vocabulary, weights.tolist())), "term string, coefficient double")
    return top_signed(terms, "coefficient", n)


def top_signed(terms: DataFrame, column: str, n: int) -> DataFrame:
    """(side, term, ...): the ``n`` highest above 0 and the ``n`` lowest below it, ties by term."""
    c = F.col(column)
    high = terms.filter(c > 0).orderBy(c.desc(), "term").limit(n).select(F.lit("positive").alias("side"), "*")
    return high.unionByName(terms.filter(c < 0).orderBy(c, "term").limit(n).select(F.lit("negative").alias("side"), "*"))
