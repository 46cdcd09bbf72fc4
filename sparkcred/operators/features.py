"""Text features in long form (key, term, weight): TF-IDF, chi-square, naive-Bayes ratios, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.operators.ranking import ranked
from sparkcred.session import cut, maybe_broadcast


def term_counts(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf) of an array column of terms; documents without terms give no rows."""
    return docs.select(F.col(key).alias("key"), F.explode(terms).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def word_ngrams(tokens, n_max: int = 2, stopwords: tuple[str, ...] = ()):
    """Word n-grams of a token array; stop words are removed before the n-grams are made."""
    t = F.filter(tokens, lambda w: ~w.isin(*stopwords)) if stopwords else tokens

    def grams(n: int):
        # shifted copies put together: the tokens are made once a copy and not once a n-gram
        size = F.greatest(F.size(t) - n + 1, F.lit(0))
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), [F.slice(t, F.lit(k), size) for k in range(1, n + 1)])

    return F.concat(t, *[grams(n) for n in range(2, n_max + 1)])


def char_wb(text, n_min: int = 2, n_max: int = 4):
    """Character n-grams inside words padded by a blank; a word no longer than n is taken once and ends there."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(w, n: int):
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        # n-grams go on as long as the word is longer than the n before
        return F.when((F.length(w) >= n) | (F.lit(n) == n_min) | (F.length(w) > n - 1), some).otherwise(F.array().cast("array<string>"))

    def grams(w):
        return F.flatten(F.array(*[sized(w, n) for n in range(n_min, n_max + 1)]))

    return F.flatten(F.transform(padded, grams))


def document_frequencies(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, cf, idf) of the vocabulary; with ``max_features`` the terms with the highest counts, ties by term."""
    vocab = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_features)
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)


def tfidf(docs: DataFrame, key: str, terms: str, sublinear: bool = True, fit_on: DataFrame | None = None, **limits) -> DataFrame:
    """(key, term, weight), rows L2-normalised; idf = ln((1+n)/(1+df)) + 1, fitted on ``fit_on`` where given."""
    base = docs if fit_on is None else fit_on
    counts = cut(term_counts(docs, key, terms))  # read for the vocabulary, the norms and the weights
    fitted = counts if fit_on is None else term_counts(fit_on, key, terms)
    vocab = document_frequencies(fitted, base.count(), **limits)
    tf = (F.log(F.col("tf")) + 1) if sublinear else F.col("tf")
    vocab = cut(vocab.select("term", "idf"))
    raw = counts.join(maybe_broadcast(vocab, vocab.count(), 500_000), "term").select("key", "term", (tf * F.col("idf")).alias("w"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("weight"))


def mean_tfidf(weights: DataFrame, n_docs: int) -> DataFrame:
    """(term, mean_weight) over all documents, those without the term included."""
    return weights.groupBy("term").agg((F.sum("weight") / n_docs).alias("mean_weight"))


def class_sums(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, w0, w1): feature mass of each label; labels other than 0 and 1 are left out."""
    one = lambda v: F.sum(F.when(F.col("label") == v, F.col("weight")).otherwise(0.0))
    return weights.join(labels.filter("label in (0, 1)").select(F.col("key"), "label"), "key").groupBy("term").agg(one(0).alias("w0"), one(1).alias("w1"))


def chi2(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, chi2) of observed against expected feature mass per class."""
    share = labels.filter("label in (0, 1)").agg(F.avg(F.col("label").cast("double")).alias("p1"))
    s = class_sums(weights, labels).crossJoin(F.broadcast(share))  # one row
    total = F.col("w0") + F.col("w1")
    part = lambda o, p: F.when(p * total > 0, (o - p * total) * (o - p * total) / (p * total)).otherwise(0.0)
    return s.select("term", (part(F.col("w0"), 1 - F.col("p1")) + part(F.col("w1"), F.col("p1"))).alias("chi2"))


def top_terms(scores: DataFrame, column: str, k: int) -> DataFrame:
    """The k highest terms, ties by term."""
    return scores.orderBy(F.desc(column), "term").limit(k)


def nb_ratio(weights: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(term, ratio): ln of the smoothed share of each term in class 1 over that in class 0."""
    s = class_sums(weights, labels).withColumns({"p": F.col("w1") + alpha, "q": F.col("w0") + alpha})
    total = s.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    return s.crossJoin(F.broadcast(total)).select("term", F.log((F.col("p") / F.col("sp")) / (F.col("q") / F.col("sq"))).alias("ratio"))  # one row


def scaled(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns minus mean over population deviation (1 where that is 0), fitted on ``fit_on``."""
    base = df if fit_on is None else fit_on
    stats = base.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    safe = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / safe(c) for c in columns}).drop(*[f"_{x}_{c}" for x in "ms" for c in columns])


def vectors(weights: DataFrame, max_terms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, features), (term, index)): one sparse vector per document; the index follows the terms' order."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    index = ranked(weights.select("term").distinct(), ["term"], name="index").select("term", (F.col("index") - 1).cast("int").alias("index"))
    index = cut(index)
    size = index.count()
    # the vector type has neither a JVM constructor for sparse values nor an Arrow form
    to_sparse = F.udf(lambda pairs: SparseVector(size, [(int(p["index"]), float(p["weight"])) for p in pairs]), VectorUDT())
    packed = weights.join(maybe_broadcast(index, size), "term").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("p"))
    return packed.select("key", to_sparse("p").alias("features")), index
