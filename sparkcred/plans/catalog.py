"""Query catalogue: every operator on the tables of a data folder, and its DuckDB SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L
from sparkcred.functions import text as T
from sparkcred.operators import etl, evaluate, features, html, models, serving, views
from sparkcred.operators.ranking import with_ids
from sparkcred.plans import oracle
from sparkcred.session import cut, ensure_checkpoint_dir, table
from sparkcred.sources import readers, sinks
from sparkcred.streaming import feed

#: Parameters of the catalogue's queries.
SUBSET, FOLDS, TOP_TERMS, CHI2_TERMS, PAGE_NO, NOW = 60, 5, 50, 200, 2, "2024-02-01 00:00:00"
#: Terms of the classifiers, and of the search over many points.
MODEL_TERMS, SEARCH_TERMS = 15_000, 2_000
SWEEP = [round(0.25 + 0.05 * i, 2) for i in range(6)]


def _articles(s, d) -> DataFrame:
    return table(s, d, "articles")


def _news(s, d) -> DataFrame:
    return table(s, d, "realtime_news")


def _shared(spark: SparkSession, name: str) -> str:
    """A folder in the place all executors share."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), name)


def _prepared(s, d) -> DataFrame:
    """Articles with freshly cleaned text and flags."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return etl.with_flags(_articles(s, d).withColumn("clean_message", T.clean_text(text)))


def etl_flag_summary(s, d):
    ok = etl.filters()
    kept = _prepared(s, d).filter(ok["length"] & ok["special"] & ok["boilerplate"] & ok["foreign"])
    return kept.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in L.FLAGS])


def clean_text(s, d):
    return _prepared(s, d).select("id", "clean_message")


def clean_text_compact(s, d):
    return _news(s, d).select("id", T.clean_text_compact("content").alias("clean_message"))


def meta_features(s, d):
    cols = [F.round(c.cast("double"), 6).alias(n) for c, n in zip(T.meta_features("title", "content"), oracle.META)]
    return _news(s, d).select("id", *cols)


def char_ratios(s, d):
    return table(s, d, "documents").select("doc_id", F.round(T.special_ratio("text"), 6).alias("special"), F.round(T.foreign_ratio("text"), 6).alias("foreign_share"))


def lang_detect(s, d):
    return table(s, d, "documents").select("doc_id", T.detect_language("text").alias("language"))


def factcheck_flags(s, d):
    return table(s, d, "factcheck_raw").select("url", *T.flags("content", L.FACTCHECK_LEXICON, True))


def live_flags(s, d):
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return _news(s, d).select("id", *T.flags(text, L.LIVE_LEXICON, True))


def etl_flags(s, d):
    return _prepared(s, d).select("id", *L.FLAGS)


def admission_exact_dedup(s, d):
    return etl.exact_dedup(etl.admitted(_news(s, d).select("id", "title", "content", "media", "date"))).select("id", "media", "date", T.content_hash("title", "content").alias("text_key"))


def title_dedup_first(s, d):
    return etl.first_by(_articles(s, d).select("id", "title"), "title", "id")


def serving_dedup(s, d):
    return etl.first_by(_news(s, d).select("id", "title"), T.trimmed("title"), "id").select("id")


def near_dup_titles(s, d):
    return etl.near_dup_titles(_articles(s, d).select("id", "title", "label")).select("id")


def listing_dedup(s, d):
    return etl.listing_dedup(_news(s, d).select("id", "url", "title")).select("id")


def quality_filter_funnel(s, d):
    return etl.funnel(_prepared(s, d))


def truncated_content(s, d):
    out = etl.truncated_content(_prepared(s, d))
    return out.select("id", F.length("content").alias("content_len"), F.length("clean_message").alias("clean_len"))


def content_fallback(s, d):
    return etl.content_fallback(_news(s, d).select("id", "title", "content")).select("id", F.md5("content").alias("content_key"))


def mode_impute(s, d):
    return etl.mode_impute(_articles(s, d).select("id", "media", "date", "label"), ["media", "date", "label"])


def no_flag_positive_filter(s, d):
    return _articles(s, d).filter(etl.filters()["flags"]).select("id", etl.flag_score().alias("flag_score"))


def undersample_balanced(s, d):
    return etl.undersample(_articles(s, d)).select("id", "label")


def balanced_subsets(s, d):
    return etl.balanced_subsets(_articles(s, d), SUBSET).select("id", "label", "subset_no")


def stratified_split(s, d):
    return etl.stratified_split(_articles(s, d), {"train": 0.72, "val": 0.08, "test": 0.2}).select("id", "label", "split")


def kfold_assign(s, d):
    return etl.kfold(_articles(s, d), FOLDS).select("id", "label", "fold")


def id_assign(s, d):
    return with_ids(_news(s, d).select(F.col("id").alias("old_id")).filter("old_id is not null"), ["old_id"], "new_id")


def merge_incremental(s, d):
    old = _articles(s, d).select("title", "content", "label", "date", F.lpad(F.col("id").cast("string"), 12, "0").alias("ord"))
    new = table(s, d, "factcheck_raw").select("title", "content", "label", "date", F.col("url").alias("ord"))
    return etl.merged(old, new).select("title", F.md5(F.coalesce("content", F.lit(""))).alias("content_key"), "label", "date")


def token_cache_delta(s, d):
    keyed = lambda df: df.withColumn("text_key", T.content_hash("title", "content"))
    return etl.not_cached(keyed(_news(s, d).select("id", "title", "content")), keyed(_articles(s, d).select("title", "content"))).select("id")


def token_match_rate(s, d):
    cache = _articles(s, d).filter(F.size(T.tokens("content")) > 0).select(T.content_hash("title", "content").alias("text_key")).distinct().withColumn("hit", F.lit(1))
    rows = _news(s, d).select(T.content_hash("title", "content").alias("text_key")).join(cache, "text_key", "left")
    return rows.agg(F.count("*").alias("n"), F.count("hit").alias("matched"), (F.count("hit") / F.count("*") < 0.5).alias("recompute"))


def media_semi(s, d):
    return _articles(s, d).filter(F.col("media").isin(*L.ENGLISH_MEDIA)).select("id")


def media_anti(s, d):
    return _articles(s, d).filter(~F.coalesce(F.col("media").isin(*L.ENGLISH_MEDIA), F.lit(False))).select("id")


def label_counts(s, d):
    return _articles(s, d).groupBy("label").agg(F.count("*").alias("n"))


def flag_counts(s, d):
    one = _articles(s, d).filter("label = 1").agg(*[F.sum(f).alias(f) for f in L.FLAGS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in L.FLAGS])).alias("x")).select("x.*")


def source_distribution(s, d):
    return table(s, d, "factcheck_raw").filter("label = 1").groupBy("source").agg(F.count("*").alias("n"))


def source_cap(s, d):
    return etl.source_cap(table(s, d, "factcheck_raw").filter("label = 1").select("source", "url").distinct(), "source", ["url"], 10)


def factcheck_dedup(s, d):
    return etl.first_by(table(s, d, "factcheck_raw").select("source", "url", "title", "label", "verdict"), "url", "title")


def term_frequency_topn(s, d):
    words = table(s, d, "documents").select(F.explode(T.tokens("text")).alias("term")).filter(~F.col("term").isin(*L.STOPWORDS, *L.SERVING_STOPWORDS))
    return features.top_terms(words.groupBy("term").agg(F.count("*").alias("n")), "n", TOP_TERMS)


def _tfidf(s, d):
    docs = _articles(s, d).select("id", features.word_ngrams(T.tokens("content"), 2, L.STOPWORDS).alias("terms"))
    return docs, features.tfidf(docs, "id", "terms", min_df=2, max_df=0.7, max_features=50_000)


def tfidf_vectors(s, d):
    return _tfidf(s, d)[1].select("key", "term", F.round("weight", 5).alias("weight"))


def tfidf_top_terms(s, d):
    docs = _articles(s, d).select("id", F.filter(F.split(F.coalesce("content", F.lit("")), r"[ \t\r\n]+"), lambda w: w != "").alias("terms"))
    w = features.tfidf(docs, "id", "terms", sublinear=False, min_df=2, max_features=50_000)
    return features.top_terms(features.mean_tfidf(w, docs.count()).withColumn("mean_weight", F.round("mean_weight", 7)), "mean_weight", TOP_TERMS)


def char_wb_tfidf(s, d):
    docs = _articles(s, d).select("id", features.char_wb(F.col("title")).alias("terms"))
    return features.tfidf(docs, "id", "terms", min_df=3).select("key", "term", F.round("weight", 5).alias("weight"))


def _labels(s, d):
    return _articles(s, d).select(F.col("id").alias("key"), "label")


def chi2_topk(s, d):
    c = features.chi2(_tfidf(s, d)[1], _labels(s, d)).withColumn("chi2", F.round("chi2", 7))
    return features.top_terms(c, "chi2", CHI2_TERMS)


def nb_log_ratio(s, d):
    return features.nb_ratio(_tfidf(s, d)[1], _labels(s, d)).withColumn("ratio", F.round("ratio", 6))


def meta_scaled(s, d):
    rows = _articles(s, d).select("id", *T.meta_features("title", "content"))
    return features.scaled(rows, list(oracle.META)).select("id", *[F.round(c, 6).alias(c) for c in oracle.META])


def _rated(s, d):
    return evaluate.rated(table(s, d, "scores"))


def confusion(s, d):
    return evaluate.metrics(evaluate.confusion(evaluate.predicted(_rated(s, d)), ["model"]), ["model"])


def class_report(s, d):
    return evaluate.class_report(evaluate.confusion(evaluate.predicted(_rated(s, d)), ["model"]), ["model"])


def roc_auc(s, d):
    return evaluate.roc_auc(_rated(s, d))


def threshold_sweep(s, d):
    return evaluate.sweep(_rated(s, d), SWEEP)


def best_threshold(s, d):
    return evaluate.best(evaluate.sweep(_rated(s, d), SWEEP))


def flag_slice_metrics(s, d):
    flags = _news(s, d).select(F.col("id").cast("string").alias("key"), *L.FLAGS)
    return evaluate.flag_slices(evaluate.predicted(_rated(s, d)).join(flags, "key"))


def ensemble_vote(s, d):
    return evaluate.soft_vote(_rated(s, d)).select("key", "label", F.round("score", 6).alias("score"))


def ensemble_metrics(s, d):
    vote = evaluate.predicted(evaluate.soft_vote(_rated(s, d)).withColumn("score", F.round("score", 6))).withColumn("model", F.lit("ensemble"))
    one = evaluate.predicted(_rated(s, d)).select("key", "label", "score", "pred", "model")
    return evaluate.metrics(evaluate.confusion(one.unionByName(vote), ["model"]), ["model"])


def scores_contract(s, d):
    return readers.contract(_rated(s, d), "label", ("score",))


def timeline_sort(s, d):
    return views.timeline(_news(s, d).select("id", "pub_time")).select("id", "position")


def display_order(s, d):
    return views.display_order(_news(s, d).select("id", "fake_score")).select("id", "position")


def _view(s, d):
    cols = ["id", "title", "fake_score", "body_ready", "category", "batch_no", *L.FLAGS]
    return views.scored(_news(s, d).select(*cols))


def result_labels(s, d):
    return _view(s, d).select("id", "score_source", "score", "predicted_label", "result_text")


def view_page(s, d):
    order = ["predicted_label", "score", "id"]
    return views.page(views.view_filter(_view(s, d), "causal_error"), order, PAGE_NO).select("id", "score", "position", "page", "pages")


def section_view(s, d):
    rows = views.view_filter(_view(s, d).filter("category = '경제'"), "fake")
    return views.page(rows, ["score", "id"], 1).select("id", "score", "position", "page", "pages")


def view_counts(s, d):
    return views.counts(_view(s, d))


def status(s, d):
    """The batches there are, and the next one, for which nothing has come yet."""
    have = _news(s, d).select("batch_no").filter("batch_no is not null").distinct()
    wanted = have.unionByName(have.agg((F.coalesce(F.max("batch_no"), F.lit(0)) + 1).alias("batch_no")))
    return views.status(wanted, _news(s, d), "batch_no")


def stale_sources(s, d):
    media = _news(s, d).select(F.trim("media").alias("media"), "ingest_ts").filter("media is not null")
    last = media.agg(F.max("ingest_ts").alias("now")).first()["now"]
    return views.stale(media, "media", "ingest_ts", last).select("media")


def page_cutoff(s, d):
    """Batches as pages: rows of a batch whose url no earlier row has, up to two pages in a row without any."""
    rows = _news(s, d).select("id", "url", "batch_no")
    first = etl.first_by(rows, "url", "id").groupBy("batch_no").agg(F.count("*").alias("n"))
    pages = rows.select("batch_no").distinct().join(first, "batch_no", "left").select(F.col("batch_no").alias("page"), F.coalesce("n", F.lit(0)).alias("n_new"))
    return views.page_cutoff(pages)


def article_text(s, d):
    text = views.article_text("title", "summary", "content")
    return _news(s, d).select("id", F.md5(text).alias("text_key"), F.length(views.boosted_text("title", "content")).alias("boosted_len"))


def enrich_bodies(s, d):
    news = _news(s, d)
    listing = news.filter("not body_ready").select("id", "url", "summary", F.col("summary").alias("content"))
    bodies = news.filter("body_ready and url is not null").select("url", F.col("content").alias("body"))
    return views.enriched(listing, bodies).select("id", F.md5(F.coalesce("content", F.lit(""))).alias("content_key"), "body_ready")


def parse_date(s, d):
    return _articles(s, d).select("id", T.parse_date("date").alias("date"))


def verdict_extract(s, d):
    text = F.concat(F.coalesce(F.concat(F.lit("판정: "), F.col("verdict"), F.lit("\n")), F.lit("")), F.coalesce("content", F.lit("")))
    v, label = T.verdict(text)
    return table(s, d, "factcheck_raw").select("url", v.alias("found_verdict"), label.alias("found_label"))


def id_harvest(s, d):
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce("url", F.lit("")), F.lit(r"ncd=(\d{7,8})"), F.lit(1)))
    return table(s, d, "factcheck_raw").select("url", F.array_join(ids, ",").alias("ids"))


def date_extract(s, d):
    found = F.regexp_extract(F.coalesce("pub_time", F.lit("")), r"(\d{4}[.-]\d{2}[.-]\d{2})", 1)
    return _news(s, d).select("id", F.when(found == "", "2024-01-01").otherwise(F.regexp_replace(found, r"\.", "-")).alias("day"))


def allowed_hosts(s, d):
    """Urls whose host is one of the site or below it, by label and not by substring."""
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    return _news(s, d).filter((host == "neoulmok.example") | host.endswith(".neoulmok.example")).select("id")


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escaped(c):
    x = F.coalesce(F.col(c), F.lit(""))
    for a, b in _ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html_listing(s, d):
    """Listing pages made of the records, one batch of ids a page, parsed again."""
    item = F.concat(F.lit("<li><dl><dt class='photo'><a href='#'><img src='/x.jpg'></a></dt><dt><a href=\""), _escaped("url"), F.lit('">'), _escaped("title"), F.lit("</a></dt><dd><span class='lede'>"), _escaped("summary"), F.lit("</span><span class='writing'>"), _escaped("media"), F.lit("</span><span class='date'>"), _escaped("pub_time"), F.lit("</span></dd></dl></li>"))
    pages = _news(s, d).select("id", item.alias("item")).groupBy(F.expr("id div 20").alias("page")).agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("x"))
    doc = F.concat(F.lit("<html><body><div class='list_body'><ul class='type06'>"), F.array_join(F.col("x.item"), ""), F.lit("</ul></div></body></html>"))
    return html.listings(pages.select("page", doc.alias("html"))).select("page", "pos", "title", "url", "press")


def html_body(s, d):
    doc = F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>menu</nav><div id='dic_area'><script>x()</script><p>"), _escaped("text"), F.lit("</p><div class='copyright'>c</div></div></body></html>"))
    got = html.bodies(table(s, d, "documents").select("doc_id", doc.alias("html")), "doc_id")
    return got.select("doc_id", F.md5("body").alias("body_key"))


def html_links(s, d):
    doc = F.concat(F.lit("<a href='/a'>1</a><a href=\""), _escaped("url"), F.lit("\">2</a><a href='/a'>3</a><a href='#x'>4</a>"))
    got = html.links(_news(s, d).filter("url like 'http%'").select("id", F.lit("https://list.example/").alias("base"), doc.alias("html"), "url"), "base", more=("id",))
    return got.select("id", F.array_join("links", " ").alias("links"))


def csv_roundtrip(s, d):
    path = _shared(s, "csv_articles")
    sinks.csv_with_bom(_articles(s, d).select("id", "title", "content", "media", "date", "label"), path)
    back = readers.csv(s, path, "id long, title string, content string, media string, date string, label int")
    return back.select("id", F.md5(F.coalesce("content", F.lit(""))).alias("content_key"), F.coalesce("label", F.lit(-1)).alias("label"))


def embedding_blocks(s, d):
    """Each vector brought to length 1, beside its class: sums that stand for the block."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))
    return table(s, d, "embeddings").select("vec_id", "label", F.size(v).alias("dims"), F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 5).alias("unit_sum"))


def _streamed(s, rows: DataFrame, transform, schema: str) -> DataFrame:
    """Rows landed as files, read as a stream, transformed, and what came out; every run has folders of its own, and removes its input."""
    at = _shared(s, f"stream_{os.urandom(6).hex()}")
    rows.write.parquet(f"{at}/in")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    feed.run_available(transform(feed.news_stream(s, f"{at}/in", rows.schema)), f"{at}/checkpoint", write)
    fs, p, jvm = sinks._fs(s, f"{at}/in")
    fs.delete(p, True)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{at}/out"))
    out = cut(s.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(at), True)
    return out


def stream_score_dedup(s, d):
    """The records as a stream: addresses seen, each once, with whether they have a score of their own."""
    rows = _news(s, d).select("id", "url", "fake_score", "ingest_ts").filter("url is not null")
    return _streamed(s, rows, lambda x: feed.scored(feed.deduplicated(x, ["url"], delay="400 days")).select("url"), "url string")


def _bundle(s, d) -> dict:
    """A model for each language, fitted on the articles, stored and loaded again."""
    at = _shared(s, f"models_{os.urandom(6).hex()}")
    rows = cut(serving.feature_rows(_articles(s, d).filter("label in (0, 1)").select("id", "title", "content", "label")))
    for language in ("korean", "english"):
        own = rows.filter(F.col("language") == language)
        if own.select("label").distinct().count() == 2:
            serving.save(serving.fit(own), at, language, "v1", label="label")
    loaded = {language: serving.load(s, at, language) for language in ("korean", "english")}
    fs, p, _ = sinks._fs(s, at)
    fs.delete(p, True)
    return loaded


def stream_model_scores(s, d):
    """Records scored on the stream by loaded models of their language, beside the scores of the same batch: (id, scored, same)."""
    models_ = _bundle(s, d)
    rows = _news(s, d).select("id", "title", "content", "ingest_ts")
    live = _streamed(s, rows, lambda x: serving.scored(x, models_).select("id", "fake_score"), "id long, fake_score double")
    batch = serving.scored(rows, models_).select("id", F.col("fake_score").alias("batch_score"))
    return batch.join(live, "id", "left").select("id", F.col("fake_score").isNotNull().alias("scored"), F.col("fake_score").eqNullSafe(F.col("batch_score")).alias("same"))


def model_coefficients(s, d):
    """Terms that speak most for and against label 1 in the stored model."""
    return serving.coefficients(_bundle(s, d)["korean"]).select("side", "term", F.round("coefficient", 6).alias("coefficient"))


def top_signed_ratios(s, d):
    return serving.top_signed(nb_log_ratio(s, d), "ratio", 15)


def feature_ablation(s, d):
    """Metrics of the same model with and without the flags; the flags leak labels that were filtered by them."""
    rows = serving.feature_rows(_articles(s, d).filter("label in (0, 1)").select("id", "title", "content", "label", *L.FLAGS))
    rows = cut(etl.stratified_split(rows, {"train": 0.8, "test": 0.2}))
    out = None
    for flags in (True, False):
        model = serving.fit(rows.filter("split = 'train'"), flags)
        found = models.scores(model, serving.assembled(rows.filter("split = 'test'").withColumnRenamed("id", "key"), flags)).withColumn("model", F.lit("with_flags" if flags else "without_flags"))
        one = evaluate.metrics(evaluate.confusion(evaluate.predicted(found), ["model"]), ["model"])
        out = one if out is None else out.unionByName(one)
    return out.select("model", "macro_f1", "weighted_f1", (F.col("macro_f1") - F.min("macro_f1").over(Window.partitionBy())).alias("above_lowest"))  # two rows


def model_search(s, d):
    """Grid search of naive Bayes (multinomial, complement, Bernoulli) and logistic regression over three folds, best point first."""
    rows = cut(_training(s, d, SEARCH_TERMS).filter("split = 'train'"))
    n = rows.count()
    space = {"family": ["nb", "lr"], "kind": ["multinomial", "complement", "bernoulli", "l1", "l2"], "strength": [0.1, 0.5, 1.0, 5.0]}
    points = models.grid(space, lambda p: (p["family"] == "nb") == (p["kind"] in ("multinomial", "complement", "bernoulli")) and (p["family"] == "nb" or p["strength"] >= 1.0) and p["strength"] != 5.0 or p == {"family": "lr", "kind": "l2", "strength": 5.0})
    _, _, log = models.search(rows, lambda p: models.of_point(p, n), points)
    got = [(p["family"], p["kind"], float(p["strength"]), None if f is None else round(f, 6)) for p, f in log]
    return s.createDataFrame(got, "family string, kind string, strength double, macro_f1 double").orderBy(F.desc_nulls_last("macro_f1"), "family", "kind", "strength")


def threshold_summary(s, d):
    return evaluate.threshold_summary(_rated(s, d), SWEEP)


def model_ranking(s, d):
    return evaluate.ranking(evaluate.confusion(evaluate.predicted(_rated(s, d)), ["model"]))


def all_sources(s, d):
    """Articles, fact checks and crawled records as one corpus, admitted and deduplicated by one set of keys."""
    cols = ["title", "content", "media", "date", "label"]
    key = lambda c: F.lpad(F.col(c).cast("string"), 12, "0").alias("ord")
    checks = table(s, d, "factcheck_raw").select("title", "content", F.col("source").alias("media"), "date", "label", F.col("url").alias("ord")).distinct()
    both = etl.all_sources(_articles(s, d).select(*cols, key("id")), checks, _news(s, d).select(*cols, key("id")))
    return etl.shared_dedup(both).select("source_no", "media", "date", F.coalesce("label", F.lit(-1)).alias("label"), T.content_hash("title", "content").alias("text_key"))


def document_stream(s, d):
    """Articles of one label as texts of their tokens."""
    rows = _articles(s, d).filter("label = 1").select("id", F.array_join(F.filter(T.tokens("content"), lambda w: ~w.isin(*L.STOPWORDS)), " ").alias("text"))
    return rows.filter("text <> ''").select("id", F.md5("text").alias("text_key"))


def fake_samples(s, d):
    rows = table(s, d, "factcheck_raw").select("source", "url", "title", "content", "verdict", "label").distinct()
    return etl.samples(rows, ["url", "title", "verdict", "content"]).select("url", "title", F.md5("summary").alias("summary_key"))


def result_articles(s, d):
    cols = ["id", "title", "media", "category", "pub_time", "image_url", "fake_score"]
    return views.results(_news(s, d).select(*cols, *L.FLAGS)).select("id", "image_url", "fake_score", "causal_error", "position")


def date_labels(s, d):
    day = T.parse_date("date").try_cast("date")
    return _articles(s, d).withColumn("day", day).select("id", views.date_label("day").alias("label_text"), views.query_string("id", "label").alias("query"))


def page_depth(s, d):
    """Batches as listing pages, as deep as a section is read."""
    return feed.of_kind(_news(s, d).select("id", F.col("batch_no").alias("page")), "section").groupBy("page").agg(F.count("*").alias("n"))


def event_windows(s, d):
    return table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _training(s, d, terms: int) -> DataFrame:
    """Word uni- and bigrams of title and content, chi-square selection, twelve scaled meta features: the blocks of one row."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    rows = _articles(s, d).filter("content is not null").select("id", features.word_ngrams(T.tokens(text), 2, L.STOPWORDS).alias("tokens"), "label", *[F.log1p(c.cast("double")).alias(n) for c, n in zip(T.meta_features("title", "content"), serving.META)])
    return models.training_rows(rows, "id", "tokens", "label", terms, list(serving.META))


def _model(name):
    return lambda s, d: models.evaluated(_training(s, d, MODEL_TERMS), name)


_QUERIES = [
    etl_flag_summary, clean_text, clean_text_compact, meta_features, char_ratios, lang_detect, factcheck_flags, live_flags, etl_flags,
    admission_exact_dedup, title_dedup_first, serving_dedup, near_dup_titles, listing_dedup, quality_filter_funnel, truncated_content,
    content_fallback, mode_impute, no_flag_positive_filter, undersample_balanced, balanced_subsets, stratified_split, kfold_assign, id_assign,
    merge_incremental, token_cache_delta, token_match_rate, media_semi, media_anti, label_counts, flag_counts, source_distribution, source_cap,
    factcheck_dedup, term_frequency_topn, tfidf_vectors, tfidf_top_terms, char_wb_tfidf, chi2_topk, nb_log_ratio, meta_scaled, confusion,
    class_report, roc_auc, threshold_sweep, best_threshold, flag_slice_metrics, ensemble_vote, ensemble_metrics, scores_contract, timeline_sort,
    display_order, result_labels, view_page, section_view, view_counts, status, stale_sources, page_cutoff, article_text, enrich_bodies,
    parse_date, verdict_extract, id_harvest, date_extract, allowed_hosts, html_listing, html_body, html_links, csv_roundtrip, embedding_blocks,
    stream_score_dedup, event_windows, stream_model_scores, model_coefficients, top_signed_ratios, feature_ablation, model_search, threshold_summary,
    model_ranking, all_sources, document_stream, fake_samples, result_articles, date_labels, page_depth,
]


def queries():
    out = {f.__name__: f for f in _QUERIES}
    return out | {name: _model(name) for name in ("lr_l1", "lr_l2", "nb_multinomial", "nb_complement", "nb_bernoulli", "linear_svc", "gbt")}


def oracle_sql():
    return oracle.SQL

