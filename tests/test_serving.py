import random

from pyspark.sql import functions as F

from sparkcred.operators import etl, evaluate, serving, views
from sparkcred.streaming import feed


def articles(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        y = i % 2
        words = [rng.choice(["alpha", "beta", "gamma"] if y else ["delta", "epsilon", "zeta"]) for _ in range(12)]
        korean = [rng.choice(["가나다", "라마바"] if y else ["사아자", "차카타"]) for _ in range(12)]
        rows.append((i, "title here", " ".join(words if i % 4 < 2 else korean), y))
    return spark.createDataFrame(rows + [(900, None, None, 1), (901, "", "alpha " * 3000, None)], "id long, title string, content string, label int")


def test_models_are_stored_loaded_and_routed(spark, tmp_path):
    at = str(tmp_path / "models")
    df = articles(spark)
    rows = serving.feature_rows(df)
    for language in ("korean", "english"):
        own = rows.filter((F.col("language") == language) & F.col("label").isNotNull())
        serving.save(serving.fit(own, min_df=1), at, language, "v1", rows=own.count())
    models = {x: serving.load(spark, at, x) for x in ("korean", "english")}
    got = {r.id: r for r in serving.scored(df.withColumn("language", F.lit("x")), models).collect()}
    assert len(got) == 62 and all(got[i].predicted_label == i % 2 for i in range(60))
    assert 0 <= got[900].fake_score <= 100 and got[901].fake_score is not None
    # no model of its own: the fallback's; none at all: null
    assert serving.load(spark, at, "french") is None and serving.load(spark, at, "korean", ["v9"]) is None
    alone = serving.scored(df, {"korean": models["korean"]})
    assert alone.filter("fake_score is null").count() == 0
    assert serving.scored(df, {}).filter("fake_score is not null").count() == 0
    assert serving.scored(df.limit(0), models).count() == 0
    top = serving.coefficients(models["english"], 2).collect()
    assert {r.term.split(" ")[0] for r in top if r.side == "positive"} <= {"alpha", "beta", "gamma"} and len(top) == 4


def test_stream_is_scored_in_two_phases_and_restarts(spark, tmp_path):
    df = articles(spark).select("id", "title", "content")
    models = {"english": None, "korean": serving.fit(serving.feature_rows(articles(spark).filter("label is not null")), min_df=1)}
    first = df.withColumns({"url": F.concat(F.lit("u"), "id"), "body_ready": F.lit(False), "content": F.lit(None).cast("string"), "ingest_ts": F.timestamp_seconds("id")})
    second = df.filter("id < 20").withColumns({"url": F.concat(F.lit("u"), "id"), "body_ready": F.lit(True), "ingest_ts": F.timestamp_seconds(F.col("id") + 1000)})
    out = str(tmp_path / "view")
    write = feed.published(out, models)
    write(first, 0), write(second, 1)
    got = {r.url: r for r in spark.read.parquet(out).collect()}
    assert len(got) == 62 and all(got[f"u{i}"].body_ready == (i < 20) for i in range(60)) and all(got[f"u{i}"].predicted_label == i % 2 for i in range(20))
    # a writer that died after its rows were complete is made up for
    spark.read.parquet(out).filter("url = 'u1'").withColumn("title", F.lit("pending")).write.parquet(f"{out}__pending")
    write(second.limit(0), 2)
    assert spark.read.parquet(out).filter("title = 'pending'").count() == 1
    write(second, 3)
    assert spark.read.parquet(out).count() == len(spark.read.parquet(out).select("url").distinct().collect())


def test_ranking_summary_and_samples(spark):
    rows = [(str(i), i % 2, m, (0.9 if i % 2 else 0.1) if m == "good" else 0.4) for i in range(20) for m in ("good", "flat")]
    df = spark.createDataFrame(rows, "key string, label int, model string, score double")
    place = evaluate.ranking(evaluate.confusion(evaluate.predicted(df), ["model"])).orderBy("place").collect()
    assert [r.model for r in place] == ["good", "flat"]
    s = {r.model: r for r in evaluate.threshold_summary(df, [0.3, 0.45]).collect()}
    assert s["good"].f1_gain == 0 and s["flat"].old_missed == 10
    checks = spark.createDataFrame([("a", None, "c" * 300, "거짓", 1), ("b", "t", None, None, 1), ("c", "t", "x", "x", 0)], "url string, title string, content string, verdict string, label int")
    got = {r.url: r.summary for r in etl.samples(checks, ["url", "title"]).collect()}
    assert got == {"a": "[거짓] " + "c" * 200, "b": ""}
    assert etl.samples(checks, ["url"], 1).count() == 1


def test_sources_share_one_set_of_keys(spark):
    a = spark.createDataFrame([("T", "long enough content here", None, "", 1, "1")], "title string, content string, media string, date string, label int, ord string")
    b = spark.createDataFrame([("t", "LONG enough content here", 5, "2"), ("u", "another content of some length", 6, "1")], "title string, content string, extra int, ord string")
    got = etl.shared_dedup(etl.all_sources(a, b)).orderBy("source_no", "ord").collect()
    assert [(r.source_no, r.title, r.media, r.label) for r in got] == [(0, "T", "Unknown", 1), (1, "u", "Unknown", None)]


def test_results_dates_and_query_strings(spark):
    rows = [(1, " T ", "오전 9:10", "nan", "1.5"), (2, "T", "오후 1:00", "x", "bad"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, pub_time string, image_url string, fake_score string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("media", "category")} | {f: F.lit("x") for f in ("stat_distortion", "causal_error", "emotional_provocation", "source_lack", "img_mismatch")})
    got = {r.id: r for r in views.results(df).collect()}
    assert set(got) == {1, 3} and got[1].fake_score == 1.5 and got[1].image_url is None and got[1].causal_error == 0 and got[1].position == 1
    one = spark.sql("select date'2024-01-01' as d, 'a b' as q, null as n").select(views.date_label("d").alias("l"), views.query_string("q", "n").alias("s"), views.date_label("n").alias("z")).first()
    assert tuple(one) == ("01.01(월)", "q=a+b", None)
