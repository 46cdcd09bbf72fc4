import json
import zipfile

from pyspark.sql import functions as F

from sparkcred.sources import readers, sinks
from sparkcred.streaming import feed


def test_csv_roundtrip_and_bom(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", x\nline', None), (2, None, "é")], "id long, content string, media string")
    sinks.csv_with_bom(df, str(tmp_path / "c"))
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "c").glob("part-*"))
    back = readers.csv(spark, str(tmp_path / "c"), "id long, content string, media string").orderBy("id").collect()
    assert back[0].content == 'a "q", x\nline' and back[1].media == "é"
    assert readers.csv(spark, str(tmp_path / "none"), "id long").count() == 0


def test_english_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text('title,text,subject,date\n"T","x, y","news","March 5, 2017"\n')
    (tmp_path / "g.csv").write_text("title,text,date,label\nT,x,2017,fake news\nU,y,2017,REAL\n")
    assert readers.english_by_file(spark, str(tmp_path / "f.csv"), 1).first().content == "x, y"
    assert [r.label for r in readers.english_inline(spark, str(tmp_path / "g.csv")).orderBy("title").collect()] == [1, 0]


def test_zipped_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.json", json.dumps({"sourceDataInfo": {"newsTitle": "t", "newsContent": "c", "newsCategory": "m"}, "labeledDataInfo": {"clickbaitClass": 0}}))
        z.writestr("2.json", "{bad")
        z.writestr("3.json", json.dumps({"sourceDataInfo": {"newsTitle": "u"}}))
        z.writestr("x.txt", "no")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    got = readers.zipped_json(spark, str(tmp_path)).orderBy("member").collect()
    assert [(r.title, r.label) for r in got] == [("t", 1), ("u", 0)]


def test_logs_words_cache(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("x\nMacro F1: 0.7105\nMacro F1: 0.1\n")
    assert readers.log_metric(spark, str(tmp_path / "log"), "macro f1").first().value == 0.7105
    (tmp_path / "w.txt").write_text("# c\n\n하다 \n있다\n")
    assert sorted(r.word for r in readers.stop_words(spark, str(tmp_path / "w.txt")).collect()) == ["있다", "하다"]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "k.json").write_text(json.dumps({"cache_key": "a:b", "articles": [{"title": "t", "fake_score": 1.5}]}))
    assert readers.section_cache(spark, str(tmp_path / "cache")).first().title == "t"
    assert sinks.cache_name("a:b/c,d") == "a__b__c__d"
    sinks.json_cache(spark.createDataFrame([("a:b", 1)], "cache_key string, n int"), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["cache_key=a__b"]


def test_replace_keeps_backups(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.replace(spark.range(1), path) is None
    assert sinks.replace(spark.range(2), path).endswith("__backup1")
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path + "__backup1").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"u{i % 7}", i % 3 == 0, 50.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, url string, body_ready boolean, fake_score double").withColumn("ingest_ts", F.timestamp_seconds(F.col("id") + 1_700_000_000))
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    stream = feed.scored(feed.deduplicated(feed.news_stream(spark, src, df.schema, 1), ["url"]))
    out = str(tmp_path / "out")
    feed.run_available(stream, str(tmp_path / "cp"), feed.upsert(out, "url", "id"))
    got = spark.read.parquet(out)
    assert sorted(r.url for r in got.collect()) == sorted({r[1] for r in rows}) and set(got.columns) >= {"predicted_label", "score_source"}
    feed.run_available(feed.news_stream(spark, src, df.schema), str(tmp_path / "cp2"), feed.upsert(str(tmp_path / "all"), "url", "id"))
    best = {r.url: r.id for r in spark.read.parquet(str(tmp_path / "all")).collect()}
    assert best == {u: max((b, i) for i, v, b, _ in rows if v == u)[1] for u in best}


def test_contract(spark):
    df = spark.createDataFrame([(0, 0.5), (1, -1.0)], "label int, x double")
    r = readers.contract(df, "label", ("x",)).first()
    assert (r.n, r.labels_ok, r.x_ok) == (2, True, False)
    assert readers.missing_columns(df, "label int, y string") == ["y"]
