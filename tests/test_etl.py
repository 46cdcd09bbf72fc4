import random

import pytest

from sparkcred.functions import lexicons as L
from sparkcred.operators import etl, html, views
from sparkcred.operators.ranking import ranked

ARTICLE = "id long, title string, content string, media string, date string, label int"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_admission(spark):
    rows = [(1, "t", "x" * 19, None, "", 1), (2, "t", "x" * 20, " ", "2020", 1), (3, None, None, None, None, None), (4, "T", "X" * 20, "m", "", 0)]
    got = etl.admitted(spark.createDataFrame(rows, ARTICLE)).orderBy("id").collect()
    assert [(r.id, r.media, r.date) for r in got] == [(2, "Unknown", "2020-01-01"), (4, "m", "")]
    assert ids(etl.exact_dedup(etl.admitted(spark.createDataFrame(rows, ARTICLE)))) == [2]
    assert etl.admitted(spark.createDataFrame([], ARTICLE)).count() == 0


@pytest.mark.parametrize("n, kept", [(149, 0), (150, 1), (10_001, 1)])
def test_length_filter(spark, n, kept):
    df = spark.createDataFrame([(1, "t", "a" * n, "m", "", 0)], ARTICLE).withColumn("clean_message", etl.F.col("content"))
    df = etl.with_flags(df)
    assert df.filter(etl.filters()["length"]).count() == kept
    assert etl.truncated_content(df).select(etl.F.length("content").alias("n")).first().n == min(n, 10_000)


def naive_titles(rows):
    def grams(t):
        k = "".join(c for c in t if "가" <= c <= "힣" or c.isascii() and (c.islower() or c.isdigit()))
        return set() if not k else {k} if len(k) < 3 else {k[i : i + 3] for i in range(len(k) - 2)}

    kept, label, last = [], None, None
    for lab, norm, i in sorted((str(r[2]) if r[2] is not None else "", (r[1] or "").lower().strip(" "), r[0]) for r in rows):
        g = grams(norm)
        if lab == label and last and len(g & last) / max(1, len(g | last)) >= 0.9:
            continue
        kept.append(i)
        label, last = lab, g
    return sorted(kept)


def test_near_dup_titles(spark):
    a = "abcdefghijklmnopqrstuvwxyz012345"
    chain = [(1, a, 0), (2, a + "67", 0), (3, a + "6789", 0), (4, a, 1), (5, "!!", 0), (6, "??", 0), (7, "!!", 0), (8, None, 0), (9, a, 0), (10, a, None)]
    df = spark.createDataFrame(chain, "id long, title string, label int")
    assert ids(etl.near_dup_titles(df)) == [1, 3, 4, 5, 6, 7, 8, 10] == naive_titles(chain)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        base = "".join(rng.choice("ab") for _ in range(3)) + "xyz" * 14
        rows.append((i, base[: rng.randint(30, 45)] + rng.choice(["", "q", "qr"]), rng.randint(0, 1)))
    assert ids(etl.near_dup_titles(spark.createDataFrame(rows, "id long, title string, label int"))) == naive_titles(rows)
    assert etl.near_dup_titles(spark.createDataFrame([], "id long, title string, label int")).count() == 0


def test_listing_dedup(spark):
    rng = random.Random(3)
    rows = [(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2"), (4, "u3", "t1")]
    assert ids(etl.listing_dedup(spark.createDataFrame(rows, "id long, url string, title string"))) == [1, 3]
    rows = [(i, f"u{rng.randint(0, 20)}", f"t{rng.randint(0, 20)}") for i in range(80)]
    urls, titles, kept = set(), set(), []
    for i, u, t in rows:
        if u not in urls and t not in titles:
            urls.add(u), titles.add(t), kept.append(i)
    assert ids(etl.listing_dedup(spark.createDataFrame(rows, "id long, url string, title string"))) == kept


@pytest.mark.parametrize("real, fake, sizes", [(25, 22, [10, 10, 10, 14]), (12, 40, [10, 14]), (20, 20, [10, 10, 10, 10]), (0, 5, [])])
def test_subsets(spark, real, fake, sizes):
    rows = [(i, int(i >= real)) for i in range(real + fake)]
    got = etl.balanced_subsets(spark.createDataFrame(rows, "id long, label int"), 10)
    assert [r["count"] for r in got.groupBy("subset_no").count().orderBy("subset_no").collect()] == sizes
    assert all(r.n == 1 for r in got.groupBy("id").agg(etl.F.count("*").alias("n")).collect())


def test_split_and_folds(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, label int")
    split = etl.stratified_split(df, {"train": 0.8, "test": 0.2})
    assert split.count() == 100 and split.filter("split = 'train'").count() == 27 + 26 + 26
    folds = etl.kfold(df, 5).groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_ranks_match_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9)) for i in range(500)]
    got = {r.id: r["rank"] for r in ranked(spark.createDataFrame(rows, "id long, g string, v int"), ["v", "id"], ["g"]).collect()}
    for g in ("a", "b", None):
        want = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i] for _, i in want] == list(range(1, len(want) + 1))


def test_undersample(spark):
    cols = "id long, label int, " + ", ".join(f"{f} int" for f in L.FLAGS)
    rows = [(i, int(i >= 6), *(int(k < i % 4) for k in range(5))) for i in range(16)]
    got = etl.undersample(spark.createDataFrame(rows, cols)).collect()
    assert sorted(r.label for r in got) == [0] * 6 + [1] * 6
    fakes = {r.id for r in got if r.label == 1}
    assert {7, 11, 15} <= fakes  # the highest flag scores


def test_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, None, None)], "id long, media string, label int")
    got = etl.mode_impute(df, ["media", "label"]).orderBy("id").collect()
    assert got[2].media == "a" and got[2].label is None


@pytest.mark.parametrize("n, page, want", [(0, 1, (0, 1)), (61, 9, (1, 3)), (61, 1, (30, 1))])
def test_pages(spark, n, page, want):
    got = views.page(spark.range(n).toDF("id"), ["id"], page).collect()
    assert (len(got), got[0].page if got else 1) == want


def test_page_cutoff(spark):
    pages = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 3, 0, 0, 7], 1)], "page int, n_new int")
    assert sorted(r.page for r in views.page_cutoff(pages).collect()) == [1, 2, 3, 4, 5]


def test_html(spark):
    body = "<div id='dic_area'><p>one</p><script>no()</script><div class='reporter_area'>me</div>two &amp; three</div>"
    assert html.body_text(body) == "one two & three" and html.body_text(None) == "" and html.body_text("<p>x") == ""
    page = "<div class='list_body'><ul class='type06'><li><dl><dt class='photo'><a href='/p'><img src='i.jpg'></a></dt><dt><a href='/a'> A <b>b</b></a></dt><dd><span class='lede'>s</span><span class='date'>9:10</span></dd></dl></li></ul><ul class='type06_headline'><li><a href='/h'>H</a></li></ul></div>"
    assert html.listing_rows(page) == [("H", "/h", None, "", "알 수 없음", None), ("Ab", "/a", "i.jpg", "s", "알 수 없음", "9:10")]
    df = spark.createDataFrame([("https://x.example/q", "<a href='//y.example/1'>1</a><a href='/2'>2</a><a href='/2'>2</a>")], "url string, html string")
    assert html.links(df).first().links == ["https://y.example/1", "https://x.example/2"]
    assert df.select(html.absolute_links("html", "https://x.example").alias("h")).first().h.count("https://") == 3
