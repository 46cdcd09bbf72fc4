import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkcred.llm import boilerplate, components, history, language, leakage, mixing, near_duplicates, new_batches, pages, repeated_lines, small_world, splitting, tokenizer, truncation
from sparkcred import session
from sparkcred.session import table

DATA = "/root/testdata/sf0.001"
NEWS = "id long, title string, content string, media string, url string, summary string, lang string, batch_no int"
WORDS = "river council bridge market harbor school winter budget ferry museum library teacher quota signal farmer garden engine letter window silver".split()


def news(spark, rows):
    """Rows of (id, {column: value}), with further columns whose names operators use inside."""
    cols = [c.split(" ")[0] for c in NEWS.split(", ")]
    df = spark.createDataFrame([tuple(r.get(c) if c != "id" else i for c in cols) for i, r in rows], NEWS)
    return df.withColumns({"host": F.lit("x"), "key": F.lit(1), "band": F.lit(2), "n": F.lit(3), "row": F.lit(4), "doc": F.lit(5), "a": F.lit(6), "v": F.lit("v")})


def body(rng, n=6):
    return "\n".join(" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(10)).capitalize() + "." for _ in range(n))


def site(spark, n=60, seed=1):
    """Pages of two hosts with constant lines around different bodies."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        m = i % 2
        top, end = ("Skip to content\nMenu one", f"Copyright {2000 + i} Paper {m}. All rights reserved.\nShare this {i}")
        rows.append((i, {"content": f"{top}\n\n{body(rng)}\n{end}", "media": f"Paper {m}", "url": f"https://www.paper{m}.example/a/{i}", "title": f"Title number {i} of {rng.choice(WORDS)}", "batch_no": 0}))
    return rows


ODD = [
    (1000, {"content": None, "media": None}), (1001, {"content": "", "media": "Unknown"}), (1002, {"content": " \n\r\n ", "media": " ", "url": "", "title": "", "summary": ""}),
    (1003, {"content": "x", "url": "not a url", "title": "!!", "batch_no": 3}), (1003, {"content": "x", "url": "not a url", "title": "!!", "batch_no": 3}), (1004, {"content": "one word " * 20_000, "media": "Paper 0", "batch_no": 1}), (None, {"content": "y", "batch_no": 1}),
]


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------------------------------------ problem 6


def test_boilerplate_and_shuffled_path(spark):
    rows = site(spark)
    df = news(spark, rows + ODD)
    want = sorted((i, n) for i, r in rows for n, x in enumerate(r["content"].split("\n"), 1) if x.startswith(("Skip", "Menu", "Copyright", "Share")))
    assert [p for p in pairs(boilerplate.boilerplate_lines(df)) if p[0] is not None and p[0] < 1000] == want
    assert [p for p in pairs(boilerplate.boilerplate_lines(df, most_keys=0)) if p[0] is not None and p[0] < 1000] == want
    got = {r.id: r.body for r in boilerplate.bodies(df).collect()}
    assert got[1000] is None and got[1001] == "" and "Copyright" not in got[0] and got[0].count("\n") == 5
    assert boilerplate.boilerplate_lines(news(spark, [])).count() == 0
    assert boilerplate.templates(df).count() > 0


def test_copies_are_no_template(spark):
    rng = random.Random(4)
    copy = body(rng)
    rows = site(spark) + [(500 + i, {"content": copy, "media": "Paper 0", "url": f"https://paper0.example/c/{i}"}) for i in range(40)]
    assert not [p for p in pairs(boilerplate.boilerplate_lines(news(spark, rows))) if p[0] >= 500]


# ------------------------------------------------------------------------------------------------ problem 5


def naive_repeated(rows, least):
    docs = collections.defaultdict(set)
    letters = lambda x: "".join(c for c in x if c.isalpha()).upper().lower()
    lines = []
    for d, (i, r) in enumerate(rows):
        if r.get("content") is not None and (r.get("media") or "").strip(" "):
            for n, x in enumerate(r["content"].split("\n"), 1):
                if letters(x):
                    docs[r["media"].strip(" "), letters(x)].add(d)
                    lines.append((i, n, r["media"].strip(" "), letters(x)))
    return sorted((i, n) for i, n, m, k in lines if len(docs[m, k]) >= least)


def test_repeated_lines(spark):
    rng = random.Random(7)
    rows = [(i, {"content": "\n".join(rng.choice(["A line!", "a LINE", "b 1", "b 22", "12", "", "only " + "xyz"[i % 3], "c" * (i + 1)]) for _ in range(6)), "media": rng.choice(["m", " m ", "k", None, ""])}) for i in range(60)]
    df = news(spark, rows + [rows[0]] + ODD[:5])
    assert pairs(repeated_lines.repeated_lines(df, 5)) == naive_repeated(rows + [rows[0]] + ODD[:5], 5)
    assert repeated_lines.repeated_lines(news(spark, [])).count() == 0
    clean = {r.id: r for r in repeated_lines.without_repeated(df, 5).collect()}
    assert clean[1000].content is None and clean[1000].n_removed == 0
    found = set(naive_repeated(rows + [rows[0]] + ODD[:5], 5))
    assert clean[5].content == "\n".join(x for n, x in enumerate(rows[5][1]["content"].split("\n"), 1) if (5, n) not in found)


def test_ranges_of_suffixes_against_all_prefixes():
    rng = random.Random(2)
    records = [[1, *(rng.choice((5, 6)) for _ in range(rng.randint(1, 6)))] for _ in range(60)]
    prefixes, rows = collections.Counter(), []
    for r in records:
        own = r[1:]
        prefixes.update({(1, *own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)})
        rows += [([1, *own[i:]], n) for i, n in enumerate(repeated_lines.fresh_from(own))]
    rows.sort()
    ranges = [repeated_lines.Range([s for s, _ in part], np.array([n for _, n in part])) for part in (rows[:40], rows[40:41], rows[41:90], rows[90:])]
    edges = collections.Counter()
    for r in ranges:
        for block, n in r.edges():
            edges[block] += n
    got = {b: n for r in ranges for b, n in r.blocks(edges, 10)}
    assert got and all(prefixes[b] == n for b, n in got.items())
    # every frequent prefix is one of the blocks or goes on in all its occurrences
    assert all(p in got or any(prefixes[p + (c,)] == n for c in (5, 6)) for p, n in prefixes.items() if n >= 10)
    reach = np.concatenate([r.reach(edges, 10) for r in ranges])
    for (suffix, _), k in zip(rows, reach):
        assert k == max([d for d in range(1, len(suffix)) if prefixes[tuple(suffix[: d + 1])] >= 10], default=0)


# ------------------------------------------------------------------------------------------------ problem 3


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = body(rng, 5)
        rows.append((i * 10, {"content": text, "title": "t"}))
        if i % 2:
            words = text.split(" ")
            for k in range(rng.randint(0, 14)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((i * 10 + 1, {"content": " ".join(words).upper(), "media": "m"}))
        if i % 7 == 0:
            rows.append((i * 10 + 2, {"content": text}))
    sets = {i: set(near_duplicates.grams(near_duplicates.alnum(r["content"])).tolist()) for i, r in rows}
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))
    df = news(spark, rows + ODD)
    assert len(want) > 20 and [p for p in pairs(near_duplicates.near_pairs(df)) if p[1] < 1000] == want
    groups = {r.id: r.group_id for r in near_duplicates.near_groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    assert near_duplicates.near_pairs(news(spark, [])).count() == 0


def test_tiles_skip_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, rng.integers(30, 300)).astype("uint64")) for _ in range(40)]
    sets += [np.unique(np.r_[s[: int(len(s) * 0.9)], rng.integers(0, 1 << 60, 5).astype("uint64")]) for s in sets]
    bits = np.array([np.frombuffer(near_duplicates.bitmap(s), "uint64") for s in sets])
    pop, size = np.bitwise_count(bits).sum(axis=1).astype("int32"), np.array([len(s) for s in sets])
    out = near_duplicates.tile_pairs(np.arange(len(sets)), bits, pop, size, np.zeros(len(sets), int), 0.6)
    got = {tuple(sorted(p)) for a, b in out for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = np.intersect1d(sets[i], sets[j]).size
            if both >= 0.6 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got


def test_large_bucket_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 4)
    rng = random.Random(5)
    text = body(rng, 6)
    # one host each, so that only the tiles are at work
    rows = [(i, {"content": text + " " + "".join(rng.choice("qwertz") for _ in range(6)), "url": f"https://h{i}.example/"}) for i in range(30)]
    assert len(pairs(near_duplicates.near_pairs(news(spark, rows)))) == 30 * 29 // 2


def test_tiles_of_buckets_in_one_pass():
    rng = random.Random(8)
    members = [sorted(rng.sample(range(1000), n)) for n in (1, 2, 2, 30, 1, 9, 300, 1)]
    members += [members[3], members[1]]
    rows = [(i, band) for band, ids in enumerate(members) for i in ids]
    for size in (1, 7, 64, len(rows)):
        parts = (pd.DataFrame(rows[k : k + size], columns=["id", "band"]) for k in range(0, len(rows), size))
        got = pd.concat(near_duplicates._tiles(16)(parts))
        for band, own in got.groupby("band"):
            assert sorted(i for ids in own["ids"] for i in ids) == members[band] and set(own["n"]) == {len(members[band])}
            assert all(len(own) == 1 for _ in [0] if len(members[band]) <= 16)
        assert sorted(set(got["band"])) == [b for b, ids in enumerate(members) if len(ids) > 1]
        who = got.groupby("band")["who"].first()
        assert who[3] == who[8] and who[1] == who[9] and who[1] != who[2]
        assert [sorted(x) for x in got[got["band"] == 6].sort_values("t")["ids"]] != [members[6]]


def test_buckets_are_shuffled_once(spark, monkeypatch):
    bands, shuffled = [], near_duplicates._tiles
    monkeypatch.setattr(near_duplicates, "_tiles", lambda tile: bands.append(tile) or shuffled(tile))
    joins = []
    monkeypatch.setattr(near_duplicates, "cut", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString()) or session.cut(df))
    assert near_duplicates.near_pairs(news(spark, [(i, {"content": body(random.Random(i % 9))}) for i in range(18)])).count() == 9
    assert len(bands) == 1 and not any(line.lstrip(" :+-").startswith("Join") and "band" in line for plan in joins for line in plan.split("\n"))


def test_signatures_of_a_batch_equal_those_of_each_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh\U0001f600가") for _ in range(n)) for n in (5, 6, 150, 700, 1100)]
    for t, (bits, pop, size, bands) in zip(texts, near_duplicates.signatures_of(texts)):
        g = near_duplicates.grams(t)
        assert bits == near_duplicates.bitmap(g) and size == len(g) and pop == np.bitwise_count(np.frombuffer(bits, "uint8")).sum()
        x = (g >> np.uint64(32)).astype("uint32")
        least = (near_duplicates._A[:, None] * x + near_duplicates._B[:, None]).min(axis=1).reshape(near_duplicates.BANDS, near_duplicates.ROWS)
        for n, m in enumerate(least.tolist(), 1):
            h = n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            for v in m:
                h = (h ^ v) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
                h ^= h >> 29
            assert bands[n - 1] & 0xFFFFFFFFFFFFFFFF == h


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and len(got) == 43
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------------------------------ problem 1


def test_language_accuracy_on_held_out_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").toPandas()
    model = language.fit(table(spark, DATA, "documents"))
    rows = [(t, x) for t, x in zip(docs.text, docs.lang) if isinstance(x, str) and len(t) > 40][:400]
    score, size = model.scores([language.normal(t) for t, _ in rows])
    assert np.mean([model.languages[int(s.argmax())] == x for s, (_, x) in zip(score, rows)]) > 0.97
    got = model.posterior(score)
    assert np.allclose(got.sum(axis=1), 1)


def test_kneser_ney_is_a_distribution():
    model = language.KneserNey({"en": ["abab abba baab", "abc cab"], "fr": ["aaa bbb ccc"]}, ("en", "fr"), 3)
    chars = " abc"
    for ctx in ("ab", " a", "zz"):
        x = np.array([ord(ctx[0]) << 32 | ord(ctx[1]) << 16 | ord(w) for w in chars], "uint64")
        assert (np.exp(model._rows(x, 3)).sum(axis=0) <= 1 + 1e-4).all()
        assert (np.exp(model._rows(x, 3)).sum(axis=0) > 0.6).all()


def test_language_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["ko", " KOR ", "ko-KR", "en_US", "Japanese", "und", "", None, "n/a", "es-419"]], "x string")
    assert [r.c for r in df.select(language.label_code(F.col("x")).alias("c")).collect()] == ["ko", "ko", "ko", "en", "ja", None, None, None, None, "es"]


def test_language_cases(spark):
    ko = "현장에서는 통신망 복구 때문에 차분한 반응이 이어졌고 대책을 온라인으로 공개했다."
    en = "The decision affects about nine thousand people because demand fell faster than expected."
    rows = [(1, {"content": ko, "lang": "ko"}), (2, {"content": ko, "lang": "en"}), (3, {"content": f"{ko}\n\n{en}", "lang": "ko"}), (4, {"content": en, "lang": None}), (5, {"content": "Kinkinna Lulekdu " + ko, "lang": "ko"})]
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = pairs(language.language_cases(news(spark, rows + ODD[:4]), docs))
    assert [g for g in got if g[0] < 1000] == [(2, 0, "ko"), (3, 1, "ko"), (3, 3, "en"), (4, 0, "en")]
    conf = {(r.id, r.line_no): r for r in language.languages(news(spark, rows + ODD[:4]), docs).collect()}
    assert conf[1, 0].confidence > 0.9 and conf[1001, 0].lang == "und" and (1000, 0) not in conf
    assert language.language_cases(news(spark, []), docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ problem 2


def test_truncation(spark):
    rng = random.Random(9)
    rows = site(spark, 80, 3)
    full = body(rng, 3)
    cut = full[: len(full) // 2 - 3]
    rows += [(300, {"content": full, "summary": full.split(".")[0]}), (301, {"content": cut, "summary": full.split("\n")[0][:40] + "..."}), (302, {"content": full + " …", "summary": full.split("\n")[0]})]
    got = pairs(truncation.truncated(news(spark, rows + ODD)))
    assert (301, "content") in got and (301, "summary") in got
    assert not [g for g in got if g[0] in (300, 302) or g[0] < 80]
    shares = truncation.shares(news(spark, rows)).collect()
    assert sum(r.records for r in shares) == 83 + 3
    assert truncation.truncated(news(spark, [])).count() == 0


def test_prefix_order_against_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(20)]
    values = [b[: rng.randint(15, 60)] + rng.choice(["", ".", ".xy"]) for b in base for _ in range(12)]
    rows = [(i, v.rstrip("."), not v.endswith("."), False) for i, v in enumerate(values)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {r.row: r.verdict for r in truncation._prefix_verdicts(spark.createDataFrame(rows, "row long, v string, open boolean, guess boolean").repartition(5)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, v, is_open, _ in rows:
        longer = sorted(w for _, w, _, _ in rows if w.startswith(v) and len(w) > len(v))
        if is_open:
            assert got[i] == (None if not longer else int(longer[0][len(v)] != ".")), v


# ------------------------------------------------------------------------------------------------ problem 4


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("https://news.x.example/article/400", "http://M.X.example/%61rticle/400/?utm_source=f#top", True), ("https://www.x.example/view?oid=1&aid=2", "https://x.example/view?aid=2&oid=1&ref=home", True),
        ("https://x.example/view?aid=2", "https://x.example/view?aid=3", False), ("https://x.example/a", "https://y.example/a", False), ("https://x.example/a.html", "https://x.example/a.htm%6C", True), ("", "", False), (None, None, False), ("https://x.example/", "https://x.example", False),
    ],
)
def test_url_keys(spark, a, b, same):
    x, y = (r.k for r in spark.createDataFrame([(a,), (b,)], "u string").select(new_batches.url_key("u").alias("k")).collect())
    assert (x is not None and x == y) == same


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Bank opens new branch in Lulavel", "UPDATE 1 - Bank opens new branch in Lulavel (updated) | The Paper", True), ("Bank opens new branch", "Bank opnes new branch", True), ("Bank opens new branch", "Bank opens neew branch - video", True),
        ("Weekly note no. 137: the flood maps", "Weekly note no. 138: the flood maps", False), ("Bank opens branch in Lulavel", "Bank opens branch in Lutavel", False), ("“절대 물러서지 않겠다” 재개", "[속보] &quot;절대 물물러서지 않겠다&quot; 재개 (종합)", True), ("Bank opens", "Museum closes", False),
    ],
)
def test_headlines(a, b, same):
    x, y = new_batches.headline(a), new_batches.headline(b)
    assert (x == y or new_batches.same_headline(x, y)) == same


def test_batches(spark):
    rng = random.Random(8)
    title = lambda: " ".join(rng.choice(WORDS) + rng.choice("abcd") + rng.choice("xyz") for _ in range(7))
    rows, want = [], []
    for i in range(150):
        t = title()
        rows.append((i, {"title": t, "url": f"https://x.example/a/{i}", "batch_no": 0}))
        if i % 3 == 0:
            k = rng.randrange(3, len(t) - 3)
            rows.append((1000 + i, {"title": t[:k] + t[k + 1 :], "url": f"https://x.example/b/{i}", "batch_no": 1 + i % 12}))
            want.append((i, 1000 + i))
        if i % 5 == 0:
            rows.append((2000 + i, {"title": title(), "url": f"http://m.x.example/a/{i}/#top", "batch_no": 2}))
            want.append((i, 2000 + i))
    rows += [(5000, {"title": rows[0][1]["title"], "url": None, "batch_no": None}), (5001, {"title": " ", "url": " ", "batch_no": 1}), (5002, {"title": " ", "url": " ", "batch_no": 2}), (None, {"title": "x y z w", "batch_no": 1})]
    got = pairs(new_batches.known_articles(news(spark, rows)))
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert new_batches.known_articles(news(spark, [])).count() == 0
    ids = new_batches.article_ids(news(spark, rows))
    assert ids.count() == len({i for i, _ in rows if i is not None})


def test_small_world_recall():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (1500, 4)).astype("uint64")
    near = base.copy()
    near[:, 0] ^= np.uint64(1) << rng.integers(0, 63, 1500).astype("uint64")
    bits, hashes = np.concatenate([base, near]), np.tile(np.arange(1500, dtype="int64"), 2)[:, None]
    g = small_world.SmallWorld(bits, np.concatenate([hashes, hashes], 1))
    beam = g.tune(np.concatenate([hashes, hashes], 1), 4)
    found, dist = g.search(base, beam, np.concatenate([hashes, hashes], 1)[:1500])
    exact = [set(np.flatnonzero(small_world.distances(b[None], bits) <= 4)) for b in base[:200]]
    hit = sum(len(e & set(f.tolist())) for e, f in zip(exact, found))
    assert hit >= 0.9 * sum(map(len, exact))


# ------------------------------------------------------------------------------------------------ problem 7


def test_automaton_against_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    auto = leakage.Automaton(texts)
    for _ in range(50):
        doc = "".join(rng.choice("abcd") for _ in range(80))
        for a, b, items in auto.matches(doc, 3):
            part = doc[a:b]
            assert items == sum(1 << k for k, t in enumerate(texts) if part in t)
            assert b == len(doc) or not any(doc[a : b + 1] in t for t in texts)
            assert a == 0 or not any(doc[a - 1 : b] in t for t in texts)


def test_leaks(spark):
    rng = random.Random(10)
    item = body(rng, 6).replace("\n", " ")
    words = item.split(" ")
    altered = " ".join("zzz" if i % 9 == 4 else w for i, w in enumerate(words))
    docs = [
        (1, "before " + item.upper().replace(" ", "  ") + " after"), (2, body(rng) + " " + altered[: int(len(altered) * 0.7)]), (3, item[: int(len(item) * 0.3)]),
        (4, body(rng)), (5, None), (6, ""), (7, " ".join(words[:20]) + " " + body(rng, 3) + " " + " ".join(words[40:50])), (8, "ａ" + item),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(9), "share": F.lit(1)})
    e = spark.createDataFrame([(1, item, None), (2, None, "x"), (3, "!!", "y")], "item_id long, text string, answer string")
    assert pairs(leakage.leaked_pairs(d, e)) == [(1, 1), (1, 2), (1, 8)]
    clean = {r.doc_id: r for r in leakage.without_leaks(d, e, most_removed=1.0).collect()}
    assert clean[1].text.split() == ["before", "after"] or clean[1].text.startswith("before ")
    assert leakage.leaked_pairs(d, e.limit(0)).count() == 0 and leakage.leaked_pairs(d.limit(0), e).count() == 0


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    rng = random.Random(12)
    items = [(i, body(rng, 4)) for i in range(5)]
    d = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    assert pairs(leakage.leaked_pairs(d, spark.createDataFrame(items, "item_id long, text string"))) == [(i, i) for i in range(5)]


# ------------------------------------------------------------------------------------------------ problem 8


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, body(rng, rng.randint(1, 6)), rng.choice(["a", " A ", "b", "c"])) for i in range(300)] + [(900, None, "a"), (901, "", "b"), (902, body(rng), None), (903, body(rng), "not listed"), (5, body(rng, 1), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"tokens": F.lit(1), "step": F.lit(2), "uses": F.lit(3)})
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.4, 2), ("d", 0.1, 5)], "source string, target_share double, max_repeats int")
    sz = tokenizer.sizer()
    total = 9000
    chosen = mixing.selection(docs, targets, total_tokens=total).collect()
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.uses <= caps[r.source] for r in chosen)
    size = {(i, t): sz.count(t) for i, t, _ in rows if t}
    assert all(r.tokens in {n for (i, _), n in size.items() if i == r.doc_id} for r in chosen)
    got = {r.source: r for r in mixing.report(docs, targets, total_tokens=total).collect()}
    for s, share in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        have = sum(n for (i, t), n in size.items() for j, u, src in rows if (i, t) == (j, u) and src and src.strip().lower() == s)
        want = min(round(share * total), have * caps[s])
        assert want - 60 <= got[s].used_tokens <= want and got[s].used_tokens == sum(r.tokens * r.uses for r in chosen if r.source == s)
    assert got["d"].used_tokens == 0 and got["d"].shortfall_tokens == 900 and got["not listed"].used_tokens == 0
    assert pairs(mixing.selection(docs, targets, total_tokens=total)) == sorted(tuple(r) for r in chosen)
    assert mixing.selection(docs.limit(0), targets).count() == 0 and mixing.report(docs.limit(0), targets).count() == 4


def test_heavy_weights_come_first(spark):
    good, poor = " ".join(f"{w}{i}" for i, w in enumerate(WORDS)), "- - - 1 1 1 " * 12
    docs = spark.createDataFrame([(i, good if i % 2 else poor, "a") for i in range(400)], "doc_id long, text string, source string")
    s = mixing.sized(docs).toPandas().sort_values("sort_key").head(100)
    assert (s.doc_id % 2).mean() > 0.6


# ------------------------------------------------------------------------------------------------ problem 9


@pytest.mark.parametrize("kind", ["words", "no_blank", "hangul", "lines", "emoji", "empty"])
def test_pieces_cover_the_text(kind):
    rng = random.Random(1)
    text = {
        "words": body(rng, 60), "no_blank": "".join(rng.choice("abcxyz") for _ in range(4000)), "hangul": "가나다라마바사 " * 600,
        "lines": "\n".join("x" * rng.randint(0, 30) for _ in range(300)), "emoji": "👩‍🚀🧪" * 500, "empty": "",
    }[kind]
    sz = tokenizer.sizer()
    cuts = splitting.pieces_of(text, 200, 20, sz)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for s, e, n in cuts:
        assert n <= 200 and n == (sz.count(text[s:e]) if text else 0)
    for (s, e, _), (t, f, _) in zip(cuts, cuts[1:]):
        assert s < t <= e < f and abs(sz.count(text[t:e]) - 20) <= 8
    if kind == "words":
        assert all(text[:e].rstrip()[-1] in ".!?" or e == len(text) for _, e, _ in cuts)


def test_oversized(spark):
    rng = random.Random(1)
    rows = [(1, body(rng, 40)), (2, "short"), (3, None), (4, ""), (1, body(rng, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "piece_no": F.lit(2)})
    limit = spark.createDataFrame([("w", 300, 30)], "limit_name string, max_tokens int, overlap_tokens int")
    assert pairs(splitting.oversized(docs, limit)) == [(1,), (1,)]
    assert splitting.pieces(docs, limit.limit(0)).count() == 0 and splitting.pieces(docs.limit(0), limit).count() == 0
    assert all(r.n_tokens <= 300 for r in splitting.pieces(docs, limit).collect())


def test_same_mask():
    assert pages.mask(" ▶ Share  this (12,345)") == pages.mask("share this (9)") and pages.key_of("ab") != pages.key_of("ac")


def test_word_odds_count_every_page(spark, monkeypatch):
    monkeypatch.setattr(pages, "FIT_PAGES", 5, raising=False)
    rng = random.Random(21)
    rows = [(i, {"url": f"https://a.example/{i}", "content": ("Zyx qwv jkp\n" if i % 6 == 0 else "") + body(rng, 4)}) for i in range(40)]
    odds = pages.Marker(pages.pages_of(news(spark, rows))).model.value.odds
    assert all(odds[b] > 0 for b in pages.buckets("Zyx qwv jkp"))


def test_item_matches_against_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    auto = leakage.Automaton(texts)
    for _ in range(50):
        doc = "".join(rng.choice("abcd") for _ in range(80))
        got = {(a, b, k) for a, b, items in auto.item_matches(doc, 3) for k in range(6) if items >> k & 1}
        spans = [(a, b, k) for k, t in enumerate(texts) for a in range(78) for b in range(a + 3, 81) if doc[a:b] in t]
        want = {(a, b, k) for a, b, k in spans if (b == 80 or doc[a : b + 1] not in texts[k]) and (a == 0 or doc[a - 1 : b] not in texts[k])}
        assert got == want


def test_matches_of_one_item_are_those_of_all_items_read_alone():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(7)]
    auto = leakage.Automaton(texts)
    for _ in range(60):
        doc = "".join(rng.choice("abcd" if rng.random() < 0.2 else "abc") for _ in range(120))
        for k in range(7):
            assert auto.matches_of(doc, k, 4) == [(a, b) for a, b, items in auto.item_matches(doc, 4) if items >> k & 1]


@pytest.mark.parametrize("table", [1 << 22, 1 << 6])
def test_runs_that_may_count_against_sorted_positions(monkeypatch, table):
    monkeypatch.setattr(leakage.Seeds, "TABLE", table)
    rng = random.Random(7)
    phrases = ["".join(rng.choice(WORDS) for _ in range(3)) for _ in range(12)]
    texts = ["".join(rng.choice(phrases) + rng.choice("qwxyz") for _ in range(rng.randint(3, 9))) for _ in range(15)]
    docs = ["".join(rng.choice(phrases) if rng.random() < 0.6 else rng.choice(texts)[: rng.randint(5, 90)] + "j" * rng.randint(0, 40) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    seeds, want = leakage.Seeds(texts), []
    chained = []
    chains = leakage.Seeds.chains
    monkeypatch.setattr(leakage.Seeds, "chains", lambda self, *a: chained.append(chains(self, *a)) or chained[-1])
    for d, doc in enumerate(docs):
        for k, t in enumerate(texts):
            places = collections.defaultdict(list)
            for p in range(len(t) - 7):
                places[t[p : p + 8]].append(p)
            hits = [p for p in range(len(doc) - 7) if doc[p : p + 8] in places]
            for run in np.split(hits, np.flatnonzero(np.diff(hits) > 32) + 1) if hits else []:
                held = len({q for p in run.tolist() for q in range(p, p + 8)})
                own = len({q for p in run.tolist() for x in places[doc[p : p + 8]] for q in range(x, x + 8)})
                if min(held, own) >= seeds.need[k] - 1e-9:
                    want.append((d, k, int(run[0]), int(run[-1]) + 8))
    assert len(want) > 20 and sorted(seeds.candidates(docs)) == want and any(x is not None and not x.all() for x in chained)


def test_items_that_share_text(spark):
    rng = random.Random(22)
    shared, one, two = (body(rng, n).replace("\n", " ") for n in (6, 2, 2))
    items = spark.createDataFrame([(1, shared + " " + one), (2, shared + " " + two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, shared + " " + two), (2, one)], "doc_id long, text string")
    assert pairs(leakage.leaked_pairs(docs, items)) == [(1, 1), (2, 1)]


def test_contexts_are_counted_on_every_page(spark, monkeypatch):
    monkeypatch.setattr(truncation, "FIT_PAGES", 5, raising=False)
    rng = random.Random(23)
    rows = [(i, {"url": f"https://a.example/{i}", "content": body(rng, 4) + (f"\nRare w{chr(97 + i)}x ended here." if i < 12 else "")}) for i in range(60)]
    rows.append((100, {"url": "https://a.example/100", "content": body(rng, 4), "summary": "Some other ended here"}))
    assert (100, "summary") not in pairs(truncation.truncated(news(spark, rows)))


def test_ends_inside_a_word_are_no_ends_however_often_they_recur(spark):
    rng = random.Random(27)
    said = "The council spoke about maintenance today and left."
    rows = [(i, {"url": f"https://a.example/{i}", "content": body(rng, 2) + " " + " ".join([said] * 20) + " Cars use the main road."}) for i in range(30)]
    ends = [(100 + i, {"url": f"https://a.example/{100 + i}", "content": body(rng, 2) + " The council spoke about main"}) for i in range(4)]
    closed = [(200 + i, {"url": f"https://a.example/{200 + i}", "content": body(rng, 2) + " Notes by the desk of main"}) for i in range(4)]
    got = pairs(truncation.truncated(news(spark, rows + ends + closed)))
    assert got == [(i, "content") for i, _ in ends]


def test_contexts_of_many_lines_against_a_loop(monkeypatch):
    rng = random.Random(28)
    lines = [" ".join(rng.choice(["a", "B.", "of", "office", "offices", "12", "3.5", "(x)", "end.", "?", "''", "가나다", "가나", "“of”"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    monkeypatch.setattr(truncation, "asked_for", lambda bits, keys: np.ones(keys.shape, bool))
    monkeypatch.setattr(truncation, "TOKENS_AT_ONCE", 200)
    model = type("M", (), {"value": type("N", (), {"marks": lambda self, host, lines, known: [0] * len(lines)})()})()
    pdf = pd.DataFrame({"host": "h", "content": ["\n".join(lines[k : k + 5]) for k in range(0, 300, 5)]})
    got = pd.concat(truncation._count_contexts(model, type("B", (), {"value": None})(), False)(iter([pdf[:30], pdf[30:], pdf[:0]])))
    want, loose = collections.defaultdict(lambda: [0, 0, 0]), set()
    for x in lines:
        sentences = list(truncation._sentences(truncation.tokens(x)))
        for n, s in enumerate(sentences, 1):
            for k in range(len(s)):
                a, b, c = (["^", "^", *s][k + j] for j in range(3))
                key = lambda c: truncation.context_keys(*np.array([[truncation._token_hash(t)[0]] for t in (a, b, c)], "uint64"))[:, 0].tolist()  # noqa: B023, E731
                if k == len(s) - 1 and n == len(sentences):
                    loose |= {(v, pages.key_of(x)) for j, v in enumerate(key(c)) if j != 4 and (j != 2 or truncation._token_hash(c)[1])}
                    continue
                for v in key(c):
                    want[v][0] += 1
                    want[v][1] += k == len(s) - 1
                for m in range(1, len(c) if c[0].isalpha() else 0):
                    for v in key(c[:m])[:2]:
                        want[v][2] += 1
    own = got[got["line"] == 0].groupby("key")[["total", "ends", "longer"]].sum()
    assert dict(zip(own.index.tolist(), own.to_numpy().tolist())) == want
    assert set(zip(*(got[got["line"] != 0][c].tolist() for c in ("key", "line")))) == loose


def test_context_counts_against_a_loop(spark):
    rows = [(i, {"url": f"https://a.example/{i}", "content": "One two three. One two five.\nMany two three."}) for i in range(5)]
    marker = pages.Marker(p := pages.pages_of(news(spark, rows)))
    values = spark.createDataFrame([(truncation.end_keys("One two three"),), (truncation.end_keys("Many two"),), (truncation.end_keys("five five"),), (truncation.end_keys("zzz"),)], "keys array<long>")
    got = {r.ctx: r.cut for r in truncation._guesses(marker, p, values).collect()}
    assert got == {truncation.end_keys(t)[0]: c for t, c in [("One two three", False), ("Many two", True), ("five five", False), ("zzz", True)]}


def test_shuffled_path_agrees(spark, monkeypatch):
    rows = site(spark, 48, 5)
    for i, r in rows[:6]:
        r["content"] = r["content"].replace(f"\nCopyright {2000 + i}", f"\nThe end of it is Copyright {2000 + i}").replace("\nShare this", " Share this")
        r["content"] += "\nOther notice" * (i % 2)
    for i, r in rows[6:12]:
        r["content"] = "\n".join(r["content"].split("\n")[:-2]) + " Menu one"
    df, docs = news(spark, rows + ODD), table(spark, DATA, "documents")
    marks = lambda: pages.Marker(pages.pages_of(df)).model.value.odds
    queries = [lambda: pairs(truncation.judged(df)), lambda: pairs(boilerplate.boilerplate_lines(df).filter("id is not null")), lambda: pairs(near_duplicates.near_pairs(df)), lambda: pairs(language.language_cases(df, docs).filter("id is not null"))]
    odds, want = marks(), [q() for q in queries]
    monkeypatch.setattr(pages.Marker.__init__, "__defaults__", (0,))
    assert (marks() == odds).all()
    for q, w in zip(queries, want):
        assert q() == w


def test_templated_headlines_fill_no_beam(spark):
    import pandas as pd

    rng = random.Random(24)
    keys = [f"dailymarketreportfortheharbordistrictnumber{n:04d}" for n in range(600)]
    pick = rng.sample(range(600), 40)
    keys += [keys[k].replace("harbor", "harbour").replace("report", "repport") for k in pick]
    bits, route = new_batches.title_bits(keys)
    got = new_batches._segment(pd.DataFrame({
        "id": range(len(keys)), "batch_no": 0, "title_key": keys, "bits": [b.tobytes() for b in bits], "rings": list(new_batches.rings(route)[:, 0]), "part": 0, "home": 0,
    }))
    assert set(zip(got["a"], got["b"])) >= {(k, 600 + n) for n, k in enumerate(pick)}


def test_history_is_not_indexed_again_with_every_merge(monkeypatch):
    rng = random.Random(31)
    keys = ["".join(rng.choice("abcdefghijklmnop") for _ in range(24)) for _ in range(1000)]
    batch = [0] * 600 + [1 + k // 10 for k in range(400)]
    for n in range(0, 1000, 25):
        keys[n] = keys[n // 2 + 1][:11] + keys[n // 2 + 1][12:]
    bits, route = new_batches.title_bits(keys)
    indexed, build = [], new_batches.SmallWorld
    monkeypatch.setattr(new_batches, "SmallWorld", lambda b, h: indexed.append(len(b)) or build(b, h))
    got = new_batches._segment(pd.DataFrame({
        "id": range(len(keys)), "batch_no": batch, "title_key": keys, "bits": [b.tobytes() for b in bits], "rings": list(new_batches.rings(route)[:, 0]), "part": 0, "home": 0,
    }))
    links = set(zip(got["a"], got["b"]))
    want = {(n // 2 + 1, n) for n in range(25, 1000, 25)}
    assert len(want & links) >= 0.92 * len(want)
    assert len(indexed) > 40 and sum(indexed) < 3 * len(keys)


@pytest.mark.parametrize("n", [1, 2, 300, 512])
def test_small_shards_are_compared_as_a_whole(n):
    rng = np.random.default_rng(n)
    bits, hashes = rng.integers(0, 1 << 63, (n, 4)).astype("uint64"), rng.integers(0, 1 << 60, (n, 2))
    bits[n // 2 :] = bits[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 63, (n - n // 2, 4)).astype("uint64"))
    bits[-1] = ~bits[0]
    g = small_world.SmallWorld(bits, hashes)
    g.tune(hashes, 16)
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype="int64")
    assert (small_world.distances(bits[:, None], bits[None]) == apart).all()
    assert sorted(zip(*(x.tolist() for x in g.within(bits, 16, hashes)))) == sorted(zip(*(x.tolist() for x in np.nonzero(apart <= 16))))


def test_history_batch_by_batch_equals_all_at_once(spark, tmp_path):
    df = table(spark, DATA, "realtime_news").select("id", "title", "media", "url", F.least("batch_no", F.lit(3)).alias("batch_no"))
    df = df.unionByName(spark.createDataFrame([(9_000_001, None, None, None, 2), (9_000_002, " ", "x", "", 3), (None, "t", "m", "u", 1)], df.schema)).withColumn("h", F.lit(1))
    outlets = frozenset(r[0] for r in df.select(F.lower(F.trim("media"))).filter("media is not null and trim(media) <> ''").distinct().collect())
    store = history.History(spark, str(tmp_path / "store"), segments=2, compact_every=2)
    last = df.agg(F.max("batch_no")).first()[0]
    for n in range(last + 1):
        got = store.accept(df.filter(F.col("batch_no") == n), n, outlets)
        if n == last:
            again = pairs(got)
            assert pairs(store.accept(df.filter(F.col("batch_no") == n), n, outlets)) == again  # a repeated attempt
    whole = {(r.node, r.component) for r in new_batches.articles(df).collect()}
    assert whole == {(r.node, r.component) for r in store.labels(last + 1).collect()} and whole
    # merged shards hold what they replace
    live = store.shards(last + 1)
    assert live.groupBy("route", "segment", "part").count().agg(F.max("count")).first()[0] <= 2
    assert store.accept(df.limit(0), last + 1, outlets).count() == 0


def test_outlet_names_by_join_equal_those_by_list(spark):
    df = spark.createDataFrame([(1, 0, "Bridge opens early - The Post", "Other"), (2, 0, "Bridge opens - early - Nobody", "The Post"), (3, 1, "[New] Bridge opens early – the post (1)", None), (4, 1, "", "x")], "id long, batch_no int, title string, media string")
    outlets = spark.createDataFrame([("the post",), ("other",)], "m string")
    narrow, wide = (sorted(map(tuple, new_batches.headlines(df, outlets, most).collect())) for most in (10, 0))
    assert narrow == wide and narrow[0][2] == "bridgeopensearly"
