"""Problem 4: deduplicating new batches against all history.

Addresses are brought to one form and joined. Titles are stripped of what is not part of the headline;
equal ones are joined too, and the rest is found by graph search: a title is a 256-bit map of its letter
pairs; it is routed by three min-hashes to three segments, and each segment keeps navigable small-world
graphs: one of the history, a new one for each batch, and every few batches these are merged into one, with
every older one that is not more than twice as large. Beams are widened until sampled searches agree with an exhaustive one; a title whose beam
ends within the radius is compared with its whole shard. Candidates within the radius are reranked exactly by edits. Links carry on through connected components.

The number of segments follows the number of titles and a title visits three of them, so a batch costs its
own size and not that of the history.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.llm.components import components
from sparkcred.llm.pages import url_host
from sparkcred.llm.small_world import SmallWorld
from sparkcred.session import cut, maybe_broadcast

BITS, ROUTES, SEGMENT_TITLES, RADIUS = 256, 3, 12_000, 16
#: Batch shards of a segment that are searched side by side before they are merged.
COMPACT_EVERY = 8
LEAST_TITLE = 4

#: Labels before a headline, and query parameters that only track a visit.
LABELS = ("update", "updated", "breaking", "exclusive", "live", "urgent", "watch", "direct", "exclusif", "alerte", "última hora", "urgente", "exclusiva", "en directo", "directo", "eilmeldung", "eil", "exklusiv", "独家", "快讯", "速报", "速報", "独自", "更新", "단독", "속보", "종합")
TRACKING = ("utm_[a-z]+", "fbclid", "gclid", "ref", "from", "igshid", "mc_cid", "mc_eid", "yclid", "msclkid", "spm")

_TAG_FRONT = re.compile(r"^\s*(?:[\[(【〔［（][^\])】〕］）]{1,16}[\])】〕］）]\s*)+(?=\S)")
_TAG_BACK = re.compile(r"\s*[\[(【〔［（][^\])】〕］）]{1,16}[\])】〕］）]\s*$")
_LABEL = re.compile(r"^\s*(?:" + "|".join(LABELS) + r")(?:\s*\d+)?\s*[:：|｜\-–—]\s*")
_MEDIA_BAR = re.compile(r"\s*(?:\||｜|::|：：)\s*[^|｜]{1,40}$")
_DASH = re.compile(r"\s+[-–—]\s+([^-–—]{1,40})$")
_FRONT = re.compile(r"^\s*([^:：|｜]{5,16})\s*[:：|｜]\s*(?=\S)")
_KINDS = {"video", "vídeo", "vidéo", "영상", "동영상", "動画", "视频", "audio", "photo", "photos", "live"}
_NOT_ALNUM = re.compile(r"[\W_]+")


def url_key(url: str) -> F.Column:
    """One form of an address: host without leading labels, decoded path without end slashes, sorted identifying parameters.

    Null, blank and addresses without a path give null.
    """
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    decoded = lambda x: F.coalesce(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x)
    path = F.regexp_replace(decoded(F.regexp_extract(u, r"(?i)^https?://[^/?]+([^?]*)", 1)), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(" + "|".join(TRACKING) + ")(=|$)"))
    key = F.concat_ws("?", F.concat(url_host(url), path), F.nullif(F.array_join(F.array_sort(F.transform(params, decoded)), "&"), F.lit("")))
    return F.when((url_host(url) != "") & ((path != "") | (F.size(params) > 0)), key)


def headline(title: str, media: str | None = None, known: frozenset[str] = frozenset()) -> str:
    """Letters and digits of the headline itself, without tags, labels and the name of the outlet."""
    s = unicodedata.normalize("NFKC", html.unescape(html.unescape(title))).casefold().strip()
    own = unicodedata.normalize("NFKC", media).casefold().strip() if media else None
    while True:
        t = _TAG_BACK.sub("", _LABEL.sub("", _TAG_FRONT.sub("", s)))
        t = _MEDIA_BAR.sub("", t)
        m = _DASH.search(t)
        if m and (m[1].strip() == own or m[1].strip() in _KINDS or m[1].strip() in known):
            t = t[: m.start()]
        m = _FRONT.match(t)
        if m and any(same_headline(m[1].strip(), x, 1) for x in LABELS if len(x) > 6):
            t = t[m.end() :]
        if not t.strip() or t == s:
            return _NOT_ALNUM.sub("", s if not t.strip() else t)
        s = t


def same_headline(a: str, b: str, edits: int = 2) -> bool:
    """Whether two stripped headlines differ only by dropped, doubled, added or swapped characters.

    Replaced characters make another name, and digits must agree, so those headlines are different.
    """
    if [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return False

    def close(x: str, y: str, k: int) -> bool:
        i = 0
        while i < len(x) and i < len(y) and x[i] == y[i]:
            i += 1
        x, y = x[i:], y[i:]
        if not x and not y:
            return True
        if k == 0 or abs(len(x) - len(y)) > k:
            return False
        return bool(
            x and close(x[1:], y, k - 1) or y and close(x, y[1:], k - 1)
            or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and close(x[2:], y[2:], k - 1)
        ) and not (len(x) == len(y) and _replaced(x, y))

    nfd = lambda s: unicodedata.normalize("NFD", s)
    return close(a, b, edits) or close(nfd(a), nfd(b), edits)


def _replaced(x: str, y: str) -> bool:
    """Whether one replaced character alone explains the difference (a deletion and an insertion at one place)."""
    return x[1:] == y[1:]


def title_bits(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bit maps [n, 4], min-hashes [n, ROUTES]) of the letter pairs of titles, in decomposed form."""
    bits = np.zeros((len(keys), BITS), "uint8")
    route = np.zeros((len(keys), ROUTES), "uint64")
    mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "uint64")
    for n, k in enumerate(keys):
        c = np.frombuffer((" " + unicodedata.normalize("NFD", k) + " ").encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
        two = (c[:-1] << np.uint64(21)) | c[1:]
        h = two * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        bits[n, (h % np.uint64(BITS)).astype("int64")] = 1
        three = (two[:-1] << np.uint64(21) | c[2:]) if len(c) > 2 else two
        g = three[:, None] * mult[None]
        g ^= g >> np.uint64(29)
        route[n] = (g * np.uint64(0xC4CEB9FE1A85EC53)).min(axis=0)
    return np.packbits(bits, axis=1).view("uint64"), route


#: Outlet names up to this number go to every task; beyond it the names a title may end with are joined.
MOST_OUTLETS = 20_000


def _keys(known: frozenset[str] | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            names = [known] * len(pdf) if known is not None else [() if x is None else set(x) for x in pdf["names"]]
            keys = [headline(t, m, k) for t, m, k in zip(pdf["title"], pdf["media"], names)]
            yield pd.DataFrame({"id": pdf["id"], "batch_no": pdf["batch_no"], "title_key": pd.Series([k if len(k) >= LEAST_TITLE else None for k in keys], dtype=object)})

    return run


def _folded(name: str) -> str:
    return unicodedata.normalize("NFKC", name).casefold()


def _endings(title: str) -> list[str]:
    """What a title may hold as the name of an outlet: every part between dashes, folded as in ``headline``."""
    s = _folded(html.unescape(html.unescape(title)))
    return list(dict.fromkeys(x.strip() for x in re.split(r"[-–—|｜\[\](){}【】〔〕［］（）]", s) if 0 < len(x.strip()) <= 40))


def headlines(titles: DataFrame, outlets: DataFrame, most: int | None = None) -> DataFrame:
    """(id, batch_no, title_key) of the titles with enough letters, without tags, labels and the names of the outlets (m)."""
    schema = "id long, batch_no int, title_key string"
    few = outlets.limit((MOST_OUTLETS if most is None else most) + 1).collect()
    if len(few) <= (MOST_OUTLETS if most is None else most):
        return titles.mapInPandas(_keys(frozenset(_folded(r.m) for r in few)), schema).filter("title_key is not null")

    def parts_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(h, x) for h, t in zip(pdf["h"], pdf["title"]) for x in _endings(t)]
            yield pd.DataFrame(out, columns=["h", "name"]).astype({"h": "int64"})

    def folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"name": [_folded(x) for x in pdf["m"]]})

    titles = titles.withColumn("h", F.xxhash64("title"))
    names = titles.select("h", "title").distinct().mapInPandas(parts_of, "h long, name string")
    found = names.join(outlets.mapInPandas(folded, "name string").distinct(), "name").groupBy("h").agg(F.collect_set("name").alias("names"))
    return titles.join(found, "h", "left").drop("h").mapInPandas(_keys(None), schema).filter("title_key is not null")


def _signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        bits, route = title_bits(list(pdf["title_key"]))
        yield pdf.assign(bits=[b.tobytes() for b in bits], routes=list(route.view("int64")), rings=[x.ravel() for x in rings(route)])


def rings(route: np.ndarray) -> np.ndarray:
    """[n, ROUTES, 2] sort keys: in its segment a title stands next to those that share two of its min-hashes."""
    half = route >> np.uint64(32)
    both = [[(half[:, r] << np.uint64(32)) | half[:, (r + k) % ROUTES] for k in (1, 2)] for r in range(ROUTES)]
    return np.array(both, "uint64").transpose(2, 0, 1).view("int64")


def kept(sizes: list[int], batches: list[int]) -> int:
    """How many of a segment's shards stay as they are; the others are merged into one.

    Nothing is merged before COMPACT_EVERY batch shards stand beside the first one. Then they are, with the older
    ones that are no more than twice as large, so a title is indexed again a logarithmic number of times and a
    batch does not cost a new graph of the history.
    """
    at = len(sizes)
    while at and batches[at - 1] == 1:
        at -= 1
    at = max(at, 1)
    if len(sizes) - at < COMPACT_EVERY:
        return len(sizes)
    while at and sizes[at - 1] <= 2 * sum(sizes[at:]):
        at -= 1
    return at


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Run one segment in the order of arrival: search all shards, then index the batch as a new shard."""
    pdf = pdf.sort_values(["batch_no", "id"], kind="stable")
    ids, batch, keys, mine = pdf["id"].to_numpy(), pdf["batch_no"].to_numpy(), pdf["title_key"].tolist(), pdf["part"].to_numpy() == pdf["home"].to_numpy()
    bits = np.frombuffer(b"".join(pdf["bits"]), "uint64").reshape(len(pdf), BITS // 64)
    hashes = np.array(pdf["rings"].tolist(), "int64")
    digits = pd.factorize(np.array(["".join(c for c in k if c.isdigit()) for k in keys], dtype=object))[0]
    shards: list[tuple[SmallWorld, np.ndarray, int]] = []  # graph, rows, batches it was merged from
    links: set[tuple[int, int]] = set()

    def build(rows: np.ndarray, batches: int) -> None:
        g = SmallWorld(bits[rows], hashes[rows])
        g.tune(hashes[rows], RADIUS)
        shards.append((g, rows, batches))

    def search(rows: np.ndarray) -> None:
        for g, own, _ in shards:
            x, y = g.within(bits[rows], RADIUS, hashes[rows])
            x, y = rows[x], own[y]
            alike = digits[x] == digits[y]  # others are different headlines
            for q, r in zip(x[alike].tolist(), y[alike].tolist()):
                if q != r and (min(q, r), max(q, r)) not in seen:
                    seen.add((min(q, r), max(q, r)))
                    if same_headline(keys[q], keys[r]):
                        links.add((int(min(ids[q], ids[r])), int(max(ids[q], ids[r]))))

    seen: set[tuple[int, int]] = set()
    for b in np.unique(batch):
        rows = np.flatnonzero(batch == b)
        own = rows[mine[rows]]
        if len(own):
            build(own, 1)  # the batch's own shard is searched too: copies inside one batch
        search(rows)
        keep = kept([len(r) for _, r, _ in shards], [n for *_, n in shards])
        if keep < len(shards):
            some = shards[keep:]
            del shards[keep:]
            build(np.concatenate([r for _, r, _ in some]), sum(n for *_, n in some))
    return pd.DataFrame(sorted(links), columns=["a", "b"]).astype("int64")


def headline_links(titles: DataFrame) -> DataFrame:
    """(a, b): links between the first records of different headlines that are the same but for small edits."""
    signed = cut(titles.mapInPandas(_signed, "title_key string, id long, batch_no int, bits binary, routes array<long>, rings array<long>"))
    n = signed.count()
    segments = max(1, -(-n // SEGMENT_TITLES))
    at = signed.select("id", "batch_no", "title_key", "bits", "rings", F.posexplode("routes").alias("route", "h"))
    at = at.withColumn("rings", F.slice("rings", F.col("route") * 2 + 1, 2))
    at = at.withColumn("segment", F.pmod(F.xxhash64("h", "route"), F.lit(segments)).cast("int"))
    # a segment that got far more than its share is cut into parts; its titles are searched in each of them
    parts = at.groupBy("route", "segment").agg(F.ceil(F.count("*") / (3 * SEGMENT_TITLES)).cast("int").alias("parts"))
    parts = cut(parts)
    at = at.join(maybe_broadcast(parts, parts.count()), ["route", "segment"])
    at = at.withColumn("home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    return at.groupBy("route", "segment", "part").applyInPandas(_segment, "a long, b long").distinct()


def articles(news: DataFrame) -> DataFrame:
    """(node, component) of every record that is the same article as another one, by address or headline."""
    base = news.filter("id is not null").select("id", F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"), "title", "media", url_key("url").alias("url_key"))
    outlets = base.select(F.lower(F.trim("media")).alias("m")).filter("m <> '' and m <> 'unknown'").distinct()
    titles = cut(headlines(base.filter("title is not null").select("id", "batch_no", "title", "media"), outlets))
    by_title = titles.groupBy("title_key").agg(F.min("id").alias("id"), F.min("batch_no").alias("batch_no"), F.count("*").alias("n"))
    by_title = cut(by_title)
    by_url = base.filter("url_key is not null").groupBy("url_key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("url_key", "a")
    url_links = base.select(F.col("id").alias("b"), "url_key").join(by_url, "url_key").select("a", "b")
    title_links = titles.select(F.col("id").alias("b"), "title_key").join(by_title.filter("n > 1").select("title_key", F.col("id").alias("a")), "title_key").select("a", "b")
    near = headline_links(by_title.select("title_key", "id", "batch_no"))
    return components(url_links.unionByName(title_links).unionByName(near).filter("a <> b"))


def known_articles(news: DataFrame) -> DataFrame:
    """(id_a, id_b): for each record of batch 1 or later that is an article already there, the earliest record of it.

    Null and blank urls and titles match nothing; a null batch counts as history; records without id are left out.
    """
    found = articles(news)
    late = news.filter("batch_no >= 1 and id is not null").select(F.col("id").alias("id_b")).distinct()
    return late.join(found, late.id_b == found.node).filter("component < id_b").select(F.col("component").alias("id_a"), "id_b")


def article_ids(news: DataFrame) -> DataFrame:
    """(id, article_id): one row per record; a record without any link is its own article."""
    ids = news.filter("id is not null").select("id").distinct()
    return ids.join(articles(news).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("article_id"))
