"""Page model: which lines of a crawled page belong to the page around the article.

Template deduction by equivalence classes. The unit is a *line token*: a line after masking of digits
and addresses. Over the pages of one host each token has an occurrence vector; tokens with the same vector
are one class. A class is valid if it is frequent, its lines keep their order on the pages, and it does not
interleave with another class; valid classes are nested (a class lies in a slot between two lines of its
parent, or of the page as a whole) and form the host's template. What is left on a page fills the slots
after template lines. Slots that hold next to no sentence are slots of the page; in all others the words of
an open line decide, by their log odds between page slots and article.

The statistics are small tables: template lines per host, page counts per host, classes and slots per host,
and log odds of hashed word tokens (a fixed 2**18 buckets whatever the corpus).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.session import cut, maybe_broadcast

BUCKETS = 1 << 18
#: A line is constant if it has at least this many different pages and this share of its host's pages.
#: Lines that end like a sentence need more, since sentences of articles recur by chance.
LEAST_PAGES, SHARE_OPEN, SHARE_SENTENCE = 8, 0.002, 0.022
#: Share of a line's pages that must differ in their anchor, and of the places that must be taken; copies of one
#: article, edited or not, fall below one of them.
LEAST_VARIETY, LEAST_SPOTS = 0.5, 0.2
#: A line that is too rare by itself joins with its class: one of at least this many lines on this many different pages.
CLASS_LINES, CLASS_PAGES = 3, 8
#: Share of its pages on which a class must keep its order and its place; share of sentences up to which a slot is the page's.
VALID_SHARE, SLOT_SENTENCES, SLOT_LINES = 0.9, 0.01, 8
#: Beyond this many template lines the shuffled path is taken instead of a broadcast.
MOST_KEYS = 500_000

#: Word log odds from which a sentence in a slot of the page belongs to the page.
SENTENCE_ODDS = 1.5
#: Prior log odds of an open line by what stands before it: page start, constant, page slot, sentence, open body line.
PRIOR = {"^": -0.3, "c": 0.5, "x": 0.7, "s": -0.95, "y": -0.95}

_EDGE = re.compile(r"^[\s\-–—·•▶▷►☞■□◆◇●○▲△※*>]+")
_MAIL = re.compile(r"[\w.+\-]+@[\w.\-]+")
_DIGITS = re.compile(r"\d[\d.,]*")
_SPACE = re.compile(r"\s+")
_TERM = re.compile(r"[.!?。！？．｡]['\"”’»›」』)）\]】]*\s*$")
_HAN = re.compile("[一-鿿]")
_WORD = re.compile(r"[a-zà-öø-ÿßœ]+|[가-힣ᄀ-ᇿ]+|[぀-ヿ]+|[一-鿿]|#|[^\w\s]")


def url_host(url: str) -> F.Column:
    """Host of a url in lower case, without the usual leading labels; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?i)^\s*https?://(?:www\.|m\.|news\.|amp\.)*([^/?#:\s]+)", 1))


def site_of(url: str, media: str) -> F.Column:
    """Host of the page; the trimmed media where there is no url."""
    host = url_host(url)
    return F.coalesce(F.when(host != "", host), F.lower(F.trim(F.col(media))), F.lit(""))


def mask(line: str) -> str:
    s = unicodedata.normalize("NFKC", line).casefold()
    s = _MAIL.sub("@", s) if "@" in s else s
    return _SPACE.sub("", _DIGITS.sub("#", _EDGE.sub("", s)))


def _h64(s: str) -> int:
    b = s.encode("utf-8", "surrogatepass")
    return ((zlib.crc32(b) << 32) | zlib.adler32(b[::-1]) ^ (len(b) << 20 & 0xFFFFFFFF)) - (1 << 63)


def mask_inner(part: str) -> str:
    """Mask of a part of a line between blanks, its beginning left as it is."""
    s = unicodedata.normalize("NFKC", part).casefold()
    s = _MAIL.sub("@", s) if "@" in s else s
    return _SPACE.sub("", _DIGITS.sub("#", s))


def key_of_masked(tail: str) -> int:
    """Key of the line whose masked parts are put together in ``tail``."""
    return _h64(_EDGE.sub("", tail))


def key_of(line: str) -> int:
    """64-bit key of a masked line."""
    return _h64(mask(line))


def host_part(host: str) -> int:
    return zlib.crc32(host.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15


def site_key(host: str, key: int) -> int:
    return (host_part(host) ^ key) & 0xFFFFFFFFFFFFFFFF


def finished(line: str) -> bool:
    return bool(_TERM.search(line))


class Memo(dict):
    """Bounded cache of line features; lines of a site recur all the time."""

    def __init__(self, f, most: int = 200_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, k):
        if len(self) >= self.most:
            self.clear()
        v = self[k] = self.f(k)
        return v


def words(line: str) -> list[str]:
    """Word tokens with the edges marked; numbers are one token; Han text gives character pairs."""
    s = _DIGITS.sub("#", unicodedata.normalize("NFKC", line).casefold())
    t = _WORD.findall(s.strip())
    out = ["^" + t[0], t[-1] + "$"] if t else []
    if not _HAN.search(s):
        return out + t
    for a, b in zip(t, t[1:] + [""]):
        out.append(a + b if len(a) == 1 and "一" <= a <= "鿿" and b else a)
    return out


_bucket = Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1))


def buckets(line: str) -> list[int]:
    return [_bucket[w] for w in words(line)]


def split_lines(content: str | None) -> list[str]:
    return [] if content is None else content.split("\n")


# ---------------------------------------------------------------------------------------------- fitting


def _line_tokens(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, key, anchor, sentence, spot, page) once per page and line token.

    Two names of the page tell different articles apart: the anchor is its longest other line, the spot one
    of 64 places for a min-hash of its three longest other lines. Copies of an article share at least one.
    """
    memo = Memo(lambda s: (key_of(s), finished(s)))
    for pdf in parts:
        hosts, keys, anchors, ends, spots, pages = [], [], [], [], [], []
        for host, content, page in zip(pdf["host"], pdf["content"], pdf["page"]):
            ls = [x for x in map(str.strip, split_lines(content)) if x]
            if len(ls) < 2:
                continue
            long = [memo[x][0] for x in sorted(ls, key=len)[:-5:-1]]
            for k, e in {memo[x] for x in ls}:
                others = [x for x in long if x != k] or [k]
                hosts.append(host), keys.append(k), anchors.append(others[0]), ends.append(e), pages.append(page)
                spots.append(1 << ((min(x ^ k for x in others[:3]) ^ k) % 64))
        yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "key": np.array(keys, "int64"), "anchor": np.array(anchors, "int64"), "sentence": np.array(ends, bool), "spot": np.array(spots, "uint64").view("int64"), "page": np.array(pages, "int64")})


def line_tokens(pages: DataFrame) -> DataFrame:
    """Occurrence vectors of the line tokens of each host: (host, key, sentence, pages, contexts, spots, vector).

    ``vector`` is the exclusive-or of the hashes of all pages the token stands on, so tokens with equal
    occurrence vectors share it. Both aggregations combine before the shuffle, so a frequent line is no hot key.
    """
    rows = pages.filter("content is not null").select("host", "content", F.xxhash64("id", "content").alias("page"))
    toks = rows.mapInPandas(_line_tokens, "host string, key long, anchor long, sentence boolean, spot long, page long")
    once = toks.groupBy("host", "key", "anchor", "sentence").agg(F.count("*").alias("n"), F.bit_or("spot").alias("spot"), F.bit_xor("page").alias("page"))
    return once.groupBy("host", "key", "sentence").agg(F.sum("n").alias("pages"), F.count("*").alias("contexts"), F.bit_count(F.bit_or("spot")).alias("spots"), F.bit_xor("page").alias("vector"))


def class_tokens(pages: DataFrame) -> DataFrame:
    """Tokens of the frequent classes of each host: (host, key, sentence, pages, cls, n_lines, alone).

    ``cls`` names the equivalence class; ``alone``: the token is frequent enough without its class.
    """
    totals = pages.filter("content is not null").groupBy("host").agg(F.count("*").alias("host_pages"))
    share = F.when(F.col("sentence"), F.lit(SHARE_SENTENCE)).otherwise(F.lit(SHARE_OPEN))
    differ = (F.col("contexts") >= LEAST_VARIETY * F.col("pages")) & (F.col("spots") >= LEAST_SPOTS * F.least("pages", F.lit(64)))
    tokens = cut(line_tokens(pages).filter((F.col("contexts") >= min(CLASS_PAGES, LEAST_PAGES)) & differ).withColumn("cls", F.xxhash64("host", "vector", "pages")))
    sizes = tokens.groupBy("cls").agg(F.count("*").cast("int").alias("n_lines"))
    alone = (F.col("contexts") >= LEAST_PAGES) & (F.col("contexts") >= share * F.col("host_pages"))
    out = tokens.join(totals, "host").join(sizes, "cls").withColumn("alone", alone)
    return out.filter((F.col("alone") | ((F.col("n_lines") >= CLASS_LINES) & (F.col("contexts") >= CLASS_PAGES)))).select("host", "key", "sentence", "pages", "cls", "n_lines", "alone")


def known_of(known) -> dict[int, tuple[int, int]]:
    """Positions of template lines as ``Marker._known`` gives them, with class and slot."""
    return {} if known is None else {int(x["n"]): (int(x["cls"]), int(x["slot"])) for x in known}


class Model:
    """Broadcast part of the page model: template lines with their class and slot, and word log odds.

    ``slot`` of a template line: 1 if what follows it belongs to the page. ``cls`` is 0 for a class of one line.
    """

    def __init__(self, keys: np.ndarray, cls: np.ndarray, slot: np.ndarray, shared: np.ndarray, odds: np.ndarray | None = None):
        self.keys, self.cls, self.slot, self.shared, self.odds = keys, cls, slot, shared, odds
        self._sets()

    def _sets(self) -> None:
        self.key_set = dict(zip(self.keys.tolist(), zip(self.cls.tolist(), self.slot.tolist())))
        self.shared_set = set(self.shared.tolist())
        self.memo = Memo(lambda s: (key_of(s), finished(s)))
        self.odds_memo = Memo(self._odds)
        self.hosts = Memo(host_part)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("keys", "cls", "slot", "shared", "odds")}

    def __setstate__(self, d):
        self.__dict__.update(d)
        self._sets()

    def _odds(self, line: str) -> float:
        if self.odds is None:
            return 0.0
        v = self.odds[buckets(line)]
        v = v[v != 0]
        return float(2 * v.mean()) if len(v) else 0.0

    def read(self, host: str, lines: list[str], known: dict[int, tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
        """(kind, class, slot) of each line: b blank, c template line, s sentence, o open (no sentence end)."""
        out, own = [], self.hosts[host]
        for i, x in enumerate(lines):
            x = x.strip()
            if not x:
                out.append(("b", 0, 0))
                continue
            k, e = self.memo[x]
            hit = known.get(i) if known is not None else self.key_set.get((own ^ k) & 0xFFFFFFFFFFFFFFFF)
            if hit is None and k in self.shared_set:
                hit = (0, 0)
            out.append(("s" if e else "o", 0, 0) if hit is None else ("c", *hit))
        return out

    def marks(self, host: str, lines: list[str], known: dict[int, tuple[int, int]] | None = None) -> list[int]:
        """-1 blank, 0 body, 1 page around the body."""
        read = self.read(host, lines, known)
        out, prev, slot = [], "^", 0
        alone = sum(k != "b" for k, _, _ in read) == 1
        for x, (k, _, at) in zip(lines, read):
            if k == "b":
                out.append(-1)
                continue
            if k == "c":
                site, prev, slot = True, "c", at
            elif k == "s":
                # a sentence leaves a slot of the page unless its words belong there
                site = bool(slot) and not alone and self.odds_memo[x.strip()] > SENTENCE_ODDS
                prev, slot = ("x", slot) if site else ("s", 0)
            else:
                site = not alone and (bool(slot) or self.odds_memo[x.strip()] + PRIOR[prev] > 0)
                prev = "x" if site else "y"
            out.append(int(site))
        return out


def _nesting(found: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(class, order of its lines on this page, parent) of the classes of several lines on one page.

    ``found`` has (class, key) of the template lines in order. The parent is the innermost class that goes on
    around all lines of a class, 0 for the page, -1 if it interleaves with another one.
    """
    first, last, order = {}, {}, {}
    for i, (c, k) in enumerate(found):
        first.setdefault(c, i)
        last[c] = i
        order[c] = (order.get(c, 0) * 0x100000001B3 + k) & 0x7FFFFFFFFFFFFFFF
    for c in order:
        parent, width = 0, 1 << 30
        for d in order:
            if d != c and first[d] < last[c] and last[d] > first[c]:
                inside = first[d] < first[c] and last[d] > last[c] and len({sum(1 for e, _ in found[:i] if e == d) for i, (e, _) in enumerate(found) if e == c}) == 1
                around = first[c] < first[d] and last[c] > last[d]
                if inside and last[d] - first[d] < width:
                    parent, width = d, last[d] - first[d]
                elif not inside and not around:
                    parent, width = -1, -1
        yield c, order[c], parent


def _slot_counts(model, wide: bool = False):
    """What the template of the frequent classes leaves: rows (what, host, a, b, n, m), combined per task.

    words: bucket a, n tokens in the article, m in variable slots of the page; order: class a, order b, n pages;
    nest: class a, parent b, n pages; slot: template line a, n sentences, m open lines after it.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value if hasattr(model, "value") else model
        memo = Memo(buckets)
        body, site = np.zeros(BUCKETS, "int64"), np.zeros(BUCKETS, "int64")
        counts: dict[tuple, list[int]] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, *v) for k, v in counts.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=["what", "host", "a", "b", "n", "m"])

        for pdf in parts:
            in_body, in_site = [], []
            for host, content, known in zip(pdf["host"], pdf["content"], pdf["known"] if wide else pdf["host"]):
                lines = split_lines(content)
                prev, after, found = "^", 0, []
                read = m.read(host, lines, known_of(known) if wide else None)
                if sum(k != "b" for k, _, _ in read) < 3:
                    continue
                for x, (k, cls, _) in zip(lines, read):
                    if k == "b":
                        continue
                    if k == "c":
                        prev, after = "c", m.memo[x.strip()][0]
                        if cls:
                            found.append((cls, after))
                        continue
                    if after:
                        at = counts.setdefault(("slot", host, after, 0), [0, 0])
                        at[k == "o"] += 1
                        if k == "s":
                            after = 0  # the rest is the article's
                    if k == "s" or prev in "sy":
                        in_body.extend(memo[x.strip()])
                        prev = "s" if k == "s" else "y"
                    else:
                        in_site.extend(memo[x.strip()])
                        prev = "x"
                for cls, order, parent in _nesting(found) if found else ():
                    counts.setdefault(("order", host, cls, order), [0, 0])[0] += 1
                    counts.setdefault(("nest", host, cls, parent), [0, 0])[0] += 1
            body += np.bincount(np.array(in_body, "int64"), minlength=BUCKETS)
            site += np.bincount(np.array(in_site, "int64"), minlength=BUCKETS)
            if len(counts) > 200_000:
                yield flush()
        yield flush()
        some = np.flatnonzero(body + site)
        yield pd.DataFrame({"what": "words", "host": "", "a": some, "b": 0, "n": body[some], "m": site[some]})

    return run


def word_odds(counts: DataFrame) -> np.ndarray:
    """Log odds that a word token belongs to a slot of the page rather than to the article (2**18 buckets), counted on all pages."""
    got = counts.filter("what = 'words'").toPandas()
    body, site = np.zeros(BUCKETS), np.zeros(BUCKETS)
    body[got["a"]], site[got["a"]] = got["n"], got["m"]
    kinds = max(1, len(got))
    pb, ps = (body + 0.5) / (body.sum() + 0.5 * kinds), (site + 0.5) / (site.sum() + 0.5 * kinds)
    odds = np.clip(np.log(ps / pb), -3, 3)
    odds[body + site < 5] = 0
    return odds.astype("float32")


def valid_classes(counts: DataFrame) -> DataFrame:
    """(cls, valid, parent) of the classes of several lines: order and place are the same on nearly all their pages."""
    n = F.sum("n").alias("pages")
    top = counts.filter("what in ('order', 'nest')").groupBy("what", F.col("a").alias("cls")).agg(n, F.max("n").alias("most"), F.max_by("b", "n").alias("best"), F.sum(F.when(F.col("b") == -1, F.col("n")).otherwise(0)).alias("crossed"))
    of = lambda what: F.max(F.when(F.col("what") == what, F.struct("pages", "most", "best", "crossed")))
    both = top.groupBy("cls").agg(of("order").alias("o"), of("nest").alias("t"))
    ordered = F.col("o.most") >= VALID_SHARE * F.col("o.pages")
    apart = F.col("t.crossed") <= (1 - VALID_SHARE) * F.col("t.pages")
    parent = F.when((F.col("t.most") >= VALID_SHARE * F.col("t.pages")) & (F.col("t.best") != -1), F.col("t.best")).otherwise(0)
    return both.select("cls", (ordered & apart).alias("valid"), parent.alias("parent"))


def pages_of(news: DataFrame, *more: str) -> DataFrame:
    """The columns the page model needs; other columns of the input are left out and cannot clash.

    A page without a usable url takes the most usual host of its media, else the media itself, else ''.
    """
    host, media = site_of("url", "media"), F.lower(F.trim("media"))
    known = news.select(media.alias("_m"), url_host("url").alias("_h")).filter("_m is not null and _m not in ('', 'unknown') and _h != ''")
    usual = known.groupBy("_m", "_h").agg(F.count("*").alias("n")).groupBy("_m").agg(F.max_by("_h", F.struct("n", "_h")).alias("_h"))
    usual = cut(usual)
    usual = maybe_broadcast(usual, usual.count())
    base = news.select("id", host.alias("_host"), url_host("url").alias("_u"), media.alias("_m"), "content", *[c for c in more if c not in ("id", "content")])
    out = base.join(usual, "_m", "left")
    return out.select("id", F.when((F.col("_u") == "") & F.col("_h").isNotNull(), F.col("_h")).otherwise(F.col("_host")).alias("host"), "content", *[c for c in more if c not in ("id", "content")])


class Marker:
    """Fitted page model bound to a session; ``apply`` runs a Python function over marked pages.

    ``template`` has the lines of the valid classes of each host: (host, key, cls, slot, parent, n_lines, pages, sentence).
    """

    def __init__(self, pages: DataFrame, most_keys: int | None = None):
        self.most_keys = MOST_KEYS if most_keys is None else most_keys
        tokens = class_tokens(pages)
        one = F.col("n_lines") == 1
        # classes of one line have neither order nor place
        self._take(tokens.withColumn("cls", F.when(one, 0).otherwise(F.col("cls"))).withColumn("slot", F.lit(0)))
        counts = self._known(pages) if self.wide else pages
        counts = counts.select("host", "content", *["known"] * self.wide).filter("content is not null").mapInPandas(_slot_counts(self.model, self.wide), "what string, host string, a long, b long, n long, m long")
        counts = cut(counts.groupBy("what", "host", "a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
        classes = valid_classes(counts)
        slots = counts.filter("what = 'slot'").select("host", F.col("a").alias("key"), (((F.col("n") + F.col("m")) >= SLOT_LINES) & (F.col("n") <= SLOT_SENTENCES * (F.col("n") + F.col("m")))).cast("int").alias("slot"))
        valid = F.coalesce("valid", F.lit(False))
        template = (
            self.constants.drop("slot").join(classes, "cls", "left").filter(F.col("alone") | valid).join(slots, ["host", "key"], "left")
            .select("host", "key", F.when(valid, F.col("cls")).otherwise(0).alias("cls"), F.coalesce("slot", F.lit(0)).alias("slot"), F.coalesce("parent", F.lit(0)).alias("parent"), "n_lines", "pages", "sentence", "alone")
        )
        self._take(template, word_odds(counts))
        self.template = self.constants

    def _take(self, constants: DataFrame, odds: np.ndarray | None = None) -> None:
        """Template lines and those shared by hosts, as a model where they are few enough."""
        self.constants = cut(constants)
        self.shared = self.constants.filter("alone").groupBy("key").agg(F.count("*").alias("hosts")).filter("hosts >= 3").select("key")
        self.wide = self.constants.count() > self.most_keys
        table = [np.zeros(0, t) for t in ("uint64", "int64", "int8", "int64")]
        if not self.wide:
            got = self.constants.select("host", "key", "cls", "slot").toPandas()
            keys = np.array([site_key(h, k) for h, k in zip(got["host"], got["key"])], "uint64")
            table = [keys, got["cls"].to_numpy("int64"), got["slot"].to_numpy("int8"), self.shared.toPandas()["key"].to_numpy("int64")]
        self.model = constants.sparkSession.sparkContext.broadcast(Model(*table, odds))

    def constant(self, pages: DataFrame, keys_of, name: str) -> DataFrame:
        """Pages with the numbers of those keys that are constant on their host or shared by hosts, found by a join.

        ``keys_of`` gives (number, key) for a page row. Pages are told apart by all they hold, since ids
        may be null or repeat.
        """

        def keys(parts):
            for pdf in parts:
                out = [(row.page, row.host, n, k) for row in pdf.itertuples(index=False) for n, k in keys_of(row)]
                yield pd.DataFrame(out, columns=["page", "host", "n", "key"]).astype({"page": "int64", "n": "int32", "key": "int64"})

        pages = pages.withColumn("page", F.xxhash64("host", "content"))
        at = pages.filter("content is not null").dropDuplicates(["page"]).mapInPandas(keys, "page long, host string, n int, key long")
        hit = at.join(self.constants.select("host", "key", "cls", "slot"), ["host", "key"]).select("page", "n", "cls", "slot")
        hit = hit.unionByName(at.join(self.shared, "key", "left_semi").select("page", "n", F.lit(0).cast("long").alias("cls"), F.lit(0).alias("slot")))
        hit = hit.groupBy("page", "n").agg(F.max(F.struct("cls", "slot")).alias("x")).groupBy("page").agg(F.collect_list(F.struct("n", "x.cls", "x.slot")).alias(name))
        return pages.join(hit, "page", "left").drop("page")

    def _known(self, pages: DataFrame) -> DataFrame:
        """Shuffled path: positions of constant lines found by a join, without any broadcast."""
        memo = Memo(key_of)
        return self.constant(pages, lambda row: ((n, memo[x.strip()]) for n, x in enumerate(split_lines(row.content)) if x.strip()), "known")

    def apply(self, pages: DataFrame, make, schema: str, finish=None) -> DataFrame:
        """``make(model)`` gives a function of one page row (namedtuple with ``marks`` and ``lines``) yielding output tuples.

        ``finish`` turns the tuples of a batch into those of the schema.
        """
        wide, model = self.wide, self.model
        if wide:
            pages = self._known(pages)
        names = [x.strip().split(" ")[0] for x in schema.split(",")]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m: Model = model.value
            rows_of = make(m)
            for pdf in parts:
                out = []
                for row in pdf.itertuples(index=False):
                    lines = split_lines(row.content)
                    known = None
                    if wide:
                        known = known_of(row.known)
                    out.extend(rows_of(row, lines, m.marks(row.host, lines, known)))
                yield pd.DataFrame(finish(out) if finish else out, columns=names)

        return pages.mapInPandas(run, schema)
