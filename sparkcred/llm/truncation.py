"""Problem 2: text cut off by field limits.

All values (article bodies and summaries) are normalised and put in one global order. A value that is a
strict prefix of a longer copy stands directly before its extensions, so one look at the next value tells
how the text goes on: with a sentence end (the value is finished, only its stop is missing) or inside a
sentence (it was cut). Values without a longer copy are decided by how their last words occur elsewhere:
contexts that usually go on are cut, contexts that usually end a sentence or a line are finished.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.llm.pages import Marker, Memo, Model, _TERM, key_of, key_of_masked, known_of, mask_inner, pages_of, split_lines
from sparkcred.session import cut

#: Least count of a context.
LEAST_COUNT = 3
#: Bits of the filter of contexts that some open end asks for, and tokens counted at once.
FILTER_BITS, TOKENS_AT_ONCE = 1 << 26, 1 << 20
#: Shares of a context's occurrences that end a sentence or line from which it counts as an end.
END_SHARE = 0.5
#: Ends of a context under this share of the longer words that begin like its token are cuts of such words.
CUT_SHARE = 0.01
#: Prefixes under this many characters prove nothing.
LEAST_PREFIX = 12

_MARK = re.compile(r"\s*(?:[\(\[（［]\s*(?:\.{2,}|…+|⋯+)\s*[\)\]）］]|\.{3,}|…+|⋯+|‥+)\s*$")
_CUT_MARKUP = re.compile(r"(?:<[^<>]{0,80}|&#?\w{0,8}|�)$")
_TOKEN = re.compile(r"\d[\d.,]*|[^\W\d_ぁ-ゟ一-鿿ァ-ヿ]+|[ァ-ヿ]+|[ぁ-ゟ一-鿿]|[^\w\s]")
_STOP = {".", "!", "?", "。", "！", "？", "｡"}
_DOT = re.compile(r"(?<=\d)[.,](?=\d)")
_STOPS = re.compile(r"[.!?。｡…]+")
_REST = re.compile(r"[^\w.]+|_+")


def value_of(text: str) -> str:
    """Letters, digits and sentence stops only, without case and width."""
    s = unicodedata.normalize("NFKC", html.unescape(text)).casefold()
    return _REST.sub("", _STOPS.sub(".", _DOT.sub("", s)))


def words_of(text: str) -> list[str]:
    """Tokens with their digits."""
    return _TOKEN.findall(unicodedata.normalize("NFKC", html.unescape(text)).casefold())


def tokens(text: str) -> list[str]:
    return ["#" if t[0].isdigit() else t for t in words_of(text)]


def _token_hash(t: str) -> tuple[int, bool]:
    """(64-bit hash, whether it closes a bracket or quote)."""
    b = t.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) << 32 | zlib.adler32(b), unicodedata.category(t[0]) in ("Pe", "Pf")


def _key(level: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, "uint64")
    for x in parts:
        h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h.view("int64")


def context_keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[5, n] keys of the contexts of tokens c after b after a: from the longest to the shortest, then those that leave the token itself open."""
    return np.array([_key(level, *parts) for level, parts in enumerate(((a, b, c), (b, c), (c,), (a, b), (b,)), 1)])


_START = _token_hash("^")[0]


def _beginnings(t: str) -> np.ndarray:
    """Hashes of the beginnings of a word that are shorter than the word."""
    some = [t[:n].encode("utf-8", "surrogatepass") for n in range(1, len(t))] if t[0].isalpha() else []
    return np.array([zlib.crc32(x) << 32 | zlib.adler32(x) for x in some], "uint64")


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys that occur, in order, and the sums of the counts of each."""
    if not len(key):
        return key, *counts
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], *(np.add.reduceat(n[order], first) for n in counts)


def end_keys(text: str) -> list[int] | None:
    """Keys of the contexts of the last token; None where the text has none after its last stop."""
    s = list(_sentences(tokens(text)))[-1]
    if not s:
        return None
    h = [_START, _START, *(_token_hash(t)[0] for t in s[-3:])]
    return context_keys(*np.array(h[-3:], "uint64")[:, None])[:, 0].tolist()


def _sentences(t: list[str]) -> Iterator[list[str]]:
    s: list[str] = []
    for i, x in enumerate(t):
        # a stop after a single letter is an initial
        if x in _STOP and not (s and len(s[-1]) == 1 and s[-1].isascii() and s[-1].isalpha()):
            yield s
            s = []
        else:
            s.append(x)
    yield s


def _count_contexts(model, asked: np.ndarray, wide: bool):
    """Counts of the contexts asked for (line 0), and one row per context that ends a line without a stop.

    Such lines are counted once however often their text recurs, and not for contexts of one word,
    which may be the first part of a longer word. ``longer`` counts the longer words that stand where the
    token of a context of several words would.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        names, hashes, kinds = [], [], []  # of the vocabulary; kind 1 a stop, 2 an initial, 3 a closing mark

        def code(t: str) -> int:
            t = "#" if t[0].isdigit() else t
            h, closes = _token_hash(t)
            names.append(t), hashes.append(h)
            kinds.append(1 if t in _STOP else 3 if closes else 2 if len(t) == 1 and t.isascii() and t.isalpha() else 0)
            return len(hashes) - 1

        vocabulary, begun = Memo(code, 1 << 60), Memo(lambda n: _beginnings(names[n]), 1 << 60)
        bits = asked.value
        codes, sizes, texts = [], [], []  # tokens of all lines, their number in each line, the lines

        def counted() -> pd.DataFrame:
            at, size = np.array(codes, "int64"), np.array(sizes, "int64")
            kind = np.array(kinds, "int8")[at]
            of_line = np.repeat(np.arange(len(size)), size)
            after = np.r_[False, (kind[:-1] == 2) & (of_line[1:] == of_line[:-1])][: len(at)]
            stop = (kind == 1) & ~after  # a stop after a single letter is an initial
            starts = np.r_[True, stop[:-1] | (of_line[1:] != of_line[:-1])][: len(at)]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            followed = np.r_[starts[1:], True][: len(at)]  # the last of its line, or a stop
            ends_line = followed & ~stop
            before_stop = np.r_[stop[1:] & ~starts[1:], False][: len(at)]
            h = np.array(hashes, "uint64")[at]
            b = np.where(place >= 1, np.r_[h[:1], h[:-1]][: len(h)], _START)
            a = np.where(place >= 2, np.r_[h[:2], h[:-2]][: len(h)], _START)
            inside, last = np.flatnonzero(~stop & ~ends_line), np.flatnonzero(ends_line)
            loose_a, loose_b, loose_c, closing = a[last], b[last], h[last], kind[last] == 3
            line = [key_of(texts[n]) or 1 for n in of_line[last].tolist()]
            codes.clear(), sizes.clear(), texts.clear()
            # each run of three tokens once, with its counts
            full = _key(1, a[inside], b[inside], h[inside])
            order = np.argsort(full, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(full[order]) != 0][: len(order)])
            n = np.diff(np.r_[first, len(order)])
            stops = np.add.reduceat(before_stop[inside][order].astype("int64"), first) if len(first) else first
            one_each = inside[order[first]]
            a, b, c, token = a[one_each], b[one_each], h[one_each], at[one_each]
            keys = context_keys(a, b, c)
            wanted = asked_for(bits, keys)
            each = lambda x: np.broadcast_to(x, wanted.shape)[wanted]
            key, total, n_ends = _summed(keys[wanted], each(n), each(stops))
            # longer words where a context is asked for that leaves its token open
            near = np.flatnonzero(wanted[4])
            some, which = np.unique(token[near], return_inverse=True)
            parts_of = [begun[x] for x in some.tolist()]
            size = np.array([len(x) for x in parts_of], "int64")
            many = size[which]
            from_ = np.repeat((np.cumsum(size) - size)[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = np.concatenate([*parts_of, np.zeros(0, "uint64")])[from_]
            of = np.repeat(near, many)
            part = np.concatenate([_key(1, a[of], b[of], begin), _key(2, b[of], begin)])
            ok = asked_for(bits, part)
            part, longer = _summed(part[ok], np.concatenate([n[of], n[of]])[ok])
            ends = context_keys(loose_a, loose_b, loose_c)
            loose = asked_for(bits, ends)
            loose[2] &= closing
            loose[4] = False
            lines = np.broadcast_to(np.array(line, "int64"), loose.shape)[loose]
            if len(hashes) > 400_000:
                vocabulary.clear(), begun.clear(), names.clear(), hashes.clear(), kinds.clear()
            none, one = np.zeros(len(part), "int64"), np.ones(len(lines), "int64")
            return pd.DataFrame({
                "key": np.r_[key, part, ends[loose]], "line": np.r_[np.zeros(len(key) + len(part), "int64"), lines], "total": np.r_[total, none, one],
                "ends": np.r_[n_ends, none, one], "longer": np.r_[np.zeros(len(key), "int64"), longer, 0 * one],
            }).astype("int64")

        for pdf in parts:
            for host, content, known in zip(pdf["host"], pdf["content"], pdf["known"] if wide else pdf["host"]):
                lines = split_lines(content)
                for x, mark in zip(lines, m.marks(host, lines, known_of(known) if wide else None)):
                    if mark != 0:
                        continue
                    found = words_of(x.strip())
                    codes.extend([vocabulary[t] for t in found])
                    sizes.append(len(found)), texts.append(x)
                if len(codes) >= TOKENS_AT_ONCE:
                    yield counted()
        yield counted()

    return run


def asked_for(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has the keys; one that has them all by chance is left out by the join."""
    at = keys & (FILTER_BITS - 1)
    return (bits[at >> 6] >> (at & 63).astype("uint64") & np.uint64(1)).astype(bool)


def judge(text: str) -> tuple[bool, bool, str, list[int] | None]:
    """(open, guess, text without the mark of omission, context keys): open if neither a sentence end nor markup decides it.

    The guess of an open end holds where its contexts say nothing: it is cut.
    """
    bare = _MARK.sub("", text.rstrip())
    if not bare:
        return False, False, bare, None
    if _CUT_MARKUP.search(bare):
        return False, True, bare, None
    if _TERM.search(bare):
        return False, False, bare, None
    keys = end_keys(bare)
    return True, keys is not None, bare, keys


_masked = Memo(mask_inner)


def _tails(last: str) -> Iterator[tuple[int, int]]:
    """(position of the blank before, key) of what may be a page line glued to the end of a line.

    A masked line is its masked words put together, so each word is masked once.
    """
    at, tail = len(last), ""
    for _ in range(24):
        end, at = at, last.rfind(" ", 0, at)
        if at <= 0 or len(last) - at > 160:
            break
        tail = _masked[last[at + 1 : end]] + tail
        yield at, key_of_masked(tail)


def body_end(m: Model, host: str, last: str, glued: set[int] | None = None) -> str:
    """The last body line without a page line glued to its end; ``glued`` has the positions found by a join."""
    own = m.hosts[host]
    for at, k in _tails(last):
        if (at in glued) if glued is not None else (own ^ k) & 0xFFFFFFFFFFFFFFFF in m.key_set or k in m.shared_set:
            return last[:at].rstrip()
    return last


def _with_glued(marker: Marker, pages: DataFrame) -> DataFrame:
    """Shuffled path: pages with the positions in their last body line at which a page line may be glued on."""
    model = marker.model

    def tails(row):
        lines = split_lines(row.content)
        body = [x.strip() for x, m in zip(lines, model.value.marks(row.host, lines, known_of(row.known))) if m == 0]
        return _tails(body[-1]) if body else ()

    return marker.constant(marker._known(pages), tails, "glued").drop("known")


def _guesses(marker: Marker, pages: DataFrame, values: DataFrame) -> DataFrame:
    """(ctx, cut) of the open ends of values by how their contexts go on in all pages; ctx is the key of the longest one.

    A filter of the contexts asked for (fixed size) spares the count of most others; what passes it is
    combined per task, summed and joined, so nothing grows with the corpus in memory.
    """
    spark = pages.sparkSession
    ends = values.filter("keys is not null").select("keys").distinct().select(F.col("keys")[0].alias("ctx"), F.posexplode("keys").alias("at", "key"))
    place = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = ends.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((key & {FILTER_BITS - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, "uint64")
    bits[words["w"].to_numpy("int64")] = words["b"].to_numpy("int64").view("uint64")
    wide = marker.wide
    pages = pages.filter("content is not null").select("id", "host", "content")
    pages = marker._known(pages).select("host", "content", "known") if wide else pages.select("host", "content")
    counts = (
        pages.mapInPandas(_count_contexts(marker.model, spark.sparkContext.broadcast(bits), wide), "key long, line long, total long, ends long, longer long")
        .groupBy("key", "line").agg(*[F.when(F.col("line") == 0, F.sum(c)).otherwise(F.max(c)).alias(c) for c in ("total", "ends", "longer")])
        .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", "ends", "longer")]).filter(F.col("total") + F.col("longer") >= LEAST_COUNT)
    )
    inside = F.col("ends") < CUT_SHARE * F.col("longer")  # of a word
    is_cut = F.when(inside, True).when(F.col("total") >= LEAST_COUNT, F.col("ends") / F.col("total") < END_SHARE)
    at = lambda n, x: F.max(F.when(F.col("at") == n, x))
    found = ends.join(counts, "key").groupBy("ctx").agg(*[at(n, is_cut).alias(f"c{n}") for n in range(5)], *[at(n, F.when(inside, True)).alias(f"w{n}") for n in range(2)])
    cut_by = F.when(F.col("c2").isNotNull(), F.coalesce("c0", "c1", "c2")).otherwise(F.coalesce("w0", "w1", "c3", "c4"))
    return found.select("ctx", cut_by.alias("cut")).filter("cut is not null")


def _prefix_verdicts(values: DataFrame) -> DataFrame:
    """(row, open, guess, verdict, ctx): verdict 1 cut, 0 finished, null where no longer copy exists.

    Range partitions keep the global order; the first value of each partition answers for the last one
    of the partition before, so at most two values a partition reach the driver.
    """

    if "ctx" not in values.columns:
        values = values.withColumn("ctx", F.lit(0).cast("long"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[tuple] = []
        at, first = -1, None
        for pdf in parts:
            out = []
            for p, row, v, is_open, guess, ctx in zip(pdf["p"], pdf["row"], pdf["v"], pdf["open"], pdf["guess"], pdf["ctx"]):
                if first is None:
                    first, at = v, p
                    out.append((None, False, False, None, p, "first", v, 0))
                if pending and v != pending[0][1]:
                    old = pending[0][1]
                    verdict = None if not v.startswith(old) or len(old) < LEAST_PREFIX else int(v[len(old)] != ".")
                    out += [(r, True, g, verdict, p, None, None, x) for r, _, g, x in pending]
                    pending = []
                if is_open:
                    pending.append((row, v, guess, ctx))
                else:
                    out.append((row, False, guess, None, p, None, None, 0))
            yield pd.DataFrame(out, columns=["row", "open", "guess", "verdict", "p", "kind", "v", "ctx"]).astype({"verdict": "Int32", "row": "Int64", "ctx": "int64"})
        if pending:
            out = [(r, True, g, None, at, "last", v if i == 0 else None, x) for i, (r, v, g, x) in enumerate(pending)]
            yield pd.DataFrame(out, columns=["row", "open", "guess", "verdict", "p", "kind", "v", "ctx"]).astype({"verdict": "Int32", "row": "Int64", "ctx": "int64"})

    ranged = values.repartitionByRange(F.col("v")).sortWithinPartitions("v").withColumn("p", F.spark_partition_id())
    done = cut(ranged.select("p", "row", "v", "open", "guess", "ctx").mapInPandas(run, "row long, open boolean, guess boolean, verdict int, p int, kind string, v string, ctx long"))
    edges = done.filter("v is not null").select("p", "kind", "v").collect()
    firsts = sorted((e.p, e.v) for e in edges if e.kind == "first")
    late = {}
    for e in edges:
        if e.kind == "last":
            after = next((v for p, v in firsts if p > e.p), "")
            if after.startswith(e.v) and len(after) > len(e.v) >= LEAST_PREFIX:
                late[e.p] = int(after[len(e.v)] != ".")
    verdict = F.col("verdict")
    for p, x in late.items():
        verdict = F.when((F.col("p") == p) & (F.col("kind") == "last"), x).otherwise(verdict)
    return done.filter("row is not null").select("row", "open", "guess", verdict.alias("verdict"), "ctx")


def judged(news: DataFrame) -> DataFrame:
    """(id, field, cut): every non-blank content body and summary with the verdict on its end.

    Null and blank values give no rows; a page without any body line gives none for content.
    """
    pages = pages_of(news, "summary").filter("id is not null")
    marker = Marker(pages)
    wide = marker.wide

    def make(model):
        def row(row, lines, marks):
            body = [x.strip() for x, m in zip(lines, marks) if m == 0]
            if body:
                body[-1] = body_end(model, row.host, body[-1], known_of(row.glued) if wide else None)
                yield row.id * 2, *ended(body)
            summary = [x.strip() for x in split_lines(row.summary) if x.strip()]
            if summary:
                yield row.id * 2 + 1, *ended(summary)

        return row

    def ended(lines):
        is_open, guess, bare, keys = judge(lines[-1])
        v = value_of("\n".join([*lines[:-1], bare]))
        return (v.rstrip(".") if is_open else v), is_open, guess, keys

    values = cut(marker.apply(_with_glued(marker, pages) if wide else pages, make, "row long, v string, open boolean, guess boolean, keys array<long>"))
    done = _prefix_verdicts(values.select("row", "v", "open", "guess", F.coalesce(F.get("keys", F.lit(0)), F.lit(0)).alias("ctx")))
    done = done.join(_guesses(marker, pages, values), "ctx", "left").withColumn("guess", F.coalesce("cut", "guess"))
    is_cut = F.when(F.col("open") & F.col("verdict").isNotNull(), F.col("verdict") == 1).otherwise(F.col("guess"))
    return done.select(F.expr("row div 2").alias("id"), F.when(F.pmod("row", F.lit(2)) == 0, "content").otherwise("summary").alias("field"), is_cut.alias("cut"))


def truncated(news: DataFrame) -> DataFrame:
    """(id, field) of every value that ends inside a word or sentence."""
    return judged(news).filter("cut").select("id", "field")


def shares(news: DataFrame) -> DataFrame:
    """(media, field, records, cut, share): how often each media cuts each field; null and blank media are one group, ''."""
    media = news.select("id", F.coalesce(F.trim("media"), F.lit("")).alias("media"))
    return judged(news).join(media, "id").groupBy("media", "field").agg(
        F.count("*").alias("records"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share")
    )
