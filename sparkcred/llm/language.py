"""Problem 1: language of documents and of the lines of mixed documents.

One interpolated Kneser-Ney character model per language. The n-grams of all languages stand in one
sorted array per order, each with a row of log probabilities, one column a language; an n-gram that is
not there backs off with the weights of its context. A text gets the language with the lowest
cross-entropy per character; confidence is the calibrated posterior, and texts whose cross-entropy
under their best model lies above what held-out text of that language shows are rejected as ``und``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.llm.pages import Marker, known_of, pages_of, split_lines

LANGUAGES = ("ko", "en", "ja", "zh", "es", "fr", "de")
ORDER = 4
#: The models are fitted on at most this many labelled texts and characters a language, none longer than FIT_LONGEST.
FIT_TEXTS, FIT_CHARS, FIT_LONGEST, FIT_FOLDS = 600, 250_000, 20_000, 5
#: Cross-entropy per character up to which a model explains a line whose own language has no other text.
EXPLAINED = 2.5
#: A line is in another language than its record if that language's cross-entropy per character is lower by what
#: all but this share of held-out lines show against any other language, and by LEAST_GAP at least; over the line
#: that must come to LINE_ODDS. Lines under LEAST_LETTERS letters are no evidence.
GAP_QUANTILE, LEAST_GAP, LINE_ODDS, LEAST_LETTERS = 0.001, 0.2, 8.0, 8
#: Log odds that a line is in its record's language, or a page line in the page's.
PRIOR = 2.0
#: Quantile of held-out cross-entropy beyond which (plus a margin) a text is rejected.
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.5

#: Codes and English names of the languages.
CODES = {
    "ko": "ko", "kor": "ko", "korean": "ko",
    "en": "en", "eng": "en", "english": "en",
    "ja": "ja", "jpn": "ja", "japanese": "ja",
    "zh": "zh", "zho": "zh", "chi": "zh", "chinese": "zh",
    "es": "es", "spa": "es", "spanish": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de",
}

_JUNK = re.compile(r"<[^>\n]*>|&#?\w+;|[\w.+\-]+@[\w.\-]+|https?://\S+")
_OTHER = re.compile(r"[\W\d_]+")


def label_code(label: F.Column) -> F.Column:
    """Two-letter code of a language label in any usual form; null where it names none of the languages."""
    first = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_].*)?$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), first)


def normal(text: str) -> str:
    """Lower case, one space for anything but letters; the models see only this."""
    return _OTHER.sub(" ", _JUNK.sub(" ", unicodedata.normalize("NFKC", text)).casefold()).strip()


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")
    return np.minimum(c, 0xFFFF).astype("uint64")


def _packed(c: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each position from order - 1 on."""
    out = c[: len(c) - order + 1].copy()
    for k in range(1, order):
        out = (out << np.uint64(16)) | c[k : len(c) - order + 1 + k]
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at, (keys[at] == x) if len(keys) else np.zeros(len(x), bool)


def _discounts(num: np.ndarray) -> np.ndarray:
    """What is taken from counts of 1, 2 and more, from the counts of counts."""
    n = np.array([(num == k).sum() for k in (1, 2, 3, 4)], "float64")
    if not n[:2].all():
        return np.full(3, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)])
    return np.clip(d, 0.05, [0.95, 1.9, 2.85])


class KneserNey:
    """Models of all languages over shared sorted n-gram arrays."""

    def __init__(self, texts: dict[str, list[str]], languages: tuple[str, ...] = LANGUAGES, order: int = ORDER):
        self.languages, self.order = languages, order
        pad = " " * (order - 1)
        counts = []  # per language, per order: n-grams and counts
        for lang in languages:
            c = _codes("".join(pad + normal(t) + " " for t in texts.get(lang, [])) or pad + " ")
            high = np.unique(_packed(c, order), return_counts=True)
            per = {order: high}
            for n in range(order - 1, 0, -1):
                # lower orders count the different characters before an n-gram, not its occurrences
                grams = per[n + 1][0] & np.uint64((1 << 16 * n) - 1)
                per[n] = np.unique(grams, return_counts=True)
            counts.append(per)
        self.keys, self.logp, self.ctx, self.logb = {}, {}, {}, {}
        n_lang = len(languages)
        vocab = max(1, len(np.unique(np.concatenate([p[1][0] for p in counts]))))
        lower = None
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([p[n][0] for p in counts]))
            ctxs = np.unique(keys >> np.uint64(16)) if n > 1 else np.zeros(1, "uint64")
            prob, back = np.zeros((len(keys), n_lang)), np.ones((len(ctxs), n_lang))
            for j, per in enumerate(counts):
                grams, num = per[n]
                d = _discounts(num)[np.minimum(num, 3) - 1]
                at = np.searchsorted(ctxs, grams >> np.uint64(16)) if n > 1 else np.zeros(len(grams), int)
                total = np.bincount(at, weights=num, minlength=len(ctxs))
                taken = np.bincount(at, weights=d, minlength=len(ctxs))
                seen = total > 0
                back[seen, j] = taken[seen] / total[seen]
                prob[np.searchsorted(keys, grams), j] = (num - d) / total[at]
            below = np.full((len(keys), n_lang), 1.0 / (vocab + 1)) if n == 1 else lower(keys & np.uint64((1 << 16 * (n - 1)) - 1))
            at = np.searchsorted(ctxs, keys >> np.uint64(16)) if n > 1 else np.zeros(len(keys), int)
            prob += back[at] * below
            self.keys[n], self.logp[n] = keys, np.log(np.maximum(prob, 1e-12)).astype("float32")
            self.ctx[n], self.logb[n] = ctxs, np.log(np.maximum(back, 1e-6)).astype("float32")
            self.floor = np.log(1.0 / (vocab + 1))
            lower = lambda x, n=n: np.exp(self._rows(x, n))
        self.temperature, self.limit, self.gap = 1.0, np.full(n_lang, np.inf), LEAST_GAP

    def _rows(self, x: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of packed n-grams of one order, one column a language."""
        at, found = _find(self.keys[n], x)
        out = self.logp[n][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            y = x[miss]
            if n == 1:
                out[miss] = self.floor + self.logb[1][0]
            else:
                out[miss] = self._rows(y & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
                at, known = _find(self.ctx[n], y >> np.uint64(16))
                out[miss[known]] += self.logb[n][at[known]]
        return out

    def scores(self, texts: list[str], chunk: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood [texts, languages], characters) of normalised texts."""
        pad = " " * (self.order - 1)
        out, sizes = np.zeros((len(texts), len(self.languages)), "float64"), np.array([len(t) for t in texts], "int64")
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + sizes[j] < chunk):
                n += sizes[j] + self.order
                j += 1
            c = _codes("".join(pad + t + " " for t in texts[i:j]) + " " * self.order)
            length = sizes[i:j] + 1
            start = np.concatenate([[0], np.cumsum(length + len(pad))[:-1]])
            at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            packed = _packed(c, self.order)
            for k in range(0, len(at), chunk):
                rows = self._rows(packed[at[k : k + chunk]], self.order)
                owner = np.repeat(np.arange(j - i), length)[k : k + chunk]
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[i + owner[first]] += np.add.reduceat(rows, first, axis=0)
            i = j
        return out, sizes

    def calibrate(self, held: list[tuple[str, str]]) -> None:
        """Temperature, limits of rejection and least gap from held-out normalised lines of known language."""
        held = [(k, x) for k, x in held if len(x) >= 20]
        if not held:
            return
        score, size = self.scores([x for _, x in held])
        truth = np.array([self.languages.index(k) for k, _ in held])
        best = (np.inf, 1.0)
        for t in (1, 2, 4, 8, 16, 32):
            z = score / t
            z = z - z.max(axis=1, keepdims=True)
            loss = -(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
            best = min(best, (loss, float(t)))
        self.temperature = best[1]
        entropy = -score / (size + 1)[:, None]
        own = entropy[np.arange(len(truth)), truth]
        for j in range(len(self.languages)):
            if (truth == j).sum() >= 5:
                self.limit[j] = np.quantile(own[truth == j], REJECT_QUANTILE) + REJECT_MARGIN
        entropy[np.arange(len(truth)), truth] = np.inf
        self.gap = max(LEAST_GAP, float(np.quantile(entropy.min(axis=1) - own, GAP_QUANTILE)))

    def entropies(self, score: np.ndarray, size) -> np.ndarray:
        """Cross-entropy per character of scores, the end of the text counted as one."""
        return -score / (np.asarray(size) + 1)[..., None]

    def posterior(self, score: np.ndarray) -> np.ndarray:
        z = score / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def labelled_sample(documents: DataFrame) -> dict[str, list[str]]:
    """Texts by language from a bounded hash sample of the labelled documents.

    A language gives the documents whose hash lies under a threshold set by its count, so what reaches the
    driver is at most about FIT_TEXTS texts of FIT_LONGEST characters a language, whatever the corpus.
    """
    h = F.xxhash64("doc_id", F.lit("fit"))
    ok = documents.select(F.col("text"), label_code(F.col("lang")).alias("lang"), h.alias("h"))
    ok = ok.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= FIT_LONGEST))
    sizes = {r["lang"]: r["n"] for r in ok.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[str]] = {}
    if not sizes:
        return out
    reach = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 1.25 * FIT_TEXTS / n) * (1 << 40)))])
    for r in sorted(ok.filter(F.pmod("h", F.lit(1 << 40)) < F.try_element_at(reach, F.col("lang"))).collect(), key=lambda r: (r["h"], r["text"])):
        own = out.setdefault(r["lang"], [])
        if len(own) < FIT_TEXTS and sum(map(len, own)) < FIT_CHARS:
            own.append(r["text"])
    return out


def fit(documents: DataFrame) -> KneserNey:
    """Fit on the lines of a bounded sample of labelled documents, without those whose label the others deny.

    A line is judged by models that have not seen its text (FIT_FOLDS parts, twice), so neither a wrong
    label nor a text in two languages can vouch for itself. Null or unusual labels, null texts and empty
    tables are allowed; a language without texts never wins over a fitted one.
    """
    # (part, line) by language; equal lines may stand in several texts and count as often
    lines = {k: [(n % FIT_FOLDS, x) for n, t in enumerate(v) for x in map(normal, t.split("\n")) if x] for k, v in labelled_sample(documents).items()}
    held: list[tuple[str, str]] = []
    for _ in range(2):
        kept: dict[str, list[tuple[int, str]]] = {k: [] for k in lines}
        held = []
        for fold in range(FIT_FOLDS):
            part = {k: [x for f, x in v if f != fold] for k, v in lines.items()}
            rest = [(k, x) for k, v in lines.items() for f, x in v if f == fold]
            judge = KneserNey(part)
            score, size = judge.scores([x for _, x in rest]) if rest else (np.zeros((0, len(LANGUAGES))), np.zeros(0))
            entropy = judge.entropies(score, size)
            # a label is denied by a clear gap; where the language has no other text, by one that explains the line well
            agreed = [(k, x) for (k, x), h in zip(rest, entropy) if (h[LANGUAGES.index(k)] - h.min() <= LEAST_GAP if part[k] else h.min() > EXPLAINED)]
            for k, x in agreed:
                kept[k].append((fold, x))
            if fold == FIT_FOLDS - 1:
                held = agreed
        lines = {k: kept[k] or v for k, v in lines.items()}
    # the model that is used has not seen the lines its limits are set by
    model = KneserNey({k: [x for f, x in v if f < FIT_FOLDS - 1] or [x for _, x in v] for k, v in lines.items()})
    model.calibrate(held)
    return model


def _tagger(kn: KneserNey):
    """Rows of marked pages -> (row, lines, letters per line, scores per line) in batches, scored together."""

    def tag(rows: list[tuple]) -> Iterator[tuple]:
        norm = [[normal(x) for x in lines] for _, lines, _ in rows]
        flat = {t: None for ts in norm for t in ts if t}
        score, size = kn.scores(list(flat)) if flat else (np.zeros((0, len(kn.languages))), [])
        where = {t: i for i, t in enumerate(flat)}
        zero = np.zeros(len(kn.languages))
        for (row, lines, marks), ts in zip(rows, norm):
            yield row, lines, marks, ts, np.array([score[where[t]] if t else zero for t in ts]).reshape(len(ts), -1)

    return tag


def _decide(kn: KneserNey, lines, marks, ts, score):
    """(record's score and size, its language, score per line, mixed); None where there is no letter.

    Another language counts for a line only if its model explains the line: by the calibrated gap in
    cross-entropy per character, and within its limit of rejection.
    """
    body = np.array([m == 0 and bool(t) for m, t in zip(marks, ts)], bool)
    if not body.any():
        body = np.array([bool(t) for t in ts], bool)
    if not body.any():
        return None
    total = score[body].sum(axis=0)
    own = int(total.argmax())
    sizes = np.array([len(t) for t in ts])
    letters = np.array([len(t.replace(" ", "")) for t in ts])
    entropy = kn.entropies(score, sizes)
    gap, least = entropy[:, own] - entropy.min(axis=1), entropy.min(axis=1)
    other = body & (letters >= LEAST_LETTERS) & (gap >= np.maximum(kn.gap, LINE_ODDS / (sizes + 1))) & (least <= kn.limit[entropy.argmin(axis=1)])
    page = np.array([m == 1 for m in marks], bool)
    around = score[page].sum(axis=0) if page.any() else total
    prior = np.where(page[:, None], PRIOR * 2 * (np.arange(score.shape[1]) == around.argmax()), PRIOR * (np.arange(score.shape[1]) == own))
    return total, int((sizes[body] + 1).sum() - 1), own, score + prior, bool(other.any())


def _tagged(news: DataFrame, documents: DataFrame, make_rows, schema: str) -> DataFrame:
    spark = news.sparkSession
    pages = pages_of(news, "lang").select("id", "host", "content", "lang")
    pages = pages.withColumn("label", label_code(F.col("lang"))).drop("lang").filter("content is not null")
    marker = Marker(pages)
    kn = spark.sparkContext.broadcast(fit(documents))
    model, wide = marker.model, marker.wide
    if wide:
        pages = marker._known(pages)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, k = model.value, kn.value
        tag = _tagger(k)
        for pdf in parts:
            for i in range(0, len(pdf), 1000):
                rows = []
                for row in pdf.iloc[i : i + 1000].itertuples(index=False):
                    lines = split_lines(row.content)
                    known = known_of(row.known) if wide else None
                    rows.append((row, lines, m.marks(row.host, lines, known)))
                yield pd.DataFrame([x for t in tag(rows) for x in make_rows(k, *t)], columns=names)

    return pages.mapInPandas(run, schema)


def language_cases(news: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, line_no, lang): records with a missing or wrong label (line_no 0), and every line of records in two languages.

    Null or blank content gives no rows, content without any letter and bodies rejected by every model neither.
    """

    def rows(kn, row, lines, marks, ts, score):
        got = _decide(kn, lines, marks, ts, score)
        if got is None:
            return
        total, size, own, per_line, mixed = got
        if mixed:
            for n, (x, s) in enumerate(zip(lines, per_line), 1):
                if x.strip():
                    yield row.id, n, kn.languages[int(s.argmax())]
        elif row.label != kn.languages[own] and kn.entropies(total, size)[own] <= kn.limit[own]:
            yield row.id, 0, kn.languages[own]

    return _tagged(news, documents, rows, "id long, line_no int, lang string")


def languages(news: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, line_no, lang, confidence): line_no 0 for the whole record, and one row per line of records in two languages.

    Texts no model explains are ``und``. Null content gives no rows; content without letters gives ``und`` with confidence 0.
    """

    def named(kn, score, size):
        j = int(score.argmax())
        sure = float(kn.posterior(score)[j])
        return (kn.languages[j] if kn.entropies(score, size)[j] <= kn.limit[j] else "und"), sure

    def rows(kn, row, lines, marks, ts, score):
        got = _decide(kn, lines, marks, ts, score)
        if got is None:
            yield row.id, 0, "und", 0.0
            return
        total, size, own, per_line, mixed = got
        yield row.id, 0, *named(kn, total, size)
        if mixed:
            for n, (x, s, t) in enumerate(zip(lines, per_line, ts), 1):
                if x.strip():
                    yield row.id, n, *named(kn, s, len(t))

    return _tagged(news, documents, rows, "id long, line_no int, lang string, confidence double")
