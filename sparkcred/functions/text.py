"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcred.functions import lexicons as L

#: White space as Unicode defines it; the same in Java and RE2.
WS = r"[\s\x{85}\x1c-\x1f\p{Z}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Null to '', runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), WS, " "))


def trimmed(c) -> Column:
    """Null to '', white space of any kind removed from both ends."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), f"^{WS}|{WS}$", "")


def clean_text(c) -> Column:
    """Lower case, tags and all but Hangul, ASCII letters, digits and blanks replaced by a blank."""
    x = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"<[^>]+>", " ")
    return strip(F.regexp_replace(x, r"[^가-힣a-zA-Z0-9\s\x{85}\x1c-\x1f\p{Z}]", " "))


def clean_text_compact(c) -> Column:
    """Everything but Hangul, ASCII letters, digits and white space deleted, then lower case; blanks stay."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^가-힣a-zA-Z0-9\s\x{85}\x1c-\x1f\p{Z}]", ""))


def parse_date(c) -> Column:
    """ISO date from four formats, else the first four digits as a year, else ''."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    tries = [F.try_to_timestamp(x, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "y-M-d", "M/d/y")]
    year = F.regexp_extract(x, r"(\d{4})", 1)
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.when(year != "", F.concat(year, F.lit("-01-01"))), F.lit(""))


def keyword_regex(words) -> str:
    """One alternation; only RE2 and Java metacharacters are escaped."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def flags(text: Column | str, lexicon: dict = L.ETL_LEXICON, case_sensitive: bool = False) -> list[Column]:
    """0/1 columns: whether any keyword of a flag is contained in the text (null counts as '')."""
    x = F.coalesce(col(text), F.lit(""))
    return [x.rlike(("" if case_sensitive else "(?i)") + keyword_regex(words)).cast("int").alias(f) for f, words in lexicon.items()]


def special_ratio(c) -> Column:
    """Share of characters outside the standard class; 1 for empty text."""
    x = F.coalesce(col(c), F.lit(""))
    n = F.length(x)
    return F.when(n == 0, 1.0).otherwise(F.length(F.regexp_replace(x, f"[{L.STANDARD_CHARS}]", "")) / n)


def foreign_ratio(c) -> Column:
    """Share of Han and kana characters; 0 for empty text."""
    x = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(x) == 0, 0.0).otherwise(F.regexp_count(x, F.lit(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]")) / F.length(x))


def boilerplate_dominant(c) -> Column:
    """Whether less than the limit of characters is left without the boilerplate patterns."""
    rest = F.regexp_replace(F.coalesce(col(c), F.lit("")), "(?i)" + "|".join(L.BOILERPLATE), "")
    return F.length(F.trim(F.regexp_replace(rest, rf"^{WS}|{WS}$", ""))) < L.BOILERPLATE_REST


def detect_language(c) -> Column:
    """'korean' under ten characters or from a share of Hangul on, else 'english'."""
    x = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(x) < 10, "korean").when(F.regexp_count(x, F.lit("[가-힣]")) / F.length(x) >= L.KOREAN_SHARE, "korean").otherwise("english")


def trigrams(title) -> Column:
    """Distinct trigrams of Hangul, a-z and digits; the whole text if it is shorter; empty for ''."""
    x = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^가-힣a-z0-9]", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a, b) -> Column:
    """Of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def tokens(c) -> Column:
    """Lower-case runs of Hangul, Latin letters or digits of two characters and more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([가-힣]+|[a-z]+|[0-9]+)"), F.lit(1)), lambda w: F.length(w) > 1)


def meta_features(title, content) -> list[Column]:
    """Twelve counts and ratios of a title and its content."""
    t, c = F.coalesce(col(title), F.lit("")), F.coalesce(col(content), F.lit(""))
    n = lambda x, p: F.regexp_count(x, F.lit(p))
    tl, cl = F.length(t), F.length(c)
    emo, quote, dots = n(t, L.EMOTION_PATTERN), n(c, "[\"']"), n(t, r"\.\.\.")
    excl, quest = n(t, "!") + n(c, "!"), n(t, r"\?") + n(c, r"\?")
    return [
        emo.alias("emo_count"), (emo / (tl + 1)).alias("emo_ratio"), quote.alias("quote_count"), (quote / (cl + 1)).alias("quote_ratio"),
        dots.alias("ellipsis_count"), (dots / (tl + 1)).alias("ellipsis_ratio"), excl.alias("excl_count"), (excl / (tl + cl + 1)).alias("excl_ratio"),
        quest.alias("quest_count"), (quest / (tl + cl + 1)).alias("quest_ratio"), tl.alias("title_len"), cl.alias("content_len"),
    ]


def verdict(text) -> tuple[Column, Column]:
    """(verdict, label): the first keyword in a stated verdict, else in the whole text, else ('', -1)."""
    x = F.coalesce(col(text), F.lit(""))
    stated = F.trim(F.regexp_extract(x, L.VERDICT_PATTERN, 1))
    said = F.coalesce(*[F.when((stated != "") & stated.contains(k), F.struct(stated.alias("verdict"), F.lit(v).alias("label"))) for k, v in L.VERDICTS])
    anywhere = F.coalesce(*[F.when(x.contains(k), F.struct(F.lit(k).alias("verdict"), F.lit(v).alias("label"))) for k, v in L.VERDICTS])
    best = F.coalesce(said, anywhere, F.struct(F.lit("").alias("verdict"), F.lit(-1).alias("label")))
    return best["verdict"], best["label"]


def time_key(c) -> tuple[Column, Column]:
    """Sort key of a clock time or date: (1, minutes), (0, yyyymmdd) or (0, 0)."""
    x = F.coalesce(col(c), F.lit(""))
    part = lambda p, g: F.regexp_extract(x, p, g).try_cast("int")
    pm, am, day = r"^오후\s*(\d+):(\d+)", r"^(?:오전\s*)?(\d+):(\d+)", r"^(\d{4})\.(\d{2})\.(\d{2})"
    h = part(pm, 1)
    minutes = F.coalesce(F.when(h == 12, 12).otherwise(h + 12) * 60 + part(pm, 2), part(am, 1) * 60 + part(am, 2))
    date = part(day, 1) * 10000 + part(day, 2) * 100 + part(day, 3)
    return F.when(minutes.isNotNull(), 1).otherwise(0), F.coalesce(minutes, date, F.lit(0))


def content_hash(title, content) -> Column:
    """md5 of the lower-case title and content; the key of a text."""
    return F.md5(F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.coalesce(col(content), F.lit("")))))


def seeded(key, seed: int = 42) -> Column:
    """Portable order that stands for a seeded shuffle."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")))
