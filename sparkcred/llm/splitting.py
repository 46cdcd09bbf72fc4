"""Problem 9: splitting oversized items at natural boundaries.

Token offsets give a prefix sum from characters to tokens; natural boundaries stand in a sorted array.
A piece ends at the last boundary under the limit (found by binary search), or in a hard cut where there
is none in its second half; the next piece starts ``overlap`` tokens before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.llm.tokenizer import FOLDER, Sizer, sizer

#: Natural boundaries from strong to weak: after blank lines, lines, sentences, words.
_LEVELS = [re.compile(p) for p in (r"\n[ \t]*\n+", r"\n+", r"(?<=[.!?])['\"”’»)\]]*\s+|[。！？]['\"”’」』）]*", r"\s+")]


def pieces_of(text: str, most: int, overlap: int, sz: Sizer) -> list[tuple[int, int, int]]:
    """(start, end, tokens) in characters of the pieces of one text; one piece if it is within the limit.

    Every piece has at most ``most`` tokens when encoded on its own, the pieces cover the text, and each
    starts ``overlap`` tokens (rounded to whole characters) before the end of the one before it.
    """
    if not text:
        return [(0, 0, 0)]
    ends = sz.char_ends(text)
    if len(ends) <= most:
        return [(0, len(text), len(ends))]
    overlap = max(0, min(overlap, most // 2))
    levels = [np.array([m.end() for m in p.finditer(text)], "int64") for p in _LEVELS]
    out, start = [], 0
    while True:
        first = int(np.searchsorted(ends, start, "right")) if start else 0  # tokens that end by the start
        limit = most
        while True:
            last = first + limit
            if last >= len(ends):
                end = len(text)
            else:
                reach = int(ends[last - 1])
                half = int(ends[first + limit // 2])
                end = reach
                for b in levels:
                    i = int(np.searchsorted(b, reach, "right")) - 1
                    if i >= 0 and b[i] > max(half, start):
                        end = int(b[i])
                        break
                end = max(end, start + 1)
            n = sz.count(text[start:end])
            if n <= most or end <= start + 1:
                break
            limit = max(1, limit - (n - most) - 1)
        out.append((start, end, n))
        if end >= len(text):
            return out
        # step back by the overlap, to a whole character
        back = int(np.searchsorted(ends, end, "left")) + 1 - overlap
        start = max(start + 1, min(end, int(ends[back - 1]) if back > 0 else 0))


def split_documents(documents: DataFrame, most: int, overlap: int, folder: str = FOLDER) -> DataFrame:
    """(doc_id, piece_no, start, end, n_tokens, text) of every document over ``most`` tokens.

    A text of no more bytes than ``most`` has no more tokens either, since a token holds at least one
    byte, and is not encoded. Null texts and texts within the limit give no rows; repeated rows are split
    once each.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sz = sizer(folder)
        for pdf in parts:
            for i in range(0, len(pdf), 500):
                out = []
                for doc, text in zip(pdf["doc_id"][i : i + 500], pdf["text"][i : i + 500]):
                    cuts = pieces_of(text, most, overlap, sz)
                    if len(cuts) > 1:
                        out += [(doc, k, s, e, n, text[s:e]) for k, (s, e, n) in enumerate(cuts, 1)]
                yield pd.DataFrame(out, columns=["doc_id", "piece_no", "start", "end", "n_tokens", "text"])

    large = documents.select("doc_id", "text").filter(F.octet_length("text") > most)
    return large.mapInPandas(run, "doc_id long, piece_no int, start long, end long, n_tokens int, text string")


def limits(split_limits: DataFrame) -> tuple[int, int] | None:
    """The one limit of the table (the first by name if there are several); None if it is empty."""
    row = split_limits.filter("max_tokens is not null").orderBy("limit_name").first()
    return None if row is None else (int(row.max_tokens), int(row.overlap_tokens or 0))


def pieces(documents: DataFrame, split_limits: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Pieces of all oversized documents under the table's limit; no rows where there is no limit."""
    most, overlap = limits(split_limits) or (1 << 31, 0)
    return split_documents(documents, most, overlap, folder)


def oversized(documents: DataFrame, split_limits: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id) of the documents that had to be split."""
    return pieces(documents, split_limits, folder).filter("piece_no = 2").select("doc_id")
