"""Sizes and offsets in tokens of a public tokenizer; its folder is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

#: Folder of the vocabulary files and the file used for sizes.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Sizer:
    def __init__(self, folder: str = FOLDER, ranks: str = RANKS):
        import tiktoken

        with open(os.path.join(folder, ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, "int64")
        for b, i in table.items():
            self.width[i] = len(b)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def char_ends(self, text: str) -> np.ndarray:
        """Per token the number of characters of the text that are complete after it."""
        ids = np.array(self.encoding.encode_ordinary(text), "int64")
        raw = np.frombuffer(text.encode("utf-8", "replace"), "uint8")
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = np.cumsum(self.width[ids]) if len(ids) else np.zeros(0, "int64")
        whole = np.concatenate([(raw & 0xC0) != 0x80, [True]])[ends] if len(ids) else np.zeros(0, bool)
        # a token that ends inside a character completes only the characters before it
        return starts[ends] - ~whole


@functools.lru_cache(2)
def sizer(folder: str = FOLDER, ranks: str = RANKS) -> Sizer:
    """One per worker process."""
    return Sizer(folder, ranks)
