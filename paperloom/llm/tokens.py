"""Token ids of whole texts by a public byte-level BPE.

The added tokens of the tokenizer's file are found first, wherever their text occurs, and have ids of their own; what
stands between them is cut into pre-tokens and merged, as the tokenizer does by default. Nothing is remembered from text to
text, so memory is that of the vocabulary and of one text.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
END_ID = 1


class Encoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit bytes; null counts as empty."""

    def __init__(self, ranks: str = RANKS, tokenizer: str = TOKENIZER):
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        longest = sorted(self.added, key=lambda t: (-len(t), t))
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self.split(text))
        return self._plain(text)


@functools.lru_cache(maxsize=1)
def encoder() -> Encoder:
    """One encoder per Python worker."""
    return Encoder()
