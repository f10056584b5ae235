"""Token sizes by a public tokenizer whose vocabulary file is named by a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import tiktoken

VOCABULARY = os.environ.get("GRAPHMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoder of a vocabulary file of ranks; loaded once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def byte_lengths(path: str = VOCABULARY) -> np.ndarray:
    """Bytes per token id."""
    e = encoding(path)
    out = np.zeros(e.n_vocab, np.int64)
    for token in e.token_byte_values():
        out[e.encode_single_token(token)] = len(token)
    return out


_LONGEST_RUN = 20_000


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Token ids of a whole text. A very long text goes through in stretches that end before a blank, where the
    pattern always cuts, so the ids are those of one call; a stretch without any blank is encoded as it is."""
    e = encoding(path)
    if len(text) <= 2 * _LONGEST_RUN:
        return np.asarray(e.encode_ordinary(text), np.int64)
    parts, i = [], 0
    while i < len(text):
        j = min(len(text), i + _LONGEST_RUN)
        while j < len(text) and not (text[j] == " " and not text[j - 1].isspace() and j + 1 < len(text) and text[j + 1].isalnum()):
            j += 1
        parts.append(e.encode_ordinary(text[i:j]))
        i = j
    return np.concatenate([np.asarray(p, np.int64) for p in parts])
