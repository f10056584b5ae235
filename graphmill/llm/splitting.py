"""p10: oversized texts in pieces under a limit of tokens, cut at the strongest natural boundary.

Sizes are tokens of a public tokenizer. For each place before a token a boundary strength is read from the text around it; a
sparse table gives the strongest one in the window of permissible lengths, the rightmost among equals; the next piece starts
`overlap` tokens before the cut. No piece cuts a character. Each piece's own token count is checked by encoding it again, and the
cut moves to an earlier boundary if it grew, so that no piece exceeds the limit. Without any break cuts fall at the limit.

Null texts give no piece. Texts within the limit give one piece (`split`) and do not appear in p10_pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.tokens import VOCABULARY, byte_lengths, encode
from graphmill.sources.tables import table

LIMIT, OVERLAP, LEAST_SHARE = 512, 64, 0.5
# strengths, strongest first: blank line, line end, sentence end, clause end, blank, inside a word, inside a character
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, WORD, NEVER = 6, 5, 4, 3, 2, 1, 0


def strengths(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Boundary strength of a cut before each byte offset in `at` (all > 0)."""
    b = np.frombuffer(raw, np.uint8)
    here, before = b[at], b[at - 1]
    before2 = np.where(at > 1, b[np.maximum(at - 2, 0)], 0)
    before3 = np.where(at > 2, b[np.maximum(at - 3, 0)], 0)
    out = np.full(len(at), WORD)
    is_blank = np.isin(here, [32, 9]) | np.isin(before, [32, 9])
    out[is_blank] = BLANK
    prior = np.where(np.isin(before, [32, 9]), before2, before)
    out[is_blank & np.isin(prior, [44, 59, 58])] = CLAUSE
    out[is_blank & np.isin(prior, [46, 33, 63])] = SENTENCE
    wide = (before3 == 0xEF) & (before2 == 0xBC)
    out[wide & np.isin(before, [0x8C, 0x9B, 0x9A])] = CLAUSE
    out[((before3 == 0xE3) & (before2 == 0x80) & (before == 0x82)) | (wide & np.isin(before, [0x81, 0x9F]))] = SENTENCE
    line = (before == 10) & (here != 10)
    out[line] = LINE
    out[line & ((before2 == 10) | ((before2 == 13) & (before3 == 10)))] = PARAGRAPH
    out[(here & 0xC0) == 0x80] = NEVER
    return out


class StrongestCut:
    """Sparse table over boundary strengths: position of the greatest value in a range, the rightmost among equals."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int64) << 40 | np.arange(len(values), dtype=np.int64)]
        k = 1
        while 2 * k <= len(values):
            prev = self.rows[-1]
            self.rows.append(np.maximum(prev[:-k], prev[k:]))
            k *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) over lo..hi inclusive."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.rows[level]
        v = int(max(row[lo], row[hi - (1 << level) + 1]))
        return v & ((1 << 40) - 1), v >> 40


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY, ids: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, tokens) in bytes of its UTF-8 form, in order; each starts `overlap` tokens before the last one's end."""
    assert 0 <= overlap < limit * LEAST_SHARE
    raw = text.encode("utf-8", "surrogatepass")
    if ids is None:
        ids = encode(text, path)
    n = len(ids)
    if n <= limit:
        return [(0, len(raw), n)]
    ends = np.cumsum(byte_lengths(path)[ids])
    starts = np.concatenate(([0], ends))
    value = np.concatenate(([NEVER], strengths(raw, ends[:-1]), [PARAGRAPH + 1]))  # before token i, and the end
    table_ = StrongestCut(value)
    out = []
    a = 0
    while True:
        hi = min(n, a + limit)
        lo = min(hi, a + max(overlap + 1, int(limit * LEAST_SHARE)))
        while True:
            cut, strength = table_.best(lo, hi)
            if strength == NEVER:  # a run of tokens that are parts of one character
                lo = max(a + 1, lo - 8)
                if lo == a + 1 and table_.best(lo, hi)[1] == NEVER:
                    cut = hi
                else:
                    continue
            piece = raw[starts[a] : starts[cut]]
            size = len(encode(piece.decode("utf-8", "surrogatepass"), path)) if strength != NEVER else cut - a
            if size <= limit or cut <= a + 1:
                break
            hi = cut - 1
            lo = min(lo, hi)
        out.append((int(starts[a]), int(starts[cut]), int(size)))
        if cut >= n:
            return out
        nxt = cut - overlap
        while nxt > a + 1 and value[nxt] == NEVER:
            nxt -= 1
        a = nxt if nxt > a else cut


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY, only_long: bool = True) -> DataFrame:
    """(doc_id, piece, start_byte, end_byte, n_tokens, text) of docs (doc_id, text). A narrow map; nothing is shuffled."""

    def run(pdfs):
        for p in pdfs:
            rows = []
            for doc, text in zip(p["doc_id"], p["text"]):
                ids = encode(text, path)
                if only_long and len(ids) <= limit:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                for k, (a, b, n) in enumerate(split(text, limit, overlap, path, ids)):
                    rows.append((doc, k, a, b, n, raw[a:b].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_byte", "end_byte", "n_tokens", "text"])

    given = docs.select("doc_id", "text").where("text is not null")
    if only_long:  # a token has at least one byte, so a text of so few bytes cannot exceed the limit
        given = given.where(F.octet_length("text") > limit)
    return given.mapInPandas(run, "doc_id long, piece long, start_byte long, end_byte long, n_tokens long, text string")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pieces of every document longer than the limit."""
    return pieces(table(spark, d, "documents"))


QUERIES = {"p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
