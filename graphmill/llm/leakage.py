"""p9: passages of held-out texts inside corpus documents, by spaced-seed hashing.

A word is a run of letters and digits in lower case. Fixed masks select positions of a window of words; the hashes of
the held-out texts' windows are looked up for every window of every document, and hits are verified word by word around
them. Every mask spans at most `min_run` words, so a shared run of that length is hit by each mask; masks that skip
positions also hit passages with substituted words.

The held-out side is broadcast in blocks of at most `block_words` words, so its size is bounded whatever it grows to;
further blocks are further passes over the documents. Documents are never shuffled. Null and empty texts share nothing.
Texts are processed whole; repeated documents each come out; ids need not be dense.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.registry_sql import P9_SQL
from graphmill.sources.tables import table

# The masks; 1 marks a word position that counts.
MASKS = ["110110111011", "111010011101"]
MIN_RUN = 12
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"position {i}") | 1 for i in range(64)], np.uint64)
_VOCABULARY: dict[str, int] = {}
_VOCABULARY_LIMIT = 1_000_000


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_codes(ws: list[str]) -> np.ndarray:
    """A 64-bit code per word."""
    known = _VOCABULARY
    if len(known) > _VOCABULARY_LIMIT:
        known.clear()
    out = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = c
    return out


def window_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash of every window of consecutive words."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            h += codes[k : k + n] * _MULTIPLIERS[k]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


def overlap(a: np.ndarray, b: np.ndarray, shift: int, min_run: int, share: float) -> int:
    """Length of the longest stretch, along the diagonal a[i] ~ b[i - shift], of at least min_run words of which at
    least `share` agree and which begins and ends with agreeing words; 0 if there is none."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    same = a[lo:hi] == b[lo - shift : hi - shift]
    if share >= 1:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        runs = edges[1::2] - edges[::2]
        best = int(runs.max()) if len(runs) else 0
        return best if best >= min_run else 0
    score = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - share, -share))))
    low = np.minimum.accumulate(score)
    best = 0
    for j in np.flatnonzero(same):
        i = int(np.searchsorted(-low[: j + 1], -(score[j + 1] + 1e-9)))
        best = max(best, j + 1 - i)
    return best if best >= min_run else 0


def leaks(docs: DataFrame, items: DataFrame, min_run: int = MIN_RUN, share: float = 1.0, masks: list[str] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words) for every document that shares a stretch of at least min_run words with an item, of
    which at least `share` agree. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    assert all(len(m) <= min_run for m in masks)
    sized = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 3 / block_words))
    out = None
    for b in range(blocks):
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        got = _block(spark, docs.select("doc_id", "text"), part.collect(), min_run, share, masks)
        out = got if out is None else out.unionByName(got)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def _block(spark: SparkSession, docs: DataFrame, items: list, min_run: int, share: float, masks: list[str]) -> DataFrame:
    ids = [r.item_id for r in items]
    codes = [word_codes(words(r.text)) for r in items]
    tables = []
    for mask in masks:
        hs = [window_hashes(c, mask) for c in codes]
        h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        at = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        tables.append((mask, h[order], item[order], at[order]))
    shared = spark.sparkContext.broadcast((ids, codes, tables))

    def run(pdfs):
        ids, codes, tables = shared.value
        for p in pdfs:
            found: dict[tuple[int, int], int] = {}
            own = [word_codes(words(t)) for t in p["text"]]
            if own:
                starts = np.concatenate(([0], np.cumsum([len(c) for c in own])))
                flat = np.concatenate(own)
                for mask, h, item, at in tables:
                    if not len(h):
                        continue
                    w = window_hashes(flat, mask)
                    left = np.searchsorted(h, w, "left")
                    hit = np.flatnonzero((left < len(h)) & (h[np.minimum(left, len(h) - 1)] == w))
                    doc_of = np.searchsorted(starts, hit, "right") - 1
                    inside = hit + len(mask) <= starts[doc_of + 1]
                    tried = set()
                    for i, doc in zip(hit[inside], doc_of[inside]):
                        k = left[i]
                        while k < len(h) and h[k] == w[i]:
                            key = (int(doc), int(item[k]), int(i - starts[doc] - at[k]))
                            if key not in tried:
                                tried.add(key)
                                n = overlap(own[doc], codes[item[k]], key[2], min_run, share)
                                if n:
                                    found[key[:2]] = max(n, found.get(key[:2], 0))
                            k += 1
            doc_ids = p["doc_id"]
            yield pd.DataFrame({"doc_id": [doc_ids.iloc[a] for a, _ in found], "item_id": [ids[b] for _, b in found], "n_words": list(found.values())}, columns=["doc_id", "item_id", "n_words"])

    return docs.where("doc_id is not null").mapInPandas(run, "doc_id long, item_id long, n_words long")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item that leaked, with the number of documents that hold it."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))


def p9_changed(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of at least 16 words of which nine in ten agree, so that changed passages are found too."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), min_run=16, share=0.9)


QUERIES = {"p9_found": p9_found, "p9_items": p9_items, "p9_changed": p9_changed}
SQL = P9_SQL
