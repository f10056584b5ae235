"""p8: documents into containers under simultaneous limits on tokens, segments and loss-bearing tokens.

Vector bin packing by the dot-product heuristic: the open container takes, of all items that fit, the one whose sizes have the
greatest dot product with the space left, each dimension weighted by how scarce it is over all items. When none fits
the next container opens. An item that alone exceeds a limit is split first, at natural boundaries without overlap; nothing
else is split. Loss-bearing are the tokens after the first line, which states the task.

Items are spread over shards by a hash of their id, so that a shard holds about `shard_items` items whatever the sizes or
sources; each shard is packed by one task. Only its last container can be left with much space. Null texts are not
packed; an empty text is an item of no tokens that takes a segment. Repeated ids are packed as often as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.splitting import split
from graphmill.llm.tokens import VOCABULARY, encode
from graphmill.sources.tables import table

CAPACITY, SEGMENTS, LOSS_CAPACITY, SHARD_ITEMS = 4096, 64, 4032, 8192


def sizes(text: str, path: str = VOCABULARY) -> tuple[int, int, np.ndarray]:
    """Tokens, loss-bearing tokens (those after the first line) and the token ids."""
    ids = encode(text, path)
    head = text.find("\n")
    prompt = len(encode(text[: head + 1], path)) if 0 <= head < len(text) - 1 else 0
    return len(ids), max(0, len(ids) - prompt), ids


def items(docs: DataFrame, capacity: int = CAPACITY, loss_capacity: int = LOSS_CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, n_tokens, n_loss) of docs (doc_id, text); a document beyond a limit gives several parts."""

    def run(pdfs):
        most = min(capacity, loss_capacity)
        for p in pdfs:
            rows = []
            for doc, text in zip(p["doc_id"], p["text"]):
                n, loss, ids = sizes(text, path)
                if n <= capacity and loss <= loss_capacity:
                    rows.append((doc, 0, n, loss))
                else:
                    rows += [(doc, k, m, m) for k, (_, _, m) in enumerate(split(text, most, 0, path, ids))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "n_tokens", "n_loss"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, part long, n_tokens long, n_loss long")


def pack(size: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item; size is (items, dimensions), each row within the limits.

    Items alike in all dimensions form one class, so a step costs the number of classes rather than of items.
    """
    classes, inverse, counts = np.unique(size, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    queue = np.argsort(inverse, kind="stable")
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    left = counts.copy()
    scaled = classes / limits
    weight = (scaled * counts[:, None]).sum(0)
    weight = weight / max(weight.sum(), 1e-12)
    weighted = scaled * weight
    out = np.empty(len(size), np.int64)
    box, space = 0, limits.astype(np.int64).copy()
    live = np.arange(len(classes))
    remaining = len(size)
    while remaining:
        fits = np.flatnonzero((classes[live] <= space).all(1))
        if not len(fits):
            box, space = box + 1, limits.astype(np.int64).copy()
            continue
        score = weighted[live[fits]] @ (space / limits)
        c = live[fits[len(fits) - 1 - int(np.argmax(score[::-1]))]]
        out[queue[first[c] + counts[c] - left[c]]] = box
        space -= classes[c]
        left[c] -= 1
        remaining -= 1
        if not left[c]:
            live = live[live != c]
    return out


def containers(docs: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int = LOSS_CAPACITY, shard_items: int = SHARD_ITEMS, path: str = VOCABULARY) -> DataFrame:
    """(container, doc_id, part, n_tokens, n_loss) for every document."""
    n = docs.count()
    shards = max(1, math.ceil(n / shard_items))
    sized = items(docs, capacity, loss_capacity, path).withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["doc_id", "part"]).reset_index(drop=True)
        size = np.stack([p["n_tokens"], np.ones(len(p), np.int64), p["n_loss"]], 1).astype(np.int64)
        box = pack(size, np.array([capacity, segments, loss_capacity]))
        return pd.DataFrame({"container": [f"{p['shard'].iloc[0]}-{b}" for b in box], "doc_id": p["doc_id"], "part": p["part"], "n_tokens": p["n_tokens"], "n_loss": p["n_loss"]})

    # the rows are small but the work is not: one task a shard, as an exchange of a stated number is not coalesced
    return sized.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "container string, doc_id long, part long, n_tokens long, n_loss long")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its container."""
    return containers(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every container with its documents, its tokens and the share of its space that is used."""
    c = containers(table(spark, d, "documents"))
    return c.groupBy("container").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / CAPACITY, 6).alias("used"))


def p8_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every document that was packed, and whether one of its containers is beyond a limit, which SQL states as never."""
    c = containers(table(spark, d, "documents"))
    beyond = (F.sum("n_tokens") > CAPACITY) | (F.count("*") > SEGMENTS) | (F.sum("n_loss") > LOSS_CAPACITY)
    return c.join(c.groupBy("container").agg(beyond.alias("beyond")), "container").groupBy("doc_id").agg(F.max("beyond").alias("beyond"))


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_docs": p8_docs}
SQL = {"p8_docs": "select doc_id, false beyond from documents where text is not null"}
