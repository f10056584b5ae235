"""Ranked search: BM25 over texts, exact cosine search, their fusion by reciprocal ranks, and relevance measures."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
QUERY_BLOCK = 4096


def bm25(docs: DataFrame, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) for every document (id, text) that holds one of the terms, words being lower-case runs of a-z and 0-9. No terms or only
    blank ones: no rows.

    One pass counts each document's terms; only documents that hold a term leave it, and the statistics are one row. Empty texts
    count towards the average length.
    """
    terms = sorted({t.lower() for t in terms if t.strip()})
    text = F.lower(F.coalesce("text", F.lit("")))
    # a plain search spares the pattern on documents without the term
    counts = [F.when(F.contains(text, F.lit(t)), F.regexp_count(text, F.lit(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])"))).otherwise(0).cast("double") for t in terms]
    tf = docs.select("id", F.regexp_count(text, F.lit("[a-z0-9]+")).cast("double").alias("len"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)])
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avglen"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    joined = tf.where(F.lit(False) if not terms else F.expr(" or ".join(f"tf{i} > 0" for i in range(len(terms))))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    return joined.select("id", score.alias("score"))


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, rank) by falling score, ties by id. With a limit only the first rows are sorted on one task."""
    if limit is not None:
        scores = scores.orderBy(F.desc("score"), "id").limit(max(0, limit))
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def fuse(first: DataFrame, second: DataFrame | None, k: int = 60, limit: int | None = None) -> DataFrame:
    """(id, rrf) by the sum of 1 / (k + rank) over one or two legs (id, rank); a missing leg adds nothing."""
    legs = first.select("id", "rank")
    if second is not None:
        legs = legs.unionByName(second.select("id", "rank"))
    out = legs.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))
    return out.orderBy(F.desc("rrf"), "id").limit(limit) if limit is not None else out


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None, same: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, similarity): for each query its k most similar vectors of (id, embedding) by exact cosine, not itself.

    The stated queries are broadcast in blocks of about `block` rows; each batch of vectors meets a block as one matrix
    product and only its k best per query leave the task. `same` names a column that must be equal. Null, zero or odd-sized
    vectors take no part. Ties go to the smaller id.
    """
    extra = [same] if same else []
    spark = vectors.sparkSession
    rows = queries.select("id", "embedding", *extra).where("embedding is not null")
    blocks = max(1, -(-rows.count() // block))
    out = None
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        dims = pd.Series([len(r["embedding"]) for r in part]).mode()
        dim = int(dims.iloc[0]) if len(dims) else 0
        part = [r for r in part if len(r["embedding"]) == dim and any(r["embedding"])]
        q = np.array([r["embedding"] for r in part], np.float64).reshape(len(part), dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((q, np.array([r["id"] for r in part]), np.array([r[same] for r in part]) if same else None))

        def run(pdfs, shared=shared, dim=dim):
            q, ids, groups = shared.value
            for p in pdfs:
                ok = [v is not None and len(v) == dim and bool(np.any(v)) for v in p["embedding"]]
                p = p[ok]
                if not len(p) or not len(q):
                    continue
                x = np.stack(p["embedding"]).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sim = q @ x.T
                pid = p["id"].to_numpy()
                sim[ids[:, None] == pid[None, :]] = -2
                if groups is not None:
                    sim[groups[:, None] != p[same].to_numpy()[None, :]] = -2
                order = np.lexsort((np.broadcast_to(pid, sim.shape), -sim))[:, :k]
                best = np.take_along_axis(sim, order, 1)
                r, c = np.nonzero(best > (-1.5 if floor is None else floor - 1e-12))
                yield pd.DataFrame({"query_id": ids[r], "id": pid[order[r, c]], "similarity": best[r, c]})

        kind = vectors.schema["id"].dataType.simpleString()
        got = vectors.select("id", "embedding", *extra).mapInPandas(run, f"query_id {kind}, id {kind}, similarity double")
        out = got if out is None else out.unionByName(got)
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hit_and_mrr(results: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """(query, hit, rr): share of the relevant ids in the first k, and one over the rank of the top choice, 0 if absent.

    results: (query, id, rank); judgements: (query, relevant ARRAY, top_choice).
    """
    r = results.where(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x")).select("query", F.transform("x", lambda y: y["id"]).alias("ids"))
    j = judgements.join(r, "query", "left").withColumn("ids", F.coalesce("ids", F.array().cast(judgements.schema["relevant"].dataType)))
    pos = F.array_position("ids", F.col("top_choice"))
    hit = F.size(F.array_intersect("ids", "relevant")) / F.size("relevant")
    return j.select("query", hit.alias("hit"), F.when(pos > 0, 1.0 / pos).otherwise(0.0).alias("rr"))


def function_text(df: DataFrame) -> Column:
    """The text of a function that is embedded: kind and name, parameters, container, documentation up to 500 characters; empty parts are left out."""
    kind = F.when(F.col("is_method"), "method").when(F.col("is_async"), "async function").otherwise("function")
    params = F.array_join("params", ", ")
    return F.concat_ws(
        "\n",
        F.concat(kind, F.lit(" "), F.col("qualified_name")),
        F.when(params != "", F.concat(F.lit("params: "), params)),
        F.when(F.coalesce("parent_class_qn", F.lit("")) != "", F.concat(F.lit("in "), F.col("parent_class_qn"))),
        F.when(F.coalesce("docstring", F.lit("")) != "", F.substring("docstring", 1, 500)),
    )


def hashed_embedding(df: DataFrame, dim: int = 64) -> DataFrame:
    """(id, embedding): words hashed to signed coordinates, scaled to length one; an offline stand-in for a model."""

    def run(pdfs):
        for p in pdfs:
            out = []
            for text in p["text"]:
                v = np.zeros(dim)
                for w in (text or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.DataFrame({"id": p["id"], "embedding": out})

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>")
