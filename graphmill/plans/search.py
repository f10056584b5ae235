"""Queries of ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import lookup as lk
from graphmill.operators import search as se
from graphmill.sources.tables import table

TERMS = ["route", "tables", "lease", "tenant"]
RELEVANCE = [("orphaned branches", ["orphaned", "branches"]), ("token counts", ["token", "counts"]), ("late callbacks", ["late", "callbacks"]), ("snapshot store", ["snapshot", "store"])]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def bm25(s: SparkSession, d: str) -> DataFrame:
    return se.bm25(_docs(s, d), TERMS).select("id", F.round("score", 6).alias("score"))


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    v = _vectors(s, d)
    return se.vector_topk(v, v.where("id % 100 = 0"), 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def knn(s: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of the same label, of similarity at least 0.3, for the same queries."""
    v = _vectors(s, d)
    return se.vector_topk(v, v.where("id % 100 = 0"), 3, floor=0.3, same="label").select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def context_union(s: SparkSession, d: str) -> DataFrame:
    """Per query vector the similar ones, tagged, together with the label's first three members as its own line."""
    v = _vectors(s, d)
    q = v.where("id % 100 = 0")
    near = se.vector_topk(v, q, 3, floor=0.3, same="label").select("query_id", "id", F.lit("similar").alias("source"))
    own = q.select(F.col("id").alias("query_id"), F.col("id"), F.lit("ancestor").alias("source"))
    return near.unionByName(own)


def rrf(s: SparkSession, d: str) -> DataFrame:
    """Documents and vectors of the same number fused: the BM25 leg and the leg nearest to vector 0, 200 each; first 100."""
    v = _vectors(s, d)
    vec = se.vector_topk(v, v.where("id = 0"), 200).select("id", "rank")
    return se.fuse(se.ranked(se.bm25(_docs(s, d), TERMS), 200), vec, limit=100).select("id", F.round("rrf", 9).alias("rrf"))


def rrf_bm25_only(s: SparkSession, d: str) -> DataFrame:
    return se.fuse(se.ranked(se.bm25(_docs(s, d), TERMS), 200), None, limit=100).select("id", F.round("rrf", 9).alias("rrf"))


def embed_text(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "function_node")
    return f.select("repo", "qualified_name", se.function_text(f).alias("text")).distinct()


def embed_hash(s: SparkSession, d: str) -> DataFrame:
    return se.hashed_embedding(table(s, d, "class_node").select(F.concat_ws(" ", "repo", "qualified_name").alias("id"), F.concat_ws(" ", F.regexp_replace("name", "([A-Z])", " $1"), "docstring").alias("text")).distinct())


def hit_mrr(s: SparkSession, d: str) -> DataFrame:
    """Search judged against the documents that hold the phrase: hit rate and reciprocal rank at 10 per phrase."""
    docs = _docs(s, d)
    results = judged = None
    for phrase, terms in RELEVANCE:
        r = se.ranked(se.bm25(docs, terms), 10).select(F.lit(phrase).alias("query"), "id", "rank")
        has = docs.where(F.contains(F.lower("text"), F.lit(phrase))).orderBy("id").limit(10)
        j = has.agg(F.array_sort(F.collect_list("id")).alias("relevant"), F.min("id").alias("top_choice")).select(F.lit(phrase).alias("query"), "relevant", "top_choice")
        results = r if results is None else results.unionByName(r)
        judged = j if judged is None else judged.unionByName(j)
    return se.hit_and_mrr(results, judged, 10).select("query", F.round("hit", 6).alias("hit"), F.round("rr", 6).alias("rr"))


def _bm25_sql(terms: list[str], name: str = "b") -> str:
    tf = lambda t: f"cast(len(list_filter(w, lambda x: x = '{t}')) as double)"
    tfs = ", ".join(f"{tf(t)} tf{i}" for i, t in enumerate(sorted(terms)))
    dfs = ", ".join(f"cast(count(*) filter (tf{i} > 0) as double) df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avglen))" for i in range(len(terms)))
    any_ = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}t as (select doc_id id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w from documents), {name}f as (select id, cast(len(w) as double) len, {tfs} from {name}t),
{name}s as (select count(*) n, avg(len) avglen, {dfs} from {name}f), {name} as (select id, {score} score from {name}f, {name}s where {any_})"""


_COS = "list_cosine_similarity(list_transform(q.embedding, lambda x: cast(x as double)), list_transform(e.embedding, lambda x: cast(x as double)))"
_KNN = f"sim as (select q.vec_id query_id, e.vec_id id, q.label ql, e.label el, {_COS} similarity from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0)"
_HIT = ", ".join(
    _bm25_sql(t, f"b{i}") + f", r{i} as (select id, row_number() over (order by score desc, id) as rank from b{i} qualify rank <= 10), j{i} as (select list(id order by id) relevant, min(id) top from (select doc_id id from documents where contains(lower(text), '{p}') order by doc_id limit 10)), h{i} as (select '{p}' as query, (select count(*) from r{i} where list_contains((select relevant from j{i}), r{i}.id)) / (select len(relevant) from j{i}) hit, coalesce((select 1.0::double / rank from r{i} where id = (select top from j{i})), 0.0) rr)"
    for i, (p, t) in enumerate(RELEVANCE)
)

QUERIES = {f.__name__: f for f in (bm25, vector_topk, knn, context_union, rrf, rrf_bm25_only, embed_text, embed_hash, hit_mrr)}
SQL = {
    "bm25": f"with {_bm25_sql(TERMS)} select id, round(score, 6) score from b",
    "vector_topk": f"with {_KNN} select query_id, id, round(similarity, 6) similarity, row_number() over (partition by query_id order by similarity desc, id) as rank from sim qualify rank <= 10",
    "knn": f"with {_KNN} select query_id, id, round(similarity, 6) similarity from sim where ql = el and similarity >= 0.3 qualify row_number() over (partition by query_id order by similarity desc, id) <= 3",
    "context_union": f"with {_KNN} select * from (select query_id, id, 'similar' source from sim where ql = el and similarity >= 0.3 qualify row_number() over (partition by query_id order by similarity desc, id) <= 3) union all select vec_id, vec_id, 'ancestor' from embeddings where vec_id % 100 = 0",
    "rrf": f"with {_KNN}, {_bm25_sql(TERMS)}, legs as (select id, row_number() over (order by score desc, id) r from b qualify r <= 200 union all select id, row_number() over (order by similarity desc, id) r from sim where query_id = 0 qualify r <= 200), f as (select id, sum(1.0::double / (60 + r)) rrf from legs group by 1) select id, round(rrf, 9) rrf from f order by f.rrf desc, id limit 100",
    "rrf_bm25_only": f"with {_bm25_sql(TERMS)}, legs as (select id, row_number() over (order by score desc, id) r from b qualify r <= 200) select id, round(1.0::double / (60 + r), 9) rrf from legs where r <= 100",
    "embed_text": "select distinct repo, qualified_name, concat_ws(chr(10), concat(case when is_method then 'method' when is_async then 'async function' else 'function' end, ' ', qualified_name), case when array_to_string(params, ', ') <> '' then concat('params: ', array_to_string(params, ', ')) end, case when coalesce(parent_class_qn, '') <> '' then concat('in ', parent_class_qn) end, case when coalesce(docstring, '') <> '' then left(docstring, 500) end) as text from function_node",
    "hit_mrr": "with " + _HIT + " " + " union all ".join(f"select query, round(hit, 6) hit, round(rr, 6) rr from h{i}" for i in range(len(RELEVANCE))),
}
