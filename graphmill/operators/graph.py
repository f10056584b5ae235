"""Graph analytics over (repo, source, target) edges: projections, flows, components, communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.functions.scratch import Scratch

MIN_PATH, MAX_PATH, FRONTIER_LIMIT = 2, 8, 50_000_000


def call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct calls (repo, source, target) between functions of the repo, without calls of a function to itself."""
    own = functions.select("repo", F.col("qualified_name").alias("qn")).distinct()
    e = calls.select("repo", F.col("caller_qn").alias("source"), F.col("callee_qn").alias("target")).where("source <> target").distinct()
    e = e.join(own.withColumnRenamed("qn", "source"), ["repo", "source"], "left_semi")
    return e.join(own.withColumnRenamed("qn", "target"), ["repo", "target"], "left_semi").select("repo", "source", "target")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges once per unordered pair (repo, a, b), a before b; loops are kept."""
    return edges.select("repo", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def code_graph(calls: DataFrame, inherits: DataFrame, imports: DataFrame, members: DataFrame) -> DataFrame:
    """Undirected edges (repo, a, b) between members of a repo: calls and inheritance between two of them, and for each import of a
    module the first member by name of the importing file with that of the module's file.

    calls and inherits: repo, source, target; imports: repo, path, target_path; members: repo, path, member.
    """
    m = members.where("member is not null").select("repo", "path", "member").distinct()
    own = m.select("repo", "member").distinct()
    e = calls.select("repo", "source", "target").unionByName(inherits.select("repo", "source", "target")).distinct()
    e = e.join(own.withColumnRenamed("member", "source"), ["repo", "source"], "left_semi").join(own.withColumnRenamed("member", "target"), ["repo", "target"], "left_semi")
    first = m.groupBy("repo", "path").agg(F.min("member").alias("member"))
    i = imports.select("repo", "path", "target_path").distinct().join(first.withColumnRenamed("member", "source"), ["repo", "path"])
    i = i.join(first.select("repo", F.col("path").alias("target_path"), F.col("member").alias("target")), ["repo", "target_path"]).where("source <> target")
    return undirected(e.select("repo", "source", "target").unionByName(i.select("repo", "source", "target")))


def entry_points(edges: DataFrame) -> DataFrame:
    """(repo, node): nodes that call and are not called; in a repo without any, the calling nodes called least."""
    out = edges.groupBy("repo", F.col("source").alias("node")).agg(F.count("*").alias("n_out"))
    ins = edges.groupBy("repo", F.col("target").alias("node")).agg(F.count("*").alias("n_in"))
    deg = out.join(ins, ["repo", "node"], "left").select("repo", "node", F.coalesce("n_in", F.lit(0).cast("long")).alias("n_in"))
    least = deg.groupBy("repo").agg(F.min("n_in").alias("least"))
    return deg.join(least, "repo").where("n_in = least").select("repo", "node")


def chains(edges: DataFrame, entries: DataFrame, longest: int = MAX_PATH, limit: int = FRONTIER_LIMIT, name: str = "chains") -> DataFrame:
    """(repo, path) of all simple forward paths of 2 to `longest` nodes that begin at an entry; every prefix is a path.

    One join per added node, the partial paths written between; raises when more than `limit` paths lead on, since
    their number can grow with every step.
    """
    scratch = Scratch(edges.sparkSession, name)
    e = scratch.save(edges.select("repo", F.col("source").alias("__s"), F.col("target").alias("__t")))
    frontier = scratch.save(entries.select("repo", F.array("node").alias("path")))
    out = None
    for _ in range(longest - 1):
        step = frontier.withColumn("__last", F.element_at("path", -1)).join(e.withColumnRenamed("repo", "__r"), (F.col("repo") == F.col("__r")) & (F.col("__last") == F.col("__s")))
        frontier = scratch.save(step.where(~F.array_contains("path", F.col("__t"))).select("repo", F.array_append("path", F.col("__t")).alias("path")))
        out = frontier if out is None else out.unionByName(frontier)
        n = frontier.count()
        if n > limit:
            raise ValueError(f"{n} paths lead on, more than the limit of {limit}")
        if not n:
            break
    return out


def chain_score(path: Column, labels: Column) -> Column:
    """Length times the number of different labels less one; nodes without label do not count."""
    return F.size(path) * F.greatest(F.size(F.array_distinct(F.array_compact(labels))) - 1, F.lit(0))


def scored_chains(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo, path, score) of paths whose score is above zero; labels: (repo, node, label)."""
    p = paths.withColumn("path_id", F.array_join("path", "|"))
    x = p.select("repo", "path_id", F.size("path").alias("len"), F.explode("path").alias("node")).join(labels, ["repo", "node"], "left")
    s = x.groupBy("repo", "path_id").agg(F.max("len").alias("len"), F.countDistinct("label").alias("n_labels"))
    return s.select("repo", "path_id", (F.col("len") * F.greatest(F.col("n_labels") - 1, F.lit(0))).cast("long").alias("score")).where("score > 0")


def top_processes(scored: DataFrame, keep: int = 50) -> DataFrame:
    """(repo, rank, name, path_id, score): per repo the best chains by score and path, named by first and last node's last part; equal
    names are numbered in that order."""
    w = W.partitionBy("repo").orderBy(F.desc("score"), "path_id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    nodes = F.split("path_id", r"\|")
    base = F.concat(last(F.element_at(nodes, 1)), F.lit(" -> "), last(F.element_at(nodes, -1)))
    top = top.withColumn("base", base).withColumn("k", F.row_number().over(W.partitionBy("repo", "base").orderBy("rank")))
    return top.select("repo", F.col("rank").cast("long").alias("rank"), F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" #"), F.col("k").cast("string"))).alias("name"), "path_id", "score")


def process_steps(top: DataFrame) -> DataFrame:
    """(repo, name, step, member) of the rows of `top_processes`, steps counted from 0."""
    return top.select("repo", "name", F.posexplode(F.split("path_id", r"\|")).alias("step", "member")).withColumn("step", F.col("step").cast("long"))


def process_summary(path_id: str | Column, shown: int = 6) -> Column:
    """The last name parts of a path's first nodes, with three dots where there are more."""
    nodes = F.transform(F.split(path_id, r"\|"), lambda x: F.element_at(F.split(x, r"\."), -1))
    return F.concat(F.array_join(F.slice(nodes, 1, shown), ", "), F.when(F.size(nodes) > shown, "...").otherwise(""))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo, label, cohesion): share of a community's edges that stay inside, 0 without edges; edges (repo, a, b) undirected."""
    l1 = labels.select("repo", F.col("node").alias("a"), F.col("label").alias("la"))
    l2 = labels.select("repo", F.col("node").alias("b"), F.col("label").alias("lb"))
    e = edges.join(l1, ["repo", "a"]).join(l2, ["repo", "b"])
    inside = F.col("la") == F.col("lb")
    ends = e.select("repo", F.explode(F.when(inside, F.array("la")).otherwise(F.array("la", "lb"))).alias("label"), inside.alias("inside"))
    per = ends.groupBy("repo", "label").agg(F.sum(F.col("inside").cast("long")).alias("intra"), F.count("*").alias("total"))
    every = labels.select("repo", "label").distinct()
    return every.join(per, ["repo", "label"], "left").select("repo", "label", F.round(F.coalesce(F.col("intra") / F.col("total"), F.lit(0.0)), 6).alias("cohesion"))


def _words(members: DataFrame) -> DataFrame:
    """(repo, label, token, n, first): words of the members' last two name parts with their number and first place in order of members."""
    parts = F.slice(F.split("member", r"\."), -2, 2)
    two = F.when(F.size(F.split("member", r"\.")) < 2, F.split("member", r"\.")).otherwise(parts)
    words = F.filter(F.split(F.regexp_replace(F.lower(F.array_join(two, ".")), "[^a-z._-]", ""), "[._-]"), lambda x: x != "")
    x = members.select("repo", "label", "member", F.posexplode(words).alias("i", "token"))
    return x.groupBy("repo", "label", "token").agg(F.count("*").alias("n"), F.min(F.struct("member", "i")).alias("first"))


def label_tokens(members: DataFrame) -> DataFrame:
    """(repo, label, token): a community's most frequent word of its members' last two name parts, the earliest in order of members among equals."""
    best = _words(members).groupBy("repo", "label").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "token")).alias("m"))
    return best.select("repo", "label", F.col("m.token").alias("token"))


def community_names(members: DataFrame) -> DataFrame:
    """(repo, label, name): communities named by their most frequent word, in the order of their size and label; a word that is taken
    gets the next most frequent ones after it until the pair is free, else the name is `cluster_` and the community's place.

    members: repo, label, member. Words of a repo's communities stream through one task in that order, which only holds the names taken.
    """
    size = members.select("repo", "label", "member").distinct().groupBy("repo", "label").agg(F.count("*").alias("size"))
    words = _words(members.select("repo", "label", "member").distinct())
    rows = size.join(words, ["repo", "label"], "left")

    def run(pdfs):
        repo = label = None
        place, used, first, name = -1, set(), None, None
        for p in pdfs:
            out = []
            for r, x, token in zip(p["repo"], p["label"], p["token"]):
                if (r, x) != (repo, label):
                    if label is not None:
                        name = name or f"cluster_{place}"
                        used.add(name)
                        out.append((repo, label, name))
                    if r != repo:
                        place, used = -1, set()
                    repo, label, place, first, name = r, x, place + 1, token, None
                    if token is not None and token not in used:
                        name = token
                elif name is None and f"{first}_{token}" not in used:
                    name = f"{first}_{token}"
            yield pd.DataFrame(out, columns=["repo", "label", "name"])
        if label is not None:
            yield pd.DataFrame([(repo, label, name or f"cluster_{place}")], columns=["repo", "label", "name"])

    ordered = rows.repartition("repo").sortWithinPartitions("repo", F.desc("size"), "label", F.desc("n"), "first")
    return ordered.select("repo", "label", "token").mapInPandas(run, "repo string, label string, name string")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b), by alternating small-star and large-star joins.

    Each round replaces edges by ones to the least neighbour, so rounds grow with the logarithm of the component's size; whether
    a round changed anything is observed while its edges are written. Raises where `max_rounds` rounds do not end it.
    """
    scratch = Scratch(edges.sparkSession, name)
    cur = scratch.save(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = cur.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    last = None
    for _ in range(max_rounds):
        star = cur.where("a <> b")
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = scratch.save(both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct())
        low2 = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low2, F.col("b") == F.col("u")).select(F.col("m").alias("x"), "a", "b")
        nxt = small.select(F.col("x").alias("p"), F.col("b").alias("q")).unionByName(small.select(F.col("x").alias("p"), F.col("a").alias("q"))).where("p <> q")
        seen = Observation()
        new = scratch.save(nxt.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        scratch.drop(large)
        if last is not None:  # the first table stays for the nodes
            scratch.drop(cur)
        cur, now = new, (seen.get["n"], seen.get["h"])
        if now == last:
            return nodes.join(cur.select(F.col("b").alias("node"), F.col("a").alias("root")).groupBy("node").agg(F.min("root").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
        last = now
    raise ValueError(f"no components after {max_rounds} rounds")


def strong_components(edges: DataFrame, name: str = "scc", max_rounds: int = 200) -> DataFrame:
    """(node, component): nodes that reach each other share the least of them; others are their own. edges: (source, target).

    Forward and backward closures as frontier loops over the pairs, met in one join; for module graphs, whose closures are small.
    """
    from graphmill.operators.lookup import closure

    e = edges.where("source is not null and target is not null").select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()
    nodes = e.select(F.explode(F.array("parent", "child")).alias("root")).distinct()
    reach = closure(e, nodes, name, max_rounds)
    back = reach.select(F.col("root").alias("node"), F.col("node").alias("root"))
    mutual = reach.join(back, ["root", "node"])
    return mutual.groupBy(F.col("root").alias("node")).agg(F.min("node").alias("component"))


def _louvain(a: np.ndarray, b: np.ndarray, n: int, resolution: float) -> np.ndarray:
    """Community of each of n nodes by local moves in fixed order and aggregation, until nothing gains."""
    label = np.arange(n)
    weights: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for x, y in zip(a.tolist(), b.tolist()):
        weights[x][y] = weights[x].get(y, 0.0) + 1.0
        if x != y:
            weights[y][x] = weights[y].get(x, 0.0) + 1.0
    while True:
        size = len(weights)
        degree = {i: sum(w for j, w in ws.items() if j != i) + 2 * ws.get(i, 0.0) for i, ws in weights.items()}
        total = sum(degree.values()) or 1.0
        com = {i: i for i in weights}
        mass = dict(degree)
        moved_any = False
        for _ in range(100):
            moved = False
            for i in sorted(weights):
                links: dict[int, float] = {}
                for j, w in weights[i].items():
                    if j != i:
                        links[com[j]] = links.get(com[j], 0.0) + w
                mass[com[i]] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * mass[c] / total  # noqa: B023, E731
                best = max(sorted({*links, com[i]}), key=lambda c: (gain(c), c == com[i]))
                if best != com[i] and gain(best) > gain(com[i]) + 1e-12:
                    com[i] = best
                    moved = moved_any = True
                mass[com[i]] += degree[i]
            if not moved:
                break
        names = {c: k for k, c in enumerate(sorted(set(com.values())))}
        label = np.array([names[com[x]] for x in label.tolist()])
        if not moved_any or len(names) == size:
            return label
        merged: dict[int, dict[int, float]] = {k: {} for k in range(len(names))}
        for i, ws in weights.items():
            for j, w in ws.items():
                if j < i:
                    continue
                x, y = names[com[i]], names[com[j]]
                merged[x][y] = merged[x].get(y, 0.0) + w
                if x != y:
                    merged[y][x] = merged[x][y]
        weights = merged


def louvain(edges: DataFrame, resolution: float = 2.0) -> DataFrame:
    """(repo, node, label): communities of each repo's undirected graph (repo, a, b), the label being the community's least node.

    Repos are independent, and so are connected components within one: each component is a task's group, so only
    a component that is itself huge weighs on one task. Deterministic: nodes move in the order of their names.
    """
    sep = "\x01"
    keyed = edges.select("repo", F.concat_ws(sep, "repo", "a").alias("a"), F.concat_ws(sep, "repo", "b").alias("b"))
    comp = components(keyed.select("a", "b"), "louvain")
    placed = keyed.join(comp.withColumnRenamed("node", "a"), "a").select("repo", "component", "a", "b")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate((p["a"].to_numpy().astype(object), p["b"].to_numpy().astype(object))))
        at = {x: i for i, x in enumerate(names)}
        q = p.sort_values(["a", "b"])
        lab = _louvain(np.array([at[x] for x in q["a"]]), np.array([at[x] for x in q["b"]]), len(names), resolution)
        first: dict[int, str] = {}
        for x, k in zip(names, lab.tolist()):
            first.setdefault(k, x)
        bare = lambda x: x.split(sep, 1)[1]
        return pd.DataFrame({"repo": [p["repo"].iloc[0]] * len(names), "node": [bare(x) for x in names], "label": [bare(first[k]) for k in lab.tolist()]})

    return placed.groupBy("component").applyInPandas(run, "repo string, node string, label string")
