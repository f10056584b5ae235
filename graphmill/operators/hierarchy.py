"""Parent-child links to depth, root, subtree size, paths and cycles, by Euler tours and parallel list ranking.

Every node contributes list elements: an inner node an entry (2n) and an exit (2n+1), a leaf one element for both, so
leaves are peeled into their parent's list at once. Each element's successor follows from its own row and its next
sibling, hence the tours of all trees are linked by one window and one join, without walking. Ranking contracts
the lists: per round, elements whose random priority exceeds both neighbours' are spliced out (about a third), in one hash
aggregation; lists that are down to their head leave. What is left after the contraction is ranked by
pointer jumping in one task once it has at most `base_rows` elements, a fixed bound. Then the spliced elements get
their ranks back, latest first. Rounds grow with the logarithm of the number of nodes, whatever the depth.

A tour that never ends lies on a component with a cycle. The entry and the exit of a node on a cycle fall into
different endless tours, those of a node below it into one: that is how cycles are found.

Hot parents: siblings are chained within (parent, salt) groups whose number follows the table's size, then the groups
are chained, so no window holds all children of one parent.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.functions.scratch import Scratch

BASE_ROWS = 1 << 18
SIBLINGS_PER_GROUP = 250_000
TOUR_POSITIONS = 1 << 16
HELD_IDS = 200_000
NONE = -1

_RANKED = "e long, pos long, dep long, head long"


def number_nodes(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From (id, parent): nodes (id, n) with a number each, and links (n, p), p null where no such parent exists."""
    nodes = scratch.save(df.select("id", "parent", F.monotonically_increasing_id().alias("n")))
    parents = nodes.select(F.col("id").alias("__id"), F.col("n").alias("p"))
    links = scratch.save(nodes.join(parents, F.col("parent") == F.col("__id"), "left").select("n", "p"))
    return nodes, links


def tour_elements(links: DataFrame, n_nodes: int, siblings_per_group: int) -> DataFrame:
    """List elements (e, nx, w, d): successor, positions taken, change of depth. nx is NONE at the end of a tree's tour."""
    salts = max(1, math.ceil(n_nodes / siblings_per_group))
    kids = links.where("p is not null").select("n", "p", F.pmod(F.xxhash64("n"), F.lit(salts)).alias("s"))
    kids = kids.withColumn("sib", F.lead("n").over(W.partitionBy("p", "s").orderBy("n")))
    groups = kids.groupBy("p", "s").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    if salts > 1:
        groups = groups.withColumn("after", F.lead("first").over(W.partitionBy("p").orderBy("s")))
        after = groups.where("after is not null").select(F.col("last").alias("__last"), "after")
        kids = kids.join(after, (F.col("n") == F.col("__last")) & F.col("sib").isNull(), "left").withColumn("sib", F.coalesce("sib", "after"))
    firsts = groups.groupBy("p").agg(F.min_by("first", "s").alias("first")).select(F.col("p").alias("n"), F.col("first"))
    # kids first: an inner join with the parents' list of children tells inner nodes from leaves
    after_kid = kids.select("n", F.coalesce(F.col("sib") * 2, F.col("p") * 2 + 1).alias("then"))
    roots = links.where("p is null").select("n", F.lit(NONE).cast("long").alias("then"))
    every = after_kid.unionByName(roots).join(firsts, "n", "left").where(f"first is not null or then <> {NONE}")
    entry = F.when(F.col("first").isNull(), F.struct((F.col("n") * 2).alias("e"), F.col("then").alias("nx"), F.lit(2).cast("long").alias("w"), F.lit(0).cast("long").alias("d"))).otherwise(
        F.struct((F.col("n") * 2).alias("e"), (F.col("first") * 2).alias("nx"), F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("d"))
    )
    exit_ = F.when(F.col("first").isNotNull(), F.struct((F.col("n") * 2 + 1).alias("e"), F.col("then").alias("nx"), F.lit(1).cast("long").alias("w"), F.lit(-1).cast("long").alias("d")))
    return every.select(F.explode(F.array_compact(F.array(entry, exit_))).alias("x")).select("x.*")


def _with_previous(el: DataFrame) -> DataFrame:
    """Adds the previous element and the weights between (pv, pw, pd): each element tells its successor."""
    nul = F.lit(None).cast("long")
    own = el.select("e", "nx", "w", "d", nul.alias("pv"), nul.alias("pw"), nul.alias("pd"))
    told = el.where(f"nx <> {NONE}").select(F.col("nx").alias("e"), nul.alias("nx"), nul.alias("w"), nul.alias("d"), F.col("e").alias("pv"), F.col("w").alias("pw"), F.col("d").alias("pd"))
    return own.unionByName(told).groupBy("e").agg(*[F.max(c).alias(c) for c in ("nx", "w", "d")], F.coalesce(F.max("pv"), F.lit(NONE)).alias("pv"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("pw", "pd")])


def _spliced(rnd: int):
    """Whether an element leaves in this round, judged from its own row alone."""
    h = lambda c: F.xxhash64(F.col(c), F.lit(rnd))
    return (F.col("pv") != NONE) & (F.col("pv") != F.col("e")) & (h("pv") < h("e")) & ((F.col("nx") == NONE) | (h("nx") < h("e")))


def _contract(el: DataFrame, rnd: int) -> DataFrame:
    """The list without the elements of `_spliced`; their neighbours are told of each other."""
    gone = _spliced(rnd)
    nul = F.lit(None).cast("long")
    names = ["nx", "w", "d", "pv", "pw", "pd", "nx2", "w2", "d2", "pv2", "pw2", "pd2"]
    own = el.where(~gone).select("e", "nx", "w", "d", "pv", "pw", "pd", *[nul.alias(c) for c in names[6:]])
    out = el.where(gone)
    left = out.select(F.col("pv").alias("e"), *[nul.alias(c) for c in names[:6]], F.col("nx").alias("nx2"), (F.col("pw") + F.col("w")).alias("w2"), (F.col("pd") + F.col("d")).alias("d2"), *[nul.alias(c) for c in names[9:]])
    right = out.where(f"nx <> {NONE}").select(F.col("nx").alias("e"), *[nul.alias(c) for c in names[:9]], F.col("pv").alias("pv2"), (F.col("pw") + F.col("w")).alias("pw2"), (F.col("pd") + F.col("d")).alias("pd2"))
    merged = own.unionByName(left).unionByName(right).groupBy("e").agg(*[F.max(c).alias(c) for c in names])
    return merged.select("e", *[F.coalesce(F.col(f"{c}2"), F.col(c)).alias(c) for c in ("nx", "w", "d", "pv", "pw", "pd")])


def _rank_rest(pdfs):
    """Pointer jumping over at most base_rows elements: position and depth from the head, or the smallest element of a loop."""
    parts = list(pdfs)
    if not parts:
        return
    p = pd.concat(parts, ignore_index=True)
    if not len(p):
        return
    e = p["e"].to_numpy(np.int64)
    order = np.argsort(e)
    e = e[order]
    pv = p["pv"].to_numpy(np.int64)[order]
    me = np.arange(len(e))
    is_head = pv == NONE
    ptr = np.where(is_head, me, np.searchsorted(e, pv))
    pos = np.where(is_head, 0, p["pw"].to_numpy(np.int64)[order])
    dep = np.where(is_head, 0, p["pd"].to_numpy(np.int64)[order])
    low = e.copy()
    for _ in range(max(1, math.ceil(math.log2(len(e) + 1)) + 1)):
        pos, dep, low, ptr = pos + pos[ptr], dep + dep[ptr], np.minimum(low, low[ptr]), ptr[ptr]
    tree = is_head[ptr]
    yield pd.DataFrame({"e": e, "pos": np.where(tree, pos, 0), "dep": np.where(tree, dep, 0), "head": np.where(tree, e[ptr], -low - 1)})


def rank(elements: DataFrame, scratch: Scratch, base_rows: int = BASE_ROWS) -> DataFrame:
    """(e, pos, dep, head) for every element; head is the first element of its tour, or -(loop + 1) on an endless one."""
    active = scratch.save(_with_previous(elements))
    removed: list[DataFrame] = []
    ranked: list[DataFrame] = []
    rnd = 0
    while active.count() > base_rows:
        rnd += 1
        removed.append(scratch.save(active.where(_spliced(rnd)).select("e", "pv", "pw", "pd")))
        merged = scratch.save(_contract(active, rnd))
        scratch.drop(active)
        alone = (F.col("pv") == NONE) & (F.col("nx") == NONE) | (F.col("pv") == F.col("e"))
        zero = F.lit(0).cast("long")
        ranked.append(merged.where(alone).select("e", zero.alias("pos"), zero.alias("dep"), F.when(F.col("pv") == NONE, F.col("e")).otherwise(-F.col("e") - 1).alias("head")))
        active = merged.where(~alone)
    ranked.append(scratch.save(active.select("e", "pv", "pw", "pd").coalesce(1).mapInPandas(_rank_rest, _RANKED)))
    for gone in reversed(removed):
        known = ranked[0]
        for part in ranked[1:]:
            known = known.unionByName(part)
        known = known.select(F.col("e").alias("pv"), "pos", "dep", "head")
        back = gone.join(known, "pv").select("e", (F.col("pos") + F.col("pw")).alias("pos"), (F.col("dep") + F.col("pd")).alias("dep"), "head")
        ranked.append(scratch.save(back))
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part)
    return out


def hierarchy(df: DataFrame, base_rows: int = BASE_ROWS, siblings_per_group: int = SIBLINGS_PER_GROUP, name: str = "hierarchy") -> DataFrame:
    """One row per node of (id, parent): id, root_id, depth, n_descendants, entry, exit, on_cycle.

    `id` must be unique and not null; a null parent, or one that is no id, makes a root of depth 0. For nodes on a
    cycle or below one, root_id is the smallest id on that cycle, depth and n_descendants are -1 and the interval is
    null. A node is an ancestor of another iff both have the same root and its [entry, exit] holds the other's.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, name)
    nodes, links = number_nodes(df.select("id", "parent"), scratch)
    ranks = rank(tour_elements(links, links.count(), siblings_per_group), scratch, base_rows)
    down = F.col("e") % 2 == 0
    per = ranks.groupBy(F.expr("e div 2").alias("n")).agg(
        F.max(F.when(down, F.col("pos"))).alias("entry"),
        F.max(F.when(~down, F.col("pos"))).alias("exit"),
        F.max(F.when(down, F.col("dep"))).alias("depth"),
        F.max(F.when(down, F.col("head"))).alias("h"),
        F.max(F.when(~down, F.col("head"))).alias("h_exit"),
    )
    every = scratch.save(nodes.select("id", "n").join(per, "n", "left"))
    tree = every.where("h is null or h >= 0").withColumn("r", F.coalesce(F.expr("h div 2"), F.col("n")))
    rooted = tree.select("*", F.when(F.col("r") == F.col("n"), F.col("id")).alias("self_id"))
    root_ids = rooted.where("self_id is not null").select("r", F.col("id").alias("root_id"))
    entry = F.coalesce("entry", F.lit(0).cast("long"))
    exit_ = F.coalesce("exit", entry + 1)
    in_trees = rooted.join(root_ids, "r").select("id", "root_id", "depth", ((exit_ - entry - 1) / 2).cast("long").alias("n_descendants"), entry.alias("entry"), exit_.alias("exit"), F.lit(False).alias("on_cycle"))
    in_trees = in_trees.withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    loops = every.where("h < 0").withColumn("on_cycle", F.col("h_exit").isNotNull() & (F.col("h") != F.col("h_exit")))
    ends = loops.where("on_cycle").select("id", F.explode(F.array("h", "h_exit")).alias("h"))
    least = ends.groupBy("h").agg(F.min("id").alias("root_id"))
    nul = F.lit(None).cast("long")
    none = F.lit(-1).cast("long")
    in_loops = loops.join(least, "h").select("id", "root_id", none.alias("depth"), none.alias("n_descendants"), nul.alias("entry"), nul.alias("exit"), "on_cycle")
    return in_trees.unionByName(in_loops)


def _stacks(tree: DataFrame, positions: int, emit, schema: str) -> DataFrame:
    """Calls `emit(ids above, id)` for every node of `tree` outside cycles, the ids above from the root down, by a stack over intervals.

    A tour is cut into stretches of `positions` entries, so a tree that holds most rows is spread over many tasks; a node
    whose interval reaches into later stretches goes there as well, which is less than what the result holds for their nodes.
    """
    c = F.lit(positions)
    flat = tree.where("depth >= 0").select("id", "root_id", "entry", "exit", F.floor(F.col("entry") / c).alias("first"), F.floor(F.col("exit") / c).alias("last"))
    placed = flat.select("id", "root_id", "entry", "exit", "first", F.explode(F.sequence("first", "last")).alias("part"))

    def run(pdfs):
        group, stack = None, []
        names = [x.split()[0] for x in schema.split(", ")]
        for p in pdfs:
            out, held = [], 0
            for node, root, entry, exit_, own, part in zip(p["id"], p["root_id"], p["entry"], p["exit"], p["first"] == p["part"], p["part"]):
                if (root, part) != group:
                    group, stack = (root, part), []
                while stack and stack[-1][0] < entry:
                    stack.pop()
                if own:
                    out += emit([x for _, x in stack], node)
                    held += len(stack) + 1
                    if held > HELD_IDS:  # deep trees give long rows: a batch is bounded by the ids it holds
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if exit_ > entry + 1:
                    stack.append((exit_, node))
            yield pd.DataFrame(out, columns=names)

    return placed.repartition("root_id", "part").sortWithinPartitions("root_id", "part", "entry").mapInPandas(run, schema)


def paths(tree: DataFrame, positions: int = TOUR_POSITIONS) -> DataFrame:
    """(id, path) with the ids from the root down to the node, for every node of `tree` (a `hierarchy` result) outside cycles."""
    return _stacks(tree, positions, lambda above, node: [(node, [*above, node])], "id string, path array<string>")


def descendants(tree: DataFrame, positions: int = TOUR_POSITIONS) -> DataFrame:
    """(ancestor, descendant, distance) for every pair of nodes of `tree` outside cycles, one row a pair."""
    return _stacks(tree, positions, lambda above, node: [(x, node, len(above) - i) for i, x in enumerate(above)], "ancestor string, descendant string, distance long")
