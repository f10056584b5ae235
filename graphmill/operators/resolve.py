"""Name resolution as joins: candidates of every rule are unioned with the rule's rank, and the best per reference is taken.

Rules for a callee, in order: (0) a function of exactly that name in the repo; (1) a bare imported name; (2) a function of a module that is
imported as a wildcard; (3) a method of a parameter's or variable's type, inherited ones included, and of the type of one of its
fields, over at most two fields; (4) an imported module's prefix;
(5) the one function of that bare name in the repo's exports; else it is an external symbol. Private names are not seen by (2) and (5).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators import extract as ex
from graphmill.operators.graph import components


def owner(qn: str):
    """A qualified name without its last part."""
    return F.regexp_replace(qn, r"\.?[^.]*$", "")


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, bindings: DataFrame | None = None, methods: DataFrame | None = None) -> DataFrame:
    """(repo, caller, callee, line, target, rule): the definition each raw callee refers to; rule null and target = callee if external.

    calls: repo, caller, callee, line; functions: repo, qualified_name; imports: repo, module, local_name, target, kind (symbol, module,
    wildcard); bindings: repo, scope, var, type_qn; methods: repo, class_qn, method, target (see `method_table`).
    """
    c = calls.select("repo", "caller", "callee", "line").distinct()
    fn = functions.select("repo", F.col("qualified_name").alias("target")).distinct()
    # the modules that a caller may stand in: its name without the last one or two parts
    scoped = c.select("*", F.explode(F.array_distinct(F.array(owner("caller"), owner(owner("caller"))))).alias("module")).where("module <> ''")
    first, rest = F.substring_index("callee", ".", 1), F.when(F.contains("callee", F.lit(".")), F.expr("substr(callee, instr(callee, '.') + 1)"))
    last = F.element_at(F.split("callee", r"\."), -1)
    keys = ["repo", "caller", "callee", "line"]
    named = imports.where("kind <> 'wildcard'").select("repo", "module", F.col("local_name").alias("__local"), F.col("target").alias("__to"))
    wild = imports.where("kind = 'wildcard'").select("repo", "module", F.col("target").alias("__to"))
    hit = scoped.withColumn("__local", first).join(named, ["repo", "module", "__local"])
    parts = [
        c.select(*keys, F.col("callee").alias("target"), F.lit(0).alias("rank")),
        hit.where(rest.isNull()).select(*keys, F.col("__to").alias("target"), F.lit(1).alias("rank")),
        hit.where(rest.isNotNull()).select(*keys, F.concat("__to", F.lit("."), rest).alias("target"), F.lit(4).alias("rank")),
        scoped.where(~F.contains("callee", F.lit(".")) & ~F.startswith("callee", F.lit("_"))).join(wild, ["repo", "module"]).select(*keys, F.concat("__to", F.lit("."), "callee").alias("target"), F.lit(2).alias("rank")),
    ]
    if bindings is not None and methods is not None:
        b = bindings.select("repo", "scope", F.col("var").alias("__var"), F.col("type_qn").alias("class_qn")).distinct()
        m = methods.select("repo", "class_qn", F.col("method").alias("__method"), F.col("target").alias("__target"))
        recv = c.select(*keys, F.explode(F.array_distinct(F.array("caller", owner("caller"), owner(owner("caller"))))).alias("scope"), first.alias("__var"), last.alias("__method"), F.size(F.split("callee", r"\.")).alias("__n"))
        typed = recv.where("__n = 2").join(b, ["repo", "scope", "__var"]).withColumn("depth", F.length("scope"))
        parts.append(typed.join(m, ["repo", "class_qn", "__method"]).select(*keys, F.col("__target").alias("target"), F.lit(3).alias("rank")))
        me = recv.where("__var in ('self', 'this', 'super') and __n = 2").where(F.col("scope") == owner("caller")).withColumn("class_qn", F.col("scope"))
        own = me.join(m, ["repo", "class_qn", "__method"]).where((F.col("__var") != "super") | (F.col("__target") != F.concat("class_qn", F.lit("."), "__method")))
        parts.append(own.select(*keys, F.col("__target").alias("target"), F.lit(3).alias("rank")))
        parts.append(resolve_compound(c, bindings, methods).select(*keys, "target", F.lit(3).alias("rank")))
    public = fn.withColumn("name", F.element_at(F.split("target", r"\."), -1)).where(~F.startswith("name", F.lit("_"))).groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    bare = c.where(~F.contains("callee", F.lit("."))).withColumn("name", F.col("callee"))
    parts.append(bare.join(public, ["repo", "name"]).select(*keys, "target", F.lit(5).alias("rank")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.join(fn, ["repo", "target"], "left_semi").groupBy(*keys).agg(F.min(F.struct("rank", "target")).alias("b"))
    return c.join(best, keys, "left").select(*keys, F.coalesce("b.target", "callee").alias("target"), F.col("b.rank").cast("long").alias("rule"))


def resolve_compound(calls: DataFrame, bindings: DataFrame, methods: DataFrame) -> DataFrame:
    """(repo, caller, callee, line, target) of calls through one or two fields, as in `self.a.b()` or `x.a.b.c()`: the head is the caller's
    class or a variable seen from the caller, each field a binding in its class, the last part a method, inherited ones included."""
    keys = ["repo", "caller", "callee", "line"]
    b = bindings.select("repo", "scope", F.col("var").alias("__var"), F.col("type_qn").alias("__type")).distinct()
    p = F.split("callee", r"\.")
    c = calls.select(*keys, p.alias("__p")).where(F.size("__p").between(3, 4)).distinct()
    me = c.where(F.col("__p")[0].isin("self", "this")).select(*keys, "__p", owner("caller").alias("__type"), F.lit(0).alias("__far"))
    seen = c.select(*keys, "__p", F.col("__p")[0].alias("__var"), F.posexplode(F.array("caller", owner("caller"), owner(owner("caller")))).alias("__far", "scope")).join(b, ["repo", "scope", "__var"])
    near = seen.groupBy(*keys, "__p").agg(F.min("__far").alias("__far")).withColumnRenamed("__p", "__q")
    heads = me.unionByName(seen.join(near.drop("__q"), [*keys, "__far"]).select(*keys, "__p", "__type", "__far"))
    cur, done = heads.select(*keys, "__type", F.slice("__p", 2, 3).alias("__rest")), None
    for _ in range(2):
        step = cur.where("size(__rest) > 1").select(*keys, F.col("__type").alias("scope"), F.col("__rest")[0].alias("__var"), F.slice("__rest", 2, 3).alias("__rest"))
        cur = step.join(b, ["repo", "scope", "__var"]).select(*keys, "__type", "__rest")
        ended = cur.where("size(__rest) = 1")
        done = ended if done is None else done.unionByName(ended)
    m = methods.select("repo", F.col("class_qn").alias("__type"), F.col("method").alias("__method"), "target")
    return done.withColumn("__method", F.col("__rest")[0]).join(m, ["repo", "__type", "__method"]).groupBy(*keys).agg(F.min("target").alias("target"))


def resolve_types(types: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, module, text, type_qn): the class that a type's text names in a module; null if none of the repo.

    Every name in the text is tried in its order, each as a class's own name, as one of the same module, as an imported class, and as a
    class of an imported module; only if none fits, as a class of the modules imported as a wildcard.
    """
    t = types.select("repo", "module", "text").where("text is not null").distinct()
    names = t.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), 1)).alias("pos", "head"))
    cl = classes.select("repo", F.col("qualified_name").alias("type_qn")).distinct()
    named = imports.where("kind <> 'wildcard'").select("repo", "module", F.col("local_name").alias("head"), F.col("target").alias("__to"))
    wild = imports.where("kind = 'wildcard'").select("repo", "module", F.col("target").alias("__to"))
    hit = names.join(named, ["repo", "module", "head"])
    out = lambda df, qn, wildcard, rule: df.select("repo", "module", "text", qn.alias("type_qn"), F.struct(F.lit(wildcard).alias("w"), F.col("pos").alias("p"), F.lit(rule).alias("r")).alias("rank"))
    dot = F.lit(".")
    every = out(names, F.col("head"), 0, 0).unionByName(out(names, F.concat("module", dot, "head"), 0, 1)).unionByName(out(hit, F.col("__to"), 0, 2)).unionByName(out(hit, F.concat("__to", dot, "head"), 0, 3))
    every = every.unionByName(out(names.join(wild, ["repo", "module"]), F.concat("__to", dot, "head"), 1, 4))
    best = every.join(cl, ["repo", "type_qn"], "left_semi").groupBy("repo", "module", "text").agg(F.min(F.struct("rank", "type_qn")).alias("b"))
    return t.join(best, ["repo", "module", "text"], "left").select("repo", "module", "text", F.col("b.type_qn").alias("type_qn"))


def external_symbols(resolved: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, qualified_name, name) of callees that resolve to nothing and are no known symbols yet."""
    s = resolved.where("rule is null").select("repo", F.col("target").alias("qualified_name")).distinct()
    return s.join(known.select("repo", "qualified_name").distinct(), ["repo", "qualified_name"], "left_anti").withColumn("name", F.element_at(F.split("qualified_name", r"\."), -1))


def resolve_parents(inherits: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, child, parent, target): the class behind each parent's name: its own name, one of the same module, an imported one, the one class of
    that name in the repo; null if external."""
    i = inherits.select("repo", "child", "parent").distinct()
    cl = classes.select("repo", F.col("qualified_name").alias("target")).distinct()
    module = owner("child")
    named = imports.where("kind <> 'wildcard'").select("repo", "module", F.col("local_name").alias("parent"), F.col("target").alias("target"))
    one = cl.withColumn("parent", F.element_at(F.split("target", r"\."), -1)).groupBy("repo", "parent").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    parts = (
        i.select("*", F.col("parent").alias("target"), F.lit(0).alias("rank"))
        .unionByName(i.select("*", F.concat(module, F.lit("."), "parent").alias("target"), F.lit(1).alias("rank")))
        .unionByName(i.withColumn("module", module).join(named, ["repo", "module", "parent"]).select("repo", "child", "parent", "target", F.lit(2).alias("rank")))
        .unionByName(i.join(one, ["repo", "parent"]).select("repo", "child", "parent", "target", F.lit(3).alias("rank")))
    )
    best = parts.join(cl, ["repo", "target"], "left_semi").groupBy("repo", "child", "parent").agg(F.min(F.struct("rank", "target")).alias("b"))
    return i.join(best, ["repo", "child", "parent"], "left").select("repo", "child", "parent", F.col("b.target").alias("target"))


def method_table(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo, class_qn, method, target): what a method name means on a class, its own before inherited ones; of several parents the
    first listed wins, a shared ancestor counts under the parent visited first, which is the last listed.

    methods: repo, class_qn, method, target; parents: repo, class_qn, parent_qn, pos. Classes linked by inheritance form a
    component and are handled by one task each; cycles end at the first class met again.
    """
    sep = "\x01"
    key = lambda c: F.concat_ws(sep, "repo", c)
    edges = parents.where("parent_qn is not null").select(key("class_qn").alias("a"), key("parent_qn").alias("b"))
    alone = methods.select(key("class_qn").alias("a")).distinct()
    comp = components(edges.unionByName(alone.select("a", F.col("a").alias("b"))), "dispatch")
    m = methods.select(key("class_qn").alias("node"), "method", "target", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("pos"))
    p = parents.where("parent_qn is not null").select(key("class_qn").alias("node"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("target"), key("parent_qn").alias("parent"), F.col("pos").cast("int").alias("pos"))
    rows = m.unionByName(p).join(comp, "node")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, dict[str, str]] = {}
        up: dict[str, list[tuple[int, str]]] = {}
        for node, method, target, parent, pos in zip(g["node"], g["method"], g["target"], g["parent"], g["pos"]):
            if isinstance(parent, str):
                up.setdefault(node, []).append((int(pos), parent))
            else:
                d = own.setdefault(node, {})
                d[method] = min(target, d.get(method, target))
        out = []
        for node in sorted({*own, *up}):
            table: dict[str, str] = {}
            seen = {node}

            def visit(n: str) -> None:
                for _, parent in sorted(up.get(n, []), reverse=True):
                    if parent not in seen:
                        seen.add(parent)
                        visit(parent)
                        table.update(own.get(parent, {}))

            visit(node)
            table.update(own.get(node, {}))
            repo, qn = node.split(sep, 1)
            out += [(repo, qn, k, v) for k, v in sorted(table.items())]
        return pd.DataFrame(out, columns=["repo", "class_qn", "method", "target"])

    return rows.groupBy("component").applyInPandas(run, "repo string, class_qn string, method string, target string")


def variable_types(bindings: DataFrame, scopes: DataFrame) -> DataFrame:
    """(repo, scope, var, type_name, depth) of the binding seen from each scope: the innermost enclosing one, its last in line order.

    bindings: repo, scope, var, type_name, line; scopes: repo, scope, ancestor, depth (0 for the scope itself).
    """
    last = bindings.groupBy("repo", "scope", "var").agg(F.max(F.struct("line", "type_name")).alias("m")).select("repo", F.col("scope").alias("ancestor"), "var", F.col("m.type_name").alias("type_name"))
    j = scopes.join(last, ["repo", "ancestor"])
    return j.groupBy("repo", "scope", "var").agg(F.min(F.struct("depth", "type_name")).alias("m")).select("repo", "scope", "var", F.col("m.type_name").alias("type_name"), F.col("m.depth").alias("depth"))


def resolve_chain(chains: DataFrame, returns: DataFrame, max_hops: int = 8) -> DataFrame:
    """(repo, id, type_qn): the type that a dotted chain ends in; null where a link is unknown or the chain is longer than `max_hops`.

    chains: repo, id, start (a type's name), links ARRAY<STRING>; returns: repo, type_qn, member, result_qn. One join per link, unrolled.
    """
    r = returns.groupBy("repo", "type_qn", "member").agg(F.min("result_qn").alias("result_qn"))
    cur = chains.select("repo", "id", F.col("start").alias("type_qn"), "links")
    done = None
    for _ in range(max_hops):
        ended = cur.where("size(links) = 0 or type_qn is null").select("repo", "id", F.when(F.size("links") == 0, F.col("type_qn")).alias("type_qn"))
        done = ended if done is None else done.unionByName(ended)
        going = cur.where("size(links) > 0 and type_qn is not null").withColumn("member", F.element_at("links", 1))
        cur = going.join(r, ["repo", "type_qn", "member"], "left").select("repo", "id", F.col("result_qn").alias("type_qn"), F.slice("links", 2, 1000).alias("links"))
    return done.unionByName(cur.select("repo", "id", F.when(F.size("links") == 0, F.col("type_qn")).alias("type_qn")))


# Types that stand for a database session.
SESSION_TYPES = ["AsyncSession", "Session", "scoped_session", "sessionmaker"]


def classify_table_access(hints: DataFrame, tables: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """(repo, function, table_name, op_kind, line) of call hints (repo, caller, callee, leaf, arg_head, inner_arg, line); hints that fit no
    rule or name no table are dropped.

    `Model.objects.leaf` reads, writes, or does both. A session's method takes the table from its argument: a model, one inside
    a statement, or a variable of `bindings` (repo, scope, var, type_name) that holds one; a receiver of more than one part has
    to be a session type. `x.save()` writes and `x.refresh_from_db()` reads the table of the variable's model.
    """
    isin = lambda c, names: F.col(c).isin(*sorted(names))
    parts = F.split("callee", r"\.")
    statement = F.when(F.col("arg_head") == "select", F.array(F.lit("read"))).when(F.col("arg_head").isin("insert", "update", "delete"), F.array(F.lit("write")))
    manager = F.when(isin("leaf", ex.READ_LEAVES), F.array(F.lit("read"))).when(isin("leaf", ex.WRITE_LEAVES), F.array(F.lit("write"))).when(isin("leaf", ex.BOTH_LEAVES), F.array(F.lit("read"), F.lit("write")))
    session = F.when(F.col("leaf") == "execute", statement).when(F.col("leaf").isin("query", "get", "scalars"), F.array(F.lit("read"))).otherwise(F.array(F.lit("write")))
    is_manager = (F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(2)) == "objects")
    is_session = isin("leaf", ex.SESSION_LEAVES) & ((F.size(parts) <= 2) | F.try_element_at(parts, F.lit(-2)).isin(*SESSION_TYPES))
    ops = F.when(is_manager, manager).when(is_session, session).when(F.size(parts) == 2, F.when(F.col("leaf") == "save", F.array(F.lit("write"))).when(F.col("leaf") == "refresh_from_db", F.array(F.lit("read"))))
    argument = F.when(F.col("leaf") == "execute", F.col("inner_arg")).otherwise(F.col("arg_head"))
    head = F.substring_index(F.when(is_manager, parts[0]).when(is_session, argument).otherwise(parts[0]), ".", 1)
    h = hints.select("repo", F.col("caller").alias("function"), "line", head.alias("model"), F.explode(ops).alias("op_kind"), (~is_manager).alias("__held")).where("model <> ''")
    if bindings is not None:
        b = bindings.select("repo", F.col("scope").alias("function"), F.col("var").alias("model"), F.element_at(F.split("type_name", r"\."), -1).alias("__of")).distinct()
        h = h.join(b, ["repo", "function", "model"], "left").withColumn("model", F.when(F.col("__held"), F.coalesce("__of", "model")).otherwise(F.col("model")))
    t = tables.select("repo", F.col("model").alias("model"), "table_name").distinct()
    return h.join(t, ["repo", "model"]).select("repo", "function", "table_name", "op_kind", "line").distinct()
