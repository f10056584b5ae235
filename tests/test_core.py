"""Core operators on small fixtures: nulls, ties, repeated rows, empty tables, clashing extra columns, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from graphmill.functions.keys import norm_id
from graphmill.functions.scratch import Scratch
from graphmill.functions.paths import camel_to_snake, module_name, nextjs_path, normalize_path
from graphmill.operators import extract, graph, hierarchy, ledger, lookup, orphans, resolve, scopes, search, upserts
from graphmill.plans import code_graph
from graphmill.sources import scan


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


# --- orphans -------------------------------------------------------------------------------------------------------
def _refs(spark, data):
    return spark.createDataFrame(data, "table_name string, record_key string, scope string, ref string, at timestamp")


def _parents(spark, data):
    return spark.createDataFrame(data, "scope string, key string, created timestamp, deleted boolean")


def _t(n):
    import datetime

    return datetime.datetime(2026, 1, n)


def test_orphans_in_increments_equal_one_load(spark):
    rng = random.Random(3)
    refs = [("t", f"r{i}", "s", f"p{rng.randrange(12)}", _t(rng.randrange(1, 28))) for i in range(60)]
    parents = [("s", f"p{i}", _t(rng.randrange(1, 28)), rng.random() < 0.2) for i in range(9)]
    whole, _ = orphans.apply(None, None, _refs(spark, refs), _parents(spark, parents))
    state = index = None
    for k in range(3):
        state, index = orphans.apply(state, index, _refs(spark, refs[k::3]), _parents(spark, parents[k::3]))
    assert rows(whole) == rows(state)
    again, _ = orphans.apply(state, index, _refs(spark, refs[:5]), _parents(spark, []))
    assert rows(again) == rows(whole)


def test_orphans_reopen_on_deletion_and_settle_on_arrival(spark):
    state, index = orphans.apply(None, None, _refs(spark, [("t", "a", "s", "p", _t(5)), ("t", "b", "s", "q", _t(5)), ("t", None, "s", "q", _t(5)), ("t", "c", "s", None, _t(5)), ("t", "d", "s", "p", None)]), _parents(spark, [("s", "p", _t(1), False)]))
    assert rows(state, "record_key", "reason") == [("a", None), ("b", "absent"), ("d", None)]
    state, index = orphans.apply(state, index, _refs(spark, []), _parents(spark, [("s", "q", _t(9), False), ("s", "p", _t(2), True)]))
    assert rows(state, "record_key", "reason") == [("a", "deleted"), ("b", "late"), ("d", "deleted")]
    state, _ = orphans.apply(state, index, _refs(spark, []), _parents(spark, [("s", "q", _t(2), False)]))
    assert ("b", None) in rows(state, "record_key", "reason")
    assert rows(orphans.snapshot(state), "table_name", "period", "reason", "n_orphans") == [("t", "2026-01", "deleted", 1), ("t", None, "deleted", 1)]
    empty, _ = orphans.apply(None, None, _refs(spark, []), _parents(spark, []))
    assert rows(empty) == []


def test_orphans_out_of_order(spark):
    """Older rows that arrive late lose, a newer row without reference ends an older one's, and parents have their newest creation time."""
    refs = lambda data: spark.createDataFrame(data, "table_name string, record_key string, scope string, ref string, at timestamp, version timestamp")
    par = lambda data: spark.createDataFrame(data, "scope string, key string, created timestamp, deleted boolean, version timestamp")
    steps = [
        ([("t", "a", "s", "p", _t(5), _t(9)), ("t", "b", "s", None, _t(5), _t(9)), ("t", "c", "s", "gone", _t(5), _t(1))], [("s", "p", _t(2), False, _t(2))]),
        ([("t", "a", "s", "gone", _t(5), _t(3)), ("t", "b", "s", "gone", _t(5), _t(3)), ("t", "c", "s", "p", _t(5), _t(2))], []),
        ([], [("s", "p", _t(8), False, _t(7))]),
    ]
    state = index = None
    for r, p in steps:
        state, index = orphans.apply(state, index, refs(r), par(p))
    assert rows(state, "record_key", "ref", "reason") == [("a", "p", "late"), ("b", None, None), ("c", "p", "late")]
    folded = orphans.fold(((refs(r), par(p)) for r, p in steps), Scratch(spark, "test"))
    assert rows(folded, "record_key", "ref", "reason") == rows(state, "record_key", "ref", "reason")
    whole = orphans.fold([(refs([x for r, _ in steps for x in r]), par([x for _, p in steps for x in p]))], Scratch(spark, "test"))
    assert rows(whole, "record_key", "ref", "reason") == rows(state, "record_key", "ref", "reason")


# --- hierarchy -----------------------------------------------------------------------------------------------------
def brute(links):
    out = {}
    for n in links:
        path, seen = [n], {n}
        cyc = None
        while links.get(path[-1]) in links:
            p = links[path[-1]]
            if p in seen:
                cyc = path[path.index(p) :]
                break
            path.append(p)
            seen.add(p)
        out[n] = (min(cyc), -1, None) if cyc else (path[-1], len(path) - 1, path)
    desc = {n: 0 for n in links}
    for n, (_, d, path) in out.items():
        if d >= 0:
            for a in path[1:]:
                desc[a] += 1
    return sorted((n, r, d, desc[n] if d >= 0 else -1) for n, (r, d, _) in out.items())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("base,group", [(1 << 18, 10**6), (8, 4)])
def test_hierarchy_against_brute_force(spark, seed, base, group):
    rng = random.Random(seed)
    links = {}
    for i in range(120):
        kind = rng.random()
        links[f"n{i:03}"] = None if kind < 0.1 else f"n{rng.randrange(max(1, i)):03}" if kind < 0.8 else "n000" if kind < 0.93 else f"n{rng.randrange(120):03}" if kind < 0.97 else "missing"
    df = spark.createDataFrame(list(links.items()), "id string, parent string").withColumn("n", F.lit(1)).withColumn("e", F.lit("x"))
    got = hierarchy.hierarchy(df, base_rows=base, siblings_per_group=group)
    assert rows(got, "id", "root_id", "depth", "n_descendants") == brute(links)


def test_hierarchy_long_chain_cycles_and_intervals(spark):
    links = {f"c{i:03}": f"c{i - 1:03}" if i else None for i in range(200)} | {"x": "y", "y": "x", "z": "x", "s": "s"}
    df = spark.createDataFrame(list(links.items()), "id string, parent string")
    tree = hierarchy.hierarchy(df, base_rows=16)
    assert rows(tree, "id", "root_id", "depth", "n_descendants") == brute(links)
    assert rows(tree.where("on_cycle"), "id") == [("s",), ("x",), ("y",)]
    t = {r.id: r for r in tree.collect()}
    assert t["c010"].entry < t["c150"].entry and t["c150"].exit < t["c010"].exit
    p = {r.id: r.path for r in hierarchy.paths(tree, positions=3).collect()}
    assert p["c003"] == ["c000", "c001", "c002", "c003"] and "x" not in p and len(p["c199"]) == 200
    few = hierarchy.hierarchy(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None)], "id string, parent string"))
    for positions in (1, 2, 1000):
        assert rows(hierarchy.descendants(few, positions)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]
        assert rows(hierarchy.paths(few, positions)) == [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("d", ["a", "d"]), ("e", ["e"])]


def test_hierarchy_empty(spark):
    assert rows(hierarchy.hierarchy(spark.createDataFrame([], "id string, parent string"))) == []


# --- keys, paths ---------------------------------------------------------------------------------------------------
def test_keys_and_paths(spark):
    df = spark.createDataFrame([(" Ab\n",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(norm_id("x")).collect()] == ["ab", None, None]
    p = spark.createDataFrame([("",), ("users/",), ("//A//b",), ("/",), (None,), ('"/q/"',)], "x string")
    assert [r[0] for r in p.select(normalize_path("x")).collect()] == ["/", "/users", "/a/b", "/", "/", "/q"]
    n = spark.createDataFrame([("app/users/[id]/route.ts",), ("pages/docs/[...slug].tsx",), ("src/app/(shop)/page.tsx",)], "x string")
    assert [r[0] for r in n.select(nextjs_path("x")).collect()] == ["/users/{id}", "/docs/{*slug}", "/"]
    c = spark.createDataFrame([("HTTPServer",), ("userId",)], "x string")
    assert [r[0] for r in c.select(camel_to_snake("x")).collect()] == ["httpserver", "user_id"]
    m = spark.createDataFrame([("a/b/__init__.py",), ("a/index.ts",), ("x.py",)], "x string")
    assert [r[0] for r in m.select(module_name("x")).collect()] == ["a.b", "a", "x"]


# --- ledger, lookup, upserts ---------------------------------------------------------------------------------------
def test_rollup_without_tasks_is_zero(spark):
    p = spark.createDataFrame([("a", "w", "n", "done", _t(1))], "id string, workflow_id string, name string, status string, created_at timestamp")
    t = spark.createDataFrame([], "project_id string, status string, cost_usd decimal(10,6)")
    assert rows(ledger.project_rollup(p, t), "task_count", "done_count", "total_cost_usd") == [(0, 0, 0.0)]


def test_closure_meets_cycles_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), (None, "x")], "parent string, child string")
    r = spark.createDataFrame([("a",), ("q",)], "root string")
    assert rows(lookup.closure(e, r)) == [("a", "a"), ("a", "b"), ("a", "c"), ("q", "q")]


def test_lookup_details(spark):
    d = spark.createDataFrame([("r", "m.f", "function", "f", "x.py", 1, 2), ("r", "m.f", "class", "f", "x.py", 3, 4)], "repo string, qualified_name string, kind string, name string, file_path string, line_start int, line_end int")
    assert lookup.find_definition(d, "r", "m.f").first().kind == "function"
    assert rows(lookup.find_definition(d, "r", "none")) == []
    assert lookup.find_symbol(d, " ").count() == 0 and lookup.find_symbol(d, "F").count() == 2
    t = spark.createDataFrame([("tests/a.py",), ("a/test_b.py",), ("contest/a.py",), (None,)], "p string")
    assert [r[0] for r in t.select(lookup.is_test_path("p")).collect()] == [True, True, False, False]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, z string")
    new = spark.createDataFrame([("a", 2, "n"), ("b", 5, "n"), ("c", 1, None), (None, 1, "q")], "k string, v int, z string")
    once = upserts.upsert(old, new, ["k"], ["v"])
    assert rows(once) == rows(upserts.upsert(once, new, ["k"], ["v"])) == [("a", 2, "n"), ("b", 5, "n"), ("c", 1, None)]
    f = spark.createDataFrame([("r", "p", "1"), ("r", "q", "2")], "repo string, path string, sha string")
    assert rows(upserts.changed_files(f, f.where("path = 'p'")), "path") == [("q",)]
    assert upserts.changed_files(f, f, force=True).count() == 2
    assert upserts.prune_stale(f, "r", "old", "new").count() == 0 and upserts.prune_stale(f, "r", None, "new").count() == 2 and upserts.prune_stale(f, "r", "old", "").count() == 2
    e = spark.createDataFrame([("r", "a", "t"), ("r", "a", "u")], "repo string, source string, target string")
    known = spark.createDataFrame([("r", "t")], "repo string, qn string")
    assert rows(upserts.pick_target(e, [("function", known.limit(0)), ("symbol", known)]), "target", "target_kind") == [("t", "symbol"), ("u", None)]
    assert rows(upserts.edges_with_ends(e, spark.createDataFrame([("r", "a")], "repo string, qn string"), known, ["repo", "source", "target"]), "target") == [("t",)]


# --- search --------------------------------------------------------------------------------------------------------
def test_search_edges(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, ""), (4, None)], "id long, text string")
    assert rows(search.bm25(d, ["a"]), "id") == [(1,)]
    assert rows(search.bm25(d, [" "])) == [] and rows(search.bm25(d.limit(0), ["a"])) == []
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (1, 2)], "id long, rank int")
    assert [r.id for r in search.fuse(a, b, limit=5).collect()] == [1, 2]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, embedding array<double>")
    got = search.vector_topk(v, v.where("id = 1"), 2, block=1)
    assert rows(got, "id") == [(2,), (3,)]
    assert rows(search.vector_topk(v, v.where("id = 1"), 2, floor=0.5), "id") == [(2,)]
    h = search.hashed_embedding(spark.createDataFrame([("a", "x y"), ("b", None)], "id string, text string"))
    assert all(len(r.embedding) == 64 for r in h.collect())


# --- graph, scopes -------------------------------------------------------------------------------------------------
def test_graph_operators(spark):
    e = spark.createDataFrame([("r", "a.x", "b.y"), ("r", "b.y", "c.z"), ("r", "c.z", "b.y")], "repo string, source string, target string")
    assert rows(graph.entry_points(e), "node") == [("a.x",)]
    ch = graph.chains(e, graph.entry_points(e))
    assert rows(ch.select(F.array_join("path", ">").alias("p"))) == [("a.x>b.y",), ("a.x>b.y>c.z",)]
    with pytest.raises(ValueError):
        graph.chains(e, graph.entry_points(e), limit=0)
    lab = spark.createDataFrame([("r", "a.x", "A"), ("r", "b.y", "B"), ("r", "c.z", "C")], "repo string, node string, label string")
    sc = graph.scored_chains(ch, lab)
    assert rows(sc, "path_id", "score") == [("a.x|b.y", 2), ("a.x|b.y|c.z", 6)]
    assert rows(graph.top_processes(sc), "rank", "name") == [(1, "x -> z"), (2, "x -> y")]
    cyc = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a")], "repo string, source string, target string")
    assert rows(graph.entry_points(cyc), "node") == [("a",), ("b",)]
    assert rows(graph.strong_components(e.select("source", "target"))) == [("a.x", "a.x"), ("b.y", "b.y"), ("c.z", "b.y")]
    one = spark.createDataFrame([("r", "a", "a")], "repo string, a string, b string")
    assert graph.cohesion(one, spark.createDataFrame([("r", "a", "A"), ("r", "q", "Q")], "repo string, node string, label string")).where("label = 'A'").first().cohesion == 1.0


def test_chain_queries_go_to_eight_nodes(spark, tmp_path):
    names = [f"m.f{i}" for i in range(10)]
    spark.createDataFrame([("r", n, f"d{i}/a.py") for i, n in enumerate(names)], "repo string, qualified_name string, file_path string").write.parquet(f"{tmp_path}/function_node.parquet")
    spark.createDataFrame([("r", a, b) for a, b in zip(names, names[1:])], "repo string, caller_qn string, callee_qn string").write.parquet(f"{tmp_path}/call_site.parquet")
    want = ["|".join(names[:n]) for n in range(2, 9)]
    assert rows(code_graph.chains(spark, str(tmp_path)), "path") == sorted((p,) for p in want)
    assert rows(code_graph.chain_score(spark, str(tmp_path)), "path_id", "score") == sorted((p, n * (n - 1)) for n, p in enumerate(want, 2))
    assert code_graph.top_processes(spark, str(tmp_path)).where("rank = 1").first().path_id == want[-1]


def test_components_and_louvain(spark):
    rng = random.Random(5)
    pairs = [(f"{g}{a}", f"{g}{b}") for g in "xyz" for a in range(6) for b in range(a)] + [(f"l{i}", f"l{i + 1}") for i in range(40)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string")
    comp = {r.node: r.component for r in graph.components(df).collect()}
    assert len(set(comp.values())) == 4 and len({comp[f"l{i}"] for i in range(41)}) == 1
    e = spark.createDataFrame([("r", a, b) for a, b in pairs[:]] + [("r", "x0", "y0")], "repo string, a string, b string").where("a not like 'l%'")
    lab = {r.node: r.label for r in graph.louvain(e).collect()}
    assert len({lab[f"x{i}"] for i in range(6)}) == 1 and lab["x0"] != lab["y0"] and len(lab) == 18
    assert lab == {r.node: r.label for r in graph.louvain(e.repartition(7)).collect()}


def test_scopes_against_brute_force(spark):
    sc = [(0, 100, "m"), (10, 40, "a"), (12, 20, "b"), (50, 60, "c"), (50, 60, "d")]
    s = spark.createDataFrame([("f", *x) for x in sc], "file string, start int, end int, id string")
    assert rows(scopes.scope_parents(s, ["file"]), "id", "parent_id") == [("a", "m"), ("b", "a"), ("c", "m"), ("d", "c"), ("m", None)]
    pos = spark.createDataFrame([("f", p) for p in (0, 15, 39, 40, 55, 100)], "file string, pos int")
    assert rows(scopes.scope_at(s, pos, ["file"]), "pos", "id") == [(0, "m"), (100, None), (15, "b"), (39, "a"), (40, "m"), (55, "c")]


# --- extraction, resolution ----------------------------------------------------------------------------------------
PY = '''
import os.path
from .base import Base as B
class User(B):
    """A user."""
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    team = Column(Integer, ForeignKey("teams.id"), nullable=False)
    @app.get("/users")
    async def load(self, n: int) -> "Optional[List[User]]":
        session.query(User)
        return helper(n)
def helper(x):
    return x
'''


def test_extract_python(spark):
    got = extract.file_rows("pkg/mod.py", PY)
    tag = lambda t: [r for r in got if r[0] == t]
    assert [r[2] for r in tag("class")] == ["pkg.mod.User"] and {r[2] for r in tag("function")} == {"pkg.mod.User.load", "pkg.mod.helper"}
    assert [(r[2], r[3]) for r in tag("import")] == [("os.path", "os"), ("pkg.base.Base", "B")]
    assert tag("route")[0][2:4] == ("/users", "GET") and tag("table")[0][2] == "users"
    assert {r[3]: r[7] for r in tag("column")}["team"] == ["pk=false", "nullable=false", "index=false", "fk=teams"]
    assert tag("returns")[0][3] == "User" and ("pkg.mod.helper" in [r[2] for r in tag("call")])
    assert extract.file_rows("a.py", "def (")[0][0] == "error" and extract.file_rows("a.txt", "x") == []
    assert extract.return_type("Dict[str, int] | None") == "Dict[str, int]" and extract.return_type(None) == ""


def test_extract_braces(spark):
    java = 'package a.b;\nimport java.util.*;\n@RestController\npublic class C extends D<E> implements F {\n  @Override\n  public int f(int x, List<String> y) { return g(x); }\n  C() { this.h(); }\n}\n'
    got = extract.file_rows("src/C.java", java)
    assert ("class", "a.b.C") in {(r[0], r[2]) for r in got} and {("inherits", "D"), ("inherits", "F")} <= {(r[0], r[2]) for r in got}
    assert next(r for r in got if r[0] == "function" and r[3] == "f")[7] == ["x:int", "y:List<String>"]
    ts = 'import { A, B } from "./x";\nexport class K extends L { m(a: number): Record<string, number> { return this.n(a); } }\nexport const h = async (q: string) => { app.get("/z", q); };\n'
    got = extract.file_rows("src/k.ts", ts)
    assert {"src.k.K.m", "src.k.h"} <= {r[2] for r in got if r[0] == "function"} and ("route", "/z") in {(r[0], r[2]) for r in got}
    cpp = '#include "a/b.h"\nnamespace n { class K : public B { public: virtual int f(int a) const { return g(a); } }; int h() { return 1; } }\n'
    got = extract.file_rows("x.cpp", cpp)
    assert {"n.K.f:const", "n.h"} <= {r[2] for r in got if r[0] == "function"} and "a/b.h" in {r[2] for r in got if r[0] == "import"}
    df = spark.createDataFrame([("r", "a.py", None, 1), ("r", None, "x", 1), (None, "b.py", "x", 1)], "repo string, path string, content string, tag int")
    assert [r.tag for r in extract.extract(df).collect()] == ["module"]
    roots = extract.package_roots([("pyproject.toml", "[project]\nname='x'"), ("libs/a/pyproject.toml", "[tool.poetry]"), ("b/pyproject.toml", "[tool.black]")])
    assert roots == ["libs/a", ""]
    src = [("pyproject.toml", "[tool.poetry]\npackages = [{include = 'x', from = 'src'}]"), ("l/pyproject.toml", "[tool.setuptools.package-dir]\n'' = 'src'"), ("build/pyproject.toml", "[project]")]
    assert extract.package_roots(src) == ["l/src", "src"] and extract.module_qn("l/src/p/m.py", ("l/src", "src")) == "p.m"


def test_resolution(spark):
    fn = spark.createDataFrame([("r", q) for q in ("m.f", "lib.g", "lib.K.run", "m.A.go", "m.B.go2", "w.pub", "w._priv")], "repo string, qualified_name string")
    imp = spark.createDataFrame([("r", "m", "g", "lib.g", "symbol"), ("r", "m", "lib", "lib", "module"), ("r", "m", "*", "w", "wildcard")], "repo string, module string, local_name string, target string, kind string")
    calls = spark.createDataFrame([("r", "m.f", c, i) for i, c in enumerate(["m.f", "g", "lib.g", "pub", "_priv", "k.run", "self.go", "nope", "go2"])], "repo string, caller string, callee string, line int").unionByName(spark.createDataFrame([("r", "m.A.x", "self.go", 20)], "repo string, caller string, callee string, line int"))
    b = spark.createDataFrame([("r", "m.f", "k", "lib.K")], "repo string, scope string, var string, type_qn string")
    meth = resolve.method_table(spark.createDataFrame([("r", "lib.K", "run", "lib.K.run"), ("r", "m.A", "go", "m.A.go")], "repo string, class_qn string, method string, target string"), spark.createDataFrame([], "repo string, class_qn string, parent_qn string, pos int"))
    got = {(r.caller, r.callee): (r.target, r.rule) for r in resolve.resolve_calls(calls, fn, imp, b, meth).collect()}
    assert got[("m.f", "g")] == ("lib.g", 1) and got[("m.f", "lib.g")] == ("lib.g", 0) and got[("m.f", "pub")] == ("w.pub", 2)
    assert got[("m.f", "_priv")] == ("_priv", None) and got[("m.f", "k.run")] == ("lib.K.run", 3) and got[("m.A.x", "self.go")] == ("m.A.go", 3)
    assert got[("m.f", "nope")] == ("nope", None) and got[("m.f", "go2")] == ("m.B.go2", 5)
    ext = resolve.external_symbols(resolve.resolve_calls(calls, fn, imp), spark.createDataFrame([("r", "nope")], "repo string, qualified_name string"))
    assert "nope" not in {r.qualified_name for r in ext.collect()} and "_priv" in {r.qualified_name for r in ext.collect()}


def test_dispatch_diamond(spark):
    m = spark.createDataFrame([("r", "A", "f", "A.f"), ("r", "B", "f", "B.f"), ("r", "C", "g", "C.g"), ("r", "D", "f", "D.f"), ("r", "D", "h", "D.h")], "repo string, class_qn string, method string, target string")
    p = spark.createDataFrame([("r", "X", "B", 0), ("r", "X", "C", 1), ("r", "B", "D", 0), ("r", "C", "D", 0), ("r", "D", "X", 0)], "repo string, class_qn string, parent_qn string, pos int")
    got = {(r.class_qn, r.method): r.target for r in resolve.method_table(m, p).collect()}
    assert got[("X", "f")] == "B.f" and got[("X", "h")] == "D.h" and got[("X", "g")] == "C.g" and got[("A", "f")] == "A.f"


def test_community_names_and_edges(spark):
    data = [("r", "A", f"x.auth.login{c}") for c in "abc"] + [("r", "B", f"y.auth.{c}") for c in ("route", "rule")] + [("r", "C", "z.1.2"), ("r", "D", "auth.auth"), ("s", "A", "auth.auth")]
    got = rows(graph.community_names(spark.createDataFrame(data, "repo string, label string, member string")))
    assert got == [("r", "A", "auth"), ("r", "B", "auth_route"), ("r", "C", "cluster_2"), ("r", "D", "cluster_3"), ("s", "A", "auth")]
    assert rows(graph.community_names(spark.createDataFrame([], "repo string, label string, member string"))) == []
    members = spark.createDataFrame([("r", "p1", "a"), ("r", "p1", "b"), ("r", "p2", "c"), ("r", "p2", "d"), ("r", "p3", "e"), ("r", "p3", None)], "repo string, path string, member string")
    pair = "repo string, source string, target string"
    e = graph.code_graph(spark.createDataFrame([("r", "b", "a"), ("r", "a", "b"), ("r", "a", "out")], pair), spark.createDataFrame([("r", "d", "c")], pair), spark.createDataFrame([("r", "p2", "p1"), ("r", "p3", "p3"), ("r", "p3", "none")], "repo string, path string, target_path string"), members)
    assert rows(e, "a", "b") == [("a", "b"), ("a", "c"), ("c", "d")]


def test_types_and_tables(spark):
    b = spark.createDataFrame([("r", "m", "x", "T1", 1), ("r", "m.f", "x", "T2", 2), ("r", "m.f", "x", "T3", 9)], "repo string, scope string, var string, type_name string, line int")
    s = spark.createDataFrame([("r", "m.f", "m.f", 0), ("r", "m.f", "m", 1), ("r", "m.g", "m", 1)], "repo string, scope string, ancestor string, depth int")
    assert rows(resolve.variable_types(b, s), "scope", "type_name") == [("m.f", "T3"), ("m.g", "T1")]
    ch = spark.createDataFrame([("r", 1, "A", ["b", "c"]), ("r", 2, "A", ["zz"]), ("r", 3, "A", []), ("r", 4, "A", ["s"] * 9)], "repo string, id int, start string, links array<string>")
    ret = spark.createDataFrame([("r", "A", "b", "B"), ("r", "B", "c", "C"), ("r", "A", "s", "A")], "repo string, type_qn string, member string, result_qn string")
    assert rows(resolve.resolve_chain(ch, ret), "id", "type_qn") == [(1, "C"), (2, None), (3, "A"), (4, None)]
    h = spark.createDataFrame([("r", "f", "User.objects.filter", "filter", "", "", 1), ("r", "f", "session.execute", "execute", "update", "User", 2), ("r", "f", "session.add", "add", "User", "", 3), ("r", "f", "x.y", "zzz", "User", "", 4)], "repo string, caller string, callee string, leaf string, arg_head string, inner_arg string, line int")
    t = spark.createDataFrame([("r", "User", "users")], "repo string, model string, table_name string")
    assert rows(resolve.classify_table_access(h, t), "line", "op_kind") == [(1, "read"), (2, "write"), (3, "write")]


def test_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1\n")
    (tmp_path / "node_modules" / "y.js").write_text("1")
    (tmp_path / "z.txt").write_text("no")
    assert rows(scan.read_tree(spark, str(tmp_path), "r"), "path", "language", "content") == [("a/x.py", "python", "x = 1\n")]
    f = spark.createDataFrame([("r", "src/vendor/a.js"), ("r", "b.min.js"), ("r", "c.js")], "repo string, path string")
    assert rows(scan.without_ignored(f, ["# c", "vendor/", "*.min.js", ""]), "path") == [("c.js",)]
    i = spark.createDataFrame([("r", "s/a.ts", "./b"), ("r", "s/a.ts", "../q"), ("r", "s/a.ts", "./none")], "repo string, path string, spec string")
    k = spark.createDataFrame([("r", "s/b.js"), ("r", "s/b.tsx"), ("r", "q/index.ts")], "repo string, path string")
    deep = spark.createDataFrame([("r", "s/t/u/a.ts", "../../v/./b.js"), ("r", "a.ts", "../../q")], "repo string, path string, spec string")
    assert rows(scan.script_imports(deep, spark.createDataFrame([("r", "s/v/b.ts"), ("r", "q.js")], "repo string, path string")), "target") == [("q.js",), ("s/v/b.ts",)]
    assert rows(scan.without_ignored(f, ["src*a.js", "[bx].min.js"]), "path") == [("c.js",)]
    assert rows(scan.script_imports(i, k), "spec", "target") == [("../q", "q/index.ts"), ("./b", "s/b.tsx"), ("./none", None)]
    inc = spark.createDataFrame([("r", "lib/x/a.cc", "u/h.h")], "repo string, path string, include string")
    hd = spark.createDataFrame([("r", "lib/x/u/h.h"), ("r", "app/u/h.h"), ("r", "lib/u/ah.h")], "repo string, header string")
    assert rows(scan.includes(inc, hd), "header") == [("lib/x/u/h.h",)]
    t = spark.createDataFrame([("Optional[List[User]]",), ("'int | None'",), ("Dict[str, int]",), (None,)], "x string")
    assert scan.plain_type("Optional[List[Iterator[Awaitable[User]]]]") == "User" and scan.plain_type("Promise<Array<Row>> | null") == "Row" and scan.plain_type("Generator[int, None, Row]") == "Row" and scan.plain_type("Set[int]") == "Set[int]"
    assert [r[0] for r in t.select(scan.return_type("x")).collect()] == ["User", "int", "Dict[str, int]", ""]
