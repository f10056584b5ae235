"""Queries of operators whose inputs no test table holds: small sources and records stated here, checked against results worked out by hand
from each operator's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.paths import nextjs_path
from graphmill.operators import extract as ex
from graphmill.operators import resolve as rs
from graphmill.operators import upserts as up

APP = '''
from .db import Base, session as s
import tools.net as net

class Team(Base):
    __tablename__ = "teams"
    id = Column(Integer, primary_key=True)
    title = Column(String, index=True)

class Book(models.Model):
    name = CharField(max_length=9, null=True)
    team = models.ForeignKey("Team", db_index=True)

    class Meta:
        db_table = "lib_books"

@app.get("/items/{id}")
async def read(id: int) -> "Optional[Item]":
    """Reads one."""
    return s.query(Team)

@bp.route("/both", methods=["GET", "POST"])
def both():
    s.execute(select(Team))
    return net.call(read(1))

@mcp.tool(name="lookup", description="Finds things.")
def find(q: str) -> list[str]:
    """Other text."""
    Book.objects.filter(name=q)

@mcp.tool()
def plain():
    """First part.

    Second part."""

@mcp.resource("repo://{name}")
def res(name):
    """A repo."""
'''
SPRING = """package shop.web;
import shop.core.*;
@RestController
@RequestMapping("/shop")
public class Cart extends Base<Item> implements Api, Closeable {
  @GetMapping("/all")
  public List<Item> all() { return svc.load(1); }
  @PostMapping
  void add(Item i, int n) { this.check(i); new Item(); }
}
"""


def _rows(s: SparkSession, path: str, text: str) -> DataFrame:
    return ex.extract(s.createDataFrame([("r", path, text)], "repo string, path string, content string"))


def _tag(s: SparkSession, tag: str) -> DataFrame:
    return _rows(s, "pkg/app.py", APP).where(F.col("tag") == tag)


def routes_py(s, d):
    return _tag(s, "route").select(F.col("qualified_name").alias("path"), F.col("name").alias("method"), F.col("owner").alias("handler"), F.col("detail").alias("framework"))


def mcp_desc(s, d):
    return _tag(s, "tool").unionByName(_tag(s, "resource")).select("tag", F.col("qualified_name").alias("key"), F.col("detail").alias("description"), F.col("owner").alias("handler"))


def orm_decl(s, d):
    t = _tag(s, "table").select("tag", F.col("qualified_name").alias("key"), F.col("detail").alias("kind"), F.lit("").alias("flags"))
    return t.unionByName(_tag(s, "column").select("tag", F.col("qualified_name").alias("key"), F.col("detail").alias("kind"), F.array_join("extra", ",").alias("flags")))


def orm_hint(s, d):
    return _tag(s, "hint").select(F.col("owner").alias("caller"), F.col("qualified_name").alias("callee"), F.col("name").alias("leaf"), F.col("detail").alias("arg_head"), F.array_join("extra", ",").alias("inner_arg"))


def orm_classify(s, d):
    h = _tag(s, "hint").select("repo", F.col("owner").alias("caller"), F.col("qualified_name").alias("callee"), F.col("name").alias("leaf"), F.col("detail").alias("arg_head"), F.element_at("extra", 1).alias("inner_arg"), F.col("line_start").alias("line"))
    t = _tag(s, "table").select("repo", F.col("name").alias("model"), F.col("qualified_name").alias("table_name"))
    return rs.classify_table_access(h, t).select("function", "table_name", "op_kind")


def orm_join(s, d):
    """Hints with the call they stand on: same caller, line and last part."""
    h = _tag(s, "hint").select("owner", "line_start", F.col("name").alias("leaf"), "detail")
    c = _tag(s, "call").select("owner", "line_start", F.col("name").alias("leaf"), F.col("qualified_name").alias("callee")).distinct()
    return h.join(c, ["owner", "line_start", "leaf"]).select(F.col("owner").alias("caller"), "leaf", "callee")


def extract_golden(s, d):
    return _rows(s, "pkg/app.py", APP).where("tag in ('function', 'class', 'import', 'returns')").select("tag", "qualified_name", "name", F.array_join("extra", ",").alias("extra"))


def spring_routes(s, d):
    """Routes of a controller: its prefix joined with each method's path, the verb from the annotation."""
    from graphmill.functions.paths import normalize_path

    r = _rows(s, "src/Cart.java", SPRING)
    verb = F.create_map(*[F.lit(x) for p in ex.SPRING.items() for x in p])
    path = lambda c: F.regexp_extract(c, '"([^"]*)"', 1)
    cls = r.where("tag = 'class' and exists(extra, x -> x rlike '^@(Rest)?Controller')").select(F.col("qualified_name").alias("detail"), F.coalesce(F.get(F.filter("extra", lambda x: F.startswith(x, F.lit("@RequestMapping"))), F.lit(0)), F.lit("")).alias("prefix"))
    m = r.where("tag = 'annotation'").where(F.col("name").isin(*ex.SPRING)).select("detail", F.col("owner").alias("handler"), F.col("name").alias("ann"), F.col("qualified_name").alias("text"))
    return m.join(cls, "detail").select(normalize_path(F.concat(path("prefix"), F.lit("/"), path("text"))).alias("path"), F.try_element_at(verb, F.col("ann")).alias("method"), "handler")


def java_golden(s, d):
    return _rows(s, "src/Cart.java", SPRING).where("tag in ('class', 'function', 'inherits', 'import', 'call')").select("tag", "qualified_name", "name", F.when(F.col("tag") == "function", F.array_join("extra", ",")).otherwise("").alias("extra"))


def nextjs_golden(s, d):
    p = s.createDataFrame([("app/users/[id]/route.ts",), ("pages/docs/[...slug].tsx",), ("src/app/(shop)/page.tsx",), ("pages/index.js",)], "file string")
    return p.select("file", nextjs_path("file").alias("route"))


ROOT_FILES = [
    ("pyproject.toml", "[project]\nname='x'"), ("libs/a/pyproject.toml", "[tool.poetry]\npackages = [{include = 'a', from = 'src'}]"), ("b/pyproject.toml", "[tool.black]"), ("c/pyproject.toml", "[tool.hatch.build]"),
    ("d/pyproject.toml", "[tool.setuptools.package-dir]\n'' = 'lib'"), ("venv/e/pyproject.toml", "[project]"), ("f/pyproject.toml", "[project"), ("g/pyproject.toml", "[tool.hatch.envs]"),
]


def pkg_roots(s, d):
    roots = ex.package_roots(ROOT_FILES)
    return s.createDataFrame([(i, r) for i, r in enumerate(roots)], "pos long, root string")


_METHODS = [("A", "f"), ("B", "f"), ("C", "g"), ("D", "f"), ("D", "h")]
_PARENTS = [("X", "B", 0), ("X", "C", 1), ("B", "D", 0), ("C", "D", 0)]


def dispatch(s, d):
    m = s.createDataFrame([("r", c, n, f"{c}.{n}") for c, n in _METHODS], "repo string, class_qn string, method string, target string")
    p = s.createDataFrame([("r", *x) for x in _PARENTS], "repo string, class_qn string, parent_qn string, pos int")
    return rs.method_table(m, p).select("class_qn", "method", "target")


def var_lookup(s, d):
    b = s.createDataFrame([("r", "m", "x", "T1", 1), ("r", "m.f", "x", "T2", 2), ("r", "m.f", "x", "T3", 9), ("r", "m", "y", "T4", 1)], "repo string, scope string, var string, type_name string, line int")
    sc = s.createDataFrame([("r", "m.f", "m.f", 0), ("r", "m.f", "m", 1), ("r", "m.g", "m", 1)], "repo string, scope string, ancestor string, depth int")
    return rs.variable_types(b, sc).select("scope", "var", "type_name")


def resolve_chain(s, d):
    c = s.createDataFrame([("r", 1, "A", ["b", "c"]), ("r", 2, "A", ["zz"]), ("r", 3, "A", []), ("r", 4, "A", ["s"] * 9), ("r", 5, "A", ["s"] * 8)], "repo string, id int, start string, links array<string>")
    r = s.createDataFrame([("r", "A", "b", "B"), ("r", "B", "c", "C"), ("r", "A", "s", "A")], "repo string, type_qn string, member string, result_qn string")
    return rs.resolve_chain(c, r).select("id", "type_qn")


def _resolution(s):
    fn = s.createDataFrame([("r", q) for q in ("m.f", "lib.g", "lib.K.run", "m.A.go", "m.A.up", "m.P.up", "w.pub", "w._priv", "z.only")], "repo string, qualified_name string")
    imp = s.createDataFrame([("r", "m", "g", "lib.g", "symbol"), ("r", "m", "lib", "lib", "module"), ("r", "m", "*", "w", "wildcard")], "repo string, module string, local_name string, target string, kind string")
    b = s.createDataFrame([("r", "m.f", "k", "lib.K")], "repo string, scope string, var string, type_qn string")
    meth = rs.method_table(s.createDataFrame([("r", "lib.K", "run", "lib.K.run"), ("r", "m.A", "go", "m.A.go"), ("r", "m.P", "up", "m.P.up")], "repo string, class_qn string, method string, target string"), s.createDataFrame([("r", "m.A", "m.P", 0)], "repo string, class_qn string, parent_qn string, pos int"))
    return fn, imp, b, meth


def _resolved(callees):
    def q(s, d):
        fn, imp, b, meth = _resolution(s)
        c = s.createDataFrame([("r", caller, callee, i) for i, (caller, callee) in enumerate(callees)], "repo string, caller string, callee string, line int")
        return rs.resolve_calls(c, fn, imp, b, meth).select("caller", "callee", "target", "rule")

    return q


def resolve_inherits(s, d):
    i = s.createDataFrame([("r", "m.A", "P"), ("r", "m.B", "Q"), ("r", "m.C", "lib.K"), ("r", "m.D", "Gone"), ("r", "q.E", "P")], "repo string, child string, parent string")
    c = s.createDataFrame([("r", x) for x in ("m.P", "x.Q", "y.Q", "lib.K")], "repo string, qualified_name string")
    imp = s.createDataFrame([("r", "m", "Q", "y.Q", "symbol")], "repo string, module string, local_name string, target string, kind string")
    return rs.resolve_parents(i, c, imp).select("child", "parent", "target")


_FIELDS = [("a.Service", "client", "a.ApiClient"), ("a.App", "service", "a.Service"), ("a.App", "self_loop", "a.App"), ("a.run", "app", "a.App"), ("a", "app", "a.Other")]
_COMPOUND = [("a.Service.fetch", "self.client.get"), ("a.Service.fetch", "self.client.ping"), ("a.App.go", "this.service.client.get"), ("a.run", "app.service.fetch"), ("a.run", "app.service.client.get"), ("a.run", "app.none.get"), ("a.walk", "app.service.fetch"), ("a.run", "app.self_loop.service.client.get"), ("a.run", "app.get")]


def resolve_compound(s, d):
    """Calls through fields; a variable of the nearest scope counts, and more than two fields are not followed."""
    c = s.createDataFrame([("r", caller, callee, i) for i, (caller, callee) in enumerate(_COMPOUND)], "repo string, caller string, callee string, line int")
    b = s.createDataFrame([("r", *x) for x in _FIELDS], "repo string, scope string, var string, type_qn string")
    m = rs.method_table(s.createDataFrame([("r", "a.ApiClient", "get", "a.ApiClient.get"), ("r", "a.Base", "ping", "a.Base.ping"), ("r", "a.Service", "fetch", "a.Service.fetch")], "repo string, class_qn string, method string, target string"), s.createDataFrame([("r", "a.ApiClient", "a.Base", 0)], "repo string, class_qn string, parent_qn string, pos int"))
    return rs.resolve_compound(c, b, m).select("caller", "callee", "target")


def type_name(s, d):
    """Texts of types with the class they mean: wrappers and None are passed over, aliases followed, wildcards last."""
    t = s.createDataFrame([("r", "m", x) for x in ("Optional[User]", "lib.Job", "J", "Dict[str, Unknown]", "User | None", "Wild", "list[Wild | User]")], "repo string, module string, text string")
    c = s.createDataFrame([("r", x) for x in ("m.User", "lib.Job", "w.Wild", "w.User")], "repo string, qualified_name string")
    i = s.createDataFrame([("r", "m", "J", "lib.Job", "symbol"), ("r", "m", "*", "w", "wildcard")], "repo string, module string, local_name string, target string, kind string")
    return rs.resolve_types(t, c, i).select("text", "type_qn")


def orm_rules(s, d):
    """One call of each rule of table accesses."""
    h = [("f", "User.objects.get_or_create", "get_or_create", "", ""), ("f", "User.objects.values_list", "values_list", "", ""), ("f", "User.active.filter", "filter", "", ""), ("f", "s.scalars", "scalars", "User.id", ""), ("f", "s.execute", "execute", "text", "User"), ("f", "s.execute", "execute", "insert", "User"), ("f", "s.add", "add", "u", ""), ("f", "pkg.db.Session.add", "add", "u", ""), ("f", "pkg.Basket.add", "add", "u", ""), ("f", "u.save", "save", "", ""), ("f", "u.refresh_from_db", "refresh_from_db", "", ""), ("g", "u.save", "save", "", ""), ("g", "s.bulk_insert_mappings", "bulk_insert_mappings", "User", "")]
    hints = s.createDataFrame([("r", *x, i) for i, x in enumerate(h)], "repo string, caller string, callee string, leaf string, arg_head string, inner_arg string, line int")
    b = s.createDataFrame([("r", "f", "u", "models.User")], "repo string, scope string, var string, type_name string")
    return rs.classify_table_access(hints, s.createDataFrame([("r", "User", "users")], "repo string, model string, table_name string"), b).select("line", "op_kind")


def prune(s, d):
    """File nodes after another commit of one repo was announced."""
    from graphmill.sources.tables import table

    f = table(s, d, "file_node").select("repo", "path").distinct()
    return up.prune_stale(f, "granite-hub", "old", "new")


def _values(cols: str, data: list[tuple], casts: dict[str, str] | None = None) -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    names = cols.split(", ")
    picked = ", ".join(f"cast({n} as {casts[n]}) {n}" if casts and n in casts else n for n in names)
    return f"select {picked} from (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data) + f") t({cols})"


_SELF, _VAR, _IMPORTED = [("m.A.x", "self.go"), ("m.A.x", "self.up"), ("m.A.x", "super.up"), ("m.A.x", "self.none")], [("m.f", "k.run"), ("m.f", "k.none"), ("m.q", "k.run")], [("m.f", "m.f"), ("m.f", "g"), ("m.f", "lib.g"), ("m.f", "pub"), ("m.f", "_priv"), ("m.f", "only"), ("m.f", "nope")]

QUERIES = {f.__name__: f for f in (routes_py, mcp_desc, orm_decl, orm_hint, orm_classify, orm_join, extract_golden, spring_routes, java_golden, nextjs_golden, pkg_roots, dispatch, var_lookup, resolve_chain, resolve_inherits, prune, resolve_compound, type_name, orm_rules)} | {"resolve_self": _resolved(_SELF), "resolve_var": _resolved(_VAR), "resolve_imported": _resolved(_IMPORTED)}
_RULE = {"rule": "bigint"}
SQL = {
    "routes_py": _values("path, method, handler, framework", [("/items/{id}", "GET", "pkg.app.read", "fastapi"), ("/both", "GET", "pkg.app.both", "flask"), ("/both", "POST", "pkg.app.both", "flask")]),
    "mcp_desc": _values("tag, key, description, handler", [("tool", "lookup", "Finds things.", "pkg.app.find"), ("tool", "plain", "First part.", "pkg.app.plain"), ("resource", "repo://{name}", "A repo.", "pkg.app.res")]),
    "orm_decl": _values("tag, key, kind, flags", [("table", "teams", "sqlalchemy", ""), ("column", "teams.id", "Integer", "pk=true,nullable=false,index=false,fk="), ("column", "teams.title", "String", "pk=false,nullable=true,index=true,fk="), ("table", "lib_books", "django", ""), ("column", "lib_books.name", "CharField", "pk=false,nullable=true,index=false,fk="), ("column", "lib_books.team", "ForeignKey", "pk=false,nullable=false,index=true,fk=Team")]),
    "orm_hint": _values("caller, callee, leaf, arg_head, inner_arg", [("pkg.app.read", "s.query", "query", "Team", ""), ("pkg.app.both", "s.execute", "execute", "select", "Team"), ("pkg.app.find", "Book.objects.filter", "filter", "", "")]),
    "orm_classify": _values("function, table_name, op_kind", [("pkg.app.read", "teams", "read"), ("pkg.app.both", "teams", "read"), ("pkg.app.find", "lib_books", "read")]),
    "orm_join": _values("caller, leaf, callee", [("pkg.app.read", "query", "s.query"), ("pkg.app.both", "execute", "s.execute"), ("pkg.app.find", "filter", "Book.objects.filter")]),
    "extract_golden": _values("tag, qualified_name, name, extra", [("import", "pkg.db.Base", "Base", ""), ("import", "pkg.db.session", "s", ""), ("import", "tools.net", "net", ""), ("class", "pkg.app.Team", "Team", ""), ("class", "pkg.app.Book", "Book", ""), ("function", "pkg.app.read", "read", "id:int"), ("returns", "pkg.app.read", "Item", ""), ("function", "pkg.app.both", "both", ""), ("returns", "pkg.app.both", "", ""), ("function", "pkg.app.find", "find", "q:str"), ("returns", "pkg.app.find", "str", ""), ("function", "pkg.app.plain", "plain", ""), ("returns", "pkg.app.plain", "", ""), ("function", "pkg.app.res", "res", "name:"), ("returns", "pkg.app.res", "", "")]),
    "spring_routes": _values("path, method, handler", [("/shop/all", "GET", "shop.web.Cart.all"), ("/shop", "POST", "shop.web.Cart.add")]),
    "java_golden": _values("tag, qualified_name, name, extra", [("import", "shop.core.*", "*", ""), ("class", "shop.web.Cart", "Cart", ""), ("inherits", "Base", "Base", ""), ("inherits", "Api", "Api", ""), ("inherits", "Closeable", "Closeable", ""), ("function", "shop.web.Cart.all", "all", ""), ("call", "svc.load", "load", ""), ("function", "shop.web.Cart.add", "add", "i:Item,n:int"), ("call", "this.check", "check", ""), ("call", "Item", "Item", "")]),
    "nextjs_golden": _values("file, route", [("app/users/[id]/route.ts", "/users/{id}"), ("pages/docs/[...slug].tsx", "/docs/{*slug}"), ("src/app/(shop)/page.tsx", "/"), ("pages/index.js", "/")]),
    "pkg_roots": _values("pos, root", [(0, "libs/a/src"), (1, "c"), (2, "d/lib"), (3, "")], {"pos": "bigint"}),
    "dispatch": _values("class_qn, method, target", [("A", "f", "A.f"), ("B", "f", "B.f"), ("B", "h", "D.h"), ("C", "f", "D.f"), ("C", "g", "C.g"), ("C", "h", "D.h"), ("D", "f", "D.f"), ("D", "h", "D.h"), ("X", "f", "B.f"), ("X", "g", "C.g"), ("X", "h", "D.h")]),
    "var_lookup": _values("scope, var, type_name", [("m.f", "x", "T3"), ("m.g", "x", "T1"), ("m.f", "y", "T4"), ("m.g", "y", "T4")]),
    "resolve_chain": _values("id, type_qn", [(1, "C"), (2, None), (3, "A"), (4, None), (5, "A")]),
    "resolve_inherits": _values("child, parent, target", [("m.A", "P", "m.P"), ("m.B", "Q", "y.Q"), ("m.C", "lib.K", "lib.K"), ("m.D", "Gone", None), ("q.E", "P", "m.P")]),
    "resolve_compound": _values("caller, callee, target", [("a.Service.fetch", "self.client.get", "a.ApiClient.get"), ("a.Service.fetch", "self.client.ping", "a.Base.ping"), ("a.App.go", "this.service.client.get", "a.ApiClient.get"), ("a.run", "app.service.fetch", "a.Service.fetch"), ("a.run", "app.service.client.get", "a.ApiClient.get")]),
    "type_name": _values("text, type_qn", [("Optional[User]", "m.User"), ("lib.Job", "lib.Job"), ("J", "lib.Job"), ("Dict[str, Unknown]", None), ("User | None", "m.User"), ("Wild", "w.Wild"), ("list[Wild | User]", "m.User")]),
    "orm_rules": _values("line, op_kind", [(0, "read"), (0, "write"), (1, "read"), (3, "read"), (5, "write"), (6, "write"), (7, "write"), (9, "write"), (10, "read"), (12, "write")]),
    "prune": "select distinct repo, path from file_node where repo <> 'granite-hub'",
    "resolve_self": _values("caller, callee, target, rule", [("m.A.x", "self.go", "m.A.go", 3), ("m.A.x", "self.up", "m.P.up", 3), ("m.A.x", "super.up", "m.P.up", 3), ("m.A.x", "self.none", "self.none", None)], _RULE),
    "resolve_var": _values("caller, callee, target, rule", [("m.f", "k.run", "lib.K.run", 3), ("m.f", "k.none", "k.none", None), ("m.q", "k.run", "k.run", None)], _RULE),
    "resolve_imported": _values("caller, callee, target, rule", [("m.f", "m.f", "m.f", 0), ("m.f", "g", "lib.g", 1), ("m.f", "lib.g", "lib.g", 0), ("m.f", "pub", "w.pub", 2), ("m.f", "_priv", "_priv", None), ("m.f", "only", "z.only", 5), ("m.f", "nope", "nope", None)], _RULE),
}
