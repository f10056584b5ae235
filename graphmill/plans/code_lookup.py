"""Lookups over the code graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.keys import nonblank
from graphmill.functions.paths import normalize_path
from graphmill.operators import lookup as lk
from graphmill.operators import upserts as up
from graphmill.sources.tables import table


def defs(s: SparkSession, d: str) -> DataFrame:
    return lk.definitions(table(s, d, "function_node"), table(s, d, "class_node"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "call_site").select("repo", nonblank("caller_qn").alias("caller_qn"), nonblank("callee_qn").alias("callee_qn"), "line", "file_path")


def _functions(s: SparkSession, d: str) -> DataFrame:
    return lk.first_rows(table(s, d, "function_node"), ["repo", "qualified_name"], ["file_path", "line_start"])


def find_definition(s: SparkSession, d: str) -> DataFrame:
    """The definition behind every name that is called in its own repo; a function comes before a class."""
    wanted = _calls(s, d).where("callee_qn is not null").select("repo", F.col("callee_qn").alias("qualified_name")).distinct()
    best = defs(s, d).groupBy("repo", "qualified_name").agg(F.max(F.struct("kind", "file_path", "line_start", "line_end")).alias("m"))
    return wanted.join(best, ["repo", "qualified_name"]).select("repo", "qualified_name", F.col("m.kind").alias("kind"), F.col("m.file_path").alias("file_path"), F.col("m.line_start").alias("line_start"), F.col("m.line_end").alias("line_end"))


def find_symbol(s: SparkSession, d: str) -> DataFrame:
    return lk.find_symbol(defs(s, d), "Ledger").select("repo", "qualified_name", "kind", "file_path", "line_start")


def test_path(s: SparkSession, d: str) -> DataFrame:
    """Files per repo in tests and outside, with made-up test folders for every third letter."""
    p = table(s, d, "file_node").select("repo", "path").distinct().select("repo", F.concat(F.when(F.col("path") < "b", "tests/").when(F.col("path") < "m", "x/test_").otherwise(""), "path").alias("path"))
    return p.groupBy("repo").agg(F.sum(lk.is_test_path("path").cast("long")).alias("n_test"), F.count("*").alias("n_files"))


def find_callers(s: SparkSession, d: str) -> DataFrame:
    return lk.callers(_calls(s, d), _functions(s, d)).select("repo", "callee_qn", "caller_qn", F.col("caller_file").alias("file_path"), "line")


def find_callees(s: SparkSession, d: str) -> DataFrame:
    return lk.callees(_calls(s, d), defs(s, d)).select("repo", "caller_qn", "callee_qn", "line")


def context_tool(s: SparkSession, d: str) -> DataFrame:
    """Every function's definition with how many functions call it and how many of its repo it calls."""
    fn = _functions(s, d)
    calls = _calls(s, d)
    ins = lk.callers(calls, fn).groupBy("repo", F.col("callee_qn").alias("qualified_name")).agg(F.countDistinct("caller_qn").alias("n_callers"))
    outs = lk.callees(calls, defs(s, d)).groupBy("repo", F.col("caller_qn").alias("qualified_name")).agg(F.countDistinct("callee_qn").alias("n_callees"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return fn.join(ins, ["repo", "qualified_name"], "left").join(outs, ["repo", "qualified_name"], "left").select("repo", "qualified_name", "file_path", "line_start", zero("n_callers"), zero("n_callees"))


def _folder(path: str) -> F.Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def find_modules(s: SparkSession, d: str) -> DataFrame:
    """Folders as modules of their functions."""
    f = table(s, d, "function_node").where("repo is not null and qualified_name is not null and file_path is not null")
    return lk.modules(f.select("repo", _folder("file_path").alias("label"), F.col("qualified_name").alias("member"), F.col("file_path").alias("path")))


def _steps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("process"), "l_linenumber", "l_partkey", F.concat_ws("-", "l_suppkey", "l_partkey").alias("member")).distinct()


def find_processes(s: SparkSession, d: str) -> DataFrame:
    """Orders as processes of their lines, in order."""
    m = lk.ordered_members(_steps(s, d), "process", ["l_linenumber", "l_partkey"], "member")
    return m.select("process", "step_count", F.array_join("members", ",").alias("members"))


def process_detail(s: SparkSession, d: str) -> DataFrame:
    """Every process with its steps; one without steps stays, with none."""
    m = lk.ordered_members(_steps(s, d), "process", ["l_linenumber", "l_partkey"], "member")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("process"), F.col("o_orderpriority").alias("summary"))
    return o.join(m, "process", "left").select("process", "summary", F.coalesce("step_count", F.lit(0).cast("long")).alias("step_count"), F.coalesce(F.array_join("members", ","), F.lit("")).alias("members"))


def repo_stats(s: SparkSession, d: str) -> DataFrame:
    qn = lambda name: table(s, d, name).select("repo", F.col("qualified_name").alias("key"))
    files = table(s, d, "file_node").select("repo", F.col("path").alias("key"))
    return lk.repo_stats({"file": files, "class": qn("class_node"), "function": qn("function_node"), "symbol": qn("symbol_node")})


def routes(s: SparkSession, d: str) -> DataFrame:
    """Routes derived from files: one per file, handled by its first function."""
    first = table(s, d, "function_node").groupBy("repo", "file_path").agg(F.min(F.struct("line_start", "qualified_name")).alias("m"))
    f = table(s, d, "file_node").select("repo", "path").distinct()
    r = f.join(first, (f["repo"] == first["repo"]) & (f["path"] == first["file_path"]), "left").select(f["repo"], f["path"].alias("file_path"), F.col("m.qualified_name").alias("handler_qn"))
    raw = F.concat(F.lit("//"), F.regexp_replace("file_path", r"\.[^.]*$", "/"))
    return r.select("repo", normalize_path(raw).alias("path"), F.when(F.length("file_path") % 2 == 0, "GET").otherwise("POST").alias("method"), F.regexp_extract("file_path", r"\.([^.]*)$", 1).alias("framework"), "file_path", F.coalesce("handler_qn", F.lit("")).alias("handler_qn"))


def find_routes(s: SparkSession, d: str) -> DataFrame:
    return routes(s, d).where((F.col("method") == "GET") & F.contains("path", F.lit("ledger")))


def route_handler(s: SparkSession, d: str) -> DataFrame:
    """Routes with the definition of their handler."""
    fn = lk.first_rows(table(s, d, "function_node"), ["repo", "qualified_name"], ["file_path", "line_start", "line_end", "name"]).select("repo", F.col("qualified_name").alias("handler_qn"), "line_start", "line_end")
    return routes(s, d).where("handler_qn <> ''").join(fn, ["repo", "handler_qn"]).select("repo", "method", "path", "handler_qn", F.lit("function").alias("kind"), "line_start", "line_end")


def normalized_paths(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "file_node").select("path").distinct()
    odd = F.concat(F.when(F.length("path") % 3 == 0, '"/').when(F.length("path") % 3 == 1, " //").otherwise(""), "path", F.when(F.length("path") % 3 == 0, '/"').otherwise("/ "))
    return p.select("path", normalize_path(odd).alias("normalized"))


def find_tables(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "symbol_node").select("repo", "qualified_name", "name").distinct()
    return t.where(F.contains(F.lower("name"), F.lit("ledger"))).select("repo", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), F.coalesce("name", F.lit("")).alias("name"))


def find_tools(s: SparkSession, d: str) -> DataFrame:
    """Classes whose name or documentation holds a text."""
    t = table(s, d, "class_node").select("repo", "name", F.coalesce("docstring", F.lit("")).alias("description"), "file_path").distinct()
    return t.where(F.contains(F.lower("name"), F.lit("store")) | F.contains(F.lower("description"), F.lit("tenant")))


def _events(s: SparkSession, d: str, kind: str) -> DataFrame:
    e = table(s, d, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("function"), F.get_json_object("props", "$.k").alias("table_name"), F.col("event_id").alias("line"))


def table_accessors(s: SparkSession, d: str) -> DataFrame:
    return lk.accessors(_events(s, d, "view"), _events(s, d, "purchase"))


def subclass_tree(s: SparkSession, d: str) -> DataFrame:
    """All regions, nations and customers below each region."""
    n, c, r = table(s, d, "nation"), table(s, d, "customer"), table(s, d, "region")
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    e = n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child")).unionByName(c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child")))
    return lk.closure(e, r.select(key("r", "r_regionkey").alias("root")))


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """File nodes after all scans were written in turn."""
    f = table(s, d, "file_node").select("repo", "path", "language", "sha", "scanned_at")
    half = F.col("scanned_at") < F.lit("2025-07-01").cast("timestamp")
    return up.upsert(f.where(half), f.where(~half), ["repo", "path"], ["scanned_at"])


def edge_merge(s: SparkSession, d: str) -> DataFrame:
    """Calls between functions that both exist, once per line."""
    fn = table(s, d, "function_node").select("repo", F.col("qualified_name").alias("qn"))
    e = _calls(s, d).select("repo", F.col("caller_qn").alias("source"), F.col("callee_qn").alias("target"), "line")
    return up.edges_with_ends(e, fn, fn, ["repo", "source", "target", "line"])


def poly_target(s: SparkSession, d: str) -> DataFrame:
    qn = lambda name: table(s, d, name).select("repo", F.col("qualified_name").alias("qn"))
    e = _calls(s, d).where("callee_qn is not null").select("repo", F.col("callee_qn").alias("target")).distinct()
    return up.pick_target(e, [("function", qn("function_node")), ("class", qn("class_node")), ("symbol", qn("symbol_node"))])


def sha_scan(s: SparkSession, d: str) -> DataFrame:
    """Files up to 2 MiB with the hash of their content."""
    f = table(s, d, "file_node").where(F.octet_length("content") <= 2 * 1024 * 1024)
    return f.select("repo", "path", F.sha2("content", 256).alias("sha")).distinct()


def sha_skip(s: SparkSession, d: str) -> DataFrame:
    """Files whose content differs from the first scan of any file of that path."""
    now = sha_scan(s, d)
    prior = table(s, d, "file_node").groupBy("repo", "path").agg(F.min(F.struct("scanned_at", "sha")).alias("m")).select("repo", "path", F.col("m.sha").alias("sha")).where("path < 'm'")
    return up.changed_files(now, prior)


def embed_update(s: SparkSession, d: str) -> DataFrame:
    """Function docstrings filled where a later copy of the same name in another repo has one."""
    f = lk.first_rows(table(s, d, "function_node"), ["repo", "qualified_name"], ["name", "docstring"])
    new = f.where("docstring <> ''").select("name", "docstring")
    return up.update_where_present(f.where("docstring is null or docstring = ''"), new, "name", "docstring").select("repo", "qualified_name", "docstring")


def unembedded(s: SparkSession, d: str) -> DataFrame:
    """Functions without documentation, with the class that holds them."""
    f = lk.first_rows(table(s, d, "function_node").where("docstring is null or docstring = ''"), ["repo", "qualified_name"], ["parent_class_qn", "line_start"])
    c = lk.first_rows(table(s, d, "class_node"), ["repo", "qualified_name"], ["name"]).select("repo", F.col("qualified_name").alias("parent_class_qn"), F.col("name").alias("parent_name"))
    return f.join(c, ["repo", "parent_class_qn"], "left").select("repo", "qualified_name", "parent_name")


def pk_check(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "function_node").select("repo", "qualified_name", "file_path", "line_start")
    return up.duplicate_keys(f, ["repo", "qualified_name"])


_DEFS = """df as (select repo, qualified_name, m.* from (select repo, qualified_name, min(struct_pack(file_path := file_path, line_start := line_start, line_end := line_end, name := name)) m from function_node where repo is not null and qualified_name is not null group by 1, 2)),
dc as (select repo, qualified_name, m.* from (select repo, qualified_name, min(struct_pack(file_path := file_path, line_start := line_start, line_end := line_end, name := name)) m from class_node where repo is not null and qualified_name is not null group by 1, 2)),
d as (select *, 'function' kind from df union all select *, 'class' from dc),
c as (select repo, nullif(trim(caller_qn), '') caller_qn, nullif(trim(callee_qn), '') x, caller_qn raw_caller, callee_qn raw_callee, line from call_site),
calls as (select distinct repo, case when caller_qn is not null then raw_caller end caller_qn, case when x is not null then raw_callee end callee_qn, line from c)"""
_NORM = "(case when {x} = '' then '/' else {x} end)"


def _norm_sql(e: str) -> str:
    t = f"trim({e})"
    t = f"trim(regexp_replace({t}, '^[\"'']+|[\"'']+$', '', 'g'))"
    t = f"regexp_replace(concat('/', lower({t})), '/+', '/', 'g')"
    return f"case when {t} = '/' then '/' else regexp_replace({t}, '/$', '') end"


_ROUTES = f"""f as (select distinct repo, path from file_node), fst as (select repo, file_path, min(struct_pack(l := line_start, q := qualified_name)).q q from function_node group by 1, 2),
r as (select f.repo, {_norm_sql("concat('//', regexp_replace(f.path, '\\.[^.]*$', '/'))")} as path, case when length(f.path) % 2 = 0 then 'GET' else 'POST' end as method, regexp_extract(f.path, '\\.([^.]*)$', 1) framework, f.path file_path, coalesce(q, '') handler_qn from f left join fst on fst.repo = f.repo and fst.file_path = f.path)"""
_STEPS = "st as (select l_orderkey process, count(*) step_count, string_agg(member, ',' order by l_linenumber, l_partkey, member) members from (select distinct l_orderkey, l_linenumber, l_partkey, concat(l_suppkey, '-', l_partkey) member from lineitem) group by 1)"

QUERIES = {
    f.__name__: f
    for f in (find_definition, find_symbol, test_path, find_callers, find_callees, context_tool, find_modules, find_processes, process_detail, repo_stats, find_routes, route_handler, find_tables, find_tools, table_accessors, subclass_tree, upsert_latest, edge_merge, poly_target, sha_scan, sha_skip, embed_update, unembedded, pk_check)
} | {"normalize_path": normalized_paths}
SQL = {
    "find_definition": f"with {_DEFS}, b as (select repo, qualified_name, max(struct_pack(kind := kind, file_path := file_path, line_start := line_start, line_end := line_end)) m from d group by 1, 2) select distinct b.repo, b.qualified_name, m.kind, m.file_path, m.line_start, m.line_end from b join calls on calls.repo = b.repo and calls.callee_qn = b.qualified_name",
    "find_symbol": f"with {_DEFS} select repo, qualified_name, kind, file_path, line_start from d where contains(lower(coalesce(name, qualified_name)), 'ledger')",
    "test_path": "with p as (select distinct repo, path from file_node), q as (select repo, concat(case when path < 'b' then 'tests/' when path < 'm' then 'x/test_' else '' end, path) as path from p) select repo, cast(sum(case when regexp_matches(path, '^(tests/|test/|test_)|/tests/|/test/|/test_') then 1 else 0 end) as bigint) n_test, count(*) n_files from q group by 1",
    "find_callers": f"with {_DEFS} select calls.repo, callee_qn, caller_qn, file_path, line from calls join (select repo, qualified_name, min(struct_pack(f := file_path, l := line_start)).f file_path from function_node where qualified_name is not null group by 1, 2) f on f.repo = calls.repo and f.qualified_name = caller_qn where callee_qn is not null",
    "find_callees": f"with {_DEFS} select repo, caller_qn, callee_qn, line from calls where caller_qn is not null and exists (select 1 from df where df.repo = calls.repo and df.qualified_name = calls.callee_qn)",
    "context_tool": f"with {_DEFS}, i as (select repo, callee_qn q, count(distinct caller_qn) n from calls where exists (select 1 from df where df.repo = calls.repo and df.qualified_name = caller_qn) group by 1, 2), o as (select repo, caller_qn q, count(distinct callee_qn) n from calls where exists (select 1 from df where df.repo = calls.repo and df.qualified_name = callee_qn) group by 1, 2) select df.repo, df.qualified_name, df.file_path, df.line_start, coalesce(i.n, 0) n_callers, coalesce(o.n, 0) n_callees from df left join i on i.repo = df.repo and i.q = df.qualified_name left join o on o.repo = df.repo and o.q = df.qualified_name",
    "find_modules": "with m as (select distinct repo, regexp_replace(file_path, '/[^/]*$', '') as label, qualified_name member, file_path from function_node where repo is not null and qualified_name is not null and file_path is not null), g as (select repo, label, count(distinct member) size, bool_or(not regexp_matches(file_path, '^(tests/|test/|test_)|/tests/|/test/|/test_')) r from m group by 1, 2) select g.repo, g.label, size, (select string_agg(member, ',' order by member) from (select distinct member from m where m.repo = g.repo and m.label = g.label order by member limit 5)) as sample from g where size > 1 and r",
    "find_processes": f"with {_STEPS} select * from st",
    "process_detail": f"with {_STEPS} select o_orderkey process, o_orderpriority summary, coalesce(step_count, 0) step_count, coalesce(members, '') members from orders left join st on st.process = o_orderkey",
    "repo_stats": "select repo, 'file' kind, count(distinct path) n from file_node group by 1 union all select repo, 'class', count(distinct qualified_name) from class_node group by 1 union all select repo, 'function', count(distinct qualified_name) from function_node group by 1 union all select repo, 'symbol', count(distinct qualified_name) from symbol_node group by 1",
    "find_routes": f"with {_ROUTES} select * from r where method = 'GET' and contains(path, 'ledger')",
    "route_handler": f"with {_ROUTES}, {_DEFS} select r.repo, r.method, r.path, r.handler_qn, 'function' kind, df.line_start, df.line_end from r join df on df.repo = r.repo and df.qualified_name = r.handler_qn where handler_qn <> ''",
    "normalize_path": "with p as (select distinct path from file_node), o as (select path, concat(case length(path) % 3 when 0 then '\"/' when 1 then ' //' else '' end, path, case length(path) % 3 when 0 then '/\"' else '/ ' end) x from p) select path, " + _norm_sql("x") + " normalized from o",
    "find_tables": "select distinct repo, coalesce(qualified_name, '') qualified_name, coalesce(name, '') as name from symbol_node where contains(lower(name), 'ledger')",
    "find_tools": "select distinct repo, name, coalesce(docstring, '') description, file_path from class_node where contains(lower(name), 'store') or contains(lower(coalesce(docstring, '')), 'tenant')",
    "table_accessors": "select distinct user_id as function, json_extract_string(props, '$.k') table_name, event_id line, case event_type when 'view' then 'read' else 'write' end op_kind from events where event_type in ('view', 'purchase')",
    "subclass_tree": "select concat('r', r_regionkey) root, concat('r', r_regionkey) node from region union all select concat('r', n_regionkey), concat('n', n_nationkey) from nation where n_regionkey in (select r_regionkey from region) union all select concat('r', n_regionkey), concat('c', c_custkey) from customer join nation on n_nationkey = c_nationkey",
    "upsert_latest": "select repo, path, m.language, m.sha, m.scanned_at from (select repo, path, max(struct_pack(scanned_at := scanned_at, language := language, sha := sha)) m from file_node where repo is not null and path is not null group by 1, 2)",
    "edge_merge": f"with {_DEFS} select distinct repo, caller_qn source, callee_qn target, line from calls where exists (select 1 from df where df.repo = calls.repo and df.qualified_name = caller_qn) and exists (select 1 from df where df.repo = calls.repo and df.qualified_name = callee_qn)",
    "poly_target": f"with {_DEFS} select distinct calls.repo, callee_qn target, case when exists (select 1 from function_node n where n.repo = calls.repo and n.qualified_name = callee_qn) then 'function' when exists (select 1 from class_node n where n.repo = calls.repo and n.qualified_name = callee_qn) then 'class' when exists (select 1 from symbol_node n where n.repo = calls.repo and n.qualified_name = callee_qn) then 'symbol' end target_kind from calls where callee_qn is not null",
    "sha_scan": "select distinct repo, path, sha256(content) sha from file_node where strlen(content) <= 2097152",
    "sha_skip": "with n as (select distinct repo, path, sha256(content) sha from file_node where strlen(content) <= 2097152), p as (select repo, path, min(struct_pack(a := scanned_at, b := sha)).b sha from file_node group by 1, 2) select * from n where not exists (select 1 from p where p.repo = n.repo and p.path = n.path and p.sha = n.sha and p.path < 'm')",
    "embed_update": "with f as (select repo, qualified_name, min(struct_pack(a := name, b := docstring)) m from function_node where repo is not null and qualified_name is not null group by 1, 2), n as (select m.a as name, max(m.b) doc from f where m.b <> '' group by 1) select repo, qualified_name, coalesce(n.doc, m.b) docstring from f left join n on n.name = m.a where m.b is null or m.b = ''",
    "unembedded": "with f as (select repo, qualified_name, min(struct_pack(a := parent_class_qn, b := line_start)).a p from function_node where (docstring is null or docstring = '') and repo is not null and qualified_name is not null group by 1, 2), c as (select repo, qualified_name, min(struct_pack(a := name)).a as name from class_node where repo is not null and qualified_name is not null group by 1, 2) select f.repo, f.qualified_name, c.name parent_name from f left join c on c.repo = f.repo and c.qualified_name = f.p",
    "pk_check": "select repo, qualified_name, count(*) n_rows from (select distinct repo, qualified_name, file_path, line_start from function_node) group by 1, 2 having count(*) > 1",
}
