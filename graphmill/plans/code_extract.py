"""Queries that read file contents: extraction, path rules, import targets, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.lexing import LANGUAGE_OF
from graphmill.functions.paths import module_name, nextjs_path
from graphmill.operators import extract as ex
from graphmill.operators import resolve as rs
from graphmill.sources import scan
from graphmill.sources.tables import table

_FAMILY = {"extract_python": r"\.pyi?$", "extract_typescript": r"\.(ts|tsx|js|jsx)$", "extract_java": r"\.java$", "extract_cpp": r"\.(cpp|cc|cxx|h|hpp)$"}


def _scans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "file_node").where("repo is not null and path is not null")


def _latest_of(scans: DataFrame, found) -> DataFrame:
    """(repo, path, found) of the latest scan: what is found in a content is shuffled, the content is not."""
    return scans.select("repo", "path", "scanned_at", found.alias("found")).groupBy("repo", "path").agg(F.max(F.struct("scanned_at", "found")).alias("m")).select("repo", "path", F.col("m.found").alias("found"))


def _extractor(pattern: str):
    def q(s: SparkSession, d: str) -> DataFrame:
        return ex.extract_latest(_scans(s, d).where(F.col("path").rlike(pattern))).select("repo", "path", "tag", "owner", "qualified_name", "name", "line_start", "line_end")

    return q


def _tag(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.col("tag") == tag)


def ext_language(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "file_node").select("repo", "path").distinct()
    return p.select("repo", "path", scan.language("path").alias("language"))


def file_buckets(s: SparkSession, d: str) -> DataFrame:
    return ext_language(s, d).groupBy("repo", "language").agg(F.count("*").alias("n_files"))


def scan_prune(s: SparkSession, d: str) -> DataFrame:
    """Files outside folders that are never scanned."""
    return scan.pruned(table(s, d, "file_node").select("repo", "path").distinct(), extra=["legacy"])


def gitignore(s: SparkSession, d: str) -> DataFrame:
    """Files that a list of ignore patterns leaves."""
    return scan.without_ignored(table(s, d, "file_node").select("repo", "path").distinct(), ["# tools", "vendor/", "*.min.js", "/assets", "gen*", ""])


def module_qn(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "file_node").select("path").distinct()
    return p.select("path", module_name("path").alias("module"))


def nextjs_paths(s: SparkSession, d: str) -> DataFrame:
    """Routes of files if every folder of one letter pattern were a parameter."""
    p = table(s, d, "file_node").where(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$")).select("path").distinct()
    raw = F.concat(F.lit("app/"), F.regexp_replace("path", "/(s[a-z]*)/", "/[$1]/"), F.lit("/route.ts"))
    return p.select("path", nextjs_path(F.regexp_replace(raw, r"\.(ts|tsx|js|jsx)/", "/")).alias("route"))


def ts_import(s: SparkSession, d: str) -> DataFrame:
    """Relative imports of scripts with the file they mean, by the order in which suffixes are tried."""
    f = _latest_of(_scans(s, d).where(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$")), F.regexp_extract_all("content", F.lit(r"from ['\"](\.\.?/[^'\"\n]+)['\"]"), 1))
    i = f.select("repo", "path", F.explode(F.array_distinct("found")).alias("spec"))
    return scan.script_imports(i, f.select("repo", "path"))


def cpp_include(s: SparkSession, d: str) -> DataFrame:
    """Quoted includes with the header they mean: the one whose path ends in it and shares most folders."""
    f = _latest_of(_scans(s, d).where(F.col("path").rlike(r"\.(cpp|cc|cxx|h|hpp)$")), F.regexp_extract_all("content", F.lit(r'#include "([^"\n]+)"'), 1))
    i = f.select("repo", "path", F.explode(F.array_distinct("found")).alias("include")).unionByName(f.select("repo", "path", F.regexp_extract("path", "([^/]+)$", 1).alias("include")))
    return scan.includes(i, f.select("repo", F.col("path").alias("header")))


def java_overload(s: SparkSession, d: str) -> DataFrame:
    """Methods of a class that share a name, told apart by their parameter types."""
    f = table(s, d, "function_node").where("is_method and parent_class_qn <> ''").select("repo", "parent_class_qn", "name", F.array_join(F.transform("param_types", lambda x: F.coalesce(x["type"], F.lit(""))), ",").alias("types")).distinct()
    n = f.groupBy("repo", "parent_class_qn", "name").agg(F.count("*").alias("n"))
    return f.join(n, ["repo", "parent_class_qn", "name"]).select("repo", F.concat("parent_class_qn", F.lit("."), "name", F.when(F.col("n") > 1, F.concat(F.lit(":"), "types")).otherwise("")).alias("qualified_name"))


def ret_type(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "function_node").select(F.col("return_type_raw").alias("raw")).distinct()
    return f.select("raw", scan.return_type("raw").alias("type"))


def resolve_calls(s: SparkSession, d: str) -> DataFrame:
    """All calls with what they refer to among the listed functions."""
    c = table(s, d, "call_site").where("trim(callee_qn) <> '' and caller_qn is not null").select("repo", F.col("caller_qn").alias("caller"), F.col("callee_qn").alias("callee"), "line")
    none = s.createDataFrame([], "repo string, module string, local_name string, target string, kind string")
    return rs.resolve_calls(c, table(s, d, "function_node"), none).select("repo", "caller", "callee", "line", "target", "rule")


def resolve_all(s: SparkSession, d: str) -> DataFrame:
    """Calls read from the sources, resolved through their imports, bindings and inheritance; counts per repo and rule."""
    rows = ex.extract_latest(_scans(s, d))
    fn = _tag(rows, "function").select("repo", "qualified_name", "owner", "name")
    cl = _tag(rows, "class").select("repo", "qualified_name")
    imports = _tag(rows, "import").select("repo", F.col("owner").alias("module"), F.col("name").alias("local_name"), F.col("qualified_name").alias("target"), F.col("detail").alias("kind"))
    parents = rs.resolve_parents(_tag(rows, "inherits").select("repo", F.col("owner").alias("child"), F.col("name").alias("parent")), cl, imports)
    methods = rs.method_table(fn.join(cl.select("repo", F.col("qualified_name").alias("owner")).distinct(), ["repo", "owner"], "left_semi").select("repo", F.col("owner").alias("class_qn"), F.col("name").alias("method"), F.col("qualified_name").alias("target")), parents.select("repo", F.col("child").alias("class_qn"), F.col("target").alias("parent_qn"), F.lit(0).alias("pos")))
    bound = _tag(rows, "binding").select("repo", "path", F.col("owner").alias("scope"), F.col("name").alias("var"), F.col("qualified_name").alias("text"))
    bound = bound.join(_tag(rows, "module").select("repo", "path", F.col("qualified_name").alias("module")), ["repo", "path"])
    bind = bound.join(rs.resolve_types(bound, cl, imports).where("type_qn is not null"), ["repo", "module", "text"]).select("repo", "scope", "var", "type_qn")
    calls = _tag(rows, "call").select("repo", F.col("owner").alias("caller"), F.col("qualified_name").alias("callee"), F.col("line_start").alias("line"))
    r = rs.resolve_calls(calls, fn, imports, bind, methods)
    return r.groupBy("repo", "rule").agg(F.count("*").alias("n_calls"))


def template_score(s: SparkSession, d: str) -> DataFrame:
    """Documents against word lists: two points per wanted word, three off per unwanted one, the best list if above zero."""
    lists = [("graph", ["edges", "graph", "import"], ["tenant"]), ("queue", ["queue", "callbacks", "retry"], ["prompt"]), ("budget", ["budget", "cost", "limits"], ["schema"])]
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    doc = table(s, d, "documents").select("doc_id", F.array_distinct(w).alias("w"))
    count = lambda words: F.size(F.array_intersect("w", F.array(*map(F.lit, words))))
    scores = F.array(*[F.struct((2 * count(yes) - 3 * count(no)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, yes, no) in enumerate(lists)])
    best = doc.select("doc_id", F.array_max(scores).alias("b"))
    return best.where("b.score > 0").select("doc_id", F.col("b.name").alias("template"), F.col("b.score").cast("long").alias("score"))


def cross_cutting(s: SparkSession, d: str) -> DataFrame:
    """Signals of texts: numbered items, different files named, fenced blocks, mentions of tests, and whether they reach four."""
    t = F.coalesce("text", F.lit(""))
    items = F.size(F.regexp_extract_all(t, F.lit(r"(\n[0-9]+\. )"), 1))
    files = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9_/]+\.(?:py|ts|js|java|cpp|md))"), 1)))
    fences = F.floor(F.size(F.regexp_extract_all(t, F.lit("(```)"), 1)) / 2)
    tests = F.size(F.regexp_extract_all(F.lower(t), F.lit(r"(add tests|write tests|tests for)"), 1))
    x = table(s, d, "documents").select("doc_id", items.cast("long").alias("items"), files.cast("long").alias("files"), fences.cast("long").alias("fences"), tests.cast("long").alias("tests"))
    return x.select("*", (F.col("items") + F.col("files") + F.col("fences") + F.col("tests") >= 4).alias("broad"))


def winner(s: SparkSession, d: str) -> DataFrame:
    """Per user the event type seen most often, the one of greater value among equals, then the first by name."""
    g = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("v"))
    m = g.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.coalesce("v", F.lit(0.0))).alias("v"), "event_type")).alias("m"))
    return m.select("user_id", F.col("m.event_type").alias("event_type"), (-F.col("m.n")).alias("n"))


def least_bad(s: SparkSession, d: str) -> DataFrame:
    """Per event type the user with fewest events, the smallest id among equals."""
    g = table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    m = g.groupBy("event_type").agg(F.min(F.struct("n", "user_id")).alias("m"))
    return m.select("event_type", F.col("m.user_id").alias("user_id"), F.col("m.n").alias("n"))


def flatten(s: SparkSession, d: str) -> DataFrame:
    """Orders' lines as one list with a running index over the whole order of parts."""
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return per.select("l_orderkey", F.posexplode("x").alias("idx", "p")).select("l_orderkey", F.col("idx").cast("long").alias("idx"), F.col("p.l_partkey").alias("l_partkey"))


_LANG = " ".join(f"when '{e}' then '{lang}'" for e, lang in LANGUAGE_OF.items())
_LANG_SQL = f"case lower(regexp_extract(path, '\\.([^./]+)$', 1)) {_LANG} end"
_LATEST = "fl as (select repo, path, arg_max(content, scanned_at) content from file_node where repo is not null and path is not null group by 1, 2)"

QUERIES = {name: _extractor(pattern) for name, pattern in _FAMILY.items()} | {
    f.__name__: f for f in (ext_language, file_buckets, scan_prune, gitignore, module_qn, ts_import, cpp_include, java_overload, ret_type, resolve_calls, resolve_all, template_score, cross_cutting, winner, least_bad, flatten)
} | {"nextjs_path": nextjs_paths}
SQL = {
    "ext_language": f"select distinct repo, path, {_LANG_SQL} as language from file_node",
    "file_buckets": f"select repo, {_LANG_SQL} as language, count(distinct path) n_files from file_node group by 1, 2",
    "scan_prune": "select distinct repo, path from file_node where not list_has_any(string_split(path, '/'), [" + ", ".join(f"'{x}'" for x in sorted({*scan.SKIPPED_DIRS, "legacy"})) + "])",
    "gitignore": "select distinct repo, path from file_node where not (regexp_matches(path, '(^|/)vendor(/|$)') or regexp_matches(path, '[.]min[.]js(/|$)') or regexp_matches(path, '(^|/)assets(/|$)') or regexp_matches(path, '(^|/)gen[^/]*(/|$)') or regexp_matches(path, '^gen'))",
    "module_qn": "select distinct path, replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/(__init__|index)$', ''), '/', '.') as module from file_node",
    "ts_import": f"with {_LATEST}, f as (select * from fl where regexp_matches(path, '\\.(ts|tsx|js|jsx)$')), i as (select distinct repo, path, unnest(regexp_extract_all(content, 'from [''\"](\\.\\.?/[^''\"\\n]+)[''\"]', 1)) spec from f), u as (select repo, path, spec, ltrim(list_reduce(list_prepend('', string_split(concat(regexp_replace(path, '[^/]*$', ''), spec), '/')), lambda a, x: case when x = '..' then regexp_replace(a, '/?[^/]*$', '') when x in ('', '.') then a else concat(a, '/', x) end), '/') t from i), c as (select u.*, s.r, concat(regexp_replace(t, '\\.(ts|tsx|js|jsx)$', ''), s.x) cand from u, (values (0, '.ts'), (1, '.tsx'), (2, '.js'), (3, '.jsx'), (4, '/index.ts'), (5, '/index.tsx'), (6, '/index.js'), (7, '/index.jsx')) s(r, x)) select u.repo, u.path, u.spec, m.cand target from u left join (select repo, path, spec, arg_min(cand, r) cand from c where exists (select 1 from f where f.repo = c.repo and f.path = c.cand) group by 1, 2, 3) m on m.repo = u.repo and m.path = u.path and m.spec = u.spec",
    "java_overload": "with f as (select distinct repo, parent_class_qn, name, array_to_string(list_transform(param_types, lambda x: coalesce(x.type, '')), ',') types from function_node where is_method and parent_class_qn <> '') select repo, concat(parent_class_qn, '.', name, case when count(*) over (partition by repo, parent_class_qn, name) > 1 then concat(':', types) else '' end) qualified_name from f",
    "template_score": "with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w from documents), s as (select doc_id, unnest([{'s': 2 * len(list_intersect(['edges', 'graph', 'import'], w)) - 3 * len(list_intersect(['tenant'], w)), 'o': 0, 'n': 'graph'}, {'s': 2 * len(list_intersect(['queue', 'callbacks', 'retry'], w)) - 3 * len(list_intersect(['prompt'], w)), 'o': -1, 'n': 'queue'}, {'s': 2 * len(list_intersect(['budget', 'cost', 'limits'], w)) - 3 * len(list_intersect(['schema'], w)), 'o': -2, 'n': 'budget'}]) x from d), m as (select doc_id, max(x) x from s group by 1) select doc_id, x.n as template, x.s score from m where x.s > 0",
    "cross_cutting": "with t as (select doc_id, coalesce(text, '') t from documents), x as (select doc_id, len(regexp_extract_all(t, '\\n[0-9]+\\. ')) items, len(list_distinct(regexp_extract_all(t, '[A-Za-z0-9_/]+\\.(?:py|ts|js|java|cpp|md)'))) as files, len(regexp_extract_all(t, '```')) // 2 fences, len(regexp_extract_all(lower(t), 'add tests|write tests|tests for')) tests from t) select *, items + files + fences + tests >= 4 broad from x",
    "winner": "with g as (select user_id, event_type, count(*) n, round(sum(value), 6) v from events group by 1, 2) select user_id, event_type, n from g qualify row_number() over (partition by user_id order by n desc, coalesce(v, 0.0) desc, event_type) = 1",
    "least_bad": "with g as (select user_id, event_type, count(*) n from events group by 1, 2) select event_type, user_id, n from g qualify row_number() over (partition by event_type order by n, user_id) = 1",
    "flatten": "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 idx, l_partkey from lineitem",
    "resolve_calls": "with fn as (select distinct repo, qualified_name from function_node), c as (select distinct repo, caller_qn caller, callee_qn callee, line from call_site where trim(callee_qn) <> '' and caller_qn is not null), u as (select repo, regexp_extract(qualified_name, '[^.]*$') as name, count(*) n, min(qualified_name) q from fn group by 1, 2 having count(*) = 1) select c.repo, caller, callee, line, coalesce(fn.qualified_name, u.q, callee) target, case when fn.qualified_name is not null then 0 when u.q is not null then 5 end as rule from c left join fn on fn.repo = c.repo and fn.qualified_name = callee left join u on u.repo = c.repo and u.name = callee and not contains(callee, '.') and not starts_with(callee, '_')",
}
