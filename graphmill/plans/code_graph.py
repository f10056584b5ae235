"""Queries of graph analytics over the calls between functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.keys import nonblank
from graphmill.functions.paths import camel_to_snake
from graphmill.operators import graph as g
from graphmill.operators import lookup as lk
from graphmill.operators import scopes as sc
from graphmill.sources.tables import table


def _edges(s: SparkSession, d: str) -> DataFrame:
    calls = table(s, d, "call_site").select("repo", nonblank("caller_qn").alias("caller_qn"), nonblank("callee_qn").alias("callee_qn"))
    return g.call_graph(calls, table(s, d, "function_node"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    """Folders as communities of functions."""
    f = lk.first_rows(table(s, d, "function_node"), ["repo", "qualified_name"], ["file_path"])
    return f.select("repo", F.col("qualified_name").alias("node"), F.regexp_replace("file_path", "/[^/]*$", "").alias("label"))


def call_graph(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return g.undirected(_edges(s, d))


def entry_points(s: SparkSession, d: str) -> DataFrame:
    return g.entry_points(_edges(s, d))


def _chains(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    return g.chains(e, g.entry_points(e))


def chains(s: SparkSession, d: str) -> DataFrame:
    """All simple call chains of two to eight functions from the entry points."""
    return _chains(s, d).select("repo", F.array_join("path", "|").alias("path"))


def chain_score(s: SparkSession, d: str) -> DataFrame:
    return g.scored_chains(_chains(s, d), _labels(s, d))


def top_processes(s: SparkSession, d: str) -> DataFrame:
    return g.top_processes(g.scored_chains(_chains(s, d), _labels(s, d)))


def process_steps(s: SparkSession, d: str) -> DataFrame:
    """Every kept process with its steps and the summary of its path."""
    top = top_processes(s, d)
    return g.process_steps(top).join(top.select("repo", "name", g.process_summary("path_id").alias("summary")), ["repo", "name"])


def code_graph(s: SparkSession, d: str) -> DataFrame:
    """Calls between functions and classes, and imports of one file by another through the modules of the calls' files."""
    own = lambda n: table(s, d, n).select("repo", F.col("file_path").alias("path"), F.col("qualified_name").alias("member"))
    members = own("function_node").unionByName(own("class_node"))
    calls = table(s, d, "call_site").select("repo", F.col("caller_qn").alias("source"), F.col("callee_qn").alias("target")).where("source <> target")
    inherits = table(s, d, "function_node").where("parent_class_qn <> ''").select("repo", F.regexp_replace("parent_class_qn", r"\.[^.]*$", "").alias("source"), F.col("parent_class_qn").alias("target"))
    at = members.groupBy("repo", "member").agg(F.min("path").alias("target_path"))
    imports = table(s, d, "call_site").select("repo", F.col("file_path").alias("path"), F.col("callee_qn").alias("member")).distinct().join(at, ["repo", "member"]).where("path <> target_path")
    return g.code_graph(calls, inherits, imports, members)


def community_names(s: SparkSession, d: str) -> DataFrame:
    """Folders as communities with names that differ within a repo."""
    return g.community_names(_labels(s, d).select("repo", "label", F.col("node").alias("member")))


def cohesion(s: SparkSession, d: str) -> DataFrame:
    return g.cohesion(g.undirected(_edges(s, d)), _labels(s, d))


def label_tokens(s: SparkSession, d: str) -> DataFrame:
    return g.label_tokens(_labels(s, d).select("repo", "label", F.col("node").alias("member")))


def _module_edges(s: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.concat_ws(":", "repo", F.regexp_replace(c, r"\.[^.]*$", ""))
    return _edges(s, d).select(key("source").alias("source"), key("target").alias("target")).where("source <> target").distinct()


def scc(s: SparkSession, d: str) -> DataFrame:
    """Modules that call each other in a circle."""
    return g.strong_components(_module_edges(s, d))


def connected(s: SparkSession, d: str) -> DataFrame:
    """Connected components of all functions by calls."""
    key = lambda c: F.concat_ws(":", "repo", c)
    return g.components(_edges(s, d).select(key("source").alias("a"), key("target").alias("b")))


def louvain(s: SparkSession, d: str) -> DataFrame:
    return g.louvain(g.undirected(_edges(s, d)))


def communities(s: SparkSession, d: str) -> DataFrame:
    """Louvain communities with size, cohesion and the word that names them."""
    e = g.undirected(_edges(s, d))
    lab = g.louvain(e)
    size = lab.groupBy("repo", "label").agg(F.count("*").alias("size"))
    return size.join(g.cohesion(e, lab), ["repo", "label"]).join(g.label_tokens(lab.select("repo", "label", F.col("node").alias("member"))), ["repo", "label"], "left")


def _scopes(s: SparkSession, d: str) -> DataFrame:
    cols = ["repo", "file_path", "line_start", "line_end", "qualified_name"]
    both = table(s, d, "function_node").select(*cols).unionByName(table(s, d, "class_node").select(*cols)).distinct()
    return both.select("repo", "file_path", F.col("line_start").alias("start"), (F.col("line_end") + 1).alias("end"), F.col("qualified_name").alias("id"))


def scope_parent(s: SparkSession, d: str) -> DataFrame:
    """The innermost class or function around every class and function."""
    return sc.scope_parents(_scopes(s, d), ["repo", "file_path"])


def scope_at(s: SparkSession, d: str) -> DataFrame:
    """The innermost class or function at every line that calls."""
    pos = table(s, d, "call_site").select("repo", "file_path", F.col("line").alias("pos"))
    return sc.scope_at(_scopes(s, d), pos, ["repo", "file_path"])


def qn_dedupe(s: SparkSession, d: str) -> DataFrame:
    """One definition per qualified name: classes before functions, then the first in file order."""
    cols = ["repo", "qualified_name", "file_path", "line_start"]
    both = table(s, d, "class_node").select(*cols, F.lit(0).alias("rank")).unionByName(table(s, d, "function_node").select(*cols, F.lit(1).alias("rank")))
    m = lk.first_rows(both, ["repo", "qualified_name"], ["rank", "file_path", "line_start"])
    return m.select("repo", "qualified_name", F.when(F.col("rank") == 0, "class").otherwise("function").alias("kind"), "file_path", "line_start")


def module_exports(s: SparkSession, d: str) -> DataFrame:
    """Names that a module exports: not within a class, not private; a module's name is the qualified name without its last part."""
    f = table(s, d, "function_node").where("not is_method").select("repo", "qualified_name", "name").unionByName(table(s, d, "class_node").select("repo", "qualified_name", "name"))
    f = f.where(~F.startswith("name", F.lit("_"))).distinct()
    return f.select("repo", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("module"), "name", "qualified_name")


def camel_snake(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "function_node").select("name").unionByName(table(s, d, "class_node").select("name")).distinct()
    return n.select("name", camel_to_snake("name").alias("snake"))


_E = "f as (select distinct repo, qualified_name from function_node), e as (select distinct c.repo, caller_qn source, callee_qn target from call_site c where caller_qn <> callee_qn and exists (select 1 from f where f.repo = c.repo and f.qualified_name = caller_qn) and exists (select 1 from f where f.repo = c.repo and f.qualified_name = callee_qn))"
_L = "lab as (select repo, qualified_name node, regexp_replace(min(file_path), '/[^/]*$', '') as label from function_node where qualified_name is not null group by 1, 2)"
_DEG = "o as (select repo, source node from e group by 1, 2), i as (select repo, target node, count(*) n from e group by 1, 2), deg as (select o.repo, o.node, coalesce(i.n, 0) n_in from o left join i using (repo, node)), ent as (select repo, node from deg where n_in = (select min(n_in) from deg x where x.repo = deg.repo))"
_CH = "c1 as (select repo, [node] path from ent), " + ", ".join(f"c{k} as (select c.repo, list_append(path, target) as path from c{k - 1} c join e on e.repo = c.repo and e.source = path[-1] where not list_contains(path, target))" for k in range(2, g.MAX_PATH + 1)) + ", ch as (" + " union all ".join(f"select * from c{k}" for k in range(2, g.MAX_PATH + 1)) + ")"
_SC = "x as (select repo, array_to_string(path, '|') path_id, len(path) n, unnest(path) node from ch), sc as (select x.repo, path_id, cast(max(n) * greatest(count(distinct label) - 1, 0) as bigint) score from x left join lab on lab.repo = x.repo and lab.node = x.node group by 1, 2), pos as (select * from sc where score > 0)"
_U = "u as (select distinct repo, least(source, target) a, greatest(source, target) b from e)"
_S = "s as (select distinct repo, file_path, line_start as start, line_end + 1 as stop, qualified_name id from (select repo, file_path, line_start, line_end, qualified_name from function_node union all select repo, file_path, line_start, line_end, qualified_name from class_node))"

QUERIES = {f.__name__: f for f in (call_graph, graph_edges, entry_points, chains, chain_score, top_processes, process_steps, code_graph, community_names, cohesion, label_tokens, scc, connected, louvain, communities, scope_parent, scope_at, qn_dedupe, module_exports, camel_snake)}
SQL = {
    "call_graph": f"with {_E} select * from e",
    "graph_edges": f"with {_E}, {_U} select * from u",
    "entry_points": f"with {_E}, {_DEG} select * from ent",
    "chains": f"with {_E}, {_DEG}, {_CH} select repo, array_to_string(path, '|') as path from ch",
    "chain_score": f"with {_E}, {_L}, {_DEG}, {_CH}, {_SC} select * from pos",
    "top_processes": f"with {_E}, {_L}, {_DEG}, {_CH}, {_SC}, t as (select *, row_number() over (partition by repo order by score desc, path_id) as rank from pos qualify rank <= 50), b as (select *, concat(split_part(split_part(path_id, '|', 1), '.', -1), ' -> ', split_part(split_part(path_id, '|', -1), '.', -1)) base from t), k as (select *, row_number() over (partition by repo, base order by rank) k from b) select repo, rank, case when k = 1 then base else concat(base, ' #', k) end as name, path_id, score from k",
    "cohesion": f"with {_E}, {_U}, {_L}, ee as (select u.repo, x.label la, y.label lb from u join lab x on x.repo = u.repo and x.node = a join lab y on y.repo = u.repo and y.node = b), ends as (select repo, la as label, la = lb as inside from ee union all select repo, lb, false from ee where la <> lb), per as (select repo, label, count(*) filter (inside) / count(*) c from ends group by 1, 2) select l.repo, l.label, round(coalesce(c, 0.0), 6) cohesion from (select distinct repo, label from lab) l left join per on per.repo = l.repo and per.label = l.label",
    "label_tokens": f"with {_L}, w as (select repo, label, node, list_filter(string_split_regex(regexp_replace(lower(array_to_string(case when len(string_split(node, '.')) < 2 then string_split(node, '.') else string_split(node, '.')[-2:] end, '.')), '[^a-z._-]', '', 'g'), '[._-]'), lambda x: x <> '') w from lab), x as (select repo, label, node, unnest(w) token, unnest(range(len(w))) i from w), c as (select repo, label, token, count(*) n, min(struct_pack(node := node, i := i)) first from x group by 1, 2, 3) select repo, label, token from c qualify row_number() over (partition by repo, label order by n desc, first, token) = 1",
    "scc": f"with recursive {_E}, m as (select distinct concat(repo, ':', regexp_replace(source, '\\.[^.]*$', '')) a, concat(repo, ':', regexp_replace(target, '\\.[^.]*$', '')) b from e), m2 as (select * from m where a <> b), n as (select a x from m2 union select b from m2), r as (select x, x as y from n union select r.x, m2.b from r join m2 on m2.a = r.y) select p.x node, min(p.y) component from r p join r q on q.x = p.y and q.y = p.x group by 1",
    "connected": f"with recursive {_E}, m as (select distinct concat(repo, ':', source) a, concat(repo, ':', target) b from e), m2 as (select a, b from m union select b, a from m), r as (select a x, a as y from m2 union select r.x, m2.b from r join m2 on m2.a = r.y) select x node, min(y) component from r group by 1",
    "scope_parent": f"with {_S}, j as (select a.*, b.id id2, b.stop - b.start w from s a left join s b on a.repo = b.repo and a.file_path = b.file_path and b.start <= a.start and a.stop <= b.stop and (b.stop - b.start > a.stop - a.start or (b.start = a.start and b.stop = a.stop and b.id < a.id))) select repo, file_path, start, stop as end, id, min(struct_pack(w := w, id2 := id2)) filter (id2 is not null).id2 parent_id from j group by 1, 2, 3, 4, 5",
    "scope_at": f"with {_S}, p as (select distinct repo, file_path, line pos from call_site), j as (select p.*, s.id, s.stop - s.start w from p left join s on s.repo = p.repo and s.file_path = p.file_path and s.start <= pos and pos < s.stop) select repo, file_path, pos, min(struct_pack(w := w, id := id)) filter (id is not null).id id from j group by 1, 2, 3",
    "qn_dedupe": "select repo, qualified_name, case m.r when 0 then 'class' else 'function' end kind, m.f file_path, m.l line_start from (select repo, qualified_name, min(struct_pack(r := r, f := file_path, l := line_start)) m from (select *, 0 r from (select repo, qualified_name, file_path, line_start from class_node) union all select *, 1 r from (select repo, qualified_name, file_path, line_start from function_node)) where repo is not null and qualified_name is not null group by 1, 2)",
    "module_exports": "select distinct repo, regexp_replace(qualified_name, '\\.[^.]*$', '') as module, name, qualified_name from (select repo, qualified_name, name from function_node where not is_method union all select repo, qualified_name, name from class_node) where not starts_with(name, '_')",
    "camel_snake": "select distinct name, lower(regexp_replace(name, '([^A-Z])([A-Z])', '\\1_\\2', 'g')) snake from (select name from function_node union select name from class_node)",
}
_TOP = SQL["top_processes"]
SQL["process_steps"] = f"with tp as ({_TOP}) select repo, name, unnest(range(len(p))) step, unnest(p) as member, concat(array_to_string(list_transform(p[:6], lambda x: split_part(x, '.', -1)), ', '), case when len(p) > 6 then '...' else '' end) summary from (select repo, name, string_split(path_id, '|') p from tp)"
SQL["code_graph"] = "with mem as (select distinct repo, file_path path, qualified_name m from function_node where qualified_name is not null union select distinct repo, file_path, qualified_name from class_node where qualified_name is not null), e as (select repo, caller_qn s, callee_qn t from call_site where caller_qn <> callee_qn union select repo, regexp_replace(parent_class_qn, '\\.[^.]*$', ''), parent_class_qn from function_node where parent_class_qn <> ''), ee as (select * from e where exists (select 1 from mem where mem.repo = e.repo and m = s) and exists (select 1 from mem where mem.repo = e.repo and m = t)), fm as (select repo, path, min(m) m from mem group by 1, 2), pl as (select repo, m, min(path) path from mem group by 1, 2), i as (select distinct c.repo, c.file_path p, pl.path q from call_site c join pl on pl.repo = c.repo and pl.m = c.callee_qn where c.file_path <> pl.path), ii as (select i.repo, x.m s, y.m t from i join fm x on x.repo = i.repo and x.path = i.p join fm y on y.repo = i.repo and y.path = i.q where x.m <> y.m) select distinct repo, least(s, t) a, greatest(s, t) b from (select * from ee union all select * from ii)"
