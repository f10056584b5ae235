"""Source files to typed rows: modules, classes, functions, imports, inheritance, calls, bindings, routes, tools, tables and call hints.

One narrow map over files in Arrow batches; a file that cannot be read as its language gives one row of tag `error` instead of failing
the job. All tags share one schema, so one pass over the contents serves all record types; `where("tag = ...")` picks one.
Python goes through the standard library's syntax tree, the brace languages through a token scanner that covers declarations,
heritage, imports, calls and annotations; it does not expand macros or resolve templates.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.lexing import language_of, lex
from graphmill.functions.types import plain_type as return_type
from graphmill.sources.scan import SKIPPED_DIRS

SCHEMA = "repo string, path string, tag string, owner string, qualified_name string, name string, line_start int, line_end int, detail string, extra array<string>"
# Receivers and method sets of the frameworks that are recognised.
ROUTERS = {"api", "app", "blueprint", "bp", "fastapi_app", "myapp", "router", "router_v1", "router_v2"}
VERBS = {"get", "post", "put", "delete", "patch", "head", "options"}
TOOL_RECEIVERS = {"app", "fast_mcp", "fastmcp", "mcp", "server"}
CLIENTS = {"aiohttp", "api", "api_client", "axios", "client", "fetch", "got", "http", "httpclient", "https", "httpservice", "ky", "request", "requests", "session", "urllib"}
SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
SESSION_LEAVES = {"add", "add_all", "bulk_insert_mappings", "bulk_save_objects", "bulk_update_mappings", "delete", "execute", "get", "merge", "query", "scalars"}
READ_LEAVES = {"aggregate", "all", "annotate", "count", "defer", "difference", "distinct", "exclude", "exists", "filter", "first", "get", "in_bulk", "intersection", "iterator", "last", "none", "only", "order_by", "prefetch_related", "raw", "reverse", "select_related", "union", "values", "values_list"}
WRITE_LEAVES = {"bulk_create", "bulk_update", "create", "raw_update", "update"}
BOTH_LEAVES = {"get_or_create", "update_or_create"}
INSTANCE_LEAVES = {"delete", "refresh_from_db", "save"}
ORM_LEAVES = SESSION_LEAVES | READ_LEAVES | WRITE_LEAVES | BOTH_LEAVES | INSTANCE_LEAVES
DECLARATIVE_BASES = {"Base", "DeclarativeBase", "Model", "ModelBase"}
DJANGO_BASES = {"AbstractBaseUser", "AbstractUser", "Model", "models.AbstractBaseUser", "models.AbstractUser", "models.Model"}


def module_qn(path: str, roots: tuple[str, ...] = ()) -> str:
    """Dotted module of a path below the longest matching package root; a package's own file stands for the package."""
    best = max((r for r in roots if path.startswith(r.rstrip("/") + "/")), key=len, default="")
    rest = path[len(best.rstrip("/")) + 1 :] if best else path
    rest = re.sub(r"\.[^./]+$", "", rest)
    return re.sub(r"(?:^|/)(?:__init__|index)$", "", rest).replace("/", ".") or rest.replace("/", ".")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return "super"
    return ""


def _text(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


def _literal(node: ast.AST | None):
    return node.value if isinstance(node, ast.Constant) else None


def camel_to_snake(name: str) -> str:
    return re.sub(r"([^A-Z])([A-Z])", r"\1_\2", name).lower()


def python_rows(path: str, content: str, roots: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Rows (tag, owner, qualified_name, name, line_start, line_end, detail, extra) of a Python file."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(content)
    mod = module_qn(path, roots)
    yield "module", "", mod, mod.rsplit(".", 1)[-1], 1, content.count("\n") + 1, ast.get_docstring(tree) or "", []
    package = mod if path.endswith("__init__.py") else mod.rpartition(".")[0]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", mod, a.name, a.asname or a.name.split(".")[0], node.lineno, node.lineno, "module", []
        elif isinstance(node, ast.ImportFrom):
            base = package.split(".") if package else []
            base = base[: len(base) - node.level + 1] if node.level else []
            target = ".".join([*base, *([node.module] if node.module else [])])
            for a in node.names:
                kind = "wildcard" if a.name == "*" else "symbol"
                yield "import", mod, target if a.name == "*" else f"{target}.{a.name}".strip("."), a.asname or a.name, node.lineno, node.lineno, kind, []
    local = {n.name: f"{mod}.{n.name}" for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            yield from _python_class(node, mod, local)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _python_function(node, mod, "", local)
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            yield "binding", mod, _dotted(node.value.func), node.targets[0].id, node.lineno, node.end_lineno, "module", []


def _python_class(node: ast.ClassDef, mod: str, local: dict[str, str]) -> Iterator[tuple]:
    qn = f"{mod}.{node.name}"
    bases = [b for b in map(_dotted, node.bases) if b]
    yield "class", mod, qn, node.name, node.lineno, node.end_lineno, ast.get_docstring(node) or "", [_text(d) for d in node.decorator_list]
    for b in bases:
        yield "inherits", qn, local.get(b, b), b, node.lineno, node.lineno, "", []
    fields = {t.id: n.value for n in node.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    fields |= {n.target.id: n.value for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and n.value is not None}
    named = _literal(fields.get("__tablename__"))
    django = any(b in DJANGO_BASES or b.endswith(".models.Model") for b in bases) and not named
    declared = any(b.rsplit(".", 1)[-1] in DECLARATIVE_BASES for b in bases)
    columns = {k: v for k, v in fields.items() if isinstance(v, ast.Call) and (_dotted(v.func).rsplit(".", 1)[-1] in ("Column", "mapped_column") or django and _dotted(v.func).endswith("Field") or django and _dotted(v.func).rsplit(".", 1)[-1] == "ForeignKey")}
    meta = next((n for n in node.body if isinstance(n, ast.ClassDef) and n.name == "Meta"), None)
    if django and meta:
        named = next((_literal(n.value) for n in meta.body if isinstance(n, ast.Assign) and _dotted(n.targets[0]) == "db_table"), None)
    typed = {n.target.id: n for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and _text(n.annotation).split("[")[0].rsplit(".", 1)[-1] == "Mapped"}
    if django or named or declared and (columns or typed) and "__abstract__" not in fields:
        table = named or camel_to_snake(node.name)
        yield "table", qn, table, node.name, node.lineno, node.end_lineno, "django" if django else "sqlalchemy", []
        for k, v in columns.items():
            kw = {a.arg: a.value for a in v.keywords}
            leaf = _dotted(v.func).rsplit(".", 1)[-1]
            fk = next((_literal(a.args[0]) for a in v.args if isinstance(a, ast.Call) and _dotted(a.func).endswith("ForeignKey") and a.args), None)
            if django and leaf == "ForeignKey" and v.args:
                fk = _literal(v.args[0]) or _dotted(v.args[0])
            pk = _literal(kw.get("primary_key")) is True
            null = _literal(kw.get("null" if django else "nullable"))
            nullable = (not django and not pk) if null is None else bool(null)
            index = _literal(kw.get("db_index" if django else "index")) is True
            typ = leaf if django else next((_text(a) for a in v.args if not (isinstance(a, ast.Call) and _dotted(a.func).endswith("ForeignKey"))), "")
            yield "column", table, f"{table}.{k}", k, v.lineno, v.end_lineno, typ, [f"pk={pk}".lower(), f"nullable={nullable}".lower(), f"index={index}".lower(), f"fk={str(fk or '').split('.')[0]}"]
    for n in node.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _python_function(n, qn, qn, local)


def _python_function(node, owner: str, cls: str, local: dict[str, str]) -> Iterator[tuple]:
    qn = f"{owner}.{node.name}"
    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    params = [f"{a.arg}:{_text(a.annotation)}" for a in args if a.arg not in ("self", "cls")]
    doc = ast.get_docstring(node) or ""
    yield "function", owner, qn, node.name, node.lineno, node.end_lineno, doc, params
    yield "returns", owner, qn, return_type(_text(node.returns)), node.lineno, node.lineno, "async" if isinstance(node, ast.AsyncFunctionDef) else "", []
    for d in node.decorator_list:
        target = _dotted(d.func) if isinstance(d, ast.Call) else _dotted(d)
        recv, _, verb = target.rpartition(".")
        kw = {a.arg: a.value for a in d.keywords} if isinstance(d, ast.Call) else {}
        first = _literal(d.args[0]) if isinstance(d, ast.Call) and d.args else _literal(kw.get("path") or kw.get("rule"))
        if recv.rsplit(".", 1)[-1] in ROUTERS and isinstance(first, str):
            if verb in VERBS:
                yield "route", qn, first, verb.upper(), node.lineno, node.end_lineno, "fastapi", []
            elif verb == "route":
                methods = [_literal(e) for e in kw["methods"].elts] if isinstance(kw.get("methods"), (ast.List, ast.Tuple)) else ["GET"]
                for m in methods:
                    yield "route", qn, first, str(m).upper(), node.lineno, node.end_lineno, "flask", []
        if recv.rsplit(".", 1)[-1] in TOOL_RECEIVERS and verb == "tool":
            described = _literal(kw.get("description")) or (_literal(d.args[1]) if isinstance(d, ast.Call) and len(d.args) > 1 else None) or doc.split("\n\n")[0]
            yield "tool", qn, _literal(kw.get("name")) or (first if isinstance(first, str) else node.name), node.name, node.lineno, node.end_lineno, str(described)[:500], []
        if recv.rsplit(".", 1)[-1] in TOOL_RECEIVERS and verb == "resource" and isinstance(first, str):
            yield "resource", qn, first, node.name, node.lineno, node.end_lineno, (_literal(kw.get("description")) or doc.split("\n\n")[0])[:500], []
    for n in (x for part in node.body for x in ast.walk(part)):
        if isinstance(n, ast.Call):
            callee = _dotted(n.func)
            if not callee or callee == "super":
                continue
            resolved = local.get(callee, callee) if "." not in callee else callee
            yield "call", qn, resolved, callee.rsplit(".", 1)[-1], n.lineno, n.lineno, callee, []
            leaf = callee.rsplit(".", 1)[-1]
            if "." in callee and leaf in ORM_LEAVES:
                head = _dotted(n.args[0].func) if n.args and isinstance(n.args[0], ast.Call) else _dotted(n.args[0]) if n.args else ""
                inner = _dotted(n.args[0].args[0]) if n.args and isinstance(n.args[0], ast.Call) and n.args[0].args else ""
                yield "hint", qn, callee, leaf, n.lineno, n.lineno, head, [inner]
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1:
            t = n.targets[0]
            if isinstance(t, ast.Name):
                yield "binding", qn, _dotted(n.value.func), t.id, n.lineno, n.lineno, "local", []
            elif isinstance(t, ast.Attribute) and _dotted(t.value) == "self" and cls:
                yield "binding", cls, _dotted(n.value.func), t.attr, n.lineno, n.lineno, "field", []



_SKIP = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "sizeof", "typeof", "function", "super", "this", "await", "case", "delete", "synchronized", "instanceof", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "decltype", "alignof", "noexcept"}


def braced_rows(path: str, content: str, language: str) -> Iterator[tuple]:
    """Rows of a JavaScript, TypeScript, Java or C++ file from its tokens."""
    lexed = lex(content, language)
    toks, ends = lexed.tokens, lexed.ends
    text = [content[t[1] : e] for t, e in zip(toks, ends)]
    cls = [t[0] for t in toks]
    breaks = [m.start() for m in re.finditer("\n", content)]
    line = lambda i: bisect.bisect_left(breaks, toks[i][1]) + 1
    match: dict[int, int] = {}
    stack: list[int] = []
    for i, c in enumerate(cls):
        if c in ("(", "{", "["):
            stack.append(i)
        elif c in (")", "}", "]") and stack:
            match[stack.pop()] = i
    n = len(cls)
    mod = module_qn(path)
    i = 0
    if language == "java" and cls[:1] == ["package"]:
        j = cls.index(";") if ";" in cls else 0
        mod = "".join(text[1:j])
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        mod_name = f"{mod}.{stem}"
    else:
        mod_name = mod
    yield "module", "", mod_name, mod_name.rsplit(".", 1)[-1], 1, content.count("\n") + 1, "", []
    for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*([<"])([^>"\n]+)[>"]', content, re.M) if language == "cpp" else ():
        yield "import", mod_name, m[2], m[2], content.count("\n", 0, m.start()) + 1, 0, "quoted" if m[1] == '"' else "system", []
    owners: list[tuple[int, str, str]] = []  # (end, qualified name, kind)
    pending: list[str] = []
    while i < n:
        while owners and i > owners[-1][0]:
            owners.pop()
        here = owners[-1][1] if owners else mod
        c = cls[i]
        if c == "@" and language == "java" and i + 1 < n:
            j = i + 2
            while j + 1 < n and cls[j] == ".":
                j += 2
            end = match.get(j, j) if j < n and cls[j] == "(" else j - 1
            pending.append("".join(text[i : end + 1]))
            i = end + 1
            continue
        if c == "import" and language != "cpp":
            j = i
            while j < n and cls[j] != ";" and not (j > i and toks[j][2]):
                j += 1
            part = text[i + 1 : j]
            if language == "java":
                name = "".join(p for p in part if p != "static")
                yield "import", mod_name, name, name.rsplit(".", 1)[-1], line(i), line(i), "wildcard" if name.endswith("*") else "symbol", []
            elif part and part[-1][:1] in "'\"":
                names = [p for p in part[:-1] if re.match(r"[\w$*]", p) and p not in ("from", "type")]
                for p in names or [""]:
                    yield "import", mod_name, part[-1].strip("'\""), p, line(i), line(i), "symbol" if "{" in part else "module", []
            i = j + 1
            continue
        if c == "namespace" and language in ("cpp", "typescript"):
            j = i + 1
            while j < n and cls[j] in ("ID", "::", "."):
                j += 1
            if j < n and cls[j] == "{" and j in match:
                name = "".join(text[i + 1 : j]).replace("::", ".")
                owners.append((match[j], f"{owners[-1][1]}.{name}" if owners else name or mod, "namespace"))
            i = j + 1
            continue
        if c in ("class", "interface", "struct", "enum") and i + 1 < n and cls[i + 1] in ("ID", "record", "class"):
            k = i + 2 if cls[i + 1] == "class" else i + 1
            j = k
            while j < n and cls[j] not in ("{", ";", "(", "="):
                j += 1
            if j < n and cls[j] == "{" and j in match:
                name = text[k]
                qn = f"{here}.{name}"
                yield "class", here, qn, name, line(i), line(match[j]), c, list(pending)
                head = text[k + 1 : j]
                level, base, mode = 0, "", ""
                for p in [*head, ","]:
                    level += (p == "<") - (p == ">")
                    if p in ("extends", "implements", ":") and level == 0 or p == "," and level == 0:
                        if mode and base and not (mode == "implements" and language in ("typescript", "javascript")):
                            yield "inherits", qn, base, base, line(i), line(i), mode, []
                        base = ""
                        mode = p if p != "," else mode
                    elif level == 0 and p not in (">", "public", "private", "protected", "virtual") and mode:
                        base += p
                owners.append((match[j], qn, "class"))
                pending = []
                i = j + 1
                continue
        if c in ("ID", "get", "set", "of", "from") and i + 1 < n and cls[i + 1] == "(" and i + 1 in match:
            name = text[i]
            close = match[i + 1]
            j = close + 1
            level = 0
            while language != "javascript" and j < n and (level or cls[j] not in ("{", ";", "}", "(", ")", "=", ",")) and cls[j] not in (";", "{"):
                level += (cls[j] == "<") - (cls[j] == ">")
                j += 1
            prev = cls[i - 1] if i else ""
            declared = j < n and cls[j] == "{" and name not in _SKIP and prev not in (".", "->", "new", "=", "(", ",", "return", "!", "&&", "||", "?.", "?", "+", "-") and (prev in ("function", "*") or (owners and owners[-1][2] == "class") or language in ("cpp", "java") and prev in ("ID", ">", "*", "&", "::", "~", "int", "bool", "void", "double", "float", "char", "long", "auto", "]", "boolean"))
            in_function = any(o[2] == "function" for o in owners)
            if declared and j in match and not (in_function and prev != "function"):
                owner = here
                qn = f"{owner}.{name}"
                if language == "cpp" and "const" in text[close + 1 : j]:
                    qn += ":const"
                params = _params(cls[i + 2 : close], text[i + 2 : close], language)
                yield "function", owner, qn, name, line(i), line(match[j]), "async" if "async" in text[max(0, i - 3) : i] else "", params
                for a in pending:
                    yield "annotation", qn, a, a.split("(")[0].lstrip("@"), line(i), line(i), owner, []
                pending = []
                owners.append((match[j], qn, "function"))
                i = j + 1
                continue
            if in_function and name not in _SKIP:
                k = i
                while k >= 2 and cls[k - 1] in (".", "->", "::", "?.") and cls[k - 2] in ("ID", "this", "super"):
                    k -= 2
                callee = "".join(text[k : i + 1]).replace("->", ".").replace("?.", ".")
                owner = next(o[1] for o in reversed(owners) if o[2] == "function")
                yield "call", owner, callee, name, line(i), line(i), "new" if k and cls[k - 1] == "new" else "", []
                verb = name.lower()
                recv = callee.rsplit(".", 2)[-2] if "." in callee else ""
                if language in ("javascript", "typescript") and verb in VERBS and recv and recv.lower() not in CLIENTS and i + 2 < n and cls[i + 2] == "STR":
                    yield "route", "", text[i + 2].strip("'\""), verb.upper(), line(i), line(i), "express", []
        elif c == "ID" and i + 2 < n and cls[i + 1] == "=" and language in ("javascript", "typescript") and prev_is(cls, i, ("const", "let", "var")):
            j = i + 2 + (cls[i + 2] == "async")
            if j < n and cls[j] == "(" and j in match and match[j] + 1 < n and cls[match[j] + 1] in ("=>", ":"):
                k = match[j]
                while k < n and cls[k] != "=>":
                    k += 1
                if k + 1 < n:
                    stop = match.get(k + 1, k + 1)
                    yield "function", here, f"{here}.{text[i]}", text[i], line(i), line(stop), "async" if cls[i + 2] == "async" else "", _params(cls[j + 1 : match[j]], text[j + 1 : match[j]], language)
                    owners.append((stop, f"{here}.{text[i]}", "function"))
                    i = k + 1
                    continue
        if c in (";", "}"):
            pending = []
        i += 1


def prev_is(cls: list[str], i: int, kinds: tuple[str, ...]) -> bool:
    return i > 0 and cls[i - 1] in kinds


def _params(cls: list[str], text: list[str], language: str) -> list[str]:
    out, level, cur = [], 0, []
    for c, t in [*zip(cls, text), (",", ",")]:
        level += (c in ("(", "[", "{", "<")) - (c in (")", "]", "}", ">"))
        if c == "," and level == 0:
            if cur:
                names = [x for x in cur if re.match(r"[\w$]", x)]
                if language in ("java", "cpp"):
                    out.append(f"{names[-1] if names else ''}:{''.join(cur[:-1]) if len(cur) > 1 else cur[0]}")
                else:
                    at = cur.index(":") if ":" in cur else len(cur)
                    out.append(f"{''.join(cur[:at])}:{''.join(cur[at + 1 :])}")
            cur = []
        else:
            cur.append(t)
    return out


def file_rows(path: str, content: str, roots: tuple[str, ...] = ()) -> list[tuple]:
    language = language_of(path)
    try:
        if language == "python":
            return list(python_rows(path, content, roots))
        return list(braced_rows(path, content, language)) if language else []
    except (SyntaxError, ValueError, RecursionError, IndexError, StopIteration) as e:
        return [("error", "", module_qn(path), type(e).__name__, getattr(e, "lineno", None) or 0, 0, str(e)[:200], [])]


def extract(files: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """All rows of files (repo, path, content). Null contents count as empty; files of unknown extensions give no rows."""

    def run(pdfs):
        for p in pdfs:
            out = [(r, path, *row) for r, path, content in zip(p["repo"], p["path"], p["content"]) for row in file_rows(path, content or "", roots)]
            yield pd.DataFrame(out, columns=["repo", "path", "tag", "owner", "qualified_name", "name", "line_start", "line_end", "detail", "extra"])

    return files.where("repo is not null and path is not null").select("repo", "path", "content").mapInPandas(run, SCHEMA)


def extract_latest(files: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """`extract` of the latest scan per file of (repo, path, content, scanned_at).

    Every scan is read where it lies, its rows packed into one value, and only those values are shuffled to pick the latest;
    contents never are. Of equally late scans the one with the greatest packed rows holds.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def read(pdfs):
        for p in pdfs:
            packed = [zstandard.ZstdCompressor(level=3).compress(json.dumps(file_rows(path, content or "", roots)).encode()) for path, content in zip(p["path"], p["content"])]
            yield pd.DataFrame({"repo": p["repo"], "path": p["path"], "scanned_at": p["scanned_at"], "packed": packed})

    def unpack(pdfs):
        for p in pdfs:
            yield pd.DataFrame([(r, path, *row) for r, path, x in zip(p["repo"], p["path"], p["packed"]) for row in json.loads(zstandard.ZstdDecompressor().decompress(x))], columns=names)

    rows = files.where("repo is not null and path is not null").select("repo", "path", "content", "scanned_at").mapInPandas(read, "repo string, path string, scanned_at timestamp, packed binary")
    last = rows.groupBy("repo", "path").agg(F.max(F.struct("scanned_at", "packed")).alias("m"))
    return last.select("repo", "path", "m.packed").mapInPandas(unpack, SCHEMA)


def package_roots(projects: list[tuple[str, str]], skipped: list[str] = SKIPPED_DIRS) -> list[str]:
    """Package roots among (path of a project file, its text): those that declare a package and do not lie in a skipped folder, deepest
    first; where the file names a source folder, in the way of either of two build tools, that is the root."""
    out = set()
    for path, text in projects:
        folder = path.rsplit("/", 1)[0] if "/" in path else ""
        try:
            declared = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            continue
        tool = declared.get("tool", {})
        poetry, hatch, setuptools = (tool.get(x, {}) for x in ("poetry", "hatch", "setuptools"))
        if set(path.split("/")) & set(skipped) or not ("project" in declared or "poetry" in tool or {"build", "version"} & set(hatch) or setuptools):
            continue
        listed = poetry.get("packages", [])
        sources = [x["from"] for x in (listed if isinstance(listed, list) else []) if isinstance(x, dict) and isinstance(x.get("from"), str)]
        mapped = setuptools.get("package-dir", {})
        sources += [mapped[""]] if isinstance(mapped, dict) and isinstance(mapped.get(""), str) else []
        out.add((folder, sources[0] if sources else ""))
    order = sorted(out, key=lambda x: (-len([p for p in x[0].split("/") if p]), x))
    return ["/".join(p for p in x if p) for x in order]
