"""p1: functions and classes paired with the documentation that stands in their file.

A lexer turns each file into rows: lines of code, comments, brackets (or indents) with their change of depth, and the string
that opens a Python body. SQL windows over a file's rows do the rest: a running sum of changes is the depth; the next closing row of
the same depth ends a declaration's block; adjacent line comments form islands (line minus row number); a lag over comments gives
each line the last comment above it, and a lead from an annotation's line gives the declaration below it.

A pair needs a declaration of the listed name on the listed line (its first annotation's line in Java). The
documentation is the plain string literal opening the body in Python, and elsewhere the comment that ends on the line above.
Documentation that says nothing is dropped: see `says_something`. Rows of nodes without file, line or name give no pair;
exact copies of nodes give one; of several scans of a file the latest counts; null contents are empty.
"""

from __future__ import annotations

import bisect
import itertools
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.files import file_rows
from graphmill.functions.lexing import language_of, lex
from graphmill.sources.tables import table

# kinds of rows
CODE, COMMENT, LINE_COMMENT, OPEN, CLOSE, BODY, NODE = range(7)
_STRINGS = r"\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'"
_SCAN = {
    "script": re.compile(rf"(//[^\n]*|/\*[\s\S]*?\*/)|({_STRINGS}|`(?:\\[\s\S]|[^`\\])*`|(?<=[=(,:!&|?\[;{{}}])[ \t]*/(?![*/ \t])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/)|([{{}}])"),
    "java": re.compile(rf"(//[^\n]*|/\*[\s\S]*?\*/)|(\"\"\"[\s\S]*?\"\"\"|{_STRINGS})|([{{}}])"),
    "cpp": re.compile(rf"(//[^\n]*|/\*[\s\S]*?\*/)|({_STRINGS})|([{{}}])"),
    "python": re.compile(r"(#[^\n]*)|(\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|([(\[{])|([)\]}])|(\\\n)|(\n)"),
}
# Words and signs that no declaration begins with.
_NO_DECLARATION = re.compile(r"(?:return|if|else|for|while|switch|case|break|continue|throw|do|try|catch|finally|import|package|using|delete|await|yield|goto)\b|[})\]#;.,+\-*/%&|<>=!?:\"'`\d]")
_HEADER = re.compile(r"(?:async[ \t]+)?def\b|class\b")
_BODY = re.compile(r"(?:[rRuU]?(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')[ \t]*)+(?=[;#\n]|$)")


def file_tokens(path: str, content: str) -> list[tuple]:
    """Rows (line, kind, text) of one file, in order. CODE is a line on which a declaration may stand, COMMENT one block at its last
    line, LINE_COMMENT one line, OPEN and CLOSE change the depth, BODY is at a
    Python header's line, with the documentation string that opens its body or null."""
    language = language_of(path)
    if language is None:
        return []
    if "\r" in content:
        content = content.replace("\r\n", "\n")
    return _python_rows(content) if language == "python" else _braced_rows(content, "script" if language in ("javascript", "typescript") else language)


def _braced_rows(content: str, family: str) -> list[tuple]:
    lines = content.split("\n")
    starts = list(itertools.accumulate((len(x) + 1 for x in lines), initial=0))
    out: list[tuple] = []
    at = 0  # the line, from 0, that is being read
    covered = -1  # the last line that a comment or string runs on into
    shown = -1  # the last line whose code has been put out

    def code_until(line: int) -> None:
        nonlocal shown
        for k in range(shown + 1, line + 1):
            text = lines[k].strip()
            if k > covered and text and not _NO_DECLARATION.match(text):
                out.append((k + 1, CODE, text))
        shown = max(shown, line)

    for m in _SCAN[family].finditer(content):
        i = m.start()
        if starts[at + 1] <= i:
            at = bisect.bisect_right(starts, i, at) - 1
        if m.lastindex == 3:
            code_until(at)
            out.append((at + 1, OPEN if m[0] == "{" else CLOSE, None))
            continue
        n = m[0].count("\n")
        if m.lastindex == 2:
            if n:
                code_until(at)
                covered = max(covered, at + n)
            continue
        own = not content[starts[at] : i].strip()
        code_until(at - 1 if own else at)
        if own:
            out.append((at + n + 1, LINE_COMMENT if content[i + 1] == "/" else COMMENT, m[0]))
            covered = max(covered, at + n)
            rest = lines[at + n][m.end() - starts[at + n] :].strip()
            code_until(at + n)
            if rest and not _NO_DECLARATION.match(rest):
                out.append((at + n + 1, CODE, rest))
        elif n:
            covered = max(covered, at + n)
    code_until(len(lines) - 1)
    return out


def _python_rows(content: str) -> list[tuple]:
    out: list[tuple] = []
    indents = [0]
    line, first_line, last_code, depth, start = 1, 1, 0, 0, 0
    header = 0  # the line of a header of def or class whose body has not begun

    def logical(a: int, b: int, number: int, last: int) -> None:
        """Handles one logical line content[a:b], which begins at line `number` and ends at `last`."""
        nonlocal header, last_code
        text = content[a:b]
        bare = text.lstrip(" \t\f")
        if not bare.strip() or bare[0] == "#":
            return
        width = len(text[: len(text) - len(bare)].expandtabs(8))
        if width > indents[-1]:
            indents.append(width)
            out.append((number, OPEN, None))
        while width < indents[-1] and len(indents) > 1:
            indents.pop()
            out.append((last_code, CLOSE, None))
        if header:
            m = _BODY.match(bare)
            out.append((header, BODY, m[0].rstrip() if m else None))
            header = 0
        last_code = last
        if bare[0] != "@" and not _HEADER.match(bare):
            return
        out.append((number, CODE, bare.split("\n", 1)[0].rstrip()))
        if bare[0] == "@":
            return
        if bare.rstrip().endswith(":") and "#" not in bare:
            header = number
            return
        toks, _, _ = lex(bare.rstrip() + "\n", "python")
        level = 0
        for k, (cls, _, _) in enumerate(toks):
            level += (cls in ("(", "[", "{")) - (cls in (")", "]", "}"))
            if cls == ":" and level == 0:
                if k + 1 == len(toks) or toks[k + 1][0] in ("NL", "INDENT", "DEDENT"):
                    header = number
                else:
                    m = _BODY.match(bare, toks[k + 1][1])
                    out.append((number, BODY, m[0].rstrip() if m else None))
                return

    for m in _SCAN["python"].finditer(content):
        kind = m.lastindex
        if kind == 2:
            line += m[0].count("\n")
        elif kind == 3:
            depth += 1
        elif kind == 4:
            depth = max(0, depth - 1)
        elif kind == 5:
            line += 1
        elif kind == 6:
            if depth == 0:
                logical(start, m.start(), first_line, line)
                start, first_line = m.end(), line + 1
            line += 1
    if start < len(content):
        logical(start, len(content), first_line, line)
    for _ in indents[1:]:
        out.append((last_code, CLOSE, None))
    return out


def token_rows(rows: DataFrame) -> DataFrame:
    """The rows of all files. fid numbers a scan of a file, file is the key of its repo and path."""

    def run(pdfs):
        for p in pdfs:
            events = [file_tokens(a, b or "") for a, b in zip(p["path"], p["content"])]
            counts = np.array([len(e) for e in events])
            flat = list(itertools.chain.from_iterable(events))
            if not flat:
                continue
            line, kind, text = zip(*flat)
            seq = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = {c: np.repeat(p[c].to_numpy(), counts) for c in ("file", "at", "fid")}
            yield pd.DataFrame(keys | {"seq": seq.astype(np.int32), "line": np.array(line, np.int32), "kind": np.array(kind, np.int8), "text": pd.Series(text, dtype=object)})

    numbered = rows.select(_file_key("repo", "path").alias("file"), "path", F.coalesce(F.unix_micros("scanned_at"), F.lit(-1)).alias("at"), "content", F.monotonically_increasing_id().alias("fid"))
    return numbered.mapInPandas(run, "file long, at long, fid long, seq int, line int, kind byte, text string")


def _file_key(repo: str, path: str):
    """64 bits for a file; a pair also needs the listed name on the listed line, so that a chance collision has no effect."""
    return F.xxhash64(repo, path)


def attached(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (file, line, node) with the declaration on their line or below its annotations, the comment above, the body's string and the
    block's end. Nodes join the rows of their file by a union, so that one shuffle serves all windows; only the latest scan's rows count."""
    marked = nodes.select("file", "line", F.lit(NODE).cast("byte").alias("kind"), "node")
    x = tokens.withColumn("node", F.lit(None).cast(nodes.schema["node"].dataType)).unionByName(marked, allowMissingColumns=True)
    newest = F.max(F.struct("at", "fid")).over(W.partitionBy("file"))
    x = x.withColumn("newest", newest).where("node is not null or (at = newest.at and fid = newest.fid)").drop("newest", "at", "fid")
    place = ["line", F.col("kind") != NODE, "seq"]
    back = [F.desc("line"), F.col("kind") == NODE, F.desc("seq")]
    is_line = F.col("kind") == LINE_COMMENT
    x = x.withColumn("island", F.when(is_line, F.col("line") - F.row_number().over(W.partitionBy("file", "kind").orderBy(*place))))
    run = W.partitionBy("file", "kind", "island").orderBy(*place).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("text", F.when(is_line, F.array_join(F.collect_list(F.when(is_line, F.col("text"))).over(run), "\n")).otherwise(F.col("text")))
    up = W.partitionBy("file").orderBy(*place).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("file").orderBy(*back).rowsBetween(W.unboundedPreceding, 0)
    is_code = (F.col("kind") == CODE) & ~(F.startswith("text", F.lit("@")) & F.col("text").rlike(r"^@\w+(\.\w+)*\s*(\([^()]*\))?\s*$"))
    here = F.struct("line", "text")
    x = (
        x.withColumn("depth", F.sum(F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)).over(up))
        .withColumn("above", F.last(F.when(F.col("kind").isin(COMMENT, LINE_COMMENT), here), True).over(up))
        .withColumn("decl", F.last(F.when(is_code, here), True).over(down))
        .withColumn("first", F.last(F.when(F.col("kind") == CODE, F.col("line")), True).over(down))
        .withColumn("body", F.last(F.when(F.col("kind") == BODY, here), True).over(down))
        .where(F.col("kind").isin(NODE, CLOSE))
    )
    level = W.partitionBy("file", "depth").orderBy(*back).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("line_end", F.last(F.when(F.col("kind") == CLOSE, F.col("line")), True).over(level))
    return x.where("node is not null and first = line").select("node.*", "line", "decl", "above", "body", "line_end")


# --- does a documentation say something ---------------------------------------------------------------------------------
# Texts that are no documentation, tool directives, and words that name a kind of thing.
_PLACEHOLDER = re.compile(
    r"(?:(?:todo|fixme|xxx|tbd|tba|wip|hack|n/?a|none|null|foo|bar|test|docs?|docstring|documentation|comment|description|summary|placeholder|helper|stub|dummy|temp|misc|internal|private|undocumented|no (?:docs?|documentation|docstring|description|comment)s?(?: yet| available| provided)?|not documented(?: yet)?|missing (?:docs?|documentation|description)|"
    r"(?:write|add|needs?|missing|insert|put|fill in|update) (?:the |a |some )?(?:docs?|documentation|docstrings?|comments?|descriptions?)(?: here| later| please)?|document(?: this| me| it)?(?: later)?|describe(?: this| me| it)?(?: later| here)?|(?:docs?|documentation|description) (?:here|goes here|to follow|follows|missing|pending|to come)|to be (?:documented|done|written|defined|described)|coming soon|work in progress|implement(?: me| this| later)?|"
    r"auto[- ]?generated(?: (?:method|function|class|constructor|catch block))?(?: stub| comment| javadoc)?|generated (?:method|function|class) stub|(?:your |some )?(?:text|code|comment) (?:goes )?here|lorem ipsum|default (?:comment|description)|\.\.\.)(?:[\s.:!,;-]+|$))+",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^(?:noqa\b.*|type:\s*ignore.*|pylint:.*|mypy:.*|flake8:.*|fmt:\s*(?:on|off|skip).*|isort:.*|pragma:?.*|nosec\b.*|coverage:.*|pyright:.*|ruff:.*|yapf:.*|eslint(?:-\w+)*\b.*|tslint:.*|jshint\b.*|jslint\b.*|prettier-ignore.*|biome-ignore.*|@ts-(?:ignore|nocheck|check|expect-error).*|istanbul ignore.*|c8 ignore.*|v8 ignore.*|webpack\w*:.*|stylelint.*|nolint\w*\b.*|nosonar\b.*|clang-(?:format|tidy)\b.*|cppcheck.*|iwyu pragma.*|lint:.*|checkstyle:.*|spotless:.*|noinspection\b.*|@formatter:.*|cspell:.*|spell-?checker:.*|codespell.*|sonar.*off|#?(?:end)?region\b.*|@suppress\w*.*|lgtm\b.*|keep-sorted.*|vim:.*|-\*-.*-\*-|coding[:=].*)$",
    re.I,
)
_POINTER_START = re.compile(r"^\(?(?:please )?(?:see also|see|refer to|cf\.?|compare|same as|as|like|ditto|idem|copied from|inherited from|inherits?|docs?|documentation|documented|described|defined|explained|above|below)\b", re.I)
_POINTER_WORDS = frozenset("in at on from to the a an above below before base super parent class method function interface implementation overridden declaration definition header handbook readme wiki doc docs documentation spec specification ticket issue pull request page file module elsewhere there here superclass also for detail details more information of this previous next one other caller callee see inherited and".split())
_TAG_ONLY = re.compile(r"^(?:[@\\](?:param|arg|argument|tparam|property|prop|typedef|template|throws?|exception|raises?|type|var|see|link|memberof|name|alias|extends|augments|implements|returns?|retval)\b(?:\s*\[(?:in|out|in,\s*out)\])?(?:\s*\{[^}]*\})?(?:\s+[\w.$\[\]=<>*]+)?|[@\\]\w+(?:\s*\{[^}]*\})?)\W*$")
_TAG_NAMED = re.compile(r"^[@\\](?:param|arg|argument|tparam|property|prop|throws?|exception|raises?)\b(?:\s*\[(?:in|out|in,\s*out)\])?(?:\s*\{[^}]*\})?\s+[\w.$\[\]=<>*]+\s*[-:]?\s*")
_TAG = re.compile(r"^[@\\]\w+(?:\s*\{[^}]*\})?\s*")
_FIELD = re.compile(r"^:(?:param|parameter|arg|type|raises?|raise|return|returns|rtype|var|ivar|cvar|meta|keyword|key)\b[^:]*:\s*")
_SECTION = re.compile(r"^(?:args?|arguments|params?|parameters|returns?|yields?|raises|throws|attributes|examples?|notes?|keyword args|keyword arguments|other parameters|see also|warnings?|references|todo)\s*:?\s*$", re.I)
_CODE = re.compile(
    r"^(?:[\w.$\[\]'\"]+\s*(?:=|\+=|-=|\*=|:=|\|=)\s*[^=\s].*[;)\]\w'\"]|(?:return|throw|raise|import|include|using|package|print|echo|delete|assert|yield|await|break|continue|goto)\b[^.]*;|return\s+[\w.]+\(.*\);?|(?:if|for|while|switch|else|elif|try|catch|except|with)\b.*[{(:]|(?:if|for|while|switch)\s*\(.*\)\s*\S*;?|(?:var|let|const|auto|int|float|double|bool|boolean|char|string|String|void|def|class|function|public|private|protected|static|final)\s+[\w<>\[\]*&:,\s]+(?:=.*|\(.*\)\s*)?[;{:]|[\w.$>:-]+\(.*\)\s*[;{]|[{}()\[\];,]+|#(?:include|define|if|endif|pragma).*|</?\w+[^>]*>|@\w+\(.*\))$"
)
_KIND_WORDS = frozenset("the a an this that these those of for to and or is are was be it its in on with function functions method methods class classes struct interface enum type constructor destructor getter setter procedure routine object module member field main simple def".split())


def doc_text(raw: str) -> str:
    """Documentation without its comment markers or quotes."""
    s = raw.strip()
    if s[:1] in "'\"" or re.match(r"^[rRuU]['\"]", s):
        out = []
        for m in re.finditer(r"[rRuU]?(\"\"\"|'''|\"|')([\s\S]*?)(?<!\\)\1", s):
            out.append(m[2])
        return "".join(out) if out else s.strip("'\"rRuU")
    lines = []
    for line in s.split("\n"):
        t = line.strip()
        if s.startswith("/*"):
            t = re.sub(r"^/\*+[!<]?", "", t) if t.startswith("/*") else re.sub(r"^\*+(?!/)", "", t)
            t = re.sub(r"\**\*/$", "", t)
        else:
            t = re.sub(r"^(?://+[!<]?|#+)", "", t)
        lines.append(t.rstrip())
    return "\n".join(lines)


def points_elsewhere(sentence: str) -> bool:
    """Whether a sentence only sends the reader to another place: words of pointing, and names of what is pointed at."""
    m = _POINTER_START.match(sentence)
    if not m:
        return False
    for w in sentence[m.end() :].split():
        bare = w.strip(".,;:!?()`'\"")
        named = re.search(r"[\w][._/#:()]\w|[a-z][A-Z]|^[A-Z]\w|\d|_|\(\)", w)
        if bare and bare.lower() not in _POINTER_WORDS and not named:
            return False
    return True


def _forms(word: str) -> set[str]:
    """A word and what it may be an inflection of."""
    out = {word}
    for suffix in ("ings", "ing", "ers", "er", "ors", "or", "es", "ed", "s", "d"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 2:
            stem = word[: -len(suffix)]
            out |= {stem, stem + "e"}
            if stem[-1] == "i":
                out.add(stem[:-1] + "y")
            if len(stem) > 3 and stem[-1] == stem[-2]:
                out.add(stem[:-1])
    return out


def _words(text: str) -> list[str]:
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return re.findall(r"[^\W_]+", text.lower())


def says_something(raw: str | None, name: str) -> bool:
    """Whether a documentation describes its thing.

    It does not if, after markers and bare tags are taken away, nothing is left but rules, a placeholder, words of the name or of
    kinds, pointers to other places, tool directives or lines of code.
    """
    told = telling_words(raw) if raw else ()
    if not told:
        return False
    own = {f for w in _words(name) for f in _forms(w)} | {"".join(_words(name))}
    return any(w not in own and not (_forms(w) & own) and any(c.isalpha() for c in w) for w in told)


@lru_cache(1 << 15)
def telling_words(raw: str) -> tuple[str, ...]:
    """The words of a documentation that may describe, whatever the name; none if it is a placeholder, a pointer and the like."""
    kept = []
    section = False
    for line in doc_text(raw).split("\n"):
        t = re.sub(r"</?\w+[^<>]*>", " ", line).strip()
        t = re.sub(r"\{@?(?:inheritDoc|inheritdoc)\}|^[@\\](?:inheritDoc|inheritdoc|override|overload|public|private|protected|internal|static|async|abstract|deprecated|readonly|final|hidden|ignore|nodoc|test|beta|alpha|experimental|constructor|class|function|method|since|version|author|copydoc)\b", "", t).strip(" \t*") if not t.startswith(("@param", "@return")) else t
        if not any(c.isalnum() for c in t):
            continue
        if _SECTION.match(t):
            section = True
            continue
        if _DIRECTIVE.match(t) or _TAG_ONLY.match(t):
            continue
        if section and re.match(r"^[\w*.]+(?:\s*\([^()]*\))?\s*:\s*$", t):
            continue
        t = _FIELD.sub("", t)
        t = _TAG_NAMED.sub("", t)
        t = _TAG.sub("", t) if t[:1] in "@\\" else t
        t = re.sub(r"\{@(?:link|linkplain|code|literal|see|value)\s+([^{}]*)\}", r"\1", t)
        t = re.sub(r"^(?:@?brief|@?summary)\b[:\s]*", "", t)
        if any(c.isalnum() for c in t):
            kept.append(t)
    if not kept:
        return ()
    if all(_CODE.match(t) for t in kept):
        return ()
    text = re.sub(r"\s+", " ", " ".join(kept)).strip()
    if _PLACEHOLDER.fullmatch(text.strip(" .:!-")) or _DIRECTIVE.match(text):
        return ()
    sentences = [s for s in re.split(r"(?<=[.!?;])\s+", text) if any(c.isalnum() for c in s)]
    rest = [s for s in sentences if not points_elsewhere(s) and not _PLACEHOLDER.fullmatch(s.strip(" .:!-"))]
    return tuple(w for w in dict.fromkeys(_words(" ".join(rest))) if w not in _KIND_WORDS)


def declares(text: str | None, name: str | None, kind: str, language: str) -> bool:
    """Whether a line of code, without the annotations before it, declares a function or class of this name."""
    if not text or not name:
        return False
    t = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "''", text)
    t = re.sub(r"^(?:@(?!interface\b)[\w.]+\s*(?:\((?:[^()]|\([^()]*\))*\))?\s*)+", "", t)
    n = re.escape(name)
    if language == "python":
        return re.match(rf"(?:async\s+)?def\s+{n}\s*[\[(]" if kind == "function" else rf"class\s+{n}\s*[\[(:]", t) is not None
    if kind == "class":
        return re.search(rf"\b(?:class|struct|interface|enum|record|union|namespace|object|type|trait)\b[^;{{}}()=]*(?<![\w$]){n}(?![\w$])|(?<![\w$]){n}\s*=\s*class\b", t) is not None
    m = re.search(rf"(?<![\w$]){n}(?![\w$])", t)
    if not m:
        return False
    before, after = t[: m.start()], t[m.end() :]
    if re.search(r"\b(?:return|new|throw|case|else|await|delete|typeof)\s*$", before) or re.search(r"[=(,.!+\-/%|?]\s*$", before) or before.rstrip().endswith("->"):
        return False
    if language in ("javascript", "typescript"):
        if re.match(r"\s*(?:[?!]?\s*:[^=]*)?=\s*(?:async\b)?\s*(?:function\b|\(|[\w$]+\s*=>|<)", after):
            return True
        if not re.match(r"\s*[?!]?\s*(?:<[^()]*>)?\s*\(", after):
            return False
        if re.search(r"\bfunction\b\s*\*?\s*$", before):
            return True
        return not (after.rstrip().endswith(";") and language == "javascript") and re.fullmatch(r"(?:[\w#*]+\s+)*[*#]?\s*", before) is not None and not re.search(r"\)\s*;\s*$", after)
    if not re.match(r"\s*\(", after):
        return False
    typed = re.search(r"[\w>\]&*~:]\s*$", before) is not None
    return typed or not after.rstrip().endswith(";")


def pairs(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo, qualified_name, kind, path, line_start, line_end, doc) of nodes (repo, qualified_name, kind, name, file_path,
    line_start) whose declaration and telling documentation stand in the files of `rows`."""
    wanted = nodes.where("repo is not null and qualified_name is not null and name is not null and file_path is not null and line_start is not null").select("repo", "qualified_name", "kind", "name", F.col("file_path").alias("path"), F.col("line_start").alias("line")).distinct()
    placed = wanted.select(_file_key("repo", "path").alias("file"), "line", F.struct("repo", "qualified_name", "kind", "name", "path").alias("node"))
    found = attached(token_rows(rows), placed)

    def run(pdfs):
        for p in pdfs:
            keep, docs = [], []
            for path, line, decl, above, body, name, kind in zip(p["path"], p["line"], p["decl_text"], p["above_text"], p["body_text"], p["name"], p["kind"]):
                language = language_of(path)
                doc = body if language == "python" else above
                keep.append(declares(decl, name, kind, language) and says_something(doc, name))
                docs.append(doc)
            yield p.assign(doc=docs)[["repo", "qualified_name", "kind", "path", "line", "line_end", "doc"]][keep]

    is_py = F.lower("path").rlike(r"\.pyi?$")
    flat = found.where(~is_py | (F.col("decl.line") == F.col("line"))).select(
        "repo", "qualified_name", "kind", "path", "line", "line_end", "name", F.col("decl.text").alias("decl_text"),
        F.when(F.col("above.line") == F.col("line") - 1, F.col("above.text")).alias("above_text"), F.col("body.text").alias("body_text"),
    )
    flat = flat.where(F.when(is_py, F.col("body_text").isNotNull()).otherwise(F.col("above_text").isNotNull()))
    told = flat.mapInPandas(run, "repo string, qualified_name string, kind string, path string, line int, line_end int, doc string")
    return told.withColumnRenamed("line", "line_start").dropDuplicates(["repo", "qualified_name", "kind", "path", "line_start"])


def listed_nodes(spark: SparkSession, d: str) -> DataFrame:
    cols = ["repo", "qualified_name", "name", "file_path", "line_start"]
    f = table(spark, d, "function_node").select(*cols, F.lit("function").alias("kind"))
    return f.unionByName(table(spark, d, "class_node").select(*cols, F.lit("class").alias("kind")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(listed_nodes(spark, d), file_rows(spark, d)).select("repo", "qualified_name", "kind").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs themselves: the code from its declaration to its block's end, and the documentation without markers."""
    rows = file_rows(spark, d)
    p = pairs(listed_nodes(spark, d), rows)
    last = rows.groupBy("repo", "path").agg(F.max_by("content", "scanned_at").alias("content"))
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")
    code = F.array_join(F.slice(lines, F.col("line_start"), F.greatest(F.coalesce("line_end", "line_start") - F.col("line_start") + 1, F.lit(1))), "\n")
    return p.join(last, ["repo", "path"]).select("repo", "qualified_name", "kind", "path", "line_start", code.alias("code"), clean("doc").alias("description"))


@F.pandas_udf(T.StringType())
def clean(doc: pd.Series) -> pd.Series:
    return doc.map(lambda s: re.sub(r"[ \t]+", " ", doc_text(s)).strip())


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
SQL: dict[str, str] = {}
