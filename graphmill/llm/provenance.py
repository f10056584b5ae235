"""p6: files that are not hand-written for their repo: generated, minified or bundled, third-party, or data saved as code.

Notices are looked for in the file's header only, with one Aho-Corasick automaton over all phrases: in the comments
before the first code token, a package statement and other declarations of one line at the top not counted as code. Path rules know
vendored and generated folders, lock files and suffixes of tools. Shape rules find minified text (very many tokens on a
line) and data (most of the code is literals that are no documentation). Comments and strings further down that
merely mention generated code do not count. Null contents count as empty; an empty file is judged by its path.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.files import file_rows, map_files
from graphmill.functions.lexing import Lexed, language_of, lex

# Phrases of notices, in lower case with single blanks.
GENERATED = [
    "@generated", "<auto-generated", "autogenerated file", "auto-generated file", "autogenerated by", "auto-generated by", "autogenerated from", "auto-generated from", "automatically generated", "generated automatically", "machine generated", "machine-generated",
    "code generated by", "file generated by", "generated by the", "was generated by", "is generated by", "generated from", "generated code", "this is a generated file", "this file is generated", "this file was generated", "do not edit", "do not modify", "don't edit", "do not change this file",
    "emitted by", "produced by the compiler", "to regenerate", "regenerate with", "run to refresh", "changes will be lost", "will be overwritten",
    "erzeugt von", "automatisch erzeugt", "automatisch generiert", "generiert von", "nicht von hand", "nicht bearbeiten", "généré par", "généré automatiquement", "ne pas modifier", "generado por", "generado automáticamente", "no modificar", "no editar", "自动生成", "请勿编辑", "请勿修改",
]
THIRD_PARTY = [
    "@license", "released under", "licensed under", "permission is hereby granted", "redistribution and use in source", "full notice in", "full license in", "see licence.", "see license.", "taken from the", "copied from the", "adapted from the", "vendored from", "upstream:", "local changes are marked", "this source code form is subject to",
]
BUNDLED = ["sourcemappingurl=", "webpackbootstrap", "__webpack_require__", "@preserve"]
# Folders and file names.
VENDOR_DIRS = {"vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "external", "externals", "deps", "node_modules", "site-packages", "bower_components", "jspm_packages", "pods"}
OWN_DIRS = {"node_modules", "site-packages", "bower_components", "jspm_packages"}
GENERATED_DIRS = {"generated", "__generated__", "autogen", "gen", "gen-src", "generated-src", "generated-sources", "auto-generated"}
_NAMES = re.compile(
    r"(?:\.min\.(?:js|mjs|cjs)|[.-]bundle\.js|\.chunk\.js|-[0-9a-f]{8,}\.js|\.[0-9a-f]{8,}\.js|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:cc|h|go|cpp)|\.g\.(?:ts|dart|cs|js)|\.generated\.\w+|\.gen\.\w+|_generated\.\w+|\.tab\.(?:c|cc|cpp|h|hpp)|_lexer\.(?:cc|c|cpp|h)|\.yy\.(?:c|cc|cpp)|_stub\.py|\.lock|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml)$",
    re.I,
)
_FENCE = re.compile(r"^[ \t]*```", re.M)
SCHEMA = "kind string"
MINIFIED_TOKENS_PER_LINE, MINIFIED_TOKENS, MINIFIED_BLANK_SHARE = 25, 200, 0.15
DATA_SHARE, DATA_CHARS, DATA_LITERALS = 0.55, 600, 40


@lru_cache(None)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("generated", GENERATED), ("third_party", THIRD_PARTY), ("bundled", BUNDLED)):
        for p in phrases:
            a.add_word(p, kind)
    a.make_automaton()
    return a


def notice(text: str) -> str | None:
    """The kind of the first notice in a header text."""
    for _, kind in _automaton().iter(re.sub(r"[\s*/#;]+", " ", text.lower())):
        return kind
    return None


def path_kind(path: str) -> str | None:
    """A vendored folder counts where a folder of the vendored project follows, so that a folder of the repo's own
    that happens to be named like one is no case; package managers' folders always count."""
    parts = path.lower().split("/")
    for i, part in enumerate(parts[:-1]):
        if part in OWN_DIRS or part in VENDOR_DIRS and i < len(parts) - 2:
            return "third_party"
        if part in GENERATED_DIRS:
            return "generated"
    return "generated" if _NAMES.search(parts[-1]) else None


def header(lexed: Lexed, content: str) -> str:
    """The comments before the first code, and those right after a package statement at the top."""
    first = len(content)
    toks = lexed.tokens
    i = 0
    while i < len(toks):
        if toks[i][0] == "package":
            while i < len(toks) and toks[i][0] != ";":
                i += 1
            i += 1
            continue
        first = toks[i][1]
        break
    return "\n".join(c.text for c in lexed.comments if c.start < first)


def shape(lexed: Lexed, content: str) -> str | None:
    """minified, data or None, from the token stream."""
    toks, ends = lexed.tokens, lexed.ends
    if not toks:
        return None
    code = literal = n_literals = longest = 0
    fenced = _FENCE.search(content) is not None  # the marks of a fenced block in prose are no quotes around data
    for i, (cls, at, _) in enumerate(toks):
        n = ends[i] - at
        code += n
        if cls in ("STR", "NUM", "TPL"):
            alone = (i == 0 or toks[i - 1][0] in ("NL", "INDENT", "DEDENT", ":")) and (i + 1 == len(toks) or toks[i + 1][0] == "NL")
            if not alone and not (fenced and cls in ("TPL", "STR") and "\n" in content[at : ends[i]]):
                literal += n
                n_literals += 1
                longest = max(longest, n)
    lines = [x for x in content.split("\n") if x.strip()]
    if literal >= DATA_SHARE * code and literal >= DATA_CHARS and (n_literals >= DATA_LITERALS or longest >= DATA_CHARS):
        return "data"
    blank = 1 - code / max(1, len(content) - sum(c.end - c.start for c in lexed.comments))
    if len(toks) >= MINIFIED_TOKENS and len(toks) / len(lines) >= MINIFIED_TOKENS_PER_LINE and blank <= MINIFIED_BLANK_SHARE:
        return "minified"
    return None


def judge(path: str, content: str) -> dict:
    kind = path_kind(path)
    if kind is None:
        lexed = lex(content, language_of(path) or "javascript")
        kind = notice(header(lexed, content)) or shape(lexed, content)
    return {"kind": kind or "own"}


def provenance(rows: DataFrame) -> DataFrame:
    """Every file with its kind: own, generated, third_party, bundled, minified or data."""
    return map_files(rows, judge, SCHEMA)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance(file_rows(spark, d)).where("kind <> 'own'").select("repo", "path")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files per repo and kind."""
    return provenance(file_rows(spark, d)).groupBy("repo", "kind").agg(F.count("*").alias("n_files"))


QUERIES = {"p6_found": p6_found, "p6_kinds": p6_kinds}
SQL: dict[str, str] = {}
