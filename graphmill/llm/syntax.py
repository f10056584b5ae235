"""p5: source files that do not parse, by derivatives of the language's grammar over the file's tokens.

The language is the one that the path's extension stands for; other extensions are judged `unknown` and never flagged.
An empty file, or one with comments only, is valid. Null contents count as empty. Contents are read whole. Exact
rescans of a file give one row; where scans differ the latest holds.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.files import file_rows, map_files
from graphmill.llm.grammars import grammar
from graphmill.functions.lexing import language_of, lex

SCHEMA = "language string, verdict string, line int, token string"
_DEEP = 200_000


def judge(path: str, content: str) -> dict:
    """verdict: ok, token (the token at which no continuation exists, with its line), truncated, or unknown."""
    language = language_of(path)
    if language is None:
        return {"language": None, "verdict": "unknown", "line": None, "token": None}
    if sys.getrecursionlimit() < _DEEP:
        sys.setrecursionlimit(_DEEP)  # states nest as deep as the source does
    lexed = lex(content, language, markup=path.lower().endswith("x") and language in ("javascript", "typescript"))
    verdict, i = grammar(language).parse(lexed.tokens, ";" if language in ("javascript", "typescript") else None)
    if i < 0:
        return {"language": language, "verdict": verdict, "line": None, "token": None}
    at = lexed.tokens[i][1]
    return {"language": language, "verdict": verdict, "line": content.count("\n", 0, at) + 1, "token": content[at : lexed.ends[i]][:80]}


def judged_files(rows: DataFrame) -> DataFrame:
    """Every file with language, verdict and, where one fails, the line and text of the failing token."""
    return map_files(rows, judge, SCHEMA)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return judged_files(file_rows(spark, d)).where("verdict in ('token', 'truncated')").select("repo", "path")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, invalid files and their share per repo and language."""
    j = judged_files(file_rows(spark, d)).where("verdict <> 'unknown'")
    bad = F.sum(F.when(F.col("verdict") != "ok", 1).otherwise(0)).cast("long")
    return j.groupBy("repo", "language").agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), F.round(bad / F.count("*"), 6).alias("rate"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
