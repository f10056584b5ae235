"""Column builders for URL paths, file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: str | Column) -> Column:
    """A route's path: trimmed, unquoted, in lower case, single slashes, a leading one and none at the end; blank or null gives '/'."""
    p = F.col(path) if isinstance(path, str) else path
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), "^[\"']+|[\"']+$", ""))
    joined = F.regexp_replace(F.concat(F.lit("/"), F.lower(bare)), "/+", "/")
    return F.when(joined == "/", "/").otherwise(F.regexp_replace(joined, "/$", ""))


def camel_to_snake(name: str | Column) -> Column:
    """Lower case with an underscore before a capital whose predecessor is none."""
    n = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(n, "([^A-Z])([A-Z])", "$1_$2"))


def nextjs_path(path: str | Column) -> Column:
    """The route of a page or route file: folders, with [id] as {id} and [...rest] as {*rest}."""
    p = F.col(path) if isinstance(path, str) else path
    inner = F.regexp_replace(F.regexp_replace(p, "^(src/)?(app|pages)/", ""), "/?(route|page|index)?[.](ts|tsx|js|jsx)$", "")
    inner = F.regexp_replace(inner, r"\([^)/]*\)/?", "")
    return normalize_path(F.regexp_replace(F.regexp_replace(inner, r"\[\[?\.\.\.([^\]]+)\]\]?", "{*$1}"), r"\[([^\]]+)\]", "{$1}"))


def module_name(path: str | Column) -> Column:
    """Dotted module of a source path: the suffix and a final __init__ or index dropped."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\.[^./]+$", ""), "/(__init__|index)$", ""), "/", ".")
