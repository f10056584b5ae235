"""Names of types as they are written in annotations."""

from __future__ import annotations

# Wrappers around the type that a function returns, with brackets and with angles.
WRAPPERS = ["AsyncGenerator", "AsyncIterable", "AsyncIterator", "Awaitable", "Collection", "Coroutine", "Generator", "Iterable", "Iterator", "List", "Optional", "Sequence", "list"]
SCRIPT_WRAPPERS = ["Array", "AsyncIterable", "Awaitable", "Iterable", "Observable", "Promise", "ReadonlyArray"]


def plain_type(raw: str | None) -> str:
    """A return annotation reduced to the type that matters: without quotes, without None, null or undefined beside one other type,
    wrappers taken off however deep; of several arguments in brackets the last counts, a wrapper with several in angles stays."""
    t = (raw or "").strip()
    while True:
        before = t
        if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
            t = t[1:-1].strip()
        rest = [x for x in map(str.strip, t.split(" | ")) if x not in ("None", "null", "undefined")]
        t = rest[0] if len(rest) == 1 else t
        for opened, closed, names in (("[", "]", WRAPPERS), ("<", ">", SCRIPT_WRAPPERS)):
            name, _, inner = t.partition(opened)
            if inner.endswith(closed) and name.strip() in names and (opened == "[" or "," not in inner):
                t = inner[:-1].rsplit(",", 1)[-1].strip()
        if t == before:
            return t
