"""Lexers for Python, JavaScript, TypeScript, Java and C++: token classes with offsets, and comments with their places."""

from __future__ import annotations

import re
from typing import NamedTuple

# The language that a path's extension stands for.
LANGUAGE_OF = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}

# Words that are token classes of their own, per language.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static super switch this throw true false try typeof var void while with yield as",
    "typescript": "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static super switch this throw true false try typeof var void while with yield as type interface enum implements public private protected readonly abstract declare namespace module keyof infer is satisfies unique override asserts",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true false try void volatile while record yield var sealed permits when",
    "cpp": "alignas alignof auto bool break case catch char class concept const constexpr consteval constinit const_cast continue co_await co_return co_yield decltype default delete do double dynamic_cast else enum explicit extern false final float for friend goto if inline int long mutable namespace new noexcept nullptr operator override private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while",
}
_KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_NUM = r"(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|(?:[0-9](?:[0-9_']*[0-9])?\.?(?:[0-9](?:[0-9_]*[0-9])?)?|\.[0-9](?:[0-9_]*[0-9])?)(?:[eE][+-]?[0-9]+)?)[A-Za-z_]*"
_ID = r"[^\W\d]\w*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/"
_STR = r'"(?:\\[\s\S]|[^"\\\n])*"'
_CHR = r"'(?:\\[\s\S]|[^'\\\n])*'"
_OPS_JS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]"
_OPS_C = r"<<=|>>=|<=>|\.\.\.|->\*|->|::|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|&&|\|\||<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_OPS_PY = r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\];,<>+\-*/%&|^~:=.@]"
_PY_STR = r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')"

_MASTER = {
    "javascript": re.compile(rf"(?P<ws>[ \t\r\f\v ﻿]+)|(?P<nl>\n)|(?P<com>{_LINE}|{_BLOCK})|(?P<str>{_STR}|{_CHR})|(?P<num>{_NUM}n?)|(?P<id>[$#]?(?:[^\W\d]|\$)[\w$]*)|(?P<op>{_OPS_JS})|(?P<tpl>`)"),
    "java": re.compile(rf'(?P<ws>[ \t\r\f\v﻿]+)|(?P<nl>\n)|(?P<com>{_LINE}|{_BLOCK})|(?P<str>"""[ \t\r]*\n(?:\\[\s\S]|[^\\])*?"""|{_STR}|{_CHR})|(?P<num>{_NUM})|(?P<id>(?:[^\W\d]|\$)[\w$]*)|(?P<op>{_OPS_C})'),
    "cpp": re.compile(rf'(?P<ws>(?:[ \t\r\f\v﻿]|\\\r?\n)+)|(?P<nl>\n)|(?P<com>//(?:\\\r?\n|[^\n])*|{_BLOCK})|(?P<pp>#(?:\\\r?\n|/\*[\s\S]*?\*/|(?!//)[^\n])*)|(?P<str>(?:u8|[uUL])?R"(?P<rd>[^()\\ ]{{0,16}})\([\s\S]*?\)(?P=rd)"|(?:u8|[uUL])?{_STR}|[uUL]?{_CHR})|(?P<num>{_NUM})|(?P<id>(?:[^\W\d]|\$)[\w$]*)|(?P<op>{_OPS_C})'),
    "python": re.compile(rf"(?P<ws>(?:[ \t\f﻿]|\\\r?\n)+)|(?P<nl>\r?\n)|(?P<com>#[^\n]*)|(?P<str>{_PY_STR})|(?P<num>{_NUM})|(?P<id>{_ID})|(?P<op>{_OPS_PY})"),
}
_MASTER["typescript"] = _MASTER["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
# After these an expression has ended, so that / divides and < compares.
_ENDS = frozenset({"ID", "NUM", "STR", "TPL", "REGEX", "JSX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"})
_PY_NUM = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?[0-9])*|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9]+)?[jJ]?|[0-9](?:_?[0-9])*\.(?:[eE][+-]?[0-9]+)?[jJ]?|[0-9](?:_?[0-9])*[eE][+-]?[0-9]+[jJ]?|[0-9](?:_?[0-9])*[jJ])")


class Comment(NamedTuple):
    start: int
    end: int
    text: str


class Lexed(NamedTuple):
    """tokens: (class, offset, new line before it); ends: offsets after them; comments, in order of their offsets."""

    tokens: list[tuple[str, int, bool]]
    ends: list[int]
    comments: list[Comment]


def language_of(path: str | None) -> str | None:
    return LANGUAGE_OF.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def _template_end(s: str, i: int) -> int:
    """Offset after the template literal that begins at i, -1 if it does not end; nested literals are followed."""
    i += 1
    stack = ["`"]
    n = len(s)
    while i < n:
        c = s[i]
        if stack[-1] == "`":
            if c == "\\":
                i += 2
                continue
            if c == "`":
                stack.pop()
                if not stack:
                    return i + 1
            elif c == "$" and s.startswith("${", i):
                stack.append("{")
                i += 2
                continue
        else:
            if c in "\"'":
                m = re.compile(_STR if c == '"' else _CHR).match(s, i)
                if m:
                    i = m.end()
                    continue
            if c == "`":
                stack.append("`")
            elif c == "{":
                stack.append("{")
            elif c == "}":
                stack.pop()
        i += 1
    return -1


_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)?((?:\s+[A-Za-z_][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}))?|\s*\{\s*\.\.\.[^{}]*\})*)\s*(/?)>")


def _element_end(s: str, i: int) -> int:
    """Offset after the markup element that begins at i, -1 if its tags do not match."""
    names = []
    while True:
        m = _TAG.match(s, i)
        if not m:
            return -1
        i = m.end()
        if m[1]:
            if not names or names.pop() != (m[2] or ""):
                return -1
        elif not m[4]:
            names.append(m[2] or "")
        if not names:
            return i
        depth = 0
        while i < len(s) and (depth or s[i] != "<"):
            depth += (s[i] == "{") - (s[i] == "}")
            if depth < 0:
                return -1
            i += 1


def lex(text: str, language: str, markup: bool = False) -> Lexed:
    """Tokens of a text. What no token begins with becomes one of class ERR. markup: whether elements may be expressions."""
    if language == "python":
        return _lex_python(text)
    script = language in ("javascript", "typescript")
    match, words = _MASTER[language].match, _KEYWORDS[language]
    toks: list[tuple[str, int, bool]] = []
    ends: list[int] = []
    comments: list[Comment] = []
    i, n, nl = 0, len(text), True
    if script and text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        m = match(text, i)
        kind = m.lastgroup if m else None
        j = m.end() if m else i + 1
        if kind == "ws":
            i = j
            continue
        if kind == "nl":
            nl, i = True, j
            continue
        if kind == "com":
            comments.append(Comment(i, j, text[i:j]))
            nl, i = nl or "\n" in text[i:j], j
            continue
        if kind == "pp":
            if nl:
                i = j
                continue
            cls, j = "ERR", i + 1
        elif kind == "id":
            w = text[i:j]
            cls = w if w in words and not (toks and toks[-1][0] in (".", "?.") and script) else "ID"
        elif kind == "num":
            cls = "NUM"
        elif kind == "str":
            cls = "STR"
        elif kind == "tpl":
            j = _template_end(text, i)
            cls = "TPL"
            if j < 0:
                cls, j = "ERR", n
        elif kind == "op":
            cls = text[i:j]
            if script and cls in ("/", "/=") and not (toks and toks[-1][0] in _ENDS):
                r = _REGEX.match(text, i)
                cls, j = ("REGEX", r.end()) if r else (cls, j)
            elif script and markup and cls == "<" and not (toks and toks[-1][0] in _ENDS):
                e = _element_end(text, i)
                cls, j = ("JSX", e) if e > 0 else (cls, j)
        else:
            cls = "ERR"
        toks.append((cls, i, nl))
        ends.append(j)
        nl, i = False, j
    return Lexed(toks, ends, comments)


def _lex_python(text: str) -> Lexed:
    match, words = _MASTER["python"].match, _KEYWORDS["python"]
    toks: list[tuple[str, int, bool]] = []
    ends: list[int] = []
    comments: list[Comment] = []
    indents = [(0, 0)]
    depth: list[str] = []
    close = {")": "(", "]": "[", "}": "{"}
    i, n, begin = 0, len(text), True

    def add(cls: str, a: int, b: int, nl: bool = False) -> None:
        toks.append((cls, a, nl))
        ends.append(b)

    if text.startswith("﻿"):
        i = 1
    while i < n:
        if begin and not depth:
            j, col, alt = i, 0, 0
            while j < n and text[j] in " \t\f":
                col, alt = (0, 0) if text[j] == "\f" else (col + 1, alt + 1) if text[j] == " " else ((col // 8 + 1) * 8, alt + 1)
                j += 1
            if j < n and (text[j] in "\n#" or text.startswith("\r\n", j)):
                i, begin = j, False
                if text[j] == "#":
                    k = text.find("\n", j)
                    k = n if k < 0 else k
                    comments.append(Comment(j, k, text[j:k]))
                    i = k
                i = min(n, i + (2 if text.startswith("\r\n", i) else 1))
                begin = True
                continue
            if j >= n:
                break
            i, begin = j, False
            if (col > indents[-1][0]) != (alt > indents[-1][1]) or (col == indents[-1][0]) != (alt == indents[-1][1]):
                add("ERR", j, j)
            elif col > indents[-1][0]:
                indents.append((col, alt))
                add("INDENT", j, j)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    add("DEDENT", j, j)
                if (col, alt) != indents[-1]:
                    add("ERR", j, j)
            continue
        m = match(text, i)
        kind = m.lastgroup if m else None
        j = m.end() if m else i + 1
        if kind == "ws":
            pass
        elif kind == "com":
            comments.append(Comment(i, j, text[i:j]))
        elif kind == "nl":
            if not depth:
                add("NL", i, j)
                begin = True
        elif kind == "id":
            w = text[i:j]
            add(w if w in words else "ID", i, j)
        elif kind == "num":
            add("NUM" if _PY_NUM.fullmatch(text, i, j) else "ERR", i, j)
        elif kind == "str":
            add("STR", i, j)
        elif kind == "op":
            c = text[i:j]
            if c in "([{":
                depth.append(c)
            elif c in close:
                if not depth or depth.pop() != close[c]:
                    add("ERR", i, j)
                    return Lexed(toks, ends, comments)
            add(c, i, j)
        else:
            add("ERR", i, j)
        i = j
    if toks and toks[-1][0] not in ("NL", "DEDENT") and not depth:
        add("NL", n, n)
    if not depth:
        for _ in indents[1:]:
            add("DEDENT", n, n)
    return Lexed(toks, ends, comments)
