"""Parsing with derivatives over token classes, memoised and hash-consed.

A parser state is a regular expression over token classes and grammar rules, namely all that may still follow. The derivative
by a token is the next state. States are hash-consed and derivatives memoised, so that code whose constructs and
nesting have been met before costs one dictionary lookup per token. The empty state marks the token at which no
continuation exists; at the end a state that does not accept the empty text marks truncation.

Rules are written as EBNF text: 'x' a token class, NAME a token class, name a rule, | ( ) * + ?. Rules must not be left
recursive.
"""

from __future__ import annotations

import re

EMPTY, EPS = 0, 1
_PART = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([|()*+?]))")


class Grammar:
    def __init__(self, text: str, start: str, memo_limit: int = 2_000_000):
        self.rules: dict[str, int] = {}
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.ids: dict[tuple, int] = {}
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.tokens: dict[str, int] = {}
        self.memo: dict[tuple[int, int], int] = {}
        self.memo_limit = memo_limit
        self.text, self.start_rule = text, start
        self._build()

    def _build(self) -> None:
        self.bodies = {}
        for m in re.finditer(r"^(\w+)\s*=\s*((?:.|\n(?!\w+\s*=))*)", self.text, re.M):
            self.bodies[m[1]] = m[2]
        for name, body in self.bodies.items():
            parts = [p for p in _PART.findall(body) if any(p)]
            node, rest = self._alternatives(parts, 0)
            assert rest == len(parts), (name, parts[rest:])
            self.rules[name] = node
        self.start = self._ref(self.start_rule)
        for name in self.rules:
            self._check(name, self.rules[name], set())

    def _check(self, name: str, n: int, seen: set[int]) -> None:
        """Raises on a rule that can begin with itself."""
        if n in seen:
            return
        seen.add(n)
        node = self.nodes[n]
        if node[0] == "ref":
            if node[1] == name:
                raise ValueError(f"rule {name} is left recursive")
            self._check(name, self.rules[node[1]], seen)
        elif node[0] == "star":
            self._check(name, node[1], seen)
        elif node[0] == "alt":
            for x in node[1]:
                self._check(name, x, seen)
        elif node[0] == "cat":
            self._check(name, node[1], seen)
            if self.nullable(node[1]):
                self._check(name, node[2], seen)

    def _alternatives(self, parts, i):
        alts = []
        while True:
            seq = []
            while i < len(parts) and parts[i][2] not in ("|", ")"):
                lit, word, op = parts[i]
                if op == "(":
                    node, i = self._alternatives(parts, i + 1)
                elif lit:
                    node = self._tok(lit)
                elif word in self.bodies:
                    node = self._ref(word)
                else:
                    assert word.isupper(), f"no rule {word}"
                    node = self._tok(word)
                i += 1
                while i < len(parts) and parts[i][2] in ("*", "+", "?"):
                    star = self._make(("star", node))
                    node = star if parts[i][2] == "*" else self.cat(node, star) if parts[i][2] == "+" else self.alt((node, EPS))
                    i += 1
                seq.append(node)
            out = EPS
            for node in reversed(seq):
                out = self.cat(node, out)
            alts.append(out)
            if i < len(parts) and parts[i][2] == "|":
                i += 1
                continue
            return self.alt(tuple(alts)), i

    def _make(self, key: tuple) -> int:
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.nodes)
            self.nodes.append(key)
        return n

    def _tok(self, name: str) -> int:
        return self._make(("tok", self.tokens.setdefault(name, len(self.tokens))))

    def _ref(self, name: str) -> int:
        return self._make(("ref", name))

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        na = self.nodes[a]
        if na[0] == "cat":
            return self.cat(na[1], self.cat(na[2], b))
        return self._make(("cat", a, b))

    def alt(self, parts: tuple[int, ...]) -> int:
        flat: set[int] = set()
        for p in parts:
            n = self.nodes[p]
            if n[0] == "alt":
                flat.update(n[1])
            elif p != EMPTY:
                flat.add(p)
        if not flat:
            return EMPTY
        # members that continue alike are joined, so that ambiguity does not multiply states
        tails: dict[int, list[int]] = {}
        for p in flat:
            n = self.nodes[p]
            if n[0] == "cat":
                tails.setdefault(n[2], []).append(p)
        for tail, members in tails.items():
            if len(members) > 1:
                flat.difference_update(members)
                head = self.alt(tuple(self.nodes[m][1] for m in members))
                flat.add(self.cat(head, tail))
        if len(flat) == 1:
            return flat.pop()
        return self._make(("alt", tuple(sorted(flat))))

    def nullable(self, n: int) -> bool:
        known = self.null.get(n)
        if known is not None:
            return known
        node = self.nodes[n]
        kind = node[0]
        if kind == "tok":
            v = False
        elif kind == "star":
            v = True
        elif kind == "cat":
            v = self.nullable(node[1]) and self.nullable(node[2])
        elif kind == "alt":
            v = any(self.nullable(x) for x in node[1])
        else:
            v = self.nullable(self.rules[node[1]])
        self.null[n] = v
        return v

    def derive(self, n: int, t: int) -> int:
        key = (n, t)
        d = self.memo.get(key)
        if d is not None:
            return d
        node = self.nodes[n]
        kind = node[0]
        if kind == "tok":
            d = EPS if node[1] == t else EMPTY
        elif kind == "cat":
            d = self.cat(self.derive(node[1], t), node[2])
            if self.nullable(node[1]):
                d = self.alt((d, self.derive(node[2], t)))
        elif kind == "alt":
            d = self.alt(tuple(self.derive(x, t) for x in node[1]))
        elif kind == "star":
            d = self.cat(self.derive(node[1], t), n)
        elif kind == "ref":
            d = self.derive(self.rules[node[1]], t)
        else:
            d = EMPTY
        self.memo[key] = d
        return d

    def reset_if_large(self) -> None:
        """Forgets all states beyond the memo limit; called between files, so it never changes a result."""
        if len(self.memo) > self.memo_limit:
            self.__init__(self.text, self.start_rule, self.memo_limit)

    def parse(self, tokens: list[tuple[str, int, bool]], auto: str | None = None) -> tuple[str, int]:
        """tokens: (class, offset, whether a line begins before it). ("ok", -1), ("token", index) or ("truncated", -1).

        auto: a token class put in where the next token cannot follow and either stands on a new line, is '}' or is
        the end; this is how scripts end statements without a semicolon.
        """
        self.reset_if_large()
        s, memo, ids = self.start, self.memo, self.tokens
        put = ids.get(auto) if auto else None
        for i, (cls, _, newline) in enumerate(tokens):
            t = ids.get(cls)
            if t is None:
                return "token", i
            d = memo.get((s, t))
            if d is None:
                d = self.derive(s, t)
            if d == EMPTY and put is not None and (newline or cls == "}"):
                ended = self.derive(s, put)
                d = self.derive(ended, t) if ended != EMPTY else EMPTY
            if d == EMPTY:
                return "token", i
            s = d
        if self.nullable(s) or put is not None and self.nullable(self.derive(s, put)):
            return "ok", -1
        return "truncated", -1
