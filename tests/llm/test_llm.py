"""Training-data operators: edge cases with defined results, and brute force, round trips or held-out accuracy."""

import ast
import datetime
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.functions.lexing import lex
from graphmill.llm import docpairs, leakage, packing, provenance, similar, splitting, syntax, tokens, truncation
from graphmill.llm.derivatives import Grammar


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def files(spark, data):
    """(path, content) as file_node rows, with a column whose name the operators use themselves."""
    t = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([("r", p, None, c, t) for p, c in data], "repo string, path string, language string, content string, scanned_at timestamp").withColumn("kind", F.lit("x")).withColumn("line", F.lit(1))


# --- p5 ------------------------------------------------------------------------------------------------------------
def test_derivatives_ambiguity_and_left_recursion():
    g = Grammar("s = 'a' s 'b' | 'a' s | 'c' ?\n", "s")
    ok = lambda t: g.parse([(x, 0, False) for x in t])[0]
    assert ok("aab") == "ok" and ok("aacbb") == "ok" and ok("b") == "token" and ok("") == "ok"
    assert Grammar("s = 'a' 'b'\n", "s").parse([("a", 0, False)]) == ("truncated", -1)
    with pytest.raises(ValueError):
        Grammar("s = s 'a' | 'b'\n", "s")


GOOD = {
    "a.py": ["", "# c\n", "x: int = 1; y = [*a, 2]\n", "def f(a, /, *, b=1, **k) -> 'x':\n\tif a:\n\t\treturn\n", "async def f():\n    async with a as b, c:\n        await x\n", "match x:\n    case [1, *_] if y: pass\n    case {'a': P(b=1)}:\n        pass\n", "f'{x}' r'\\d' b''\n", "a = (\n  1,\n)\n@d\nclass K[T](B, m=1): x = lambda *a, b: (yield)\n", "try:\n  pass\nexcept* E as e:\n  pass\nfinally:\n  pass\nwhile 1: break\nelse: pass\n", "print(*a, sep='')\r\nx = a if b else c\r\n"],
    "a.js": ["", "#!/usr/bin/node\nlet a = 1\nlet b = /[/{]\\//g.test(a)\n", "const {a, b: [c]} = d, f = async (x, ...y) => ({...x})\n", "export default class extends A { #p = 1; static async *m() { for await (const x of y) yield* x } get z() { return `a${`b${1}`}` } }\n", "label: for (;;) { if (a) continue label; else break }\nx ??= a?.b?.[0] ?? c\n", "import a, {b as c} from './x'; export * as d from 'y'\nif (a) b; else c\n", "!function(e){var n=e+1;return n>3?e(n):e.n[5]}(1)\n"],
    "a.jsx": ["const a = <div className=\"x\" {...p}>{b ? <i/> : null} t</div>;\n"],
    "a.ts": ["interface A<T extends B = C> extends D { readonly x?: number; (a: string): void; [k: string]: any }\n", "type M = { [K in keyof T]?: T[K] } & (A | B)[]; enum E { A = 1, B }\n", "abstract class K<T> implements I { constructor(private readonly a: Map<string, Array<number>>) { super() } abstract f(): asserts x is string; g = <T,>(x: T): T => x as unknown as T }\n", "declare module 'x' { export function f(a?: number): void }\nfunction g(this: Window, x: string | null): x is string { return x! }\nconst r = f<string>(a) satisfies B\n"],
    "A.java": ["", "package a.b; import static x.Y.*; public final class A<T extends B & C> extends D<T> implements E, F { @X(a = {1, 2}) private int[] x = {1}, y; A() { this.z(); } <R> R f(final List<? super T> a, int... b) throws E { return (R) a.stream().map(x -> x + 1).collect(C::new); } }\n", "record P(int a) { P { } } sealed interface S permits P {} enum E { A(1) { void f() {} }, B; int g() { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }\n", "class A { void f() { for (var x : y) { if (a instanceof B b && b.c() > 1 << 2) continue; } try (var r = o()) { } catch (E | F e) { throw e; } finally { } int i = a < b ? c : d; String t = \"\"\"\n x\"y\n\"\"\"; Runnable r = () -> {}; int[] q = new int[]{1}; } }\n"],
    "a.cpp": ["", "#include <a>\n#define X(a) \\\n  a\nnamespace a::b { template <typename T, int N = 3> class K final : public B<T>, private C { public: K() : x(1), y{2} {} virtual ~K() = default; K& operator=(const K&) = delete; int f(int a = 1) const override; private: std::map<int, std::vector<T>> m_; }; }\n", "int main(int c, char** v) { auto f = [&, x = 1](auto a) mutable -> int { return a; }; for (const auto& [k, w] : m) { if (int i = g(); i > 0) continue; } std::vector<std::vector<int>> q{{1}, {2}}; int* p = new int[3]; delete[] p; return static_cast<int>(c) << 2; }\n", "extern \"C\" { void f(void); }\nusing A = B<int>; static constexpr unsigned long x[] = {1, 2}; enum class E : int { A = 1, B };\nauto s = R\"(a \" b)\"; template <> struct H<int> { };\nint K::f(int a) const noexcept { do { a--; } while (a); switch (a) { case 1: break; default: ; } return a ? 1 : -1; }\n"],
}
BAD = {
    "a.py": ["print 'x'\n", "def f(:\n    pass\n", "if x:\npass\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n", "Sure, here is the file:\n", "a = 'x\n", "  x = 1\n y = 2\n", "x = 09\n", "if x:\n\ty = 1\n        z = 2\n", "return x y\n"],
    "a.js": ["function f(a: number) {}\n", "<<<<<<< HEAD\n", "f(a b)\n", "class A { x( }\n", "const a = `x\n", "if (a) {\n", "let x = ;\n", "interface A { x: number }\n"],
    "a.ts": ["def f():\n    pass\n", "class A { f(: number) {} }\n", "package a.b;\nimport x.Y;\n", "<!DOCTYPE html>\n"],
    "A.java": ["class A {", "class A { void f() { int x = 1 } }", "class A { void f() { g(; } }", "Here is the file\nclass A {}", "class A { int f( { } }"],
    "a.cpp": ["int f() { return 1; ", "package a.b;\n", "int f() { int x = 1 return x; }", "from a import b\n", ">>>>>>> x\n", "class A { int f() { } "],
}


@pytest.mark.parametrize("path", GOOD)
def test_grammars_accept(path):
    for text in GOOD[path]:
        assert syntax.judge(path, text)["verdict"] == "ok", (text, syntax.judge(path, text))


@pytest.mark.parametrize("path", BAD)
def test_grammars_reject(path):
    for text in BAD[path]:
        assert syntax.judge(path, text)["verdict"] in ("token", "truncated"), text


def test_python_grammar_agrees_with_the_parser_on_damaged_code():
    rng = random.Random(1)
    source = open(docpairs.__file__, encoding="utf-8").read()
    parts = [p for p in source.split("\n\n\n") if len(p) < 1500][:25]
    wrong = n = 0
    for _ in range(400):
        s = rng.choice(parts)
        at = rng.randrange(len(s))
        s = rng.choice([s, s[:at], s[:at] + s[at + 1 :], s[:at] + rng.choice("()[]{}:,='\n") + s[at:]])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(s)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
        n += 1
        wrong += ok != (syntax.judge("a.py", s)["verdict"] == "ok")
    assert wrong <= n * 0.03, (wrong, n)


def test_judged_files_edges(spark):
    f = files(spark, [("a.py", None), ("b.py", "x = (\n"), ("c.txt", "x = ("), ("noext", "("), ("d.js", "a" + " + a" * 20000), ("e.py", "(" * 3000 + ")" * 3000 + "\n")])
    got = {r.path: r.verdict for r in syntax.judged_files(f.unionByName(f)).collect()}
    assert got == {"a.py": "ok", "b.py": "truncated", "c.txt": "unknown", "noext": "unknown", "d.js": "ok", "e.py": "ok"}
    assert rows(syntax.judged_files(f.limit(0))) == []


def test_lexer_places():
    got = lex("let a = 1; // x\n/* y\n */", "javascript")
    assert [c.text for c in got.comments] == ["// x", "/* y\n */"] and got.tokens[0] == ("let", 0, True)


# --- p1 ------------------------------------------------------------------------------------------------------------
SAID = ["/** Splits tables at most 3 at a time. */", "// TODO: speed up. Groups briefs by tenant.", "/* 返回待处理的条目 */", "// Gibt die Liste zurück.", '"""Keep.\n\nArgs:\n    x: the tables to use\n"""', "// @param c the callees to use", "// {@code limit} is kept.", "/// See also the handbook. Moves x to the front.", "// Same as the meter does it, except that old quotes are left out."]
SILENT = ["", "//", "/** */", "/** TODO: document */", "// ------", "/** @inheritDoc */", "// {@inheritDoc}", "/** @param x\n * @return */", '"""\nArgs:\n    x:\nReturns:\n"""', "// eslint-disable-next-line", "# noqa", "// NOLINT", "/** x = old(x); */", "// return legacy(x);", "// See base class.", "// Same as above.", "/** Loads the big table. */", "// loadBigTable()", "/** The load big table function. */", "// n/a", "/** No description. */", "// Auto-generated method stub", '":param x:\n:return:"']


def test_says_something():
    assert [d for d in SAID if not docpairs.says_something(d, "loadBigTable")] == []
    assert [d for d in SILENT if docpairs.says_something(d, "loadBigTable")] == []
    assert not docpairs.says_something(None, "x") and docpairs.says_something("// Replays it twice", "replay")


def test_pairs(spark):
    py = 'class A:\n    """Holds rows."""\n    def f(self):\n        r"""Counts rows."""\n        return 1\n\n    def g(self): "Also inline."\n\n    def h(self):\n        x = 1\n        """Not the first."""\n\n    def i(self,\n          b):\n        f"""Not plain."""\n'
    java = "class B {\n    /** Reads it whole. */\n    @Override\n    @X(a = 1)\n    public int f() {\n        if (a) { b(); }\n    }\n\n    // Far above.\n\n    int g() { return 1; }\n    // One.\n    // Two lines.\n    int h() { return 2; }\n}\n"
    f = files(spark, [("a.py", py), ("B.java", java.replace("\n", "\r\n")), ("e.py", None)])
    listed = [("A", "class", "a.py", 1), ("f", "function", "a.py", 3), ("g", "function", "a.py", 7), ("h", "function", "a.py", 9), ("i", "function", "a.py", 13), ("f", "function", "B.java", 3), ("g", "function", "B.java", 11), ("h", "function", "B.java", 14), ("zz", "function", "a.py", 3), ("f", "function", "a.py", 99), ("f", "function", "e.py", 1), (None, "function", "a.py", 3)]
    n = spark.createDataFrame([("r", f"{p}:{name}:{ln}", kind, name, p, ln) for name, kind, p, ln in listed], "repo string, qualified_name string, kind string, name string, file_path string, line_start int")
    got = {r.qualified_name: (r.line_end, docpairs.doc_text(r.doc).strip()) for r in docpairs.pairs(n.unionByName(n), f).collect()}
    assert got == {"a.py:A:1": (15, "Holds rows."), "a.py:f:3": (5, "Counts rows."), "a.py:g:7": (got["a.py:g:7"][0], "Also inline."), "B.java:f:3": (7, "Reads it whole."), "B.java:h:14": (14, "One.\n Two lines.")}
    assert rows(docpairs.pairs(n, f.limit(0))) == [] and rows(docpairs.pairs(n.limit(0), f)) == []


# --- p6 ------------------------------------------------------------------------------------------------------------
def test_provenance():
    kind = lambda p, c="x = 1\n": provenance.judge(p, c)["kind"]
    assert kind("a/node_modules/x.js") == "third_party" and kind("vendor/lib/x.py") == "third_party" and kind("services/vendor/x.py") == "own"
    assert kind("a.min.js") == "generated" and kind("gen-src/A.java") == "generated" and kind("tools/generators/a.py") == "own" and kind("a/generated_report.py") == "own"
    assert kind("a.py", "# Code generated by x. DO NOT EDIT.\nx = 1\n") == "generated" and kind("a.py", "x = 1\n# DO NOT EDIT\n") == "own" and kind("a.py", 'B = "DO NOT EDIT"\n') == "own"
    assert kind("A.java", "package a;\n/* <auto-generated> */\nclass A {}") == "generated" and kind("a.js", "/* @license foo 1.2 */\nf()") == "third_party"
    assert kind("a.js", "// used to be generated, now edited by hand\nf();\n") == "own" and kind("a.py", "") == "own"
    assert kind("a.js", "const a=[" + ",".join(map(str, range(1000))) + "];") == "data" and kind("a.py", "A = 1\nB = 2\nC = 3\n") == "own"
    assert kind("a.js", "!function(e){" + "".join(f"function f{i}(x){{var n=x+{i};return n>3?f(n):x.n[5]}}" for i in range(90)) + "}();") == "minified"


def test_provenance_of_fenced_answers():
    body = "".join(f"  lease.move(table{i}, limit{i % 7});\n" for i in range(60))
    assert provenance.judge("src/a.ts", "Sure, below is the file:\n\n```typescript\n" + body + "```\n")["kind"] == "own"
    assert provenance.judge("src/a.ts", "export const A = `\n" + "QmFzZTY0ZGF0YQ\n" * 80 + "`;\n")["kind"] == "data"


def test_provenance_edges(spark):
    f = files(spark, [("a.py", None), ("b/node_modules/c", "x" * 100_000)])
    assert rows(provenance.provenance(f.unionByName(f)), "path", "kind") == [("a.py", "own"), ("b/node_modules/c", "third_party")]
    assert rows(provenance.provenance(f.limit(0))) == []


# --- p7 ------------------------------------------------------------------------------------------------------------
WORDS = "the planner moved stale leases out of every store and counts open tables before a worker restarts with new limits".split()


def _value(rng):
    said = [" ".join(rng.choices(WORDS, k=rng.randrange(5, 12))).capitalize() + "." for _ in range(rng.randrange(2, 6))]
    if rng.random() < 0.2:
        said[-1] = rng.choice(["no blockers", "merge after rebase", "owner: reviewer"])
    return '{"summary": "%s", "notes": "%s"}' % (said[0], " ".join(said[1:])) if rng.random() < 0.8 else " ".join(said)


def test_truncation_on_held_out_cuts():
    rng = random.Random(4)
    values = [_value(rng) for _ in range(1500)]
    model = truncation.train(values[:1000], frozenset())
    score = lambda v: model.score(truncation.hashed(truncation.features(v, frozenset())))
    intact = np.mean([score(v) > truncation.FOUND for v in values[1000:]])
    cuts = [c for v in values[1000:] if (c := truncation.cut(v, rng))]
    lost = np.mean([score(c) > truncation.FOUND for c in cuts])
    assert intact < 0.03 and lost > 0.9, (intact, lost)


def test_truncation_learns_lengths_at_a_limit():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["alfa", "beta", "gama", "zeta", "iota"]) for _ in range(n))
    limits = frozenset([204])  # 41 words, the last one whole
    values = [text(rng.choice([n for n in range(20, 90) if n != 41])) + rng.choice([".", ".", ""]) for _ in range(600)]
    model = truncation.train(values + [text(41) for _ in range(60)], limits)
    score = lambda v: model.score(truncation.hashed(truncation.features(v, limits)))
    at, off = [np.mean([score(text(n)) for _ in range(200)]) for n in (41, 51)]
    assert model.w[truncation.hashed(["limit:0"])][0] > 0 and at > max(off, truncation.FOUND), (at, off)


def test_truncation_inside_a_value():
    """A string that lost its end while the rest of the JSON value follows, and decoys that only look alike."""
    rng = random.Random(6)
    values = [_value(rng) for _ in range(800)] + ['{"summary": "Old leases were moved.", "ref": "%032x"}' % rng.getrandbits(128) for _ in range(80)]
    model = truncation.train(values, frozenset())
    lost = lambda v: max(model.score(truncation.hashed(e)) for e in truncation.ends(v, frozenset())) > truncation.FOUND
    assert all(map(lost, ['{"summary": "The planner moved stale leases out of ev", "notes": "All done."}', '{"summary": "Open tables before a worker rest…", "notes": "All done."}', '{"notes": "The planner counts open ta [output clipped at 90 chars]", "risk": "low"}', '[{"note": "Limits and the planner moved sta"}, {"note": "Every store restarts."}]']))
    assert not any(map(lost, ['{"summary": "The planner moved stale leases.", "notes": "Every store restarts."}', '{"summary": "The viewer prints [truncated] for long logs.", "notes": "Every store counts."}', '{"summary": "Old leases were moved.", "ref": "%032x"}' % rng.getrandbits(128)]))
    assert truncation.parsed("[" * 100_000) is None and truncation.strings({"a": [{"b": "x"}, "y"]}) == [("/a[]/b", "x"), ("/a[]", "y")]


def test_truncation_limits_by_provider(spark):
    """A limit of one provider is found however rare it is; lengths that many equal values share are none."""
    rng = random.Random(7)
    made = lambda n: "".join(rng.choices("abcde fgh.", k=n))
    data = [("p", made(160)) for _ in range(12)] + [("p", made(rng.randrange(50, 900))) for _ in range(300)] + [("q", made(rng.randrange(50, 900))) for _ in range(300)] + [("q", "Approved") for _ in range(300)]
    got = truncation.frequent_lengths(truncation.length_counts(spark.createDataFrame(data, "provider string, output string")))
    assert got == {"p": frozenset([160]), None: frozenset([160])}


def test_truncation_edges(spark):
    t = datetime.datetime(2026, 1, 1)
    later = datetime.datetime(2026, 2, 1)
    data = [(" A ", t, "cut mid wor"), ("a", later, None), ("b", t, ""), ("c", t, '{"a": "x'), (None, t, "x"), ("d", t, "All done."), ("d", t, "All done."), ("e", t, "long. " * 20000)]
    df = spark.createDataFrame([(*x, "p", None) for x in data], "id string, updated_at timestamp, output string, provider string, model_used string").withColumn("score", F.lit(9)).withColumn("logit", F.lit(9))
    got = {r.id: r.score > truncation.FOUND for r in truncation.scored(df).collect()}
    assert got == {"b": False, "c": True, "d": False, "e": False}
    assert rows(truncation.scored(df.limit(0))) == []


# --- p8, p10 -------------------------------------------------------------------------------------------------------
TEXTS = ["", "short", "One sentence. " * 400, "x" * 9000, "多字节文本没有空格" * 300, "para one.\n\n" + "para two is here. " * 300 + "\n\nend", "a\r\n\r\nb " * 500, "word " * 5000]


@pytest.mark.parametrize("limit,overlap", [(64, 0), (64, 16), (200, 50)])
def test_split_round_trip(limit, overlap):
    for text in TEXTS:
        raw = text.encode()
        parts = splitting.split(text, limit, overlap)
        assert parts[0][0] == 0 and parts[-1][1] == len(raw)
        assert all(n <= limit and n == len(tokens.encode(raw[a:b].decode())) for a, b, n in parts)
        joined, end = b"", 0
        for a, b, _ in parts:
            assert a <= end < b or not raw
            joined += raw[end:b]
            end = b
        assert joined == raw
        if overlap == 0:
            assert all(p[1] == q[0] for p, q in zip(parts, parts[1:]))


def test_split_prefers_strong_boundaries():
    text = "alpha beta. " * 30 + "\n\n" + "gamma delta. " * 60
    a, b, _ = splitting.split(text, 128, 0)[0]
    assert text[:b].endswith("\n\n")
    table = splitting.StrongestCut(np.array([1, 3, 3, 2, 5, 1]))
    assert table.best(0, 3) == (2, 3) and table.best(0, 5) == (4, 5) and table.best(5, 5) == (5, 1)
    rng = np.random.default_rng(0)
    v = rng.integers(0, 7, 500)
    t = splitting.StrongestCut(v)
    for _ in range(300):
        lo, hi = sorted(rng.integers(0, 500, 2))
        m = v[lo : hi + 1].max()
        assert t.best(int(lo), int(hi)) == (int(lo + np.flatnonzero(v[lo : hi + 1] == m)[-1]), int(m))


def test_encode_in_stretches_is_the_same():
    text = ("Some words, and 12 numbers.\n\n  indented it's " * 3000) + "y" * 50_000
    assert np.array_equal(tokens.encode(text), np.array(tokens.encoding().encode_ordinary(text)))


def test_pieces_and_packing_edges(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "short", "word " * 9000])] + [(2, "short")], "doc_id long, text string").withColumn("piece", F.lit(1)).withColumn("shard", F.lit("x"))
    p = splitting.pieces(d)
    assert {r.doc_id for r in p.collect()} == {3} and p.where("n_tokens > 512").count() == 0
    c = packing.containers(d, shard_items=2).collect()
    assert sorted(r.doc_id for r in c if r.doc_id != 3) == [1, 2, 2] and sum(r.n_tokens for r in c if r.doc_id == 3) >= 9000
    assert rows(packing.containers(d.limit(0))) == [] and rows(splitting.pieces(d.limit(0))) == []


def test_packing_limits_and_fill():
    rng = np.random.default_rng(3)
    n = rng.integers(5, 900, 3000)
    size = np.stack([n, np.ones_like(n), (n * rng.uniform(0.7, 1, 3000)).astype(int)], 1)
    box = packing.pack(size, np.array([4096, 64, 4032]))
    total = np.zeros((box.max() + 1, 3), int)
    np.add.at(total, box, size)
    assert (total <= [4096, 64, 4032]).all() and len(box) == 3000
    assert n.sum() / (4096 * (box.max() + 1)) > 0.96
    assert packing.pack(np.array([[4096, 1, 0], [4096, 1, 0]]), np.array([4096, 64, 4032])).tolist() in ([0, 1], [1, 0])


# --- p9 ------------------------------------------------------------------------------------------------------------
def _runs(a, b, n):
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "多字"]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if i % 2:
            w = rng.choice(items).split()
            k = rng.randrange(8, 20)
            at = rng.randrange(max(1, len(w) - k))
            words[5:5] = w[at : at + k]
        docs.append(rng.choice([" ", ", ", "\n-- "]).join(x.upper() if rng.random() < 0.3 else x for x in words))
    d = spark.createDataFrame([*enumerate(docs), (100, None), (101, ""), (None, docs[1])], "doc_id long, text string").withColumn("item_id", F.lit(0))
    e = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    want = list((i, j) for i, a in enumerate(docs) for j, b in enumerate(items) if _runs(leakage.words(a), leakage.words(b), 12))
    want.sort(key=repr)
    assert want and rows(leakage.leaks(d, e), "doc_id", "item_id") == want
    assert rows(leakage.leaks(d, e, block_words=60), "doc_id", "item_id") == want
    assert rows(leakage.leaks(d.limit(0), e)) == [] and rows(leakage.leaks(d, e.limit(0))) == []


def test_leaks_with_substitutions(spark):
    item = [f"t{i}" for i in range(30)]
    doc = list(item)
    doc[6], doc[19] = "other", "changed"
    d = spark.createDataFrame([(1, " ".join(["x"] * 9 + doc)), (2, " ".join(item[:10] + ["q"] * 10))], "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert rows(leakage.leaks(d, e, min_run=16, share=0.9), "doc_id", "n_words") == [(1, 30)]


# --- p4 ------------------------------------------------------------------------------------------------------------
def _vectors(n=600, dim=96, groups=40, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    x = c[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, dim))
    return (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("tables,axes", [(None, None), (18, 2)])
def test_similar_recall(spark, tables, axes):
    x = _vectors()
    t = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(f"v{i:04}", t, v.tolist()) for i, v in enumerate(x)], "id string, created_at timestamp, embedding array<float>").withColumn("grp", F.lit(1))
    got = {(r.id, r.other): r.similarity for r in similar.most_similar(df, dim=96, block=64, tables=tables, axes=axes, near=190).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(f"v{i:04}", f"v{j:04}") for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.5}
    assert len(want & set(got)) / len(want) > 0.9 and all(abs(v - s[int(a[1:]), int(b[1:])]) < 1e-4 for (a, b), v in got.items())


def test_similar_shares_of_a_hot_group(spark):
    """A group divided into shares gives the lists of the whole group, and ties of one id's time are settled the same way."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=96)
    x = np.round(base + 0.3 * rng.normal(size=(90, 96)), 3)
    t = datetime.datetime(2026, 1, 1)
    data = [(f"v{i:03}", t, v.tolist()) for i, v in enumerate(x)] + [("v000", t, x[1].tolist())]
    df = spark.createDataFrame(data, "id string, created_at timestamp, embedding array<float>")
    whole, parts = (rows(similar.most_similar(df, dim=96, block=64, group_rows=n), "id", "other", "rank") for n in (1000, 20))
    assert whole == parts and len(whole) == 90 * 5
    assert similar.near_bits(0.5) == 172 and similar.near_bits(0.9) < similar.near_bits(0.5)


def test_similar_two_axes_meet_as_often_as_one():
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    (one, two), n = (similar.plan(rows, similar.DIM) for rows in (262_144, 262_145)), 400
    assert (one[1], two[1]) == (1, 2)
    for cosine in (0.5, 0.6, 0.7):
        a, b = unit(rng.normal(size=(n, similar.DIM))), rng.normal(size=(n, similar.DIM))
        b = cosine * a + np.sqrt(1 - cosine**2) * unit(b - (a * b).sum(1, keepdims=True) * a)
        x = np.zeros((2 * n, similar.padded(similar.DIM)), np.float32)
        x[:, : similar.DIM] = np.concatenate((a, b))
        met = []
        for tables, axes in (one, two):
            k = similar.keys_of(x, tables, axes)
            met.append(np.mean([len(set(p) & set(q)) > 0 for p, q in zip(k[:n].tolist(), k[n:].tolist())]))
        assert met[1] > met[0] - 0.08, (cosine, met)


def _brute_force(ids, x, k=5, floor=0.5):
    """(id, other, rank) by comparing all in double precision."""
    x = x.astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    s = np.round(np.clip(x @ x.T / (norms * norms[:, None]), -1, 1), 12)
    out = []
    for i, me in enumerate(ids):
        near = sorted((-s[i, j], other) for j, other in enumerate(ids) if other != me and s[i, j] >= floor)
        out += [(me, other, r) for r, (_, other) in enumerate(near[:k], 1)]
    return sorted(out, key=repr)


def test_similar_leaves_out_no_pair(spark):
    """Lone pairs barely above the floor, one exactly at it, a chain, a crowd, ties and copies, over several blocks."""
    rng, dim = np.random.default_rng(11), 96
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a, b = unit(rng.normal(size=(120, dim))), rng.normal(size=(120, dim))
    c = rng.uniform(0.501, 0.65, (120, 1))
    b = c * a + np.sqrt(1 - c**2) * unit(b - (a * b).sum(1, keepdims=True) * a)
    chain = np.eye(dim)[20:32] + np.eye(dim)[21:33]  # neighbours have a cosine of exactly 1/2
    crowd = rng.normal(size=dim) + 0.1 * rng.normal(size=(60, dim))
    ties = rng.normal(size=dim).round(3) * np.array([1, 1, 2, 3, 4, 4, 5, 7])[:, None]
    x = np.concatenate((a, b, chain, crowd, ties)).astype(np.float32)
    ids = [f"v{i:04}" for i in rng.permutation(len(x))]
    t = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, t, v.tolist()) for i, v in zip(ids, x)], "id string, created_at timestamp, embedding array<float>")
    want = _brute_force(ids, x)
    assert rows(similar.most_similar(df, dim=dim), "id", "other", "rank") == want
    assert rows(similar.most_similar(df, dim=dim, group_rows=70), "id", "other", "rank") == want


def test_similar_tile_rules_out_nothing(monkeypatch):
    """Many pairs of nearly equal similarity: rows and columns keep their best, however they are computed."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=64) + 1e-3 * rng.normal(size=(50, 64))).astype(np.float32)
    y = np.concatenate((x[:20] * np.float32(2), rng.normal(size=(30, 64)).astype(np.float32)))
    xn, yn = similar._norms(x), similar._norms(y)
    exact = np.round(np.clip(x.astype(np.float64) @ y.astype(np.float64).T / np.outer(xn, yn), -1, 1), 12)
    i, j = similar._possible(similar._units(x, xn) @ similar._units(y, yn).T, 3, 0.5, 80 * 2.0**-23)
    kept = set(zip(i.tolist(), j.tolist()))
    for m, place in ((exact, lambda r, c: (r, c)), (exact.T, lambda r, c: (c, r))):
        for r in range(len(m)):
            assert {place(r, c) for c in np.argsort(-m[r])[:3].tolist() if m[r, c] >= 0.5} <= kept
    for many in (0, 10**9):
        monkeypatch.setattr(similar, "MANY_PAIRS", many)
        assert np.abs(similar._similarities(x, xn, y, yn, i, j) - exact[i, j]).max() < 2e-12


def test_similar_unpacks_batches():
    rng = np.random.default_rng(4)
    for x in (np.round(rng.normal(size=(30, 50)), 3), rng.normal(size=(30, 50)), np.array([[-32.767, 32.767, 0.001, -0.001]])):
        x = x.astype(np.float32)
        assert np.array_equal(similar._unpacked([similar.pack_vector(v) for v in x], x.shape[1]), x)


def test_similar_shares_of_a_hashed_group(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=96) + 0.3 * rng.normal(size=(90, 96)), 3)
    t = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(f"v{i:03}", t, v.tolist()) for i, v in enumerate(x)], "id string, created_at timestamp, embedding array<float>")
    whole, parts = (rows(similar.most_similar(df, dim=96, block=64, tables=6, axes=1, group_rows=n), "id", "other", "rank") for n in (1000, 20))
    assert whole == parts and len(whole) == 90 * 5


def test_similar_edges(spark):
    t, later = datetime.datetime(2026, 1, 1), datetime.datetime(2026, 2, 1)
    v = _vectors(3, 96)
    one = v[0].tolist()
    bad = [*one]
    bad[3] = float("nan")
    data = [("a", t, one), ("b", t, [2 * x for x in one]), ("c", t, None), ("d", t, one[:5]), ("e", t, [0.0] * 96), ("f", t, bad), ("g", t, one), ("g", later, None), (None, t, one), ("a", t, one), ("h", None, one)] + [(f"k{i}", t, one) for i in range(9)]
    df = spark.createDataFrame(data, "id string, created_at timestamp, embedding array<float>")
    got = rows(similar.most_similar(df, dim=96, block=64), "id", "other")
    assert {a for a, _ in got} == {"a", "b", "h", *(f"k{i}" for i in range(9))} and len(got) == 12 * 5 and all(a != b for a, b in got)
    assert ("k8", "a") in got and ("a", "b") in got
    assert rows(similar.most_similar(df.limit(0), dim=96, block=64)) == []


def test_packed_vectors_are_exact():
    rng = np.random.default_rng(0)
    for x in (np.round(rng.normal(size=50) * 0.1, 3), rng.normal(size=50), rng.normal(size=50) * 1e30, np.zeros(3)):
        v = x.astype(np.float32)
        assert np.array_equal(similar.unpack_vector(similar.pack_vector(v)), v)
