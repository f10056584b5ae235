"""p7: outputs that lost their end, by hashed logistic regression on how a value ends.

Text can be lost at the end of a value, or at the end of one string inside it where the rest of the value follows, so every
string of a JSON value is judged, and a value's score is the highest among its ends. Positives are made by cutting intact values
at random places: left as they are, with a marker put in place of the rest, or with quotes and brackets closed again; a share
exactly at the strikingly frequent lengths; and single strings inside JSON values. Features are of the closing characters and
words, punctuation, markers, what is still open, the path of the string, and the length's distance to lengths that are strikingly
frequent for the value's provider.

The training set is a bounded sample: `SAMPLE` values, those with the smallest hashes, each of at most `SAMPLE_CHARS` characters
(longer ones are scored, but not trained on), and the few `BASE` values. A first model drops the ends that were cut already from
the intact ones, then the model is fitted again. All values are scored, whole.

Null outputs are no case; an empty output is none either. Of several states of a task the latest counts, of equally late ones the
one with the higher score.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.keys import norm_id
from graphmill.functions.scratch import Scratch
from graphmill.sources.tables import table

BITS, SAMPLE, SAMPLE_CHARS, EPOCHS, STEPS, SEED, DROP, TEXT_CUTS, LIMIT_CUTS, FOUND = 16, 8000, 20_000, 4, 100, 7, 0.3, 8, 0.25, 0.2
#: A length is striking where its different values are RATIO times as many as at the NEAR lengths on either side, with a chance below exp(-SURE).
NEAR, RATIO, SURE = 8, 4, 14
#: Intact values that every training set holds, so that very small tables are judged by a trained model too.
BASE = ["All tables were read and the counts agree with the report.", '{"summary": "The import was moved behind a flag.", "risk": "low", "notes": "Run the tests again before the merge."}', "Approved", "Two files are left.\n\n- rerun the checks\n- update the list", "The build passes.\n```sh\nmake check\n```", "| table | rows |\n|---|---|\n| orders | 15 |", '["first finding.", "second finding."]', "Is the lock held for long? It is not, as far as the log shows.", "Nothing to do here!", "The run is over. ", "The run is over.\n"]
# Markers that stand for a missing rest.
MARKERS = ["...", "…", "[...]", "[…]", "[truncated]", "(truncated)", "<truncated>", "... [truncated]", "…[truncated]", "[cut]", "<snip>", "[{n} more chars]", "... [{n} chars]", "[... {n} chars]", "... (+{n} chars)", "… (+{n} chars)", "[+{n} chars]", "... {n} more characters", "[output truncated]", "--- truncated ---", "[output clipped]", "[clipped at {n} chars]", "[output clipped at {n} chars]", "(cut off)"]
_MARK = re.compile(r"(?:\.\.\.|…|\[[^\[\]]{0,40}\]|\([^()]{0,40}\)|<[^<>]{0,40}>|\*\*\*|---)\W*$")
_COUNT = re.compile(r"\d+ (?:more )?(?:chars|characters|bytes|tokens|words|lines)|truncat|\bclipped\b|\bcut off\b|abgeschnitten|gekürzt|tronqué|recortado|omitted|\bsnip\b|\[cut\]|截断", re.I)
STOPS = tuple(".!?。！？")
_WORDS = re.compile(r"[^\W_]+|[^\w\s]+")
_DIGITS = re.compile(r"\d+")


def last_text(value) -> str:
    """The last string of a parsed JSON value in its order, descending into its last member."""
    while isinstance(value, (dict, list)) and value:
        value = list(value.values())[-1] if isinstance(value, dict) else value[-1]
    return value if isinstance(value, str) else "" if isinstance(value, (dict, list)) else str(value)


def strings(value) -> list[tuple[str, str]]:
    """(path, text) of every string of a parsed JSON value in its order; a path names keys but no list positions."""
    out, stack = [], [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, str):
            out.append((path, v))
        elif isinstance(v, dict):
            stack.extend((f"{path}/{k}", x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((path + "[]", x) for x in reversed(v))
    return out


def parsed(text: str):
    """The JSON value that a text holds; None where it begins like JSON and is none, or is plain text."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(text)
        except (ValueError, RecursionError):
            pass
    return None


def open_brackets(text: str) -> tuple[str, bool]:
    """Brackets left open outside double-quoted strings, and whether a string is left open."""
    stack: list[str] = []
    quoted = escaped = False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return "".join(reversed(stack)), quoted


def _shape(word: str) -> str:
    """A word without its digits; digests, ids and other long runs of letters and digits are all one."""
    if len(word) >= 24 or len(word) >= 8 and not word.isalpha() and not word.isdigit() and word.isalnum():
        return "code"
    return _DIGITS.sub("0", word.lower())


def closing(form: str, end: str) -> list[str]:
    """Features of the closing characters and words of a text, and of a marker put in place of its rest."""
    parts = _WORDS.findall(end[-120:])
    last = [_shape(w) for w in parts[-3:]]
    c = end[-1:]
    kind = "none" if not c else "stop" if c in STOPS else "close" if c in ")]}>\"'`”»" else "pause" if c in ",;:-–—、，；：" else "digit" if c.isdigit() else "letter" if c.isalpha() else "other"
    out = [f"{form}:end:{kind}", f"end:{kind}", f"one:{last[-1] if last else ''}", f"two:{' '.join(last[-2:])}", f"three:{' '.join(last)}", f"char:{'' if last[-1:] == ['code'] else c}", f"words:{min(len(parts), 3)}"]
    m = _MARK.search(end[-60:])
    if m:
        out.append("mark:" + _DIGITS.sub("0", m[0].strip())[:24])
        before = _WORDS.findall(end[-60:][: m.start()])
        out.append("mark after:" + (_shape(before[-1]) if before else ""))
        out.append("mark after two:" + " ".join(map(_shape, before[-2:])))
    if _COUNT.search(end[-48:]):
        out.append("counted")
        if m:
            out.append("counted mark")
    return out


def features(text: str, limits: frozenset[int], value=None) -> list[str]:
    """Names of the features that hold for the end of a value; `value` is what it holds as JSON, where that is known."""
    stripped = text.rstrip()
    out = []
    form, end, keys = "text", stripped, ""
    if stripped[:1] in ("{", "["):
        value = parsed(stripped) if value is None else value
        if value is not None:
            form, end = "json", last_text(value).rstrip()
            keys = "/".join(value) if isinstance(value, dict) else "list"
            if isinstance(value, dict) and value:
                out.append(f"lastkey:{list(value)[-1]}")
        else:
            form = "broken"
            out.append(f"open:{bool(open_brackets(stripped)[0])}")
    out.append(f"form:{form}")
    out.append(f"keys:{keys}")
    if form == "text":
        if stripped.count("```") % 2:
            out.append("fence")
            out.append("open fence")
        if end.count("(") > end.count(")"):
            out.append("open round")
        if text != stripped and end[-1:] not in STOPS:
            out.append("blank end:" + ("line" if "\n" in text[len(stripped) :] else "space"))
        line = stripped.rsplit("\n", 1)[-1]
        if line.startswith("|"):
            out.append("row:" + str(line.rstrip().endswith("|") and line.count("|") > 2))
        if line.startswith(("- ", "* ")):
            out.append("bullet")
    out += closing(form, end)
    near = min((abs(len(text) - x) for x in limits), default=99)
    out.append(f"limit:{0 if near == 0 else 1 if near < 4 else 2}")
    if near == 0 and "end:stop" not in out and "end:close" not in out:
        out.append("limit and no stop")
    return out


def member(path: str, text: str) -> list[str]:
    """Features of a string inside a JSON value: it can have been cut by a limit of its own field, while the rest follows."""
    out = closing("member", text.rstrip())
    out += ["form:member", f"field:{path}", f"{path}:{out[1]}"]
    if text != text.rstrip() and text.rstrip()[-1:] not in STOPS:
        out.append("blank end:space")
    return out


def ends(text: str, limits: frozenset[int]) -> list[list[str]]:
    """Features of every place in a value where text can have been lost: its own end, and that of each string inside it."""
    value = parsed(text)
    return [features(text, limits, value)] + [member(p, t) for p, t in strings(value)]


def hashed(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(n) & ((1 << BITS) - 1) for n in names), np.int64, len(names))


def unbroken(text: str) -> bool:
    """Whether a string has no blanks, as digests, links and names have: nothing in it tells where it was meant to end."""
    return len(text.split(None, 1)) < 2


def cut(text: str, rng: random.Random) -> str | None:
    """A value with its end taken away in one of the known ways; None where it is too short."""
    if len(text) < 40:
        return None
    at = rng.randrange(max(8, len(text) // 5), len(text) - 2)
    head = text[:at]
    way = rng.random()
    is_json = head.lstrip()[:1] in ("{", "[")
    if head.rstrip()[-1:] in STOPS:  # nothing but open brackets tells such a cut from an end
        return head if is_json else None
    if way < 0.5:
        return head
    mark = rng.choice(MARKERS).format(n=len(text) - at)
    if is_json and way > 0.65:
        head = re.sub(r"\\(u[0-9a-fA-F]{0,3})?$", "", head)
        if way > 0.82:
            head += rng.choice(["", " "]) + mark
        closers, quoted = open_brackets(head)
        closed = head + ('"' if quoted else "") + closers
        value = parsed(closed)
        return head if value is None or unbroken(last_text(value)) else closed
    return head + rng.choice(["", " ", "\n"]) + mark


def limit_cuts(text: str, limits: frozenset[int], rng: random.Random) -> list[str]:
    """For a share of values, the value cut exactly at one of the limits that it is longer than."""
    below = sorted(x for x in limits if x < len(text))
    times = 1 if text.lstrip()[:1] in ("{", "[") else TEXT_CUTS
    return [text[: rng.choice(below)] for _ in range(times if below else 0) if rng.random() < LIMIT_CUTS]


def member_cut(text: str, rng: random.Random) -> tuple[str, str] | None:
    """(path, rest) of one of a JSON value's strings, cut inside a sentence, at times with a marker; None without a long enough one."""
    long = [x for x in strings(parsed(text)) if len(x[1]) >= 40 and not unbroken(x[1])]
    if not long:
        return None
    path, whole = rng.choice(long)
    at = rng.randrange(8, len(whole) - 2)
    head = whole[:at]
    if head.rstrip()[-1:] in STOPS or unbroken(head):
        return None
    return path, head if rng.random() < 0.6 else head + rng.choice(["", " "]) + rng.choice(MARKERS).format(n=len(whole) - at)


class Model:
    def __init__(self) -> None:
        self.w = np.zeros(1 << BITS)
        self.bias = 0.0

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, batch: int = 64) -> Model:
        """Logistic regression by AdaGrad steps over shuffled batches, `epochs` times through the rows and at least STEPS steps."""
        if not len(rows):
            return self
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat, starts = np.concatenate(rows), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        g, gb = np.full(1 << BITS, 1e-6), 1e-6
        order = np.arange(len(rows))
        rng = np.random.default_rng(SEED)
        for _ in range(max(epochs, STEPS * batch // len(rows))):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                row = np.repeat(np.arange(len(take)), sizes[take])
                x = flat[np.repeat(starts[take], sizes[take]) + np.arange(len(row)) - np.repeat(np.cumsum(sizes[take]) - sizes[take], sizes[take])]
                z = np.bincount(row, self.w[x], len(take)) + self.bias
                e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]
                names, where = np.unique(x, return_inverse=True)
                d = np.bincount(where, e[row])
                g[names] += d * d
                self.w[names] -= rate * d / np.sqrt(g[names])
                gb += e.sum() ** 2
                self.bias -= rate * e.sum() / np.sqrt(gb)
        return self

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.w[x].sum() + self.bias, -30, 30))))


def train(values: list[str], limits: frozenset[int] | list[frozenset[int]]) -> Model:
    """The model fitted on `values` and cuts of them; `limits` holds for all of them, or one set for each."""
    rng = random.Random(SEED)
    each = limits if isinstance(limits, list) else [limits] * len(values)
    known = [(v, x) for v, x in [*zip(values, each), *((v, frozenset()) for v in BASE)] if v.strip() and "form:broken" not in features(v, x)]
    intact = [hashed(e) for v, x in known for e in ends(v, x)]
    # plain texts are few among the values but have more ways to end, so they are cut more often
    made = [(c, x) for v, x in known for _ in range(1 if v.lstrip()[:1] in ("{", "[") else TEXT_CUTS) if (c := cut(v, rng)) is not None]
    at_limit = random.Random(SEED + 1)
    made += [(c, x) for v, x in known for c in limit_cuts(v, x, at_limit)]
    inside = random.Random(SEED + 2)
    positive = [hashed(features(c, x)) for c, x in made] + [hashed(member(*c)) for v, _ in known if (c := member_cut(v, inside))]
    first = Model().fit(intact + positive, np.concatenate((np.zeros(len(intact)), np.ones(len(positive)))), epochs=2)
    kept = [x for x in intact if first.score(x) < DROP]
    return Model().fit(kept + positive, np.concatenate((np.zeros(len(kept)), np.ones(len(positive)))))


def length_counts(outputs: DataFrame) -> DataFrame:
    """(provider, n, c, different): values, and about how many different ones, of every length of every provider."""
    n = F.length("output").cast("long").alias("n")
    return outputs.select("provider", n, F.xxhash64("output").alias("h")).groupBy("provider", "n").agg(F.count("*").alias("c"), F.approx_count_distinct("h", 0.1).alias("different"))


def frequent_lengths(counts: DataFrame) -> dict[str | None, frozenset[int]]:
    """By provider, the lengths that stand out: no neighbour has more values, and chance does not explain their number.

    Both tests compare with the mean of the neighbouring lengths, so they hold for rare lengths as for common ones. Values without a
    provider may have met any provider's limit.
    """
    around = counts.select("provider", F.explode(F.array(*[F.col("n") + k for k in range(-NEAR, NEAR + 1) if k])).alias("n"), "different")
    near = around.groupBy("provider", "n").agg(F.sum("different").alias("s"), F.max("different").alias("top"))
    both = counts.join(near.withColumnRenamed("provider", "p").withColumnRenamed("n", "m"), F.expr("p <=> provider and m = n"), "left")
    mean = (F.coalesce("s", F.lit(0)) + 1) / (2 * NEAR)
    c = F.col("different")
    out: dict[str | None, set[int]] = {}
    for r in both.where((c >= F.coalesce("top", F.lit(0))) & (c >= RATIO * mean) & (c * F.log(c / mean) - (c - mean) > SURE)).select("provider", "n").collect():
        out.setdefault(r.provider, set()).add(r.n)
    out[None] = set().union(*out.values())
    return {p: frozenset(x) for p, x in out.items()}


def draw(filled: DataFrame, n: int, sample: int) -> list:
    """Of `n` values those with the smallest hashes, at most `sample`. The hash is limited first to a range that holds about a
    fifth more than that, so that what tasks send to the driver does not grow with the table."""
    share = min(1.0, (1.2 * sample + 200) / max(1, n))
    h = F.xxhash64("id", "output")
    if share < 1:
        filled = filled.where(h < int(-(2**63) + share * 2**64))
    return filled.select("output", "provider", h.alias("h")).orderBy("h", "output").limit(sample).select("output", "provider").collect()


def scored(tasks: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, score, provider, model_used) of the valid row of every task with an output; score above FOUND means its end is lost."""
    rows = tasks.select(norm_id("id").alias("id"), "updated_at", "output", "provider", "model_used").where("id is not null")
    filled = rows.where("output is not null")
    scratch = Scratch(rows.sparkSession, "lengths")
    counts = scratch.save(length_counts(filled))
    limits = frequent_lengths(counts)
    short = f"n between 1 and {SAMPLE_CHARS}"
    n = counts.where(short).agg(F.sum("c")).first()[0] or 0
    scratch.drop(counts)
    drawn = draw(filled.where(F.length("output").between(1, SAMPLE_CHARS)), n, sample)
    model = train([r.output for r in drawn], [limits.get(r.provider, frozenset()) for r in drawn])
    shared = rows.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.bias, limits))

    def run(pdfs):
        w, bias, lim = shared.value
        seen: dict[str, float] = {}

        def weight(name: str) -> float:
            x = seen.get(name)
            if x is None:
                x = float(w[xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1)])
                if len(seen) < 1 << BITS:
                    seen[name] = x
            return x

        for p in pdfs:
            s = [None if o is None else max(sum(map(weight, e)) for e in ends(o, lim.get(q, frozenset()))) + bias if o.strip() else -30.0 for o, q in zip(p["output"], p["provider"])]
            yield pd.DataFrame({"id": p["id"], "updated_at": p["updated_at"], "logit": pd.array(s, "Float64"), "provider": p["provider"], "model_used": p["model_used"]})

    judged = rows.mapInPandas(run, "id string, updated_at timestamp, logit double, provider string, model_used string")
    last = judged.groupBy("id").agg(F.max(F.struct("updated_at", "logit", "provider", "model_used")).alias("m"))
    return last.where("m.logit is not null").select("id", (1 / (1 + F.exp(-F.col("m.logit")))).alias("score"), F.col("m.provider").alias("provider"), F.col("m.model_used").alias("model_used"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scored(table(spark, d, "tasks")).where(F.col("score") > FOUND).select(F.col("id").alias("task_id"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each provider and model loses text."""
    lost = F.sum((F.col("score") > FOUND).cast("long"))
    return scored(table(spark, d, "tasks")).groupBy("provider", "model_used").agg(F.count("*").alias("n_outputs"), lost.alias("n_lost"), F.round(lost / F.count("*"), 6).alias("rate"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
SQL: dict[str, str] = {}
