"""Secret scans by grammar inference.

From labelled credentials, a prefix tree of character classes is built for each format; states whose continuations
are statistically compatible are merged (the ALERGIA test, Hoeffding bounds), which gives a probabilistic automaton.
Every candidate token of a text gets its log likelihood under the best automaton, against a plain character model of
candidates that aren't credentials; tokens that a format explains much better are spans, besides the spans that three
fixed patterns find.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import docs_of, lean, masked, raw, tune

#: Fixed patterns of the base kinds, in their listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
ASSIGN_LEAST = 12

#: What the automata judge: tokens of credential characters, long enough for a credential.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
_START, _END = re.compile(r"(?<=[+/_=-])[A-Za-z0-9]"), re.compile(r"(?<=[A-Za-z0-9])[/=]|(?<=[A-Za-z0-9])(?=[+/_=-]*$)")


# --- automata ---------------------------------------------------------------------------------------------------


@dataclass
class _Node:
    """A state: how many tokens came by, how many by each symbol, and how many symbols were left to each one's end."""

    n: int = 0
    next: dict[str, int] = field(default_factory=dict)
    hits: dict[str, int] = field(default_factory=dict)
    left: dict[int, int] = field(default_factory=dict)


_CLASS = str.maketrans(string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)


def _classes(token: str) -> str:
    """A token by classes: a lower, A upper, 0 digit, others as they are."""
    return token.translate(_CLASS)


class Automaton:
    """A probabilistic automaton inferred from labelled tokens of one format.

    Symbols are character classes, but for characters that the format fixes: those that ``fixed`` of the tokens have
    at that place. States of the prefix tree are merged if what follows them is compatible: how often each symbol
    comes next (Hoeffding bounds), how many symbols are left to the end (Kolmogorov and Smirnov's test), and so on
    behind each symbol. So lengths that a format fixes survive the merging. Of compatible states, a state joins the one
    whose symbols left are most alike.
    """

    def __init__(self, tokens: list[str], alpha: float = 0.05, fixed: float = 0.2):
        at: dict[tuple[int, str], int] = {}
        for t in tokens:
            for i, c in enumerate(t):
                at[i, c] = at.get((i, c), 0) + 1
        self.fixed = {k for k, n in at.items() if k[1].isalnum() and n >= fixed * len(tokens)}
        self.reach = 1 + max((i for i, _ in self.fixed), default=-1)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.nodes = [_Node()]
        for t in sorted(tokens):
            at_ = 0
            symbols = self.symbols(t)
            for i, s in enumerate(symbols):
                self._visit(at_, len(symbols) - i)
                node = self.nodes[at_]
                node.hits[s] = node.hits.get(s, 0) + 1
                if s not in node.next:
                    node.next[s] = len(self.nodes)
                    self.nodes.append(_Node())
                at_ = node.next[s]
            self._visit(at_, 0)
        self._merge()
        self.states = sorted(self._reached())
        self.kinds = {s for x in self.states for s in self.nodes[x].hits}

    def _visit(self, at: int, left: int) -> None:
        node = self.nodes[at]
        node.n += 1
        node.left[left] = node.left.get(left, 0) + 1

    def symbols(self, token: str) -> str:
        """A token's classes, and the characters that the format fixes."""
        rest = _classes(token)
        if not self.reach:
            return rest
        # A fixed letter or digit is told apart from a class mark by a shift.
        head = [chr(ord(c) + 0x100) if (i, c) in self.fixed else rest[i] for i, c in enumerate(token[: self.reach])]
        return "".join(head) + rest[self.reach :]

    def _differ(self, a: _Node, b: _Node) -> bool:
        if not a.n or not b.n:
            return False
        bound = self.bound * (1 / math.sqrt(a.n) + 1 / math.sqrt(b.n))
        return self._apart(a, b) > bound or any(abs(a.hits.get(s, 0) / a.n - b.hits.get(s, 0) / b.n) > bound for s in a.hits.keys() | b.hits.keys())

    @staticmethod
    def _apart(a: _Node, b: _Node) -> float:
        """Largest difference of the distributions of symbols left."""
        most = x = y = 0.0
        for k in sorted(a.left.keys() | b.left.keys()):
            x, y = x + a.left.get(k, 0) / a.n, y + b.left.get(k, 0) / b.n
            most = max(most, abs(x - y))
        return most

    def _compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in met or x == y:
                continue
            met.add((x, y))
            p, q = self.nodes[x], self.nodes[y]
            if self._differ(p, q):
                return False
            todo += [(p.next[s], q.next[s]) for s in p.next.keys() & q.next.keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Merge the tree under b into a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            p, q = self.nodes[x], self.nodes[y]
            p.n += q.n
            for mine, its in ((p.hits, q.hits), (p.left, q.left)):
                for s, k in its.items():
                    mine[s] = mine.get(s, 0) + k
            for s, y2 in q.next.items():
                if s in p.next:
                    todo.append((p.next[s], y2))
                else:
                    p.next[s] = y2

    def _merge(self) -> None:
        red, blue = [0], [(0, s) for s in sorted(self.nodes[0].next)]
        while blue:
            # The state that most tokens reach comes first: its statistics say most.
            parent, s = max(blue, key=lambda x: (self.nodes[self.nodes[x[0]].next[x[1]]].n, x))
            child = self.nodes[parent].next[s]
            near = sorted((self._apart(self.nodes[r], self.nodes[child]), r) for r in red)
            for _, r in near:
                if self._compatible(r, child):
                    self.nodes[parent].next[s] = r
                    self._fold(r, child)
                    break
            else:
                red.append(child)
            inside = set(red)
            blue = [(r, x) for r in red for x in sorted(self.nodes[r].next) if self.nodes[r].next[x] not in inside]

    def _reached(self) -> set[int]:
        todo, met = [0], set()
        while todo:
            x = todo.pop()
            if x not in met:
                met.add(x)
                todo += self.nodes[x].next.values()
        return met

    def log_likelihoods(self, token: str) -> list[float]:
        """Of each beginning of a token, the empty one first, the natural log of its probability as a whole token.

        What a state never saw, ends too, gets a small share: a symbol of the format goes where most go from there;
        with any other symbol, the token isn't of the format.
        """
        node, path, out = self.nodes[0], 0.0, []
        for s in self.symbols(token):
            out.append(path + math.log((node.left.get(0, 0) + 0.01) / (node.n + 1.0)))
            hits = node.hits.get(s, 0)
            path += math.log((hits + 0.01) / (node.n + 1.0))
            if not hits:
                if s not in self.kinds or not node.next:
                    return out + [-math.inf] * (len(token) + 1 - len(out))
                s = max(node.next, key=lambda x, h=node.hits: (h[x], x))
            node = self.nodes[node.next[s]]
        return [*out, path + math.log((node.left.get(0, 0) + 0.01) / (node.n + 1.0))]


# --- labelled tokens --------------------------------------------------------------------------------------------

_AN, _B64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"


def labelled_credentials(each: int = 300, seed: int = 11) -> dict[str, list[str]]:
    """Made-up credentials by format, drawn from each format's public rule."""
    r = random.Random(seed)
    of = lambda chars, n: "".join(r.choices(chars, k=n))
    rules = {
        "github": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + of(_AN, 36),
        "slack": lambda: "xoxb-" + of(string.digits, 12) + "-" + of(string.digits, 12) + "-" + of(_AN, 24),
        "google": lambda: "AIza" + of(_AN + "-_", 35),
        "stripe": lambda: r.choice(["sk_live_", "sk_test_"]) + of(_AN, 24),
        "jwt": lambda: "eyJ" + of(_AN, r.randint(33, 40)),
        "aws_secret": lambda: of(_B64, 40),
        "sendgrid": lambda: "SG" + of(_AN + "-_", 64),
        "gitlab": lambda: "glpat-" + of(_AN + "-_", 20),
    }
    return {k: [f() for _ in range(each)] for k, f in rules.items()}


def labelled_others(each: int = 400, seed: int = 12) -> list[str]:
    """Long tokens that aren't credentials: paths, identifiers, dates, capitals, numbers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshrdlucmfwyp", k=r.randint(2, 9)))
    rules = [
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 999)),
        lambda: "".join(word().title() for _ in range(r.randint(3, 5))),
        lambda: "_".join([*(word() for _ in range(3)), str(r.randint(0, 99))]),
        lambda: "-".join(word() for _ in range(4)) + str(r.randint(1900, 2030)),
        lambda: "".join(word() for _ in range(4)).upper() + word(),
        lambda: "".join(r.choices(string.digits, k=r.randint(16, 24))),
    ]
    return [f for rule in rules for f in (rule() for _ in range(each)) if len(f) >= 16]


class Formats:
    """Automata of all formats, and the character model of other tokens."""

    def __init__(self, credentials: dict[str, list[str]], others: list[str], threshold: float = 8.0):
        self.automata = {k: Automaton(v) for k, v in sorted(credentials.items())}
        self.threshold = threshold
        self.longest = max((len(t) for v in credentials.values() for t in v), default=0)
        self.n: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], int] = {}
        for t in others:
            c = "^" + _classes(t) + "$"
            for a, b in zip(c, c[1:], strict=False):
                self.n[a] = self.n.get(a, 0) + 1
                self.pairs[a, b] = self.pairs.get((a, b), 0) + 1

    def _pair(self, a: str, b: str) -> float:
        return math.log((self.pairs.get((a, b), 0) + 0.5) / (self.n.get(a, 0) + 4))

    def others(self, token: str) -> list[float]:
        """Log likelihood of each beginning of a token under the model of other tokens."""
        path, last, out = 0.0, "^", []
        for c in _classes(token):
            out.append(path + self._pair(last, "$"))
            path, last = path + self._pair(last, c), c
        return [*out, path + self._pair(last, "$")]

    def scores(self, token: str) -> list[float]:
        """Of each beginning of a token, the log likelihood ratio of the best format against other tokens."""
        best = [max(x) for x in zip(*(a.log_likelihoods(token) for a in self.automata.values()), strict=True)]
        return [x - y for x, y in zip(best, self.others(token), strict=True)]

    def score(self, token: str) -> tuple[float, str]:
        """Log likelihood ratio of the best format against other tokens, and that format."""
        best = max((a.log_likelihoods(token)[-1], k) for k, a in self.automata.items())
        return best[0] - self.others(token)[-1], best[1]

    def spans(self, run: str) -> list[tuple[int, int]]:
        """The best spans of a run that don't overlap. The whole run is judged, trimmed of separators behind it or not;
        and what begins with it or behind a separator in it and ends with it, trimmed or not, or at '=' or '/', within
        twice the longest labelled credential."""
        starts = [0, *(m.start() for m in _START.finditer(run))]
        last = {len(run), len(run.rstrip("+/_=-"))}
        ends = sorted(last | {m.start() for m in _END.finditer(run)})
        scored = []
        for s in starts:
            reach = s + 2 * self.longest
            at = ends[bisect_left(ends, s + LEAST) : bisect_right(ends, reach)]
            at += [e for e in last if not s and e > reach]
            if at:
                x = self.scores(run[s : max(at)])
                scored += [(-x[e - s], s, e) for e in at if x[e - s] >= self.threshold]
        out: list[tuple[int, int]] = []
        for _, s, e in sorted(scored):
            i = bisect_left(out, (s, e))
            if (not i or out[i - 1][1] <= s) and (i == len(out) or e <= out[i][0]):
                out.insert(i, (s, e))
        return out


@lru_cache(maxsize=2)
def default_formats() -> Formats:
    return Formats(labelled_credentials(), labelled_others())


# --- scanning ---------------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by code point, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _covered(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether base spans (by start) cover all of a span together."""
    for s, _, e in base:
        if s > start:
            break
        start = max(start, e)
    return start >= end


def format_spans(text: str, formats: Formats, base: list[tuple[int, int, int]], seen: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Spans of candidates that a format explains and that base spans don't cover whole."""
    out = []
    for m in CANDIDATE.finditer(text):
        t = m.group()
        if t not in seen:
            if len(seen) > 20_000:
                seen.clear()
            seen[t] = formats.spans(t)
        out += [(m.start() + s, 3, m.start() + e) for s, e in seen[t] if not _covered(m.start() + s, m.start() + e, base)]
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, one mark."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


_COLUMNS = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("n_format", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def _scan(formats: Formats | None):
    def run(batches):
        f = formats or default_formats()
        seen: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            rows = []
            for t in raw(b.column("text")):
                text = t.decode("utf-8", "replace")
                base = base_spans(text)
                more = format_spans(text, f, base, seen)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*count, len(more), hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *[k for k, _ in _COLUMNS]])

    return run


def secret_spans(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """Per document: counts of base spans by kind, a digest of them, and all spans as kind:start:end.

    Offsets are code points, ends exclusive. Null text is empty. Repeated rows are scanned each. Only doc_id and
    text are read. ``formats`` holds automata inferred from one's own labelled credentials.
    """
    tune(docs.sparkSession)
    d = docs_of(docs, "doc_id", "text")
    return d.mapInArrow(lean("secrets", _scan(formats)), T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(k, t) for k, t in _COLUMNS]]))


def _redactor(column: str, formats: Formats | None):
    def run(batches):
        f = formats or default_formats()
        seen: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            i = b.schema.get_field_index(column)
            out = []
            for t, null in zip(raw(b.column(i)), b.column(i).is_null().to_pylist(), strict=True):
                text = t.decode("utf-8", "replace")
                base = base_spans(text)
                spans = sorted(base + format_spans(text, f, base, seen))
                out.append(None if null else redact(text, spans) if spans else text)
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    return run


def redact_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """The documents with their secrets replaced by marks; all columns and rows stay, repeated ones too, null text stays
    null. Columns of any names pass through; without a text column nothing changes. An empty table gives no rows."""
    tune(docs.sparkSession)
    d, at = masked(docs)
    if "text" not in at:
        return docs
    return d.mapInArrow(lean("secrets", _redactor(at["text"], formats)), d.schema).toDF(*docs.columns)
