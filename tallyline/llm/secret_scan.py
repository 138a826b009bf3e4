"""Secret scans: base patterns, and spans whose format a probabilistic automaton, inferred from labelled credentials by merging states of their prefix tree, makes likely."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, each_batch, take

KINDS = ("assign", "access", "hex")
ADDED = "secret"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: (kind, pattern, group whose characters count, the least of them).
_BASE = (("assign", _ASSIGN, 1, 12), ("access", _ACCESS, 0, 18), ("hex", _HEX, 0, 16))

#: A candidate is a whole run of these characters without marks at its ends, of at least CANDIDATE characters.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
CANDIDATE = 12
_BEFORE, _AFTER = "+/_.=-", "+/_.-"

#: Fitting: labelled credentials are up to CREDENTIALS values of base patterns in, and ordinary ones up to ORDINARY other runs of,
#: at most TEXTS texts of up to MAX_CHARS characters, the first by a hash of the id; and MADE examples of each public format and
#: of each ordinary shape. An example counts with its first SYMBOLS symbols.
CREDENTIALS, ORDINARY, TEXTS, MAX_CHARS, MADE, SYMBOLS = 1000, 4000, 2000, 50_000, 120, 96
#: A start that this share of the labelled examples has, and no longer one, counts character by character; all others by class.
SHARED = 0.03
#: Two states are compatible if no frequency of one differs from the other's beyond the Hoeffding bound of this confidence; states seen
#: less often than LEAST don't decide, but join what they are most like.
ALPHA, LEAST = 0.05, 10
#: A symbol that a state never showed has this weight, shared by the symbols known.
SMOOTH = 0.5
#: A candidate is a secret if its log odds against ordinary runs, with the prior, are at least MARGIN, and it has DISTINCT different characters.
PRIOR, MARGIN, DISTINCT = -7.0, 3.0, 6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind."""
    found = [(kind, *m.span()) for kind, rx, group, least in _BASE for m in rx.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> Iterable[tuple[int, int]]:
    """(start, end) of the runs that may be credentials."""
    for m in _RUN.finditer(text):
        run = m.group()
        a = m.start() + len(run) - len(run.lstrip(_BEFORE))
        b = m.end() - len(run) + len(run.rstrip(_AFTER))
        if b - a >= CANDIDATE:
            yield a, b


_CLASSES = {"a": "abcdef", "z": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}
_CLASS = {c: k for k, cs in _CLASSES.items() for c in cs}


class Alphabet:
    """Symbols of a run: single characters for a start that many examples share, classes of characters for the rest."""

    def __init__(self, examples: list[str], share: float = SHARED):
        shared: set[str] = set()
        layer = {""} if examples else set()
        while layer:
            width = len(next(iter(layer))) + 1
            counts = Counter(e[:width] for e in examples if len(e) >= width and e[: width - 1] in layer)
            layer = {p for p, n in counts.items() if n >= share * len(examples)}
            shared |= layer
        self.starts = shared - {p[:-1] for p in shared}
        self.longest = max(map(len, self.starts), default=0)

    def start(self, run: str) -> int:
        """Characters of the shared start, 0 without one."""
        return next((k for k in range(min(self.longest, len(run)), 0, -1) if run[:k] in self.starts), 0)

    def symbols(self, run: str, start: int = 0) -> list[str]:
        return [f"={c}" for c in run[:start]] + [_CLASS.get(c, c) for c in run[start:]]


class Automaton:
    """A deterministic probabilistic automaton: counts of arrivals, ends and symbols of each state."""

    def __init__(self):
        self.n: list[int] = []
        self.ends: list[int] = []
        self.next: list[dict[str, int]] = []
        self.seen: list[dict[str, int]] = []

    def _state(self) -> int:
        self.n.append(0)
        self.ends.append(0)
        self.next.append({})
        self.seen.append({})
        return len(self.n) - 1

    @classmethod
    def prefix_tree(cls, examples: Iterable[list[str]]) -> Automaton:
        """A state for each prefix of the examples."""
        self = cls()
        self._state()
        for symbols in examples:
            q = 0
            self.n[q] += 1
            for s in symbols:
                if s not in self.next[q]:
                    self.next[q][s] = self._state()
                self.seen[q][s] = self.seen[q].get(s, 0) + 1
                q = self.next[q][s]
                self.n[q] += 1
            self.ends[q] += 1
        return self

    def _distance(self, p: int, q: int, bound: float) -> float | None:
        """Half the sum of the differences of two states' frequencies; None if one is beyond the bound."""
        total = 0.0
        limit = bound * (1 / math.sqrt(self.n[p]) + 1 / math.sqrt(self.n[q]))
        for f, g in ((self.ends[p], self.ends[q]), *((self.seen[p].get(s, 0), self.seen[q].get(s, 0)) for s in self.seen[p].keys() | self.seen[q].keys())):
            d = abs(f / self.n[p] - g / self.n[q])
            if d > limit:
                return None
            total += d
        return total / 2

    def compatible(self, p: int, q: int, alpha: float = ALPHA, least: int = LEAST) -> float | None:
        """How unlike two states are, if neither they nor, as far as both go on, the states after them differ beyond the bound; else None."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        first = self._distance(p, q, bound)
        if first is None:
            return None
        pairs, met = [(p, q)], {(p, q)}
        while pairs:
            a, b = pairs.pop()
            for s in self.next[a].keys() & self.next[b].keys():
                pair = (self.next[a][s], self.next[b][s])
                if pair not in met and min(self.n[pair[0]], self.n[pair[1]]) >= least:
                    met.add(pair)
                    if self._distance(*pair, bound) is None:
                        return None
                    pairs.append(pair)
        return first

    def _fold(self, p: int, q: int) -> None:
        """Add the tree at q to state p."""
        pairs = [(p, q)]
        while pairs:
            a, b = pairs.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for s, c in self.seen[b].items():
                self.seen[a][s] = self.seen[a].get(s, 0) + c
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    pairs.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def infer(self, alpha: float = ALPHA, least: int = LEAST) -> Automaton:
        """Merge compatible states of the prefix tree: of the states that follow settled ones the one seen most either joins the settled state it is most like, or settles itself."""
        settled = [0]
        while True:
            fringe = {(self.n[t], -t): (q, s, t) for q in settled for s, t in self.next[q].items() if t not in set(settled)}
            if not fringe:
                return self._trimmed(settled)
            q, s, t = fringe[max(fringe)]
            scored = [(d, r) for r in settled if (d := self.compatible(r, t, alpha, least)) is not None]
            if not scored and self.n[t] < least:
                scored = [(1.0, q)]
            if scored:
                into = min(scored)[1]
                self.next[q][s] = into
                self._fold(into, t)
            else:
                settled.append(t)

    def _trimmed(self, states: list[int]) -> Automaton:
        out, place = Automaton(), {q: k for k, q in enumerate(states)}
        for q in states:
            k = out._state()
            out.n[k], out.ends[k], out.seen[k] = self.n[q], self.ends[q], self.seen[q]
            out.next[k] = {s: place[t] for s, t in self.next[q].items()}
        out.settle()
        return out

    def settle(self) -> None:
        """Log chances: of symbols and the end in each state, and over all states for what leaves the automaton."""
        total: dict[str, int] = {}
        for seen in self.seen:
            for s, c in seen.items():
                total[s] = total.get(s, 0) + c
        whole, self.known = sum(total.values()) + sum(self.ends), len(total) + 2
        chance = lambda c, n: math.log((c + SMOOTH / self.known) / (n + SMOOTH))
        self.any = {s: chance(c, whole) for s, c in total.items()}
        self.any_end, self.stranger = chance(sum(self.ends), whole), chance(0, whole)
        self.log = [{s: chance(c, n) for s, c in seen.items()} for seen, n in zip(self.seen, self.n, strict=True)]
        self.log_end = [chance(e, n) for e, n in zip(self.ends, self.n, strict=True)]
        self.log_new = [chance(0, n) for n in self.n]

    def likelihood(self, symbols: list[str]) -> float:
        """Log chance of the symbols and the end after them. After a symbol that its state never showed, the frequencies over all states count."""
        q, total = 0, 0.0
        for k, s in enumerate(symbols):
            if s not in self.next[q]:
                total += self.log_new[q]
                return total + sum(self.any.get(x, self.stranger) for x in symbols[k:]) + self.any_end
            total += self.log[q][s]
            q = self.next[q][s]
        return total + self.log_end[q]


def _drawn(rng: np.random.Generator, chars: str, n: int) -> str:
    return "".join(chars[int(i)] for i in rng.integers(0, len(chars), n))


_LOWER, _UPPER, _DIGITS, _HEXES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_ALNUM = _UPPER + _LOWER + _DIGITS
_URL64, _B64 = _ALNUM + "-_", _ALNUM + "+/"
#: Published formats of credentials, as pieces that are literal or (characters, number).
FORMATS = {
    "cloud access key": ("AKIA", (_UPPER + "234567", 16)),
    "cloud session key": ("ASIA", (_UPPER + "234567", 16)),
    "cloud secret key": ((_B64, 40),),
    "code host personal": ("ghp_", (_ALNUM, 36)),
    "code host server": ("ghs_", (_ALNUM, 36)),
    "code host access": ("glpat-", (_URL64, 20)),
    "chat bot": ("xoxb-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)),
    "payment live": ("sk_live_", (_ALNUM, 24)),
    "map service": ("AIza", (_URL64, 35)),
    "package index": ("npm_", (_ALNUM, 36)),
    "mail service": ("SG.", (_URL64, 22), ".", (_URL64, 43)),
    "signed claims": ("eyJ", (_URL64, 33), ".eyJ", (_URL64, 45), ".", (_URL64, 43)),
    "digest 32": ((_HEXES, 32),),
    "digest 40": ((_HEXES, 40),),
    "digest 64": ((_HEXES, 64),),
    "upper digest": (("0123456789ABCDEF", 32),),
    "basic 24": ((_B64, 22), "=="),
    "basic 44": ((_B64, 43), "="),
}


def made_credentials(n: int = MADE, seed: int = 5) -> list[tuple[str, str]]:
    """(format, credential): n of each published format."""
    rng = np.random.default_rng(seed)
    return [(name, "".join(p if isinstance(p, str) else _drawn(rng, *p) for p in parts)) for name, parts in FORMATS.items() for _ in range(n)]


def made_ordinary(n: int = MADE, seed: int = 6) -> list[tuple[str, str]]:
    """(shape, run): n of each shape that long runs in texts have without being secret: words, names, paths, hosts, dates, numbers, rules."""
    rng = np.random.default_rng(seed)
    size = lambda a, b: int(rng.integers(a, b))
    word = lambda: "".join(_drawn(rng, "bcdfghklmnprstvwz", 1) + _drawn(rng, "aeiou", 1) + _drawn(rng, "nrstl", size(0, 2)) for _ in range(size(1, 4)))
    shapes = {
        "word": lambda: "".join(word() for _ in range(size(2, 5))),
        "capitalised": lambda: "".join(word() for _ in range(size(2, 5))).capitalize(),
        "shouted": lambda: "".join(word() for _ in range(size(2, 4))).upper(),
        "camel": lambda: "".join(word().capitalize() for _ in range(size(2, 5))),
        "snake": lambda: "_".join(word() for _ in range(size(2, 5))),
        "constant": lambda: "_".join(word() for _ in range(size(2, 4))).upper(),
        "hyphens": lambda: "-".join(word() for _ in range(size(2, 5))),
        "path": lambda: "/".join(word() for _ in range(size(3, 6))) + "." + word()[:3],
        "host": lambda: ".".join(["www", *(word() for _ in range(size(1, 4))), "com"]),
        "page": lambda: "example.org/" + word() + "/" + str(size(1, 99999)) + "/" + word(),
        "date": lambda: f"20{size(10, 30)}-{size(1, 13):02}-{size(1, 29):02}T{size(0, 24):02}",
        "number": lambda: _drawn(rng, _DIGITS, size(12, 20)),
        "groups": lambda: "-".join(_drawn(rng, _DIGITS, size(2, 5)) for _ in range(size(3, 6))),
        "version": lambda: f"{word()}-{size(0, 20)}.{size(0, 20)}.{size(0, 99)}",
        "rule": lambda: _drawn(rng, "-=_.", 1) * size(12, 80),
        "sum": lambda: "=".join([word(), word() + str(size(0, 999))]),
        "same": lambda: _drawn(rng, _ALNUM, 1) * size(12, 80),
        "words by dots": lambda: ".".join(word() for _ in range(size(2, 4))) + "...",
    }
    return [(name, make()) for name, make in shapes.items() for _ in range(n)]


class Scanner:
    """Two automata, of credentials (with their shared starts) and of ordinary runs (by classes alone)."""

    def __init__(self, credentials: list[str], ordinary: list[str], alpha: float = ALPHA, least: int = LEAST):
        self.alphabet = Alphabet(credentials)
        infer = lambda xs: Automaton.prefix_tree(x[:SYMBOLS] for x in xs).infer(alpha, least)
        self.secret = infer(self.alphabet.symbols(x, self.alphabet.start(x)) for x in credentials)
        self.plain = infer(map(self.alphabet.symbols, ordinary))

    def odds(self, run: str, prior: float = PRIOR) -> float:
        """Log odds that the run is a credential. Characters of a class are equally likely, so those of a start cost an ordinary run their class's size."""
        k = self.alphabet.start(run)
        spelled = sum(math.log(len(_CLASSES.get(_CLASS.get(c, ""), "."))) for c in run[:k])
        return prior + self.secret.likelihood(self.alphabet.symbols(run, k)) - self.plain.likelihood(self.alphabet.symbols(run)) + spelled

    def is_secret(self, run: str, margin: float = MARGIN, prior: float = PRIOR) -> bool:
        return len(set(run)) >= DISTINCT and self.odds(run, prior) >= margin

    def spans(self, text: str, margin: float = MARGIN, prior: float = PRIOR) -> tuple[list, list]:
        """(base spans, those and the added ones, which overlap none of them), by start, then kind."""
        base = base_spans(text)
        free = iter(sorted((a, b) for _, a, b in base))
        added, held, far = [], next(free, None), 0
        for a, b in candidates(text):
            while held is not None and held[0] < b:
                far, held = max(far, held[1]), next(free, None)
            if a >= far and self.is_secret(text[a:b], margin, prior):
                added.append((ADDED, a, b))
        order = (*KINDS, ADDED)
        return base, sorted([*base, *added], key=lambda s: (s[1], order.index(s[0])))


def labelled(texts: list[str], credentials: int = CREDENTIALS, ordinary: int = ORDINARY) -> tuple[list[str], list[str]]:
    """(values of base patterns, other runs) of the texts: distinct ones, the first by a hash."""
    good, rest = set(), set()
    for text in texts:
        base = base_spans(text)
        for kind, a, b in base:
            run = _ASSIGN.match(text, a).group(1).rstrip(_AFTER) if kind == "assign" else text[a:b]
            if not run.isdigit():  # a long number is hex by its characters, and no sign of a credential
                good.add(run)
        rest |= {text[a:b] for a, b in candidates(text) if all(b <= x or a >= y for _, x, y in base)}
    first = lambda xs, n: sorted(xs, key=lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest())[:n]
    return first(good, credentials), first(rest, ordinary)


def fit(rows: DataFrame, texts: int = TEXTS, made: int = MADE) -> Scanner:
    """Inferred from a bounded sample of (doc_id, text) and made examples. Ids are chosen first, so what tasks send to be sorted holds no texts; of rows that repeat an id the least text counts."""
    usable = rows.where(F.length("text").between(1, MAX_CHARS) & F.col("doc_id").isNotNull())
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    sample = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    found, rest = labelled([r["text"] for r in sorted(sample, key=lambda r: r["doc_id"])])
    return Scanner([*(x for _, x in made_credentials(made)), *found], [*(x for _, x in made_ordinary(made)), *rest])


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [SECRET] in the place of each span; spans that overlap are one."""
    out, at = [], 0
    for _, a, b in spans:
        if b > at:
            out += [text[at:a], "[SECRET]"] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def _written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, redacted; a row for each input row.

    Places are code points, of whole matches. The n_ columns and base_sha256 are those of the base patterns; spans has also the runs that
    the automaton of credentials makes likelier, by `margin`, than that of ordinary runs, as kind secret; these overlap no
    base span. Null text counts as empty: no spans. A text is scanned once, whole, however long a run in it is. Without a
    scanner one is inferred from a bounded sample of the rows and made examples. Rows never meet, so repeats need no rule.
    """
    rows = take(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(scanner or fit(rows))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        found = [shared.value.spans(t, margin) for t in texts]
        out = {"doc_id": batch.column("doc_id")} | {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
        return out | {"spans": [_written(s) for _, s in found], "redacted": [redact(t, s) for t, (_, s) in zip(texts, found, strict=True)]}

    return each_batch(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).drop("redacted")
