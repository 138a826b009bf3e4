"""PII: base patterns, and a character BiLSTM with CRF transitions that reads whole texts and adds spans of other spellings."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, each_batch, take

KINDS = ("email", "ip", "card", "phone")
#: What the network labels: the kinds, and secret tokens such as access keys, which no base pattern has.
ALL_KINDS = (*KINDS, "secret")
TAGS = ["O"] + [f"{p}-{k}" for k in ALL_KINDS for p in "BI"]

#: Window of the network and how many characters neighbouring windows share.
WINDOW, OVERLAP = 512, 48
#: Windows that are run at once, and characters of the texts that are read together.
AT_ONCE, CHARS_AT_ONCE = 512, 400_000
HIDDEN = 10
#: The network is trained on windows of TRAIN_WINDOW characters: of at most TEXTS texts of up to MAX_CHARS characters, the first by
#: a hash of the id, as many with a digit or @ as without, at most PER_TEXT windows of each; and of MADE made examples.
TEXTS, MAX_CHARS, PER_TEXT, MADE, TRAIN_WINDOW = 600, 20_000, 3, 3000, 96
EPOCHS, BATCH, RATE = 12, 96, 0.03
#: A span is added only if the path with it scores so much more than the path without it: the log of its odds.
MARGIN_SCORE = 3.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
#: Signs and words that stand for @ and the dot in written-out addresses.
_AT_SIGN = re.compile(r"[ ]?[(\[{<]?[ ]?(?:@|\b[aA][tT]\b)[ ]?[)\]}>]?[ ]?")
_DOT = r"[ ]?[(\[{<]?[ ]?\b[dD][oO][tT]\b[ ]?[)\]}>]?[ ]?"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*")
_DOT_SIGN = re.compile(rf"\.|{_DOT}")
_DOT_BEFORE = re.compile(rf"[A-Za-z0-9_%+-]+{_DOT}$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """What makes a number one of its kind and characters don't show: a card's check digit, an address's parts up to 255, a phone's number of digits."""
    plain = unicodedata.normalize("NFKC", text)
    digits = "".join(_DIGIT.findall(plain))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", plain)
        return len(parts) == 4 and all(len(p) < 10 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost e-mail addresses: for each @ with a domain, the longest local part before it. Linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start; matches that fail their check are dropped, not tried again."""
    if not _SEED.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(kind, m.group())]
    return out


def _classes() -> np.ndarray:
    """The network's class of each code point below U+10000: ASCII and its full-width forms by character, then other letters, signs and spaces."""
    out = np.full(0x10000, 130, np.uint8)
    for c in range(0x10000):
        if c < 128:
            out[c] = c
        elif 0xFF01 <= c <= 0xFF5E:
            out[c] = c - 0xFEE0
        else:
            kind = unicodedata.category(chr(c))
            out[c] = 128 if kind[0] in "LM" else 48 + unicodedata.digit(chr(c)) if kind == "Nd" else 131 if kind[0] == "Z" else 130
    return out


_CLASS = _classes()
PAD, N_CLASSES = 129, 132


def codes(text: str) -> np.ndarray:
    """Classes of a text's code points."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)]


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the activation in place of tanh; a gate is half of it and a half."""
    return x / (1 + np.abs(x))


class Network:
    """Two LSTMs over characters with soft gates, a linear layer and CRF transitions, all in numpy."""

    def __init__(self, seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        k, h = len(TAGS), hidden
        self.h = h
        self.p = {f"{n}{d}": rng.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (("x", 0.5, (N_CLASSES, 4 * h)), ("u", 1.5 / h**0.5, (h, 4 * h)))}
        for d in "fb":
            self.p[f"x{d}"][:, h : 2 * h] += 2  # forget little at first
        self.p |= {"o": rng.normal(0, 0.5, (2 * h, k)).astype(np.float32), "c": np.zeros(k, np.float32), "t": rng.normal(0, 0.1, (k, k)).astype(np.float32)}
        self.p["c"][0] = 1
        self.barred = np.zeros((k, k), np.float32)
        for i, a in enumerate(TAGS):
            for j, b in enumerate(TAGS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.barred[i, j] = -1e4
        self.first = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: (steps, batch) classes. Hidden states of each step, and what the backward pass needs."""
        n, b, h = len(x), x.shape[1], self.h
        table, u = self.p[f"x{d}"], self.p[f"u{d}"]
        out, state, cell, saved = np.empty((n, b, h), u.dtype), np.zeros((b, h), u.dtype), np.zeros((b, h), u.dtype), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a = soft(table[x[t]] + state @ u)
            gates = 0.5 + 0.5 * a[:, : 3 * h]
            before, cell = cell, gates[:, h : 2 * h] * cell + gates[:, :h] * a[:, 3 * h :]
            tc = soft(cell)
            saved.append((t, state, before, a, gates, tc))
            state = gates[:, 2 * h :] * tc
            out[t] = state
        return out, saved

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of tags y and its gradient; x, y: (steps, batch)."""
        n, b, h, k = len(x), x.shape[1], self.h, len(TAGS)
        (hf, sf), (hb, sb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([hf, hb], 2)
        e = both @ self.p["o"] + self.p["c"]
        trans = self.p["t"] + self.barred
        # sums of exponentials, scaled at each step
        big = np.exp(trans)
        top = e.max(2, keepdims=True)
        ee = np.exp(e - top)
        alpha, beta, scale = np.empty_like(ee), np.ones_like(ee), np.empty((n, b, 1), ee.dtype)
        now = ee[0] * np.exp(self.first)
        for t in range(n):
            if t:
                now = (alpha[t - 1] @ big) * ee[t]
            scale[t] = now.sum(1, keepdims=True)
            alpha[t] = now / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = ((ee[t + 1] * beta[t + 1]) @ big.T) / scale[t + 1]
        z = (np.log(scale) + top).sum(0)[:, 0]
        steps, cols = np.arange(n)[:, None], np.arange(b)
        gold = e[steps, cols, y].sum(0) + self.first[y[0]] + trans[y[:-1], y[1:]].sum(0)
        de = alpha * beta
        de[steps, cols, y] -= 1
        de /= b
        right = ee[1:] * beta[1:] / scale[1:]
        dt = (alpha[:-1].reshape(-1, k).T @ right.reshape(-1, k)) * big
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1)
        grads = {"o": both.reshape(-1, 2 * h).T @ de.reshape(-1, k), "c": de.sum((0, 1)), "t": dt / b}
        dh = de @ self.p["o"].T
        half = lambda a: 0.5 * (1 - np.abs(a)) ** 2
        for d, saved, part in (("f", sf, dh[:, :, :h]), ("b", sb, dh[:, :, h:])):
            u = self.p[f"u{d}"]
            du = np.zeros_like(u)
            ds, dc, dzs = np.zeros((b, h), u.dtype), np.zeros((b, h), u.dtype), np.empty((n, b, 4 * h), u.dtype)
            for t, state, before, a, gates, tc in reversed(saved):
                ds = ds + part[t]
                dc = dc + ds * gates[:, 2 * h :] * (1 - np.abs(tc)) ** 2
                dz = np.concatenate([dc * a[:, 3 * h :], dc * before, ds * tc, dc * gates[:, :h] * 2], 1) * half(a)
                dzs[t] = dz
                du += state.T @ dz
                ds, dc = dz @ u.T, dc * gates[:, h : 2 * h]
            dx = np.zeros_like(self.p[f"x{d}"])
            order = np.argsort(x, axis=None, kind="stable")
            first = np.flatnonzero(np.diff(x.ravel()[order], prepend=-1))
            dx[x.ravel()[order][first]] = np.add.reduceat(dzs.reshape(-1, 4 * h)[order], first)
            grads[f"x{d}"], grads[f"u{d}"] = dx, du
        return float((z - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; x, y: (examples, steps). The losses of the epochs."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                loss, grads = self.gradient(x[at].T.astype(np.int64), y[at].T)
                total += loss * len(at)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-6))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= RATE * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            losses.append(total / max(1, len(x)))
        return losses

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """Hidden states (steps, hidden, batch) without what training needs; the batch lies along the rows."""
        n, b, h = len(x), x.shape[1], self.h
        table, u = np.ascontiguousarray(self.p[f"x{d}"].T), np.ascontiguousarray(self.p[f"u{d}"].T)
        out = np.empty((n, h, b), np.float32)
        state, cell, part = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32), np.empty((h, b), np.float32)
        z, size = np.empty((4 * h, b), np.float32), np.empty((4 * h, b), np.float32)
        gates, forget, give, new = z[: 3 * h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            np.matmul(u, state, out=z)
            z += table.take(x[t], axis=1, out=size, mode="clip")
            np.abs(z, out=size)
            size += 1
            z /= size
            gates *= 0.5
            gates += 0.5
            cell *= forget
            np.multiply(z[:h], new, out=part)
            cell += part
            np.abs(cell, out=part)
            part += 1
            np.divide(cell, part, out=part)
            state = np.multiply(give, part, out=out[t])
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(steps, batch, tags) of x: (steps, batch) classes."""
        e = np.matmul(self._states(x, "f").transpose(0, 2, 1), self.p["o"][: self.h])
        e += np.matmul(self._states(x, "b").transpose(0, 2, 1), self.p["o"][self.h :])
        e += self.p["c"]
        return e

    def scores(self, parts: list[np.ndarray], window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
        """Emissions (characters of all texts, tags): those of overlapping windows, which give way to each other evenly where they overlap."""
        at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
        text = np.concatenate([*parts, np.full(window, PAD, np.uint8)]).astype(np.intp)
        stride = window - overlap
        cut: list[tuple[int, int, bool, bool]] = []  # start, size, whether it is a text's first and last
        for a, x in zip(at[:-1].tolist(), parts, strict=True):
            k = max(1, -(-(len(x) - overlap) // stride)) if len(x) else 0
            cut += [(a + i * stride, min(window, len(x) - i * stride), i == 0, i == k - 1) for i in range(k)]
        cut.sort(key=lambda c: -c[1])  # windows of like size run together
        out = np.zeros((at[-1], len(TAGS)), np.float32)
        rise = ((np.arange(1, overlap + 1, dtype=np.float32) - 0.5) / max(1, overlap))[:, None, None]
        steps = np.arange(window)[:, None]
        for i in range(0, len(cut), AT_ONCE):
            part = cut[i : i + AT_ONCE]
            starts, sizes, begins, ends = (np.array(c) for c in zip(*part, strict=True))
            used = int(sizes.max())
            x = text[starts + steps[:used]]
            x[steps[:used] >= sizes] = PAD
            e = self.emissions(x)
            e[:overlap, ~begins] *= rise[:used]
            e[stride:, ~ends] *= rise[::-1][: max(0, used - stride)]
            for j, (a, n, _, _) in enumerate(part):
                out[a : a + n] += e[:n, j]
        return out

    def bounds(self) -> list[tuple[float, float, float]]:
        """For each kind the most that moves into a span, within it and out of it can gain over moves from O to O."""
        trans, outer = self.p["t"] + self.barred, [0, *range(1, len(TAGS), 2)]
        found = []
        for b in range(1, len(TAGS), 2):
            into = float((trans[:, b] - trans[:, 0]).max())
            inner = float(max(trans[b, b + 1], trans[b + 1, b + 1]) - trans[0, 0])
            away = float((trans[b : b + 2, outer] - trans[0, outer]).max())
            found.append((max(0.0, into), inner, max(0.0, away)))
        return found

    def candidates(self, e: np.ndarray, sizes: list[int], margin: float) -> np.ndarray:
        """(kinds, characters of all texts): where a span of the kind may gain more than the margin; elsewhere surely none does.

        A span from a to b gains over none: its emissions less those of O, its inner moves less those from O to O, and at
        most the best way in and out of it. A fall between texts keeps a span from reaching over it.
        """
        edges = np.cumsum(sizes)[:-1]
        out = np.zeros((len(ALL_KINDS), len(e)), bool)
        e = np.ascontiguousarray(e.T)
        for k, (into, inner, away) in enumerate(self.bounds()):
            grown = e[2 + 2 * k] - e[0]
            grown += np.float32(inner)
            grown = np.cumsum(grown, dtype=np.float64)
            grown -= 1e5 * np.repeat(np.arange(len(sizes)), sizes) if len(edges) else 0.0
            left = np.maximum.accumulate(e[1 + 2 * k] - e[0] + into - grown)
            left += np.maximum.accumulate(grown[::-1])[::-1]
            np.greater(left, margin - away - 1e-2, out=out[k])
        return out

    def decode(self, e: np.ndarray, sizes: list[int], margin: float = MARGIN_SCORE) -> list[list[tuple[str, int, int, float]]]:
        """(kind, start, end, gain) of the spans of each text on its best path through all of it, of those that gain at least the margin.

        e: emissions of the texts one after another. Characters that no span of enough gain can cover are outside spans on
        the path, so only stretches of others are walked; with margin 0 that is the best of all paths.
        """
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in sizes]
        may = self.candidates(e, sizes, margin)
        firsts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        some = may.any(0).view(np.int8)
        turn = np.concatenate(([0], np.diff(some), [0])) != 0
        turn[0], turn[len(e)] = some[:1].any(), some[-1:].any()
        turn[firsts[:-1][some[np.minimum(firsts[:-1], len(e) - 1)] > 0] if len(e) else []] = True
        edges = np.append(np.flatnonzero(turn), len(e)).tolist()
        trans = (self.p["t"] + self.barred).tolist()
        texts = np.searchsorted(firsts, edges, side="right") - 1
        for a, b, doc in zip(edges[:-1], edges[1:], texts.tolist(), strict=False):
            if a == b or not some[a]:
                continue
            first, after = a == firsts[doc], b == firsts[doc + 1]
            kinds = np.flatnonzero(may[:, a:b].any(1)).tolist()
            outer = [0, *[1 + 2 * k for k in kinds]]
            tags = [*outer, *[2 + 2 * k for k in kinds]]
            rows = e[a:b].tolist()
            best = {t: rows[0][t] + (float(self.first[t]) if first else trans[0][t]) for t in tags}
            back: list[dict[int, int]] = []
            for row in rows[1:]:
                now, came = {}, {}
                for t in outer:
                    top, who = -1e30, 0
                    for u in tags:
                        v = best[u] + trans[u][t]
                        if v > top:
                            top, who = v, u
                    now[t], came[t] = top + row[t], who
                for t in tags[len(outer) :]:  # an inner tag follows its own kind only
                    x, y = best[t - 1] + trans[t - 1][t], best[t] + trans[t][t]
                    now[t], came[t] = (x + row[t], t - 1) if x >= y else (y + row[t], t)
                best = now
                back.append(came)
            t = max(tags, key=lambda t: (best[t] + (0.0 if after else trans[t][0]), -t))
            path = [t]
            for came in reversed(back):
                t = came[t]
                path.append(t)
            path = [*([] if first else [0]), *reversed(path), *([] if after else [0])]
            low = a if first else a - 1
            i = 0
            while i < len(path):
                if path[i] % 2 == 0:
                    i += 1
                    continue
                start, inner = i, path[i] + 1
                i += 1
                while i < len(path) and path[i] == inner:
                    i += 1
                gain = sum(rows[j + low - a][path[j]] - rows[j + low - a][0] for j in range(start, i))
                chain = [*path[max(0, start - 1) : i + 1]]
                gain += sum(trans[u][v] for u, v in zip(chain, chain[1:], strict=False))
                chain = [0 if start <= j < i else path[j] for j in range(max(0, start - 1), min(len(path), i + 1))]
                gain -= sum(trans[u][v] for u, v in zip(chain, chain[1:], strict=False))
                if gain >= margin:
                    found[doc].append((ALL_KINDS[(inner - 2) // 2], low + start - int(firsts[doc]), low + i - int(firsts[doc]), gain))
        return found


def tags_of(n: int, spans: list[tuple[str, int, int]], at: int = 0) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        a, b = max(0, a - at), min(n, b - at)
        if a < b and not y[a:b].any():
            y[a:b] = TAGS.index(f"I-{kind}")
            y[a] = TAGS.index(f"B-{kind}")
    return y


_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ghp_|sk-|xox[a-z]-)[A-Za-z0-9_-]{16,64})(?![A-Za-z0-9_-])")


def shaped(text: str) -> list[tuple[str, int, int]]:
    """What the network is to label: base spans, those that only fail a check that characters don't show, and secret tokens."""
    out = base_spans(text)
    taken = [(a, b) for _, a, b in out]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    more = [("ip", m.start(), m.end()) for m in _IP.finditer(text) if free(*m.span())]
    more += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if free(*m.span()) and 13 <= len(_DIGIT.findall(m.group())) <= 19]
    return out + more + [("secret", *m.span()) for m in _SECRET.finditer(text) if free(*m.span())]


def made_examples(n: int, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans in spellings beyond the base patterns, among words, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda chars, k: "".join(pick(chars) for _ in range(k))
    size = lambda a, b: int(rng.integers(a, b))
    digits = lambda k: draw("0123456789", k)
    name = lambda: draw("abcdefghijklmnopqrstuvwxyz", size(2, 10))
    word = lambda: pick(["at", "dot", "mail", "the", "tion", "der", "une", "los"]) if rng.random() < 0.15 else draw("aaeeiioourstnlmdcpghbéüñ", size(2, 11))
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c in "0123456789" else c for c in s)

    def card() -> str:
        ds, k = digits(16), pick(["", "-", " ", ".", "/", ""])
        return k.join(ds[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        out = pick([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(11)}"])
        return wide(out) if rng.random() < 0.15 else out

    def ip() -> str:
        return pick([".", ".", ".", "[.]", " . "]).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def email() -> str:
        local = f"{name()}{pick(['', '.', '_', '-'])}{pick(['', digits(2), name(), name()])}"
        parts = [name() + pick(["", "", digits(1), "-" + name()]), *[name() for _ in range(size(0, 2))], pick(["example.com", "com", "org", "de", "co.uk", "net", "edu", "es"])]
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), ("[@]", "."), ("(@)", "."), (" (@) ", "."), (" at ", " dot "), (" at ", " dot "), (" (at) ", "."), (" (at) ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" AT ", " DOT ")])
        if at != "@" and rng.random() < 0.2:
            local = f"{name()} dot {name()}" if "dot" in dot else local
        return local + at + dot.join(".".join(parts).split("."))

    def secret() -> str:
        return pick([lambda: draw("0123456789abcdef", 40), lambda: draw("0123456789abcdef", pick([32, 64])), lambda: draw("0123456789ABCDEF", 40), lambda: pick(["AKIA", "ghp_", "sk-"]) + draw("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefghijkmnop", size(16, 37))])()

    def other() -> str:
        return pick([digits(size(1, 8)), f"{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(3)},{digits(3)}", f"@{name()}", f"v{digits(1)}", draw("0123456789abcdef", size(6, 17)), f"{digits(3)}-{digits(4)}", f"{word()} at {word()}", f"{word()} dot {word()}", f"look at the {word()} dot", "a@b", f"{word()} (at) {word()}", f"{digits(2)} {digits(2)} {digits(2)}", f"Version {digits(1)}.{digits(1)}", f"CC BY-NC {digits(1)}.0", f"{digits(4)}/{digits(2)}"])

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(size(0, 6))), []
        for _ in range(pick([0, 1, 1, 1, 2])):
            kind = pick([*ALL_KINDS, "email", "email", "phone", "", ""])
            body = make[kind]() if kind else other()
            lead = text[-1:] and pick([" ", " ", " ", " ", "\n", ": ", " (", "*** ", "| ", ', "'])
            if kind == "secret":
                lead = pick([' token = "', lead, " key=", lead])
            text += lead
            if kind:
                spans.append((kind, len(text), len(text) + len(body)))
            text += body + pick([" ", " ", " ", ". ", ", ", "\n", "*** ", "%% ", ") ", '" ', "!! "]) + " ".join(word() for _ in range(size(0, 6)))
        if rng.random() < 0.1:
            upper = text.upper()
            text = upper if len(upper) == len(text) else text
        out.append((text, spans))
    return out


def _window(text: str, spans: list, low: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full(TRAIN_WINDOW, PAD, np.uint8), np.zeros(TRAIN_WINDOW, np.int64)
    part = text[low : low + TRAIN_WINDOW]
    x[: len(part)] = codes(part)
    y[: len(part)] = tags_of(len(part), [(k, a - low, b - low) for k, a, b in spans if b > low and a < low + len(part)])
    return x, y


def training_windows(texts: list[str], made: int = MADE, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of windows: made examples, places with a digit or @ of each text, and one at random."""
    rng = np.random.default_rng(seed)
    out = []
    for text, spans in made_examples(made):
        out.append(_window(text, spans, int(rng.integers(0, max(1, len(text) - TRAIN_WINDOW + 1)))))
    for text in texts:
        spans = shaped(text)
        seeds = [m.start() for m in _SEED.finditer(text)]
        for at in [*rng.choice(seeds, min(len(seeds), PER_TEXT - 1), replace=False).tolist()] * bool(seeds) + [int(rng.integers(0, len(text)))]:
            out.append(_window(text, spans, int(np.clip(at - rng.integers(0, TRAIN_WINDOW), 0, max(0, len(text) - TRAIN_WINDOW)))))
    return np.array([w[0] for w in out], np.uint8).reshape(-1, TRAIN_WINDOW), np.array([w[1] for w in out], np.int64).reshape(-1, TRAIN_WINDOW)


def fit(docs: DataFrame, texts: int = TEXTS, made: int = MADE, epochs: int = EPOCHS) -> Network:
    """Trained on windows of a bounded sample of (doc_id, text), labelled by `shaped`, and on made examples. Of rows that repeat an id the least text counts."""
    usable = docs.where(F.length("text").between(1, MAX_CHARS) & F.col("doc_id").isNotNull())
    parts = [usable.where(cond) for cond in (F.col("text").rlike("[0-9@]"), ~F.col("text").rlike("[0-9@]"))]
    # ids are chosen first: what tasks send to be sorted holds no texts
    ids = [p.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts) for p in parts]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).distinct())
    sample = usable.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    net = Network()
    net.train(*training_windows([r["text"] for r in sorted(sample, key=lambda r: r["doc_id"])], made), epochs)
    return net


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """The address in a span: about the first sign or word for @ that has a local part before it and, after it, names with a dot between them."""
    for at in _AT_SIGN.finditer(text, a, b):
        host = _HOST.match(text, at.end())
        start = at.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        while start < at.start() and (dot := _DOT_BEFORE.search(text, a, start)):
            start = dot.start()
        start += len(text[start : at.start()]) - len(text[start : at.start()].lstrip(".-"))
        if start < at.start() and host and _DOT_SIGN.search(host.group()):
            return start, host.end()
    return a, a


def whole(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A span to the ends of what it cuts, without marks around it: an address, a number's digits, a token's letters and digits; an empty one if nothing is left."""
    if kind == "email":
        return whole_address(text, a, b)
    number = kind != "secret"
    inside = str.isdigit if number else lambda c: c.isalnum() or c in "_-"
    while a < b and not inside(text[b - 1]):
        b -= 1
    while a < b and not (inside(text[a]) or number and (text[a] == "+" or text[a] == "(" and ")" in text[a:b])):
        a += 1
    while a < b and a > 0 and inside(text[a - 1]) and inside(text[a]):
        a -= 1
    while a < b < len(text) and inside(text[b]):
        b += 1
    if number and a > 0 and text[a - 1] == "(" and ")" in text[a:b]:
        a -= 1
    return a, b


def find_spans(texts: list[str], net: Network | None, margin: float = MARGIN_SCORE) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. The network reads every text whole; a span of its own stays by its gain, if it overlaps no base span and its digits are not those of another thing."""
    order = lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])
    out = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
            chars += len(texts[end])
            end += 1
        part = texts[at:end]
        at = end
        seen = net.decode(net.scores([codes(t) for t in part]), [len(t) for t in part], margin) if net is not None else [[] for _ in part]
        for text, spans in zip(part, seen, strict=True):
            base = base_spans(text)
            taken = [(a, b) for _, a, b in base]
            added = []
            for kind, x, y, _ in spans:
                x, y = whole(kind, text, x, y)
                if x < y and all(y <= p or x >= q for p, q in taken) and holds(kind, text[x:y]):
                    added.append((kind, x, y))
                    taken.append((x, y))
            out.append((base, sorted([*base, *added], key=order)))
    return out


def redact(text: str, spans: list) -> str:
    """The text with [KIND] in the place of each span; of overlapping spans the first stands, lengthened over the others."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, secrets, redacted, and the columns in `keep`; a row for each input row.

    Places are code points. Null text counts as empty: no spans. The n_ columns and base_sha256 are those of the base
    patterns; spans has also what the network adds of these four kinds, secrets the access tokens that it finds; redacted is without both. The network reads every character: a text is
    covered by overlapping windows, whose emissions are merged and decoded as one sequence. A task holds the emissions of
    CHARS_AT_ONCE characters, or of one text, if that is longer. Rows never meet, so repeats need no rule.
    """
    rows = take(docs, id_col, text_col, *keep)
    net = docs.sparkSession.sparkContext.broadcast(fit(rows))
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) if keep else ""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        found = find_spans(texts, net.value)
        out = {"doc_id": batch.column("doc_id")} | {c: batch.column(c) for c in keep}
        for k in KINDS:
            out[f"n_{k}"] = [sum(s[0] == k for s in base) for base, _ in found]
        written = [_written(base) for base, _ in found]
        out["spans"], out["secrets"] = ([_written([x for x in s if (x[0] in KINDS) == own]) for _, s in found] for own in (True, False))
        return out | {"base_sha256": [hashlib.sha256(w.encode()).hexdigest() for w in written], "redacted": [redact(t, s) for t, (_, s) in zip(texts, found, strict=True)]}

    return each_batch(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, secrets string, redacted string" + more)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir)).drop("redacted")
