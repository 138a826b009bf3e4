"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token one vocabulary entry is the last token of its encoding. A suffix automaton of the
vocabulary matches the longest end of the prefix that lies in some entry, and its suffix links give the entries that are
ends of the prefix themselves; the one whose pair with the prefix before it is stable under the merges is stored, and
following the stored tokens from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .automaton import SuffixAutomaton
from .common import documents, each_batch, take

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Pre-tokens in a generation of what a Python worker remembers; it has two. Longer ones than CACHED_CHARS are not kept.
CACHE = 300_000
CACHED_CHARS = 40

#: White space of the Unicode property.
WHITE = "\t-\r \x85\xa0  -     　"
#: The end of a word in the automaton's alphabet; the byte alphabet has no line feed.
END = "\n"


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _inner(token: str, suffix: str) -> str:
    """A token in the automaton's alphabet: the vocabulary's mark of a word's end as one character."""
    return token[: -len(suffix)] + END if suffix and token.endswith(suffix) else token


def vocabulary_automaton(spec: str) -> dict[str, np.ndarray]:
    """The suffix automaton of a tokenizers file's vocabulary as arrays, which travel to the tasks.

    moves and to: state * 512 + character, and where it leads; link and length of each state; token: the id of the entry
    that is the state's longest string, else -1 (an entry stands nowhere else, as it ends itself); up: the next state on the
    suffix links, not counting itself, that has an entry, else 0.
    """
    model = json.loads(spec)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    names = [(_inner(s, suffix), i) for s, i in model["vocab"].items()]
    automaton = SuffixAutomaton(s for s, _ in names)
    token = np.full(len(automaton.len), -1, np.int32)
    for (_, i), passed in zip(names, automaton.prefixes, strict=True):
        token[passed[-1]] = i
    up = np.zeros(len(token), np.int32)
    for s in sorted(range(1, len(token)), key=lambda s: automaton.len[s]):
        p = automaton.link[s]
        up[s] = p if p > 0 and token[p] >= 0 else up[p] if p > 0 else 0
    moves = [(s << 9 | ord(c), t) for s, nxt in enumerate(automaton.next) for c, t in nxt.items()]
    moves, to = np.array(moves, np.int64).T
    return {"moves": moves, "to": to.astype(np.int32), "link": np.array(automaton.link, np.int32), "length": np.array(automaton.len, np.int32), "token": token, "up": up}


class PrefixEncoder:
    """Encodes one pre-token at a time with the vocabulary of a tokenizers file (its JSON text) and its automaton."""

    def __init__(self, spec: str, automaton: dict[str, np.ndarray] | None = None):
        d = json.loads(spec)
        model = d["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = {i: s for s, i in model["vocab"].items()}
        ids = {_inner(s, self.suffix): i for s, i in model["vocab"].items()}
        size = max(self.names) + 1
        self.length = [0] * size
        self.made = [-1] * size  # the rank of the merge that makes a token, -1 for one character
        self.left, self.right = [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        for s, i in ids.items():
            self.length[i] = len(s)
        for rank, (a, b) in enumerate(model["merges"]):
            a, b = _inner(a, self.suffix), _inner(b, self.suffix)
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merge[x << 20 | y] = rank
            if self.made[z] < 0:
                self.made[z], self.left[z], self.right[z] = rank, x, y
        atoms = {i for s, i in ids.items() if len(s.rstrip(END)) == 1}
        usable = lambda i: i in atoms or self.made[i] >= 0 and self.stable(self.left[i], self.right[i], self.made[i])
        a = automaton or vocabulary_automaton(spec)
        self.moves = dict(zip(a["moves"].tolist(), a["to"].tolist(), strict=True))
        self.link, self.deep = a["link"].tolist(), a["length"].tolist()
        # entries that are the end of a state's match, longest first: of the whole match, and of what is shorter
        token, up = a["token"].tolist(), a["up"].tolist()
        self.shorter: list[tuple[int, ...]] = [()] * len(token)
        self.matched: list[tuple[int, ...]] = [()] * len(token)
        for s in np.argsort(a["length"], kind="stable").tolist():
            self.shorter[s] = self.matched[up[s]] if s else ()
            self.matched[s] = (token[s], *self.shorter[s]) if token[s] >= 0 and usable(token[s]) else self.shorter[s]
        self.byte_chars = byte_alphabet()
        self.pairs: dict[int, bool] = {}

    def stable(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether no merge before rank `until` crosses the boundary of a and b.

        Time runs backwards: the pieces at the boundary are a and b at the end, and the piece made later is undone first.
        Two pieces that both exist join unless one of them is consumed by its own token first; of equal ranks the left goes first.
        """
        merge, made = self.merge, self.made
        a_until = b_until = until
        while True:
            rank = merge.get(a << 20 | b)
            if rank is not None and rank < a_until and (rank <= b_until if b_until < until else rank < until):
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                a_until, a = made[a], self.right[a]
            else:
                b_until, b = made[b], self.left[b]

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-token, by the last token of every prefix."""
        text = word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.byte_chars.__getitem__, word.encode("utf-8", "replace")))
        n = len(text)
        if self.suffix:
            text += END
            n += 1
        last = [-1] * (n + 1)
        length, pairs, moves, link, deep = self.length, self.pairs, self.moves, self.link, self.deep
        state = size = end = 0
        for c in map(ord, text):
            end += 1
            to = moves.get(state << 9 | c)
            while to is None and state:
                state = link[state]
                size = deep[state]
                to = moves.get(state << 9 | c)
            if to is None:
                continue
            state, size = to, size + 1
            for token in self.matched[state] if size == deep[state] else self.shorter[state]:
                start = end - length[token]
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    key = before << 20 | token
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) >= CACHE:
                            pairs.clear()
                        good = pairs[key] = self.stable(before, token)
                    if not good:
                        continue
                last[end] = token
                break
        out = []
        while n:
            token = last[n]
            if token < 0:
                raise ValueError(f"no encoding ends at {n} in {word[:80]!r}")
            out.append(token)
            n -= length[token]
        return out[::-1]


class _Known(dict):
    """pre-token: what make() gives for it. Full, it becomes the old generation, from which words that come again move on."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


#: Contractions that the pre-tokenizer splits off.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0A-Za-z0-9ªµºÀ-ÖØ-öø-ÿ²³¹¼½¾]+")


def normal(text: str) -> str:
    """NFC, one space for white space, lower case a character at a time."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower() of a whole string looks at the neighbours of this letter only
        return "σ".join(x.lower() for x in text.split("Σ"))
    return text.lower()


_WORKER: dict[int, tuple] = {}


def _worker(spec: str, automaton: dict[str, np.ndarray] | None = None) -> tuple[PrefixEncoder, _Known, _Known, re.Pattern | None]:
    """Of this Python worker: the encoder, what it knows, and the pattern of special tokens."""
    key = hash(spec)
    if key not in _WORKER:
        encoder = PrefixEncoder(spec, automaton)
        special = re.compile("(" + "|".join(map(re.escape, encoder.special)) + ")") if encoder.special else None
        ids_of = _Known(lambda word: " ".join(map(str, encoder.encode(word))))
        names = {str(i): s for i, s in encoder.names.items()}
        _WORKER[key] = encoder, ids_of, _Known(lambda word: " ".join(map(names.__getitem__, ids_of[word].split(" ")))), special
    return _WORKER[key]


def _split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        return _LATIN.findall(text)
    except UnicodeEncodeError:
        return _SPLIT.findall(text)


def encode_text(text: str, spec: str, automaton: dict[str, np.ndarray] | None = None) -> tuple[int, str, str]:
    """(number of ids, ids joined by spaces, decoded text) of a text; special tokens in it are found before it is normalised."""
    encoder, ids_of, names_of, special = _worker(spec, automaton)
    if special is None or not special.search(text):
        words = _split(normal(text))
        ids, names = " ".join(map(ids_of.__getitem__, words)), " ".join(map(names_of.__getitem__, words))
    else:
        parts = [([str(encoder.special[x])], [x]) if k % 2 else (list(map(ids_of.__getitem__, w := _split(normal(x)))), list(map(names_of.__getitem__, w))) for k, x in enumerate(special.split(text))]
        ids, names = (" ".join(x for p in parts for x in p[k]) for k in (0, 1))
    return ids.count(" ") + 1 if ids else 0, ids, names


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `whole` also ids (array<int>) and decoded; a row for each input row.

    Null text counts as empty: no tokens and the digests of the empty string. The tokenizer's file is read on the driver
    (its size is fixed) and travels with the task. Rows never meet, so ties and repeats need no rule.
    """
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    spec, automaton = (docs.sparkSession.sparkContext.broadcast(x) for x in (text, vocabulary_automaton(text)))

    def run(batch: pa.RecordBatch) -> dict:
        rows = [encode_text(t, spec.value, automaton.value) for t in batch.column("text").to_pylist()]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [r[0] for r in rows], "ids_sha256": [sha(r[1]) for r in rows], "decoded_sha256": [sha(r[2]) for r in rows]}
        return out | ({"ids": [[int(x) for x in r[1].split()] for r in rows], "decoded": [r[2] for r in rows]} if whole else {})

    return each_batch(take(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole)


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, decoded: the names of the ids joined by spaces, as this vocabulary (which has no decoder) is decoded. Null ids: null."""
    with open(tokenizer, encoding="utf-8") as f:
        d = json.load(f)
    names = {i: s for s, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batch: pa.RecordBatch) -> dict:
        get = shared.value
        return {"doc_id": batch.column("doc_id"), "decoded": [None if x is None else " ".join(get[i] for i in x if i in get) for x in batch.column("ids").to_pylist()]}

    return each_batch(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].alias("ids")), run, "doc_id long, decoded string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
