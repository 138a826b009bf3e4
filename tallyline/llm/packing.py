"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE, _Known, byte_alphabet
from .common import documents, each_batch, table, take

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 0
#: Pieces are dealt at random into blocks of about this many; each block is packed on its own.
BLOCK = 4096
ISLANDS, EPOCHS = 3, 2
#: An island's people and children of a generation; generations without a better packing after which it stops, and those after which it stops anyway.
POPULATION, CHILDREN, PATIENCE, GENERATIONS = 6, 3, 15, 150
#: Bins at least so full are passed on whole by the crossover, and stay when what a round leaves is packed again.
WELL_FILLED = 0.995


_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The same for texts of Latin-1 characters only.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\t-\r \x85\xa0A-Za-z0-9ªµºÀ-ÖØ-öø-ÿ²³¹¼½¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


class Encoder:
    """Ids of a text as unsigned 32-bit little-endian bytes; pre-tokens that come again are looked up.

    Where the vocabulary's ids follow its merges, a rank encoder over the same vocabulary gives the same ids with less
    work for each new pre-token; else the tokenizer itself encodes it.
    """

    def __init__(self, spec: str):
        tokenizer = tokenizers.Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        model = json.loads(spec)["model"]
        ids_of = lambda w: tokenizer.encode(w, add_special_tokens=False).ids
        if not model.get("end_of_word_suffix") and all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(model["merges"])):
            bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
            ranks = {bytes(map(bytes_of.__getitem__, s)): i for s, i in model["vocab"].items()}
            ids_of = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = _Known(lambda w: array("I", ids_of(w)).tobytes())

    def plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            words = _LATIN.findall(text)
        except UnicodeEncodeError:
            words = _SPLIT.findall(text)
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.pattern is None or not self.pattern.search(text):
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else self.plain(x) for k, x in enumerate(self.pattern.split(text)))


_WORKER: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _WORKER:
        _WORKER[key] = Encoder(spec)
    return _WORKER[key]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, whole: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if `whole`): each document's ids and a final id 0, cut if longer than `capacity`; the first piece takes the odd length."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = END_ID.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> dict:
        encoder = _encoder(spec.value)
        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encoder.encode(text) + end
            n = len(ids) // 4
            first = n % capacity or capacity
            for k, stop in enumerate(range(first, n + 1, capacity)):
                start = max(0, stop - capacity) if k else 0
                part = ids[4 * start : 4 * stop]
                for c, v in (("doc_id", doc), ("piece", k), ("start", start), ("length", stop - start), ("ids_crc32", zlib.crc32(part))):
                    out[c].append(v)
                if whole:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
        return out

    return each_batch(take(docs, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * whole)


class Bins:
    """Bins of items with a best-fit search: bit r of `free` says that some bin has room r."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity, self.bins, self.room = sizes, capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0

    def _put(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.free |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(list(items))
        self.room.append(self.capacity - sum(map(self.sizes.__getitem__, items)))
        self._put(len(self.bins) - 1)

    def best_fit(self, item: int) -> None:
        size = self.sizes[item]
        above = self.free >> size
        if not above:
            self.add_bin([item])
            return
        r = size + (above & -above).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.free &= ~(1 << r)
        self.bins[b].append(item)
        self.room[b] = r - size
        self._put(b)


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then unequal fill: the mean square of the fill."""
    return -len(bins), sum((sum(map(sizes.__getitem__, b)) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], mine: list[list[int]], other: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of `other` whole into `mine`, drop the bins of `mine` that hold duplicates, best-fit the displaced.

    Where `other` has no bin that is well filled, its fullest quarter is. Some of the poorly filled bins of `mine`, and now
    and then a full one, are emptied too.
    """
    fill = lambda b: sum(map(sizes.__getitem__, b))
    good = [b for b in other if fill(b) >= WELL_FILLED * capacity] or sorted(other, key=fill)[-max(1, len(other) // 4) :]
    passed = rng.sample(good, rng.randint(1, max(1, len(good) // 2)))
    taken = {i for b in passed for i in b}
    child = Bins(sizes, capacity)
    displaced = []
    for b in passed:
        child.add_bin(b)
    for b in mine:
        if taken.isdisjoint(b):
            if rng.random() < (0.98 if fill(b) >= 0.98 * capacity else 0.5):
                child.add_bin(b)
            else:
                displaced += b
        else:
            displaced += [i for i in b if i not in taken]
    noise = rng.choice((0.0, 0.1, 0.3))
    displaced.sort(key=lambda i: -sizes[i] * rng.uniform(1 - noise, 1 + noise))
    for i in displaced:
        child.best_fit(i)
    return child.bins


def start(sizes: list[int], capacity: int, rng: random.Random, shuffled: bool) -> list[list[int]]:
    """Best fit in falling size; later members of a population with noise in the order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (rng.uniform(0.8, 1.2) if shuffled else 1))
    bins = Bins(sizes, capacity)
    for i in order:
        bins.best_fit(i)
    return bins.bins


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]]) -> tuple[list[list[int]], int]:
    """(the best packing that one island finds in an epoch, crossovers made).

    The population is the elites and best fits in noisy orders. At the lower bound no packing has fewer bins, so an island
    there keeps to two people and one generation, in which children can still gather the free room in fewer bins; others
    go on until PATIENCE generations bring nothing better. Of equally fit ones the older stays.
    """
    rng = random.Random(seed)
    if not sizes:
        return [], 0
    bound = -(-sum(sizes) // capacity)
    people = [*elites]
    for k in range(POPULATION):
        if len(people) >= POPULATION or len(people) >= 2 and min(map(len, people)) <= bound:
            break
        people.append(start(sizes, capacity, rng, k > 0 or bool(elites)))
    score = lambda p: fitness(sizes, p, capacity)
    people.sort(key=score, reverse=True)
    made = idle = 0
    for _ in range(GENERATIONS):
        before = score(people[0])
        children = [crossover(sizes, *rng.sample(people, 2), capacity, rng) for _ in range(CHILDREN)]
        made += len(children)
        people = sorted(people + children, key=score, reverse=True)[:POPULATION]
        idle = 0 if score(people[0]) > before else idle + 1
        if len(people[0]) <= bound or idle >= PATIENCE:
            break
    return people[0], made


def _bins(assign: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(assign):
        out.setdefault(b, []).append(i)
    return list(out.values())


ITEM = "length:bigint,uid:bigint,doc_id:bigint,piece:int,start:bigint,ids_crc32:bigint"


def islands(blocks: DataFrame, n_blocks: int, capacity: int) -> DataFrame:
    """(block, assign, crossovers): the best island's bin of each item of a block, by the block's order of items.

    On each block islands evolve in parallel, a row each, and between epochs the elite of each moves to the next one by a
    join. Seeds come from the block, island and epoch, and of equally fit elites that of the last island stands, so a task
    that runs again finds the same.
    """
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.transform("items", lambda x: x["length"]).alias("sizes"), F.lit(None).cast("array<array<int>>").alias("elites"), F.lit(0).alias("crossovers"))
    for epoch in range(EPOCHS):

        def run(batch: pa.RecordBatch, epoch: int = epoch) -> dict:
            out = []
            for b, i, sizes, elites, before in zip(*(batch.column(c).to_pylist() for c in ("block", "island", "sizes", "elites", "crossovers")), strict=True):
                best, made = evolve(sizes, capacity, (b * ISLANDS + i) * EPOCHS + epoch, [_bins(e) for e in elites or []])
                assign = [0] * len(sizes)
                for k, items in enumerate(best):
                    for x in items:
                        assign[x] = k
                out.append((assign, *fitness(sizes, best, capacity), before + made))
            return {"block": batch.column("block"), "island": batch.column("island"), "sizes": batch.column("sizes"), "assign": [x[0] for x in out], "bins": [x[1] for x in out], "fit": [x[2] for x in out], "crossovers": [x[3] for x in out]}

        # a row is a whole optimisation, so a few of them make a task
        spread = state.repartition(max(1, n_blocks), "block", "island")
        state = table(each_batch(spread, run, "block long, island int, sizes array<long>, assign array<int>, bins int, fit double, crossovers int"), "islands")
        moved = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("assign").alias("guest"))
        best = state.groupBy("block").agg(F.max_by("assign", F.struct("bins", "fit", "island")).alias("assign"), F.sum("crossovers").alias("crossovers"))
        state = state.join(moved, ["block", "island"]).select("block", "island", "sizes", F.array("assign", "guest").alias("elites"), "crossovers")
    return best


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces (as `pieces` gives them; lengths from 1 to capacity).

    Full pieces are sequences of their own, with negative ids. Others are dealt at random into blocks, so no key is hot,
    and each block is packed by `islands`. What stands in bins that are not well filled is dealt and packed again, in
    rounds of fewer and fewer blocks, until one block holds it (or most of a round's pieces would come back), so that not
    every block leaves a sequence half empty. Equal lengths and repeated rows are distinct items: a row's number in the
    written table tells them apart. No rows: no rows.
    """
    rows = table(rows, "pieces").withColumn("uid", F.monotonically_increasing_id())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = rows.where(F.col("length") >= capacity).select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = table(rows.where(F.col("length") < capacity), "parts")
    n = parts.count()
    inner = F.sort_array(F.collect_list(F.struct("length", "uid", "doc_id", "piece", "start", "ids_crc32")), asc=False)

    def place(batch: pa.RecordBatch) -> dict:
        out = []
        for items, assign in zip(batch.column("items").to_pylist(), batch.column("assign").to_pylist(), strict=True):
            used: dict[int, int] = {}
            offsets = []
            for x, b in zip(items, assign, strict=True):
                offsets.append(used.get(b, 0))
                used[b] = offsets[-1] + x["length"]
            out.append([x | {"bin": b, "offset": o, "filled": used[b]} for x, b, o in zip(items, assign, offsets, strict=True)])
        return {"block": batch.column("block"), "items": out}

    level = 0
    while n:
        n_blocks = max(1, round(n / block))
        blocks = table(parts.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_blocks)).alias("block")).agg(inner.alias("items")), "blocks")
        best = islands(blocks, n_blocks, capacity)
        placed = table(each_batch(blocks.join(best, "block"), place, f"block long, items array<struct<{ITEM},bin:bigint,offset:bigint,filled:bigint>>").select("block", F.inline("items")), "placed")
        loose = F.col("filled") < WELL_FILLED * capacity
        left = placed.where(loose).count() if n_blocks > 1 else 0
        again = 0 < left < n / 2
        done = placed.where(~loose) if again else placed
        packed = packed.unionByName(done.select(*names, (F.lit(level) * (1 << 56) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"))
        parts, n, level = placed.where(loose).select("length", "uid", "doc_id", "piece", "start", "ids_crc32"), left if again else 0, level + 1
    return packed


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; null and empty texts are the end id alone. Rows that repeat an id, and rows without one, are documents of their own, with pieces from 0 each."""
    return pack(pieces(docs, id_col, text_col, tokenizer, capacity), capacity)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
