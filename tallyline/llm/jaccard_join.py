"""N-gram Jaccard join: rare-first prefixes of word shingles with length, positional and suffix filters; a pair is verified once."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, table, take
from .components import components

WORDS = 5
#: A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the frequency sketch; their number is all that reaches the driver and the tasks (4 MB), whatever the corpus.
SKETCH = 1 << 20
RANGES = 64
#: A shingle of more documents than this has its posting list split over tasks, by a hash of the document. Its count is taken
#: above the counters' median, which is what chance puts on a counter where shingles far outnumber counters, so a large corpus
#: does not make every shingle a frequent one.
HOT = 50_000
#: Rounds in which a posting list is compared with so many of its members, before the pairs that are left.
LEADERS = (1, 8, 32)



class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


_KNOWN = _Known()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; of fewer words, one for the whole sequence."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(ws)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], np.uint64) if n else np.empty(0, np.uint64)
    h = np.fromiter(map(_KNOWN.__getitem__, ws), np.uint64, n)
    with np.errstate(over="ignore"):
        s = h[: n - words + 1].copy()
        for k in range(1, words):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
            s += h[k : n - words + 1 + k]
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
    s.sort()
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def summaries(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For each row doc_id, n (set size) and digest (of the set; null if empty); besides, rows with a range of the frequency sketch of what a task read."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for b in batches:
            ns, digests = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, words)
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.intp), 1)
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield {"doc_id": b.column("doc_id"), "n": ns, "digest": digests, "part": [None] * len(ns), "counts": [None] * len(ns)}
        parts = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(np.split(counts, RANGES)) if c.any()]
        if parts:
            yield {"doc_id": [None] * len(parts), "n": [None] * len(parts), "digest": [None] * len(parts), "part": [p[0] for p in parts], "counts": [p[1] for p in parts]}

    return map_batches(docs, run, "doc_id long, n long, digest binary, part int, counts binary")


def sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' counters, in two levels: for each, in how many documents a shingle of it stands (never less than the true frequency of any)."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(c), np.uint32)
                sums[i] = sums[i] + x if i in sums else x.astype(np.uint32)
        if sums:
            yield {"part": list(sums), "counts": [zlib.compress(x.tobytes(), 1) for x in sums.values()]}

    out = np.zeros(SKETCH, np.uint32)
    size = SKETCH // RANGES
    # first within pieces of a range, so that no task sums the counters of all others
    some = map_batches(parts.repartition("part", F.xxhash64("counts") % 16), add, "part int, counts binary")
    for r in map_batches(some.repartition(RANGES, "part"), add, "part int, counts binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many of a set's first shingles hold one of any partner's: all but the least intersection, and one."""
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, frequency: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, keys, parts: each set's prefix, by rising frequency, ties by hash, so in one order for all documents; parts says over how many tasks to split each key, null if over one."""
    shared, hot = docs.sparkSession.sparkContext.broadcast(frequency), HOT + int(np.median(frequency))

    def run(batches):
        f = shared.value
        for b in batches:
            ids, ns, keys, parts = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(text, words)
                if len(s):
                    often = f[(s & np.uint64(SKETCH - 1)).astype(np.intp)]
                    order = np.argsort(often, kind="stable")[: prefix_length(len(s), percent)]
                    ids.append(doc)
                    ns.append(len(s))
                    keys.append(s[order].view(np.int64))
                    parts.append((1 + often[order] // hot).astype(np.int32) if often[order[-1]] >= hot else None)
            if ids:
                yield {"doc_id": ids, "n": ns, "keys": keys, "parts": parts}

    return map_batches(docs, run, "doc_id long, n long, keys array<long>, parts array<int>")


def _may_link(n1, p1, n2, p2, percent: int = PERCENT):
    """Length and positional filter: sizes, and what can follow the shared shingle in both sets."""
    least = F.least(n1, n2)
    return (100 * least >= percent * F.greatest(n1, n2)) & ((100 + percent) * (1 + F.least(n1 - p1, n2 - p2) - 1) >= percent * (n1 + n2))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Suffix filter first: what equal ranges of hashes can share at most."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        memory: dict[int, tuple] = {}

        def known(doc, text):
            key = (doc, hash(text))
            if key not in memory:
                if len(memory) >= 512:
                    memory.clear()
                s = shingles(text, words)
                memory[key] = s, np.bincount((s >> np.uint64(58)).astype(np.intp), minlength=64)
            return memory[key]

        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                s, hs = known(a, x)
                t, ht = known(b, y)
                total = len(s) + len(t)
                if (100 + percent) * int(np.minimum(hs, ht).sum()) < percent * total:
                    continue
                both = np.concatenate([s, t])
                both.sort()
                if (100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * total:
                    out.append((a, b))
            if out:
                yield {"a": [p[0] for p in out], "b": [p[1] for p in out]}

    return map_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; a row for each input row.

    Null and wordless texts have no shingles and link with nothing. Documents of equal sets are one class, which its
    smallest id stands for. In a class's posting lists each document is first compared with one leader, which joins most
    of a large group of near copies; then every pair of a list that is not yet in one component is compared, so no link
    between components is lost. Rows that repeat an id are one document: a link of any of its texts counts.
    """
    rows = take(docs, id_col, text_col)
    seen = table(summaries(rows, words), "summaries")
    frequency = sketch(seen.where("part IS NOT NULL").select("part", "counts"))
    per_row = seen.where("part IS NULL").select("doc_id", "n", "digest")
    classes = table(per_row.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    keys = prefixes(rows, frequency, words, percent).join(reps, "doc_id", "left_semi")
    postings = keys.select("doc_id", "n", "parts", F.posexplode("keys").alias("pos", "key"))
    split = F.coalesce(F.try_element_at("parts", F.col("pos") + 1), F.lit(1))
    postings = postings.select("doc_id", "n", "pos", "key", split.alias("parts"), F.when(split > 1, F.pmod(F.xxhash64("doc_id"), split)).otherwise(0).cast("int").alias("part"))
    # lists of one document hold no pair; those that are split have more
    w = Window.partitionBy("key", "part").orderBy("n", "doc_id")
    listed = postings.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("doc_id").over(w))
    shared = table(listed.where("rank > 1 OR next IS NOT NULL OR parts > 1").drop("rank", "next"), "postings")
    # what a list is compared with goes to each of its parts
    to_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    involved = shared.select("doc_id").distinct()
    texts = table(rows.join(involved, "doc_id", "left_semi"), "texts")

    edges = done = None
    state = shared.withColumn("comp", F.col("doc_id"))
    for star, leaders in enumerate(LEADERS):
        # leaders of a list: its shortest text at first, so that most lists of a group have the same one; then more and more
        # members at random, so that a straggler meets others of its group without meeting them all
        order = [F.col("n"), F.col("doc_id")] if star == 0 else [F.xxhash64("key", "doc_id", F.lit(star)), F.col("doc_id")]
        ranked = state.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= leaders)
        lead = ranked.select("key", to_parts, *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "pos", "comp")])
        near = state.join(lead, ["key", "part"]).where("comp <> comp_b").where(_may_link(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), percent))
        pairs = near.select(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")).distinct()
        pairs = table(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        found = table(_verified(pairs, texts, words, percent), "found")
        edges = found if edges is None else edges.unionByName(found)
        comp = table(components(edges).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "comp"), "components")
        placed = shared.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        # lists within one component are finished
        mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        state = table(placed.join(mixed, "key", "left_semi"), "mixed")
        if state.limit(1).count() == 0:
            break
    else:
        other = state.select("key", to_parts, *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "pos", "comp")])
        near = state.join(other, ["key", "part"]).where("doc_id < doc_id_b AND comp <> comp_b").where(_may_link(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), percent))
        pairs = table(near.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        edges = edges.unionByName(table(_verified(pairs, texts, words, percent), "found"))
        comp = table(components(edges).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "comp"), "components")

    # the links join representatives; a class of copies follows its own
    of_class = classes.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
    joined = per_row.join(of_class, "digest", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * n_both >= {PERCENT} * (nx.n + ny.n - n_both)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY 1
"""
