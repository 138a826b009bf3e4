"""Target-distribution importance resampling: hashed word features, weighed by how much likelier the target makes them, drawn without replacement."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, remove, written
from .license_scan import words

#: Features are runs of up to LONGEST words, hashed to BUCKETS.
LONGEST = 1
BUCKETS = 10_000
#: Words, and pairs, that are at least one in HEAD of all are frequent, so there are at most HEAD of either; longer ones than WORD_BYTES a word are not. Their hashes are broadcast.
HEAD = 1 << 15
WORD_BYTES = 64
#: Distinct features that a task counts before it hands them on.
ENTRIES = 200_000
#: Documents of at least LEAST_WORDS words take part; PERCENT of them are drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"


class Hasher:
    """Buckets of features. A frequent word's CRC state and a frequent pair's bucket are looked up; all others are hashed, a run of words from the state of its first one."""

    def __init__(self, head: Iterable[bytes] = (), pairs: Iterable[bytes] = (), longest: int = LONGEST, buckets: int = BUCKETS):
        self.states = {w: crc32(w) for w in head}
        self.pairs = {tuple(p.split(b" ")): crc32(p) % buckets for p in pairs}
        self.longest, self.buckets = longest, buckets

    def state(self, word: bytes) -> int:
        known = self.states.get(word)
        return crc32(word) if known is None else known

    def bucket(self, run: tuple[bytes, ...]) -> int:
        known = self.pairs.get(run)
        if known is not None:
            return known
        state = self.state(run[0])
        for w in run[1:]:
            state = crc32(b" " + w, state)
        return state % self.buckets

    def counts(self, ws: list[bytes]) -> dict[int, int]:
        """How many features of the words fall in each bucket."""
        out: dict[int, int] = {}
        for w, n in Counter(ws).items():
            b = self.state(w) % self.buckets
            out[b] = out.get(b, 0) + n
        for k in range(2, self.longest + 1):
            for run, n in Counter(zip(*[ws[i:] for i in range(k)], strict=False)).items():
                b = self.bucket(run)
                out[b] = out.get(b, 0) + n
        return out


def head(texts: DataFrame, longest: int = LONGEST, one_in: int = HEAD, entries: int = ENTRIES) -> tuple[list[bytes], list[bytes]]:
    """(words that are one in `one_in` of all or more, such pairs), by exact counts over all texts. Pairs are empty if features are single words.

    A task sums what it reads before the shuffle, so a word that is everywhere is a few rows. By their share there are at most `one_in` of either,
    whatever the corpus, and words over WORD_BYTES are none, so what reaches the driver is bounded.
    """

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                ws = words(t.as_py())
                held.update((w, 1) for w in ws)
                if longest > 1:
                    held.update((b" ".join(p), 2) for p in zip(ws, ws[1:], strict=False))
                if len(held) >= entries:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    def out(held: Counter) -> dict:
        return {"feature": [f for f, _ in held], "k": [k for _, k in held], "n": list(held.values())}

    sums = map_batches(texts.select("text"), count, "feature binary, k int, n long").groupBy("feature", "k").agg(F.sum("n").alias("n"))
    counted, path = written(sums, "words")
    whole = {r["k"]: r["n"] for r in counted.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    found = []
    for k in (1, 2):
        often = counted.where((F.col("k") == k) & (F.col("n") * one_in >= whole.get(k, 0)) & (F.octet_length("feature") <= k * WORD_BYTES + k - 1))
        found.append(sorted(bytes(r["feature"]) for r in often.select("feature").collect()) if k <= longest else [])
    remove(texts.sparkSession, path)
    return found[0], found[1]


def features(rows: DataFrame, hasher: Hasher, *keep: str) -> DataFrame:
    """The columns in `keep`, n_words, n_features, and the features' buckets with their counts (at most as many as there are buckets, however long the text)."""
    shared = rows.sparkSession.sparkContext.broadcast(hasher)

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {c: batch.column(c) for c in keep} | {c: [] for c in ("n_words", "n_features", "buckets", "counts")}
            for t in batch.column("text"):
                ws = words(t.as_py())
                found = shared.value.counts(ws)
                cols["n_words"].append(len(ws))
                cols["n_features"].append(sum(found.values()))
                cols["buckets"].append(list(found))
                cols["counts"].append(list(found.values()))
            yield cols

    more = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return map_batches(rows.select("text", *keep), run, f"{more}n_words long, n_features long, buckets array<int>, counts array<long>")


def totals(counted: DataFrame) -> DataFrame:
    """(bucket, n): exact counts of all features; a task sums its own before the shuffle, so at most `buckets` rows leave it."""
    return counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row: gains, an array by bucket of floor(1000 ln of the target's smoothed share over the raw share)."""
    both = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    ends = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.ln((d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets)))).cast("long")
    return both.crossJoin(F.broadcast(ends)).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", gain.alias("gain")))), lambda x: x["gain"]).alias("gains"))


def gumbel(id_: Column, seed: str = SEED) -> Column:
    """floor(1000 times a Gumbel variate) that depends on the id and the seed alone; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """rows with their place (1, 2, 3 ...) in one order over all, without a task that holds all: sorted by ranges, numbered within each, and moved on by the sizes of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("_place", 33)
    sizes = [(r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]  # one row for each range
    before, starts = 0, []
    for k, size in sorted(sizes):
        starts.append((k, before))
        before += size
    ahead = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(rank, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_place")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, one_in: int = HEAD,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: a row for each input row; rank is null where a document is not drawn.

    Words are lower-cased runs of ASCII letters, digits and other characters. All features of all rows and of all target
    texts count. weight is the sum of the gains of a document's features; score adds Gumbel noise of the id, so the highest
    scores are a sample without replacement in proportion to the weights. Of the N documents with an id and `least_words`
    words floor(percent N / 100) are drawn. Null and empty texts: no feature, weight 0, never drawn if words are asked for. Rows without an id have no
    score and are not drawn. Rows that repeat an id are documents of their own; equal scores go to the smaller id. Without target texts, or documents, gains rest on the smoothing alone.
    """
    text = lambda df, c: F.coalesce(df[c], F.lit("")).alias("text")
    rows, goal = docs.select(docs[id_col].cast("long").alias("doc_id"), text(docs, text_col)), target.select(text(target, target_text))
    hasher = Hasher(*head(rows, longest, one_in), longest, buckets)
    counted, path = written(features(rows, hasher, "doc_id"), "features")
    gain, _ = written(gains(totals(counted), totals(features(goal, hasher)), buckets), "gains")
    weight = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda a, x: a + F.get("gains", x["buckets"]) * x["counts"])
    # one row of `buckets` numbers goes to all tasks
    scored = counted.crossJoin(F.broadcast(gain)).select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored, _ = written(scored.withColumn("takes_part", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)), "scores")
    remove(docs.sparkSession, path)
    drawn = scored.where("takes_part").count() * percent // 100
    order = [F.desc("takes_part"), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    return ranked(scored, order, "rank").withColumn("rank", F.when(F.col("takes_part") & (F.col("rank") <= drawn), F.col("rank"))).drop("takes_part")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
split AS (
  SELECT true AS raw, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT false, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT raw, doc_id, unnest(ws) AS w FROM split),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table),
counts AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
ends AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, ends),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE raw GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE raw),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
