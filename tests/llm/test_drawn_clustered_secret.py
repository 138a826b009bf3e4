"""Importance resampling, centroid clustering and secret scans against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import centroids, importance, secret_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    ws = WORD.findall((text or "").translate(AZ))
    return ws, [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def plain_resample(docs, target, longest, buckets, least_words, percent, seed):
    hashed = lambda text: [zlib.crc32(f.encode()) % buckets for f in runs(text, longest)[1]]
    s, t = Counter(b for _, x in docs for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        weight = sum(gain[b] for b in hashed(x))
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(hashed(x)), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    some = sorted((r for r, (i, x) in zip(out, docs, strict=True) if i is not None and len(runs(x, 1)[0]) >= least_words), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(some[: percent * len(some) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def test_resample_equals_plain_python(spark):
    rng = random.Random(1)
    words = ["The", "déjà", "x1", "漢字", "a", "B2B", "long" * 30, "tail"] + [f"w{k}" for k in range(300)]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=[200 // (k + 1) + 1 for k in range(len(words))], k=n))
    docs = [(k, text(rng.randrange(0, 40))) for k in range(120)] + [(7, text(30)), (None, text(30)), (500, None), (501, ""), (502, "word " * 30_000)]
    target = [text(25) for _ in range(10)] + [None, ""]
    for longest, one_in in ((1, 20), (2, 50), (3, 1), (2, 10**6)):
        d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
        got = importance.resample(d, t, longest=longest, buckets=97, least_words=10, percent=30, seed="s", one_in=one_in).drop("n_words")
        assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, longest, 97, 10, 30, "s")
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_head_holds_exact_counts_whatever_a_task_holds(spark):
    texts = spark.createDataFrame([("a b a",), ("b a c",), ("x" * 100 + " c",), ("",)], "text string").repartition(3)
    assert importance.head(texts, 2, 4, entries=1) == ([b"a", b"b", b"c"], [b"b a"])  # of 8 words and 5 pairs
    assert importance.head(texts, 1, 3) == ([b"a"], [])
    assert importance.head(texts.where("text = ''"), 2) == ([], [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é", min_size=1).map(lambda s: s.encode().replace(b" ", b"x")), min_size=1, max_size=6))
def test_hash_continues_from_states(ws):
    h = importance.Hasher(ws[:2], [b" ".join(ws[:2])] if len(ws) > 1 else [], 4, 1000)
    want = Counter(zlib.crc32(b" ".join(ws[i : i + k])) % 1000 for k in range(1, 5) for i in range(len(ws) - k + 1))
    assert h.counts(ws) == dict(want)


def test_ranked_is_one_order(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("x"))
    got = importance.ranked(rows, [F.desc("x"), F.asc("id")], "rank").collect()
    want = sorted(((r["id"], r["x"]) for r in got), key=lambda r: (-r[1], r[0]))
    assert [(r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, k) for k, (i, _) in enumerate(want, 1)]


def plain_clusters(rows, clusters, rounds, dimensions, scale, seed):
    usable = lambda x: x is not None and len(x) == dimensions and all(c is not None and math.isfinite(c) for c in x)
    kept = [(i, [math.floor(scale * c) for c in x]) for i, x in rows if usable(x)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    cs = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(cs)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for k in range(len(cs)):
            mine = [v for (_, v), (_, j) in zip(kept, own, strict=True) if j == k]
            if mine:
                cs[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assign()
    inertia = Counter()
    for d, k in own:
        inertia[k] += d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, own, strict=True)), key=str)


def test_clusters_equal_plain_python(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [rng.gauss(k % 5, 1.5) for _ in range(4)]) for k in range(200)]
    rows += [(3, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.0]), (None, [9.0, -9.0, 9.0, -9.0]), (900, None), (901, []), (902, [1.0] * 5), (903, [nan, 1.0, 1.0, 1.0]), (904, [inf, 1.0, 1.0, 1.0]), (905, [None, 1.0, 1.0, 1.0]), (906, [0.0] * 4), (907, [-0.0] * 4)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(5)
    for rounds, n in ((0, 3), (3, 6), (7, 6)):
        got = centroids.cluster_vectors(df, clusters=n, rounds=rounds, dimensions=4, scale=10, seed="q")
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, n, rounds, 4, 10, "q")
    few = centroids.cluster_vectors(df.where("vec_id in (1, 2)"), dimensions=4).collect()
    assert {r["distance"] for r in few} == {0} and len({r["cluster"] for r in few}) == 2
    assert centroids.cluster_vectors(df.where("vec_id < 0")).collect() == []
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroids.cluster_vectors(huge, dimensions=2).collect()] == [2]


def test_products_move_by_what_changed(spark):
    import numpy as np

    kept = spark.createDataFrame([(1, [1, -2, 3]), (2, [5, 0, -7])], "vec_id long, v array<int>")
    before, after = np.array([[1, 2, 3], [4, 5, 6]]), np.array([[1, 2, 3], [4, -5, 7]])
    state = centroids.moved(centroids.started(kept, before), before, after).collect()
    assert {r["vec_id"]: r["dots"] for r in state} == {1: [6, 4 + 10 + 21], 2: [-16, 20 - 49]}


def test_base_spans_of_secrets():
    spans = secret_scan.base_spans
    assert spans("password = 'hunter2hunter2' x") == [("assign", 0, 26)]
    assert spans("API-KEY: abcdefghijkl aPi_KeY:abcdefghijkl") == [("assign", 22, 42)]
    assert spans("token=short token: \"0123456789abcdef0123\"") == [("assign", 12, 40), ("hex", 20, 40)]
    assert spans("AKIAABCDEFGHIJKLMN AKIAABCDEFGHIJKLM") == [("access", 0, 18)]
    assert spans("é漢 0123456789abcdef") == [("hex", 3, 19)] and spans("0123456789abcde") == []
    assert spans("paſſword=abcdefghijklmnop toKen=abcdefghijklmnop".replace("toKen", "toKen")) == []
    # a failing match is dropped whole
    assert spans("secret=a secret=token=abcdefghijkl") == [("assign", 9, 34)]


def test_states_merge_only_within_the_bound():
    loops = secret_scan.Automaton.prefix_tree([["a"] * k for k in range(10) for _ in range(512 >> k)]).infer()
    assert len(loops.n) == 1 and sum(loops.ends) == 1023 and loops.next[0] == {"a": 0}  # half end in every state
    apart = secret_scan.Automaton.prefix_tree([["x", "p"]] * 200 + [["y", "q"]] * 200).infer()
    assert apart.likelihood(["x", "p"]) > apart.likelihood(["x", "q"]) + 5
    total = sum(math.exp(apart.likelihood(w)) for w in (["x", "p"], ["y", "q"]))
    assert 0.98 < total <= 1


def test_formats_never_seen_in_fitting():
    """Made credentials and ordinary runs of other seeds; and each format left out of the fit but for its characters."""
    good, plain = [x for _, x in secret_scan.made_credentials()], [x for _, x in secret_scan.made_ordinary()]
    s = secret_scan.Scanner(good, plain)
    fresh, quiet = [x for _, x in secret_scan.made_credentials(50, 77)], [x for _, x in secret_scan.made_ordinary(50, 78)]
    assert sum(map(s.is_secret, fresh)) >= 0.98 * len(fresh) and sum(map(s.is_secret, quiet)) <= 0.01 * len(quiet)
    name = "payment live"
    other = secret_scan.Scanner([x for n, x in secret_scan.made_credentials() if n != name], plain)
    left = [x for n, x in secret_scan.made_credentials(50, 77) if n == name]
    assert sum(map(other.is_secret, left)) >= 0.9 * len(left)
    text = f"set it to {fresh[-1]}, not to the-usual-configuration/of.things; token = {fresh[0]}"
    base, spans = s.spans(text)
    assert [k for k, *_ in spans] == ["secret", "assign", "access"] and base == spans[1:]
    assert text[spans[0][1] : spans[0][2]] == fresh[-1] and secret_scan.redact(text, spans) == "set it to [SECRET], not to the-usual-configuration/of.things; [SECRET]"
    assert secret_scan.redact("abcdef", [("a", 0, 3), ("b", 1, 2), ("c", 2, 5)]) == "[SECRET]f"


def test_secret_rows_equal_the_scanner(spark):
    s = secret_scan.Scanner([x for _, x in secret_scan.made_credentials(40)], [x for _, x in secret_scan.made_ordinary(40)])
    texts = [f"some words and {x} more" for _, x in secret_scan.made_credentials(3, 8)] + ["", None, "secret: abcdefghijklmno " * 500]
    got = secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner=s).collect()
    for r in got:
        base, spans = s.spans(texts[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, *_ in base) for x in secret_scan.KINDS)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert sum("secret" in r["spans"] for r in got) > 30


def test_sets_of_lines_are_as_large_as_their_hosts(spark):
    """Three thousand hosts of one line each beside one with 40,000: buckets follow each host's own lines."""
    from pyspark.sql import functions as F

    from tallyline.llm.common import line_sets, table, with_bad_lines

    bad = table(spark.range(43_000).select(F.when(F.col("id") < 40_000, "large").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("host"), F.xxhash64("id").alias("key")), "bad")
    sizes = line_sets(bad).select("host", F.size("bad").alias("n"), F.aggregate(F.transform("bad", F.size), F.lit(0), lambda a, b: a + b).alias("keys")).collect()
    assert {(r["n"], r["keys"]) for r in sizes if r["host"] != "large"} == {(1, 1)} and [(r["n"], r["keys"]) for r in sizes if r["host"] == "large"] == [(8192, 40_000)]
    rows = spark.createDataFrame([("large", 7), ("large", 39_999), ("large", 40_001), ("h40001", 40_001), ("h40001", 7), ("none", 7)], "host string, id long")
    for few in (500_000, 10):
        joined, is_bad = with_bad_lines(rows, bad, few)
        assert {(r["host"], r["id"]) for r in joined.where(is_bad(F.xxhash64("id"))).collect()} == {("large", 7), ("large", 39_999), ("h40001", 40_001)}


def test_clauses_of_several_licences_name_none():
    from tallyline.llm.license_scan import Scanner

    s = Scanner()
    clause = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    assert s.scan(clause)["labels"] == "" and s.scan(clause)["score"] > 0.5
    assert s.scan(f"Artistic License 2.0. {clause}")["labels"] in ("", "artistic")
    assert s.scan("It is made available under the terms of the Eclipse Public License v2.0 today.")["labels"] == "epl"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    assert "gpl" in s.scan(f"{gpl}. {clause}")["labels"].split(",")
