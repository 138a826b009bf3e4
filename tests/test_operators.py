"""Small hand-written cases of the operators, with the values that they must give."""

import difflib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as X
from tallyline.functions import urls as U
from tallyline.operators import colors, intervals, layers, matching, qa, similarity, state, stats, text, windows
from tallyline.streaming.upserts import latest_by_key, stream_upserts


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


def test_pstats_drops_null_and_nan(spark):
    df = table(spark, [("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), (None, 5.0)], "g string, v double")
    got = {r["grp"]: (r["n"], r["p50"]) for r in stats.pstats_by_group(df, "v", "g").collect()}
    assert got == {None: (3, 3.0), "a": (2, 2.0)}


def test_unmeasured_item(spark):
    df = table(spark, [("a", None, 1, 1), ("b", 2.0, 2, 2)], "g string, v double, e long, pos long")
    got = as_dict(stats.numeric_item(df, "k", "v", "g", "e", "pos"), "grp")
    assert got["a"]["status"] == "unmeasured" and got["a"]["value"] is None and got["a"]["blocker"]
    assert got["b"]["value"] == 2.0 and got[None]["n"] == 1


def test_mode_ties_go_to_the_first_seen(spark):
    df = table(spark, [(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "e int, v string, pos int")
    assert stats.entity_mode(df, "e", "v", "pos").head()["mode"] == "b"


def test_tri_state(spark):
    df = table(spark, [(1, True), (1, None), (2, False), (3, None)], "e int, f boolean")
    got = {r["e"]: r["s"] for r in df.groupBy("e").agg(stats.tri_state(F.col("f")).alias("s")).collect()}
    assert got == {1: "present", 2: "absent", 3: "unmeasured"}


def test_cut_structure_rates(spark):
    """Boundary times are no transitions; a video without cuts is one shot of its whole length."""
    times = table(spark, [("A", 5.0), ("A", 10.0), ("A", 15.0), ("B", 2.0), ("B", 4.0), ("B", 10.0), ("D", 3.0), ("D", 6.0), ("D", 9.0)], "v string, t double")
    spans = table(spark, [("A", 20.0), ("B", 30.0), ("C", 10.0), ("D", 12.0)], "v string, d double")
    g = intervals.gaps(times, spans, "v", "t", "d").groupBy("v").agg(F.median("gap").alias("m"))
    assert {r["v"]: r["m"] for r in g.collect()} == {"A": 5.0, "B": 4.0, "C": 10.0, "D": 3.0}


def test_merge_intervals(spark):
    df = table(spark, [("e", 0.0, 1.0), ("e", 1.05, 2.0), ("e", 3.0, 4.0)], "e string, s double, t double")
    assert sorted((r["s"], r["t"]) for r in intervals.merge_intervals(df, "e", "s", "t", gap=0.1).collect()) == [(0.0, 2.0), (3.0, 4.0)]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i % 3, round(rng.uniform(0, 50), 3), i) for i in range(80)]
    rows = [(e, s, round(s + rng.uniform(0.1, 20), 3), i) for e, s, i in rows]
    df = table(spark, rows, "e int, start double, end double, id int")
    got = {(r["a_id"], r["b_id"]) for r in intervals.overlaps(df, df, "e", 5.0).collect()}
    want = {(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[2] and a[2] > b[1]}
    assert got == want


def test_nearest_and_as_of(spark):
    left = table(spark, [("v", 1, 10.0), ("v", 2, 20.0), ("w", 3, 1.0)], "e string, id int, t double")
    right = table(spark, [("v", 9.0, "a"), ("v", 10.5, "b"), ("v", 40.0, "c")], "e string, t double, name string")
    near = {r["id"]: r["near_name"] for r in intervals.nearest(left, right, "e", "t", 2.0, "id", ["name"]).collect()}
    assert near == {1: "b", 2: None, 3: None}
    assert {r["id"]: r["name"] for r in intervals.as_of(left, right, "e", "t", "name", "id").collect()} == {1: "a", 2: "b", 3: None}


def test_rectangle_coverage(spark):
    """Two halves cover an overlay; half of its time covers half of it."""
    cols = "e string, id int, start double, end double, x double, y double, w double, h double"
    over = table(spark, [("v", 1, 0.0, 10.0, 0.0, 0.0, 10.0, 10.0), ("v", 2, 0.0, 10.0, 50.0, 0.0, 10.0, 10.0), ("v", 3, 0.0, 1.0, 90.0, 0.0, 1.0, 1.0)], cols)
    ops = table(spark, [("v", 11, 0.0, 10.0, 0.0, 0.0, 5.0, 10.0), ("v", 12, -1.0, 12.0, 5.0, 0.0, 9.0, 10.0), ("v", 13, 5.0, 10.0, 50.0, 0.0, 10.0, 10.0)], cols)
    got = as_dict(intervals.rectangle_coverage(over, ops, "e"), "id")
    assert (got[1]["covered"], got[2]["covered"], got[2]["share"], got[3]["share"]) == (True, False, 0.5, 0.0)


def test_rank_known_first(spark):
    rows = [("y", "low", 5, 2, 1), ("y", "high", 9, 1, 1), ("y", "unk2", None, 1, 2), ("y", "unk1", None, 1, 1)]
    df = table(spark, rows, "p string, id string, v int, at int, seen int")
    got = sorted((r["place"], r["id"], r["rank"]) for r in windows.rank_known_first(df, "p", "v", "at", "seen", "id").collect())
    assert got == [(1, "high", 1), (2, "low", 2), (3, "unk1", None), (4, "unk2", None)]


def test_sequences(spark):
    df = table(spark, [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "b"), (2, 2, "a"), (2, 3, "z")], "e int, pos int, v string")
    assert {r["e"]: r["sequence"] for r in windows.collapsed_sequence(df, "e", "pos", "v").collect()} == {1: "a>b", 2: "b>a>z"}
    order = table(spark, [("a", 0), ("b", 1)], "v string, idx int")
    assert {r["e"]: (r["n_unknown"], r["in_order"]) for r in windows.follows_order(df, "e", "pos", "v", order).collect()} == {1: (0, True), 2: (1, False)}


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.youtube.com/watch?v=abcdefghijk&t=3", "youtube:abcdefghijk"), ("https://youtu.be/abcdefghijk?si=x", "youtube:abcdefghijk"), ("youtube.com/shorts/abcdefghijk", "youtube:abcdefghijk"),
        ("https://www.tiktok.com/@u/video/123?lang=en", "tiktok:123"), ("https://instagram.com/name/reel/Ab_1/", "instagram:Ab_1"), ("https://old.reddit.com/r/x/comments/a1b2/title/", "reddit:a1b2"),
        ("https://redd.it/a1b2", "reddit:a1b2"), ("HTTP://M.Example.org/a/b/?b=2&utm_source=x&a=1#top", "example.org/a/b?a=1&b=2"), ("  ", None), (None, None),
    ],
)
def test_url_key(spark, url, key):
    assert one(spark, U.url_key(F.lit(url).cast("string"))) == key


@pytest.mark.parametrize("url, handle", [("https://tiktok.com/@u.x/video/1", "@u.x"), ("https://youtube.com/shorts/abcdefghijk", None), ("https://instagram.com/reel/x", None), ("https://instagram.com/me/", "@me"), ("https://reddit.com/u/bob/", "u/bob")])
def test_handle(spark, url, handle):
    assert one(spark, U.handle(F.lit(url))) == handle


@pytest.mark.parametrize("s, seconds", [("PT1H2M3S", 3723), ("P1DT1S", 86401), ("PT59S", 59), ("P", None), ("x", None), ("PT", None)])
def test_iso8601(spark, s, seconds):
    assert one(spark, X.iso8601_seconds(F.lit(s))) == seconds


def test_recency(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, X.recency(at("2024-01-01"), at("2024-01-31"))[1]) == "recent"
    assert one(spark, X.recency(at("2024-02-01"), at("2024-01-31"))[0]) == 0
    assert one(spark, X.recency(at("2023-01-01"), at("2024-01-31"))[1]) == "old"
    assert one(spark, X.recency(at(None), at("2024-01-31"))[1]) == "unknown"


def test_credits(spark):
    df = table(spark, [(1, "출처: @maker, thanks @maker and @pal."), (2, "Video by Bob via https://a.b/c."), (3, None)], "id int, t string")
    got = sorted((r["id"], r["kind"], r["value"]) for r in text.extract_credits(df, "id", "t").collect())
    assert got == [(1, "mention", "@pal"), (1, "출처", "@maker"), (2, "credit", "Bob"), (2, "via", "https://a.b/c")]


def test_colors(spark):
    rows = [("g", "#000000", 1), ("g", "#050505", 2), ("g", "#FFFFFF", 3), ("g", "oops", 4), ("g", None, 5)]
    r = colors.color_mode(table(spark, rows, "g string, c string, pos int"), "g", "c", "pos").head()
    assert (r["n"], round(r["share"], 3)) == (2, 0.667)


def test_hamming_finds_every_pair(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    near = [(i + 100, b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 14)), replace=False))) for i, b in enumerate(base)]
    got = {(r["cand"], r["ref"], r["distance"]) for r in similarity.hamming_join(table(spark, near, "cand int, h long"), table(spark, list(enumerate(base)), "ref int, h long"), "cand", "ref", "h").collect()}
    assert got == {(c, r, (h ^ b).bit_count()) for c, h in near for r, b in enumerate(base) if (h ^ b).bit_count() <= 10}


def test_fuzzy_names(spark):
    names, refs = [(1, "Clip.Maker"), (2, "clip_makr"), (3, "someone"), (4, "theclipmakerfan")], [(9, "clipmaker")]
    got = {r["id"] for r in similarity.fuzzy_names(table(spark, names, "id int, name string"), table(spark, refs, "ref int, r string"), "name", "r").collect()}
    assert got == {1, 2, 4}
    assert difflib.SequenceMatcher(None, "clipmakr", "clipmaker").ratio() >= 0.8


def test_components(spark):
    links = table(spark, [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in similarity.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_total_order(spark):
    rows = [(1, 1, "intro"), (1, 2, "turn"), (1, 3, "end"), (2, 1, "intro"), (2, 2, "end"), (3, 1, "x"), (3, 2, "y"), (4, 1, "y"), (4, 2, "x")]
    got = {r["i"]: r["n_after"] for r in matching.total_order(table(spark, rows, "e int, pos int, i string"), "e", "pos", "i").collect()}
    assert got == {"intro": 2, "turn": 1, "end": 0, "x": 0, "y": 0}


def test_stable_ids(spark):
    old = table(spark, [("T1", [1.0, 0.0]), ("T2", [0.0, 1.0])], "o string, x array<double>")
    new = table(spark, [(1, [0.1, 1.0]), (2, [0.9, 0.1]), (3, [-1.0, -1.0])], "n int, x array<double>")
    assert {r["n"]: r["type_id"] for r in matching.stable_ids(new, old, "n", "o", "x", 0.5, "T").collect()} == {1: "T2", 2: "T1", 3: "T3"}


def test_layers(spark):
    rows = [("k", "base", 0, "b", False), ("k", "measured", 1, "m", False), ("k", "own", 2, None, True)]
    r = layers.layered(table(spark, rows, "key string, layer string, p int, value string, gone boolean"), ["key"], F.col("p"), "value", "gone").head()
    assert (r["value"], r["layer"]) == ("m", "measured")
    items = table(spark, [("a", "measured", 1, 1), ("a", "measured", 2, 2), ("b", "unmeasured", None, 1), ("b", "measured", 3, 2)], "k string, s string, v int, p int")
    assert {r["k"]: (r["status"], r["value"]) for r in layers.resolve_items(items, "k", "s", "v", "p").collect()} == {"a": ("conflict", None), "b": ("measured", 3)}


def test_upsert_is_idempotent(spark):
    old = table(spark, [(1, "t", 5.0, [], ["a"], 3)], "id long, title string, views double, history array<double>, tags array<string>, first_seen long")
    new = table(spark, [(1, 1, "", 7.0, ["b"], 9), (2, 1, "n", None, ["c"], 9)], "id long, pos long, title string, views double, tags array<string>, seen long")
    run = lambda before: state.upsert(before, new, ["id"], "pos", ["title"], "views")
    once = run(old)
    got = as_dict(once, "id")
    assert (got[1]["title"], got[1]["views"], got[1]["history"], got[1]["tags"], got[1]["first_seen"], got[1]["origin"]) == ("t", 7.0, [5.0], ["a", "b"], 3, "updated")
    assert got[2]["origin"] == "new"
    assert sorted(map(str, run(once.drop("origin")).drop("origin").collect())) == sorted(map(str, once.drop("origin").collect()))


def test_lifecycle(spark):
    now = table(spark, [(1, "fix_submitted", ["open"]), (2, "fix_submitted", []), (3, "open", []), (4, "open", []), (5, "fixed", [])], "k int, status string, history array<string>")
    run = table(spark, [(1, False), (2, True), (3, False), (5, True), (6, True), (7, False)], "k int, failing boolean")
    assert {r["k"]: r["status"] for r in state.lifecycle(now, run, "k").collect()} == {1: "fixed", 2: "reopened", 3: "resolved_without_fix", 4: "superseded", 5: "reopened", 6: "open"}


def test_count_range(spark):
    seen = table(spark, [("pop", n) for n in (1, 1, 1, 1, 9)], "k string, n int")
    asked = table(spark, [("pop", 1), ("pop", 9), ("pop", 12), ("new", 1)], "k string, n int")
    assert sorted((r["k"], r["n"], r["verdict"]) for r in qa.count_range_verdict(asked, seen, "k", "n").collect()) == [("new", 1, "unmeasured"), ("pop", 1, "in_range"), ("pop", 9, "observed"), ("pop", 12, "outside")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, p, None if p % 3 == 0 else float(p)) for p in range(40) for k in range(3)]
    df = table(spark, rows, "k long, pos long, v double")
    df.repartition(5).write.json(str(tmp_path / "in"))
    got = stream_upserts(spark, str(tmp_path / "in"), "k long, pos long, v double", "k", "pos", state=str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latest_by_key(df, "k", "pos").collect()))


def test_fuzzy_names_equal_brute_force(spark):
    """Also where all names share their grams, and where alike names share no gram of three."""
    rng = random.Random(4)
    names = [f"Customer#{i:09d}" for i in range(1, 40)] + ["abcde", "ab", "", "ring of fire", "xyzw"] + ["".join(rng.choice("abc-") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    refs = [f"Customer {i:07d}" for i in range(30)] + ["abXde", "AB", "--", "firering of fire2", "yzw"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    bare = lambda s: "".join(c for c in s.lower() if c.isalnum())
    want = {}
    for i, n in enumerate(names):
        for k, m in enumerate(refs):
            p, q = bare(n), bare(m)
            r = difflib.SequenceMatcher(None, p, q).ratio()
            if p == q or min(len(p), len(q)) >= 4 and (p in q or q in p) or r >= 0.8:
                want[i, k] = round(r, 6)
    got = similarity.fuzzy_names(table(spark, list(enumerate(names)), "id int, name string"), table(spark, list(enumerate(refs)), "ref int, r string"), "name", "r").collect()
    assert len(got) == len(want) and {(r["id"], r["ref"]): r["ratio"] for r in got} == want


def test_ratios_equal_difflib():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["ab" * 40, "customer000000123", "customer0001230", "가나다가", ""]
    r, c = np.array([(i, k) for i in range(len(texts)) for k in range(len(texts))]).T
    got = similarity._ratios(texts, texts, r, c, step=1000)
    assert got.tolist() == [difflib.SequenceMatcher(None, texts[i], texts[k]).ratio() for i, k in zip(r, c, strict=True)]


def test_fuzzy_links_are_those_of_the_pairs(spark):
    """One row for each name, also of thousands that are all alike: copies are compared once, and links are counted."""
    names = [(i, f"Customer#{i % 3000:09d}") for i in range(6000)] + [(7001, None), (7000, "none at all"), (7002, "--")]
    refs = [(k, f"Customer {k % 400:07d}") for k in range(800)] + [(900, "noneatall"), (901, "None att all"), (902, "!")]
    a, b = table(spark, names, "id long, name string"), table(spark, refs, "ref long, r string")
    begun = time.monotonic()
    got = {r["id"]: tuple(r)[1:] for r in similarity.fuzzy_links(a, b, "name", "r").collect()}
    assert time.monotonic() - begun < 60 and len(got) == 6003
    assert got[7000] == (7000, 2, 900, 1.0) and got[7001] == (7001, 0, None, None) and got[7002] == (7002, 1, 902, 1.0)
    for i in (0, 7, 2999, 5999):
        p = f"customer{i % 3000:09d}"
        s = {k: difflib.SequenceMatcher(None, p, f"customer{k % 400:07d}").ratio() for k in range(800)}
        linked = [k for k, v in s.items() if v >= 0.8 or f"customer{k % 400:07d}" in p]
        best = min(linked, key=lambda k: (-s[k], k))
        assert got[i] == (i % 3000, len(linked), best, round(s[best], 6))


def test_fuzzy_links_send_no_names_to_the_driver(spark, tmp_path):
    """Their size isn't known when the plan is made, so names, 4-grams and blocks meet by shuffles: a table that every task holds is built on the driver."""
    names, refs = spark.range(3000).select("id", F.format_string("Customer#%09d", "id").alias("name")), spark.range(300).select(F.col("id").alias("ref"), F.format_string("Customer %07d", "id").alias("r"))
    for df, at in ((names, "names"), (refs, "refs")):
        df.write.parquet(str(tmp_path / at))
    a, b = (spark.read.parquet(str(tmp_path / at)) for at in ("names", "refs"))
    for out, rows in ((similarity.fuzzy_links(a, b, "name", "r"), 3000), (similarity.fuzzy_names(a.where("id < 9"), b.where("ref < 7"), "name", "r"), 63)):
        assert len(out.collect()) == rows
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_texts_that_begin_alike_match_as_difflib():
    """Together, by their beginnings, or one by one; also in stretches, and where a second long text has frequent characters."""
    rng = random.Random(6)
    some = lambda letters, low, high, n=60: ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]
    lists = [(some("ab", 1, 10), some("ab", 1, 10)), (some("가나다ab", 1, 7), some("가나다ab", 1, 7)), ([f"customer{i:09d}" for i in rng.sample(range(3000), 150)], [f"customer{i:07d}" for i in rng.sample(range(3000), 150)])]
    lists += [([f"{rng.choice(['aab', 'abab'])}{i:03d}b" for i in range(80)], [f"{rng.choice(['aab', 'abab'])}{i:02d}ab" for i in range(80)]), (["ab" * 40 + str(i) for i in range(9)] + ["x" * 190], ["ba" * 39 + str(i) for i in range(9)] + ["x" * 210])]
    for (xs, ys), ratio, step in ((v, ratio, step) for v in lists for ratio in (0.8, 0.4) for step in (2048, 37)):
        xs, ys = (sorted(set(v), key=lambda t: (len(t), t)) for v in (xs, ys))
        got = {}
        for r, c, m, need, both in similarity._alike(xs, ys, ratio, step):
            got |= {(r.start + i, c.start + j): 2.0 * m[i, j] / both for i, j in zip(*np.nonzero(m >= need), strict=True)}
        assert got == {(i, j): s for i, p in enumerate(xs) for j, q in enumerate(ys) if (s := difflib.SequenceMatcher(None, p, q).ratio()) >= ratio}


def test_colors_of_many_small_groups(spark):
    """40,000 groups do not cost a frame each, and do not meet in one task."""
    k = F.col("id")
    rows = spark.range(80_000).select((k % 40_000).alias("g"), F.when(k < 40_000, "#102030").otherwise("#122232").alias("c"), k.alias("p"))
    begun = time.monotonic()
    got = {tuple(r) for r in colors.color_mode(rows, "g", "c", "p").groupBy("color", "n", "share").count().collect()}
    assert got == {("#112131", 2, 1.0, 40_000)} and time.monotonic() - begun < 40
