"""Places, tracks, items, roles, long intervals and coverage against plain Python."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import captions, intervals, matching, places


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ratio(a, b):
    both = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return both / (a[2] * a[3] + b[2] * b[3] - both) if a[2] > 0 and a[3] > 0 and b[2] > 0 and b[3] > 0 else 0.0


def greedy(rows, iou, alike):
    """rows: (id, key, box, look, name) in any order."""
    groups, place = [], {}
    for i, key, box, look, name in sorted(rows):
        for j, k, b, v, m in groups:
            if key == k and name == m and ratio(box, b) >= iou and (not alike or name is not None or (look is not None and v is not None and np.dot(look, v) >= 0.6)):
                place[i] = j
                break
        else:
            groups.append((i, key, box, look, name))
            place[i] = i
    return place


@pytest.mark.parametrize("few", [0, 20_000])
@pytest.mark.parametrize("iou", [0.5, 0.3])
def test_first_members_of_mixed_sizes(spark, monkeypatch, few, iou):
    monkeypatch.setattr(places, "FEW", few)
    rng = random.Random(int(iou * 10))
    rows = []
    for i in rng.sample(range(1000), 160):
        s = rng.choice([10, 37, 160, 640, 2000])
        box = [rng.randrange(3) * s + rng.uniform(-s, s) / 3, rng.uniform(-s, s) / 2, s * rng.uniform(0.7, 1.4), s * rng.uniform(0.3, 0.8)]
        rows.append((i, rng.choice(["a", None]), [round(v, 1) for v in box], None, None))
    rows += [(2000 + k, "a", rows[0][2], None, None) for k in range(3)] + [(3000, "a", [0.0, 0.0, 0.0, 5.0], None, None), (3001, "a", [0.0, 0.0, 0.0, 5.0], None, None), (3002, "a", [None] * 4, None, None)]
    df = table(spark, [(i, k, *b, i % 9) for i, k, b, _, _ in rows], "id int, k string, x double, y double, w double, h double, e int")
    want = greedy([(i, k, b if None not in b else [0.0] * 4, v, m) for i, k, b, v, m in rows], iou, False)
    assert {r["id"]: r["place"] for r in places.first_members(df, "id", ["k"], iou=iou).collect()} == want
    got = {r["place"]: r for r in places.place_groups(df, "e", "id", iou=iou, by=["k"]).collect()}
    assert got.keys() == set(want.values()) and sum(r["n"] for r in got.values()) == len(rows)


def test_two_large_boxes_are_one_place(spark):
    """IoU 0.6 at 100 px of distance; the ids run against the positions."""
    df = table(spark, [(2, 0.0, 0.0, 400.0, 100.0), (1, 100.0, 0.0, 400.0, 100.0)], "id int, x double, y double, w double, h double")
    assert {r["place"] for r in places.first_members(df, "id").collect()} == {1}
    assert places.first_members(df.where("id > 5"), "id").collect() == []


@pytest.mark.parametrize("few", [0, 20_000])
def test_first_members_must_look_alike(spark, monkeypatch, few):
    monkeypatch.setattr(places, "FEW", few)
    rng = random.Random(6)
    rows = []
    for i in range(80):
        look = np.random.default_rng(i % 4).normal(size=6) + np.random.default_rng(i).normal(size=6) * 0.4
        rows.append((i, None, [rng.uniform(0, 30), 0.0, 50.0, 20.0], None if i % 13 == 0 else (look / np.linalg.norm(look)).tolist(), rng.choice([None, None, "mark"])))
    df = table(spark, [(i, *b, v, m) for i, _, b, v, m in rows], "id int, x double, y double, w double, h double, look array<double>, name string")
    assert {r["id"]: r["place"] for r in places.first_members(df, "id", look="look", named="name").collect()} == greedy(rows, 0.5, True)


def test_groups_of_one_place_that_share_an_entity(spark):
    rows = [(1, 1, "v1", 0.0), (1, 2, "v2", 0.0), (3, 3, "v2", 1.0), (4, 4, "v9", 1.0), (5, 5, "v1", 500.0), (6, 6, "v2", 2.0)]
    m = table(spark, [(p, i, e, x, 0.0, 50.0, 20.0) for p, i, e, x in rows], "place int, id int, e string, x double, y double, w double, h double")
    assert {r["place"]: r["into"] for r in places.same_place(m, "e").collect()} == {1: 1, 3: 1, 4: 4, 5: 5, 6: 1}


def test_doubt_and_decisions(spark):
    corner, middle = [0.02, 0.02, 0.1, 0.05], [0.4, 0.4, 0.1, 0.05]
    rows = [(1, 1, "v1", *corner, 0.0, 9.0), (1, 2, "v2", *corner, None, None), (3, 3, "v1", *middle, 0.0, 1.0), (4, 4, "v3", *corner, 0.0, 1.0), (5, 5, "v2", *corner, 90.0, None)]
    cols = "place int, id int, e string, x double, y double, w double, h double, start double, end double"
    members = table(spark, rows, cols)
    caps = table(spark, [(1, "v2", 95.0, 96.0, 0.0, 0.0, 0.06, 0.1), (2, "v1", 20.0, 30.0, 0.0, 0.0, 1.0, 1.0)], "id int, e string, start double, end double, x double, y double, w double, h double")
    looked = table(spark, [("v1",), ("v2",)], "e string")
    got = {r["place"]: r["doubt"] for r in places.recurrence_doubt(members, caps, looked, "e").collect()}
    assert got == {1: "caption", 3: "position", 4: "no captions", 5: "caption"}
    assert {r["place"]: r["doubt"] for r in places.recurrence_doubt(members, caps.where("id = 2"), looked, "e").collect()} == {1: None, 3: "position", 4: "no captions", 5: None}
    groups = members.where("id = place").withColumn("basis", F.lit("recurrence"))
    made = table(spark, [(1, "accept", "a", "recurrence", 0.03, 0.02, 0.1, 0.05), (2, "reject", "b", "recurrence", 0.02, 0.02, 0.1, 0.05), (3, "accept", "c", "text", 0.02, 0.02, 0.1, 0.05), (9, "accept", "d", "recurrence", 0.1, 0.02, 0.1, 0.05)], "at int, decision string, signer string, basis string, x double, y double, w double, h double")
    kept = {r["place"]: (r["decision"], r["signer"]) for r in places.kept_decisions(groups, made, ["basis"]).collect()}
    assert kept == {1: ("reject", "b"), 3: (None, None), 4: ("reject", "b"), 5: ("reject", "b")}


def test_decisions_in_a_place_of_many_copies(spark):
    """20,000 groups and 20,000 decisions of three rectangles meet as three; nulls of `by` and in a decision count as before."""
    k, box = F.col("id"), lambda x: [x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(90.0).alias("w"), F.lit(20.0).alias("h")]
    groups = spark.range(20_000).select(k.alias("place"), F.when(k != 7, k % 2).alias("aspect"), *box(k % 3 * 10))
    made = spark.range(20_000).select((k % 5000).alias("at"), F.when(k % 5000 != 4998, F.concat(F.lit("d"), k.cast("string"))).alias("decision"), F.lit("s").alias("signer"), (k % 2).alias("aspect"), *box(k % 3 * 10))
    begun = time.monotonic()
    kept = places.kept_decisions(groups, made, ["aspect"])
    got = {(r["aspect"], r["decision"], r["signer"]): r["n"] for r in groups.join(kept, "place").groupBy("aspect", "decision", "signer").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, None, "s"): 10_000, (1, "d9999", "s"): 9_999, (None, None, None): 1} and time.monotonic() - begun < 60


def test_tracks_chain_whatever_their_ids(spark):
    """Tracks touch from end to start in time; those that overlap don't touch."""
    rows = [(2, "v", 0.0, 1.0), (1, "v", 1.05, 2.0), (5, "v", 1.9, 3.0), (4, "v", 3.0, 3.0), (3, "w", 1.0, 1.05)]
    df = table(spark, rows, "id int, e string, start double, end double")
    got = {r["track"]: (r["n"], r["start"], r["end"]) for r in matching.chain_merge(df, ["e"], 0.1, F.lit(True)).collect()}
    assert got == {1: (2, 0.0, 2.0), 4: (2, 1.9, 3.0), 3: (1, 1.0, 1.05)}


def test_split_lines_by_the_rules(spark):
    cols = "e string, id int, start double, end double, x double, y double, w double, h double, text string, ink_h double, color string, n_samples int"
    base = dict(e="v", start=6.4, end=8.4, x=100.0, y=500.0, w=200.0, h=40.0, text="red shirt man", ink_h=30.0, color="#FFFFFF", n_samples=10)
    part = dict(base, start=8.4, end=9.6, x=160.0, w=140.0, text="shirt-man", n_samples=6)
    other = [dict(part, e=f"v{k}", **change) for k, change in enumerate([{}, {"start": 8.8}, {"y": 515.0}, {"x": 290.0}, {"ink_h": 37.0}, {"color": "#C00000"}, {"text": "another"}, {"text": "!!"}, {"ink_h": None}, {"start": 8.3}])]
    rows = [dict(b, id=2 * k + j) for k, p in enumerate(other) for j, b in enumerate((dict(p), dict(base, e=p["e"])))]
    df = table(spark, [tuple(r[c.split()[0]] for c in cols.split(", ")) for r in rows], cols)
    got = captions.merge_split_lines(df, ["e"], 0.2).collect()
    joined = [r for r in got if r["n_tracks"] == 2]
    assert len(got) == 19 and [r["e"] for r in joined] == ["v0"]
    r = joined[0]
    assert (r["id"], r["text"], r["start"], r["end"], r["x"], r["w"], r["n_samples"], r["ink_h"]) == (1, "red shirt man", 6.4, 9.6, 100.0, 200.0, 16, 30.0)


def plain_items(rows, dt):
    items, out = [], {}
    for r in sorted(rows, key=lambda r: (r["e"], r["start"], r["y"], r["id"])):
        for it in items:
            f = it[0]
            if f["e"] != r["e"] or abs(f["start"] - r["start"]) > 1.5 * dt + 1e-6 or abs(f["end"] - r["end"]) > 1.5 * dt + 1e-6:
                continue
            x1, x2, y1, y2 = min(q["x"] for q in it), max(q["x"] + q["w"] for q in it), min(q["y"] for q in it), max(q["y"] + q["h"] for q in it)
            m = float(np.median([q["h"] for q in it]))
            if max(r["y"] - y2, y1 - (r["y"] + r["h"])) <= 0.8 * max(r["h"], m) and min(x2, r["x"] + r["w"]) - max(x1, r["x"]) > 0 and max(r["h"], m) <= 1.6 * min(r["h"], m):
                it.append(r)
                break
        else:
            items.append([r])
    for it in items:
        for k, q in enumerate(sorted(it, key=lambda q: (q["y"], q["id"])), 1):
            out[q["id"]] = (it[0]["id"], k)
    return out


def test_items_of_simultaneous_lines(spark):
    rng = random.Random(3)
    rows = [dict(e=rng.choice("ab"), id=i, start=round(rng.choice([0, 0, 4, 30, 31]) + rng.uniform(0, 1.2), 2), end=round(50 + rng.uniform(0, 1.5), 2), x=rng.uniform(0, 60), y=rng.uniform(0, 100), w=50.0, h=rng.choice([8.0, 10.0, 14.0])) for i in range(150)]
    df = table(spark, [tuple(r.values()) for r in rows], "e string, id int, start double, end double, x double, y double, w double, h double").repartition(7)
    got = {r["id"]: (r["item"], r["place"]) for r in captions.group_items(df, "e", 0.5).collect()}
    want = plain_items(rows, 0.5)
    assert got == want and 1 < len({v[0] for v in want.values()}) < 150


def test_registered_items_equal_plain_python(spark):
    from tallyline.plans.base import events
    from tallyline.plans.similarity import w15_items

    rows = [dict(e=r["video_id"], id=(k := r["event_id"]), start=r["t"] // 24 * 24 + k % 3, end=r["t"] // 24 * 24 + 20 + k % 4, x=k % 50, y=k * 13 % 120, w=60 + k % 5, h=10 + k % 4 * 3) for r in events(spark, "/root/testdata/sf0.001").collect()]
    assert {r["id"]: (r["item"], r["place"]) for r in w15_items(spark, "/root/testdata/sf0.001").collect()} == plain_items(rows, 1.0)


def test_a_case_for_every_role(spark):
    cols = "e string, id int, start double, end double, text string, x double, y double, w double, h double, ink_h double, color string, boxed boolean"
    rows = [
        ("v", 1, 0.0, 100.0, "My Channel", 0.0, 10.0, 100.0, 30.0, 60.0, None, False),  # the channel's own name, though shown all the time
        ("v", 2, 0.0, 90.0, "The title", 50.0, 50.0, 200.0, 40.0, 50.0, None, False),
        ("v", 3, 0.5, 20.0, "what it is about", 60.0, 95.0, 150.0, 20.0, 20.0, None, False),
        ("v", 4, 5.0, 8.0, "Anna", 300.0, 400.0, 60.0, 20.0, 20.0, None, True),
        ("v", 5, 6.0, 7.0, "wow!", 300.0, 300.0, 60.0, 40.0, 45.0, "#E02010", False),
        ("v", 6, 10.0, 12.0, "“hello there”", 100.0, 800.0, 200.0, 30.0, 30.0, "#FFE000", False),
        ("v", 7, 13.0, 15.0, "they walk home", 100.0, 805.0, 200.0, 30.0, 30.0, "#FFFFFF", False),
        ("v", 8, 16.0, 20.0, "spoken aloud", 100.0, 790.0, 200.0, 30.0, 30.0, "#FFE000", False),
        ("v", 9, 21.0, 22.0, "coloured as speech", 100.0, 800.0, 200.0, 30.0, 30.0, "#FFE205", False),
        ("v", 10, 23.0, 24.0, "another scene", 100.0, 800.0, 200.0, 30.0, 30.0, "#FFFFFF", False),
        ("v", 11, 25.0, 26.0, "far from the band", 100.0, 500.0, 200.0, 30.0, 30.0, "#FFFFFF", False),
        ("w", 12, 0.0, 1.0, None, None, None, None, None, None, None, None),
    ]
    frames, speech = table(spark, [("v", 100.0, 1000.0), ("w", 10.0, 1000.0)], "e string, duration double, height double"), table(spark, [("v", 1, 17.9, 20.0), ("v", 2, 23.9, 30.0)], "e string, id int, start double, end double")
    got = {r["id"]: r["role"] for r in captions.assign_roles(table(spark, rows, cols), frames, speech, "e", ["my channel", "ab"]).collect()}
    assert got == {1: "identity_mark", 2: "title", 3: "description", 4: "speaker", 5: "reaction", 6: "dialogue", 7: "situation", 8: "dialogue", 9: "dialogue", 10: "situation", 11: "unknown", 12: "unknown"}


def test_long_intervals_are_few_rows(spark):
    rng = random.Random(8)
    rows = [(i % 2, i, s := rng.uniform(-500, 9000), s + rng.choice([0.0, 0.1, 3.0, 24.0, 25.0, 700.0, 1e4, 1e9])) for i in range(120)] + [(0, 500, 5.0, 1.0), (0, 501, None, 1.0), (0, 502, 24.0, 48.0), (0, 503, 48.0, 96.0), (0, 504, 0.0, 24.0)]
    df = table(spark, rows, "e int, id int, start double, end double")
    good = [r for r in rows if r[2] is not None and r[2] <= r[3]]
    want = sorted((a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[2] < b[3] and a[3] > b[2])
    assert sorted((r["a_id"], r["b_id"]) for r in intervals.overlaps(df, df, "e", 24.0).collect()) == want
    points = table(spark, [(e, i, t) for e in (0, 1) for i, t in enumerate([0.0, 24.0, 48.0, 100.5, 8000.0, 1e6, None])], "e int, id int, t double")
    hit = sorted((e, i, b[1]) for e in (0, 1) for i, t in enumerate([0.0, 24.0, 48.0, 100.5, 8000.0, 1e6]) for b in good if b[0] == e and b[2] + 0.05 < t < b[3] - 0.05)
    assert sorted((r["e"], r["p_id"], r["s_id"]) for r in intervals.points_in(points, df, "e", 24.0, 0.05).collect()) == hit
    year = table(spark, [(1, 0.0, 3.2e7)], "id int, start double, end double").withColumn("level", intervals._level("start", "end", 24.0))
    n = year.select(F.size(F.concat(intervals._cells("start", "end", F.col("level"), 24.0), intervals._above("start", "end", F.col("level") + 1, F.lit(25), 24.0))).alias("n")).head()["n"]
    assert n <= 2 * 21


def test_coverage_equals_a_raster(spark):
    rng = np.random.default_rng(4)
    box = lambda n, least: [np.sort(rng.integers(0, n, 2)) + [0, least] for _ in range(3)]
    overlays = [(e, i, *box(24, 1)) for i in range(4) for e in ("v", "w")]
    ops = [("v", 100 + i, *[np.sort(rng.integers(-4, 28, 2)) for _ in range(3)]) for i in range(300)] + [("w", 900 + i, *box(24, 0)) for i in range(6)]
    flat = lambda rows: [(e, i + (50 if e == "w" else 0), *map(float, (t[0], t[1], x[0], y[0], x[1] - x[0], y[1] - y[0]))) for e, i, t, x, y in rows]
    cols = "e string, id int, start double, end double, x double, y double, w double, h double"
    got = {r["id"]: (r["covered"], r["share"]) for r in intervals.rectangle_coverage(table(spark, flat(overlays), cols), table(spark, flat(ops), cols), "e", 5.0, per_cut=20).collect()}
    for e, i, t, x, y in overlays:
        grid = np.zeros((26, 26, 26), bool)
        for f, _, u, p, q in ops:
            if f == e:
                grid[max(0, u[0]) : max(0, u[1]), max(0, p[0]) : max(0, p[1]), max(0, q[0]) : max(0, q[1])] = True
        part = grid[t[0] : t[1], x[0] : x[1], y[0] : y[1]]
        covered, share = got[i + (50 if e == "w" else 0)]
        assert abs(share - part.mean()) < 1e-6 and covered == bool(part.all())


def test_two_thousand_ops_on_one_overlay(spark):
    """Half of them are tiles that cover it whole, the others anything."""
    rng = np.random.default_rng(5)
    tiles = [(t, t + 1.0, x, y, 1.0, 1.0) for t, x, y in itertools.product(range(10), range(10), range(10))]
    noise = [(s := float(rng.uniform(0, 9)), s + 0.2, float(rng.uniform(0, 9)), float(rng.uniform(0, 9)), 0.7, 0.7) for _ in range(1000)]
    cols = "e int, id int, start double, end double, x double, y double, w double, h double"
    ops = [(1, i, *map(float, r)) for i, r in enumerate(tiles + noise)]
    over = table(spark, [(1, 1, 0.0, 10.0, 0.0, 0.0, 10.0, 10.0)], cols)
    assert [tuple(r) for r in intervals.rectangle_coverage(over, table(spark, ops, cols), "e").collect()] == [(1, True, 1.0)]
    assert [r["share"] for r in intervals.rectangle_coverage(over, table(spark, ops[1:1000], cols), "e").collect()] == [0.999]
