"""Rules of measurement, labels, gates and layers on small hand-written cases, with the values that they must give."""

import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyline.functions import scalars as X
from tallyline.functions import urls as U
from tallyline.operators import catalog, colors, endings, features, intervals, labels, layers, matching, qa, similarity, state, stats, text
from tallyline.streaming.upserts import stream_upserts


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


# ---------------------------------------------------------------- scalars


@pytest.mark.parametrize(
    ("message", "kind"),
    [
        ("\x1b[0;31mERROR:\x1b[0m Sign in to confirm you're not a bot", "login_required"),
        ("Login is required", "login_required"),
        ("This video requires logged-in cookies", "login_required"),
        ("try --cookies-from-browser", "login_required"),
        ("This content isn't available to you, log in", "login_required"),
        ("rate-limit reached or login required", "login_required"),
        ("age restricted", "login_required"),
        ("Tunnel connection failed: 403 Forbidden", "blocked"),
        ("blocked by the network policy", "blocked"),
        ("Forbidden (403)", "blocked"),
        ("HTTP Error 451", "blocked"),
        ("HTTP Error 500", "error"),
        (None, None),
    ],
)
def test_error_classes(spark, message, kind):
    assert one(spark, X.error_class(F.lit(message))) == kind


def test_scrub(spark):
    cases = {
        "at /home/me/x/y": "at ~/x/y", "in '/Users/some body/z'": "in '~ body/z'", "/root/a /rooted": "~/a /rooted",
        "C:\\Users\\me\\a and d:\\\\Users\\\\you\\\\b": "~\\a and ~\\\\b", "/tmp/a/b c": "<tmp> c", "/private/var/folders/x1/T/y)": "<tmp>)",
        "/var/tmp/q": "<tmp>", "https://ex.org/home/me/x": "https://ex.org/home/me/x", "x/tmp/a": "x/tmp/a", "file:/tmp/a": "file:/tmp/a",
    }
    for given, want in cases.items():
        assert one(spark, X.scrub(F.lit(given))) == want, given
    schema = StructType.fromDDL("a string, n int, b struct<c: array<string>, m: map<string,string>>")
    df = spark.createDataFrame([("/tmp/x", 1, (["/home/me/q", None], {"/tmp/k": "/root/z"})), (None, None, None)], schema)
    got = df.select(*[X.scrub_nested(F.col(f.name), f.dataType).alias(f.name) for f in schema]).collect()
    assert got[0].asDict(True) == {"a": "<tmp>", "n": 1, "b": {"c": ["~/q", None], "m": {"/tmp/k": "~/z"}}} and tuple(got[1]) == (None, None, None)


def test_url_parameters(spark):
    cases = {
        "http://ex.org/a?b=2&a=1&utm_x=3&ref=q": "ex.org/a?a=1&b=2", "ex.org/a?a=&b=1": "ex.org/a?b=1", "ex.org/a?a&b=%41%20c": "ex.org/a?b=A+c",
        "ex.org/a?b=A+c": "ex.org/a?b=A+c", "ex.org/?q=~*é": "ex.org?q=~%2A%C3%A9", "ex.org/?%61=1": "ex.org?a=1", "ex.org/?a=%zz": "ex.org?a=%25zz",
    }
    for given, want in cases.items():
        assert one(spark, U.url_key(F.lit(given))) == want, given


def test_aspect_of_large_sizes(spark):
    rows = [(1080, 1920, "9:16"), (7, 7, "1:1"), (99999937, 99999989, "99999937:99999989"), (0, 5, None), (5, 0, None), (None, 5, None), (40000, 10000, "4:1")]
    df = table(spark, rows, "w int, h int, want string").select(X.aspect(F.col("w"), F.col("h")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


# ---------------------------------------------------------------- colours, percentiles


def test_colours_join_a_running_median(spark):
    rows = [("g", c, i) for i, c in enumerate(["#000000", "#140000", "#1E0000"])] + [("h", "#FFFFFF", 1), ("h", "#FEFEFE", 2), ("h", "#000000", 3), ("h", "bad", 4), (None, "#010203", 1)]
    got = {r["g"]: (r["color"], r["n"], round(r["share"], 4)) for r in colors.color_mode(table(spark, rows, "g string, c string, p int"), "g", "c", "p").collect()}
    assert got == {"g": ("#140000", 3, 1.0), "h": ("#FEFEFE", 2, 0.6667), None: ("#010203", 1, 1.0)}


def test_colour_clusters_equal_plain_lists(spark):
    rng = random.Random(3)
    rows = [(k % 5, "#%02X%02X%02X" % tuple(min(255, max(0, int(rng.gauss(m, 25)))) for m in rng.choice([(30, 30, 30), (90, 60, 30), (200, 200, 180)])), k) for k in range(400)]
    want = {}
    for g in range(5):
        clusters = []
        for _, c, _ in [r for r in rows if r[0] == g]:
            v = np.array([int(c[i : i + 2], 16) for i in (1, 3, 5)], float)
            for m in clusters:
                if np.linalg.norm(v - [round(x) for x in np.median(m, axis=0)]) <= 28:
                    m.append(v)
                    break
            else:
                clusters.append([v])
        best = max(clusters, key=len)
        want[g] = ("#%02X%02X%02X" % tuple(round(x) for x in np.median(best, axis=0)), len(best))
    got = {r["g"]: (r["color"], r["n"]) for r in colors.color_mode(table(spark, rows, "g int, c string, p int"), "g", "c", "p").collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5000])
@pytest.mark.parametrize("groups", [100, 0])
def test_percentiles(spark, n, groups, monkeypatch):
    """Overall and for groups, of which null is one, by brackets that are broadcast or joined, against numpy."""
    monkeypatch.setattr(stats, "ACCURACY", 200)
    monkeypatch.setattr(stats, "GROUPS", groups)
    rng = np.random.default_rng(n)
    values = {g: np.concatenate([rng.normal(size=n // 2) * 10, rng.integers(0, 3, n - n // 2)]) for g in ("a", None, "b")}
    df = table(spark, [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("c", float("nan"))], "g string, v double").repartition(5)
    r = stats.percentiles(df, "v").head()
    assert r["n"] == 3 * n and np.allclose(r["p"], np.percentile(np.concatenate(list(values.values())), [10, 50, 90]))
    got = {r["g"]: r for r in stats.percentiles(df, "v", "g").collect()}
    assert got.keys() == values.keys() and all(got[g]["n"] == n and np.allclose(got[g]["p"], np.percentile(v, [10, 50, 90])) for g, v in values.items())
    assert stats.percentiles(df.where("v > 1e9"), "v").collect() == [] == stats.percentiles(df.where("v > 1e9"), "v", "g").collect()


def test_percentiles_of_tied_and_large_groups(spark):
    """One value two million times, few values, and many: what is put in order is a small part of the values."""
    n = 1_500_000
    df = spark.range(3 * n).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, (F.col("id") % 1000).cast("double")).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double")).alias("v"))
    out = stats.percentiles(df, "v", "g")
    got = {r["g"]: r["p"] for r in out.collect()}
    for g in range(3):
        v = np.array([r["v"] for r in df.where(f"g = {g}").select("v").toArrow().to_pylist()])
        assert np.allclose(got[g], np.percentile(v, [10, 50, 90]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CollectList" not in plan and "Percentile(" not in plan


def test_value_rules_native_sizes_and_evidence(spark):
    rows = [("a", "F1", 2.0, 1), ("b", "F1", 3.0, 2), ("c", "F2", 3.0, 3), ("d", "F2", 2.0, 4), ("e", None, None, 5)]
    df = table(spark, rows, "e string, g string, v double, pos int")
    value = {rule: {r["grp"]: r["value"] for r in stats.numeric_item(df, "k", "v", "g", "e", "pos", rule).collect()} for rule in ("mode", "min", "max", "p50")}
    assert value == {"mode": {None: 2.0, "F1": 2.0, "F2": 3.0}, "min": {None: 2.0, "F1": 2.0, "F2": 2.0}, "max": {None: 3.0, "F1": 3.0, "F2": 3.0}, "p50": {None: 2.5, "F1": 2.5, "F2": 2.5}}
    sizes = table(spark, [("540x960", 34.0), ("540x960", 36.0), ("720x1280", 40.0), (None, 1.0), ("720x1280", None)], "res string, px double")
    assert {r["res"]: (r["n"], r["p50"]) for r in stats.native_stats(sizes, "px", "res").collect()} == {"540x960": (2, 35.0), "720x1280": (1, 40.0)}
    seen = table(spark, [("a", 1, "absent"), ("b", 2, "present"), ("c", 3, "unmeasured"), ("d", 4, "present")], "e string, pos int, s string")
    assert [tuple(r) for r in stats.presence_evidence(seen, "e", "pos", "s").collect()] == [("b", "present"), ("d", "present")]
    assert [tuple(r) for r in stats.presence_evidence(seen.where("s <> 'present'"), "e", "pos", "s").collect()] == [("a", "absent")]


def test_category_columns_and_examples(spark):
    rows = [("t1", "v2", 5.0, "zoom"), ("t1", "v1", 2.0, None), ("t1", "v1", 1.0, "zoom"), ("t1", "v3", 9.0, "cut"), ("t1", "v4", 9.0, "cut"), ("t2", "v1", 3.0, None)]
    df = table(spark, rows, "type string, video string, t double, role string")
    got = {r["type"]: (r["n"], r["mode"], r["n_events"], r["n_missing"], r["status"]) for r in stats.category_column(df, "type", "role", "t").collect()}
    assert got == {"t1": (4, "zoom", 5, 1, "partial"), "t2": (0, None, 1, 1, "unmeasured")}
    assert sorted(tuple(r) for r in stats.type_examples(df, "type", "video", "t").where("type = 't1'").collect()) == [("t1", "v1", 1.0, 1), ("t1", "v2", 5.0, 2), ("t1", "v3", 9.0, 3)]


# ---------------------------------------------------------------- endings, labels, features


@pytest.mark.parametrize(
    ("line", "register"),
    [
        ("이거 실화임", "음슴체"), ("역대급 레전드임", "음슴체"), ("뒤에서 보임", "음슴체"), ("너무 귀여움", "음슴체"), ("결국 들킴!!", "음슴체"),
        ("실험 영상 모음", "명사형/기타"), ("그 사람", "명사형/기타"), ("엄마의 웃음", "명사형/기타"), ("사장님", "명사형/기타"), ("고양이의 귀여움", "명사형/기타"),
        ("봄", "명사형/기타"), ("임", "명사형/기타"), ("먼저 옴", "명사형/기타"), ("싱싱한 얼음", "명사형/기타"),
        ("학생들이 모여 있다", "반말"), ("진짜 왔어요?", "해요체"), ("감사합니다", "합쇼체"), ("오늘의 사건", "명사형/기타"), ("plain words", "명사형/기타"), ("", None), ("...", None), (None, None),
    ],
)
def test_registers(spark, line, register):
    got = one(spark, endings.ending_class(F.lit(line)))
    assert (got and got["register"]) == register


def test_entity_registers_and_top_endings(spark):
    rows = [("a", 1, "학생들이 모여 있다"), ("a", 2, "그냥 지나간다"), ("a", 3, "실험 영상 모음"), ("b", 4, "진짜 왔어요?"), ("b", 5, "감사합니다"), ("c", 6, "그 사람")]
    df = table(spark, rows, "v string, pos int, t string")
    assert {r["v"]: r["register"] for r in endings.entity_register(df, "v", "t", "pos").collect()} == {"a": "반말", "b": "혼합"}
    assert [tuple(r) for r in endings.top_endings(df, "t", "pos", 2).orderBy("rank").collect()] == [("있다", 1, 1), ("간다", 1, 2)]


def test_sequence_and_reveal_labels(spark):
    s = lambda t: tuple(one(spark, labels.sequence(F.lit(t))))
    assert s("hook > build → 반전, reaction") == (["hook", "build", "reveal", "reaction"], None)
    assert s("훅/도입|전개") == (["hook", "build"], None) and s("") == (None, None) and s(None) == (None, None)
    assert s("hook>what") == (None, "unknown part: what")
    r = lambda t: tuple(one(spark, labels.reveal(F.lit(t))))
    assert r("17.5") == (17.5, False, None) and r("없음") == (None, True, None) and r("") == (None, None, None)
    assert r("-3")[2] and r("soon")[2] and r("nan")[2]
    d = lambda p, t, n: one(spark, labels.disclosure(F.lit(p), F.lit(t), F.lit(n).cast("double"))).asDict()
    assert d("hook>reveal", "5", 20.0) == {"parts": ["hook", "reveal"], "at": 5.0, "fraction": 0.25, "reason": None}
    assert d("hook>build", "none", None)["reason"] is None and d("", "", 1.0) == {"parts": None, "at": None, "fraction": None, "reason": None}
    for p, t, n in (("hook>reveal", "none", 9.0), ("hook", "5", 9.0), ("hook>reveal", "", 9.0), ("", "5", 9.0), ("hook>reveal", "5", None), ("hook>reveal", "50", 9.0)):
        assert d(p, t, n)["reason"] and d(p, t, n)["parts"] is None


def test_features_are_null_where_a_source_is_missing(spark):
    analysed = table(spark, [("a", 20.0, True, True, True, True), ("b", None, True, False, False, False), ("c", 9.0, False, False, False, True), ("d", 10.0, False, True, False, False)], "v string, duration double, has_shots boolean, has_captions boolean, has_motion boolean, has_sounds boolean")
    shots = table(spark, [("a", "cut"), ("a", "cut"), ("a", "flash"), ("b", "cut")], "v string, type string")
    captions = table(spark, [("a", "title", 0.0, 20.0), ("a", "situation", 1.0, 3.0), ("a", "reaction", 4.0, 5.0)], "v string, role string, start double, end double")
    motion = table(spark, [("a", "zoom_in"), ("a", "freeze"), ("a", "speed")], "v string, type string")
    sounds = table(spark, [("a",), ("a",), ("c",)], "v string")
    got = {r["v"]: r.asDict() for r in features.entity_features(analysed, shots, captions, motion, sounds, "v").collect()}
    assert set(got) == {"a", "b", "d"}
    a = got["a"]
    assert (a["cuts_per_10s"], a["flash_per_10s"], a["crossfade_per_10s"], a["captions_per_10s"], a["caption_mean_dur_s"]) == (1.0, 0.5, 0.0, 1.0, 1.5)
    assert (a["share_situation"], a["share_dialogue"], a["has_title"], a["has_description"]) == (0.5, 0.0, 1.0, 0.0)
    assert (a["zoom_per_10s"], a["freeze_per_10s"], a["speed_events"], a["sfx_per_10s"]) == (0.5, 0.5, 1.0, 1.0)
    assert got["b"]["cuts_per_10s"] is None and got["b"]["has_title"] is None and got["b"]["speed_events"] is None
    assert got["d"]["captions_per_10s"] == 0.0 and got["d"]["caption_mean_dur_s"] == 0.0 and got["d"]["cuts_per_10s"] is None


def test_authorship_by_hint_id_and_link(spark):
    items = table(spark, [(1, "Shop", "shop_1", "Maker", None, None), (2, "Shop", "shop_1", None, None, None), (3, "Shop", "shop_1", None, None, "https://ex.org/x"), (4, "Shop", "shop_1", None, None, None), (5, None, None, None, None, None)], "id int, up string, up_id string, hint string, basis string, link string")
    credits = table(spark, [(1, "mention", "@pal", False, 1), (2, "mention", "@shop_1", False, 1), (4, "credit", "@maker", False, 1)], "id int, kind string, value string, is_url boolean, pos int")
    got = {r["id"]: (r["author"], r["basis"], r["original_url"], r["reposter"]) for r in text.authorship(items, credits, "id", "up", "up_id", "hint", "basis", "link").collect()}
    assert got == {1: ("Maker", "metadata", None, "Shop"), 2: ("Shop", "uploader", None, None), 3: (None, "external_link", "https://ex.org/x", "Shop"), 4: ("@maker", "description_credit", None, "Shop"), 5: (None, "unknown", None, None)}


# ---------------------------------------------------------------- layers


def test_an_unmeasured_group_falls_to_base(spark):
    rows = [("k", "base", 0, "b", False), ("k", "measured", 1, "m", False), ("k", "format", 2, None, True), ("j", "measured", 1, "m", False), ("j", "format", 2, None, True), ("i", "base", 0, "b", False), ("i", "format", 2, None, True), ("i", "requested", 3, "r", False), ("h", "base", 0, "b", False), ("h", "measured", 1, "m", False)]
    got = layers.layered(table(spark, rows, "key string, layer string, p int, value string, gone boolean"), ["key"], F.col("p"), "value", "gone", base=F.col("p") == 0)
    assert {r["key"]: (r["value"], r["layer"]) for r in got.collect()} == {"k": ("b", "base"), "j": ("m", "measured"), "i": ("r", "requested"), "h": ("m", "measured")}


def test_items_of_another_snapshot_are_refused(spark):
    rows = [("a", "measured", 1.0, 1, "s1"), ("a", "measured", 2.0, 2, "s0"), ("b", "measured", 3.0, 1, None), ("c", "measured", 4.0, 1, "s1"), ("c", "unmeasured", None, 2, "s1")]
    df = table(spark, rows, "key string, status string, value double, p int, snap string")
    assert {r["key"]: (r["status"], r["value"]) for r in layers.resolve_items(df, "key", "status", "value", "p", "snap", "s1").collect()} == {"a": ("measured", 1.0), "b": ("unmeasured", None), "c": ("measured", 4.0)}
    assert {r["key"]: r["status"] for r in layers.resolve_items(df, "key", "status", "value", "p").collect()}["a"] == "conflict"


def test_measurements_are_applied_by_group(spark):
    items = table(spark, [("size", "measured", 30.0, "px", 540, 960), ("wide", "measured", 30.0, "px", 960, 540), ("share", "measured", 0.5, None, None, None), ("gone", "unmeasured", None, None, None, None)], "key string, status string, value double, unit string, width int, height int")
    groups = table(spark, [("size", "F1", 40.0), ("size", "F2", None), ("wide", "F1", 1.0), ("share", "F1", 0.25)], "key string, grp string, value double")
    got = {(r["layer"], r["key"], r["grp"]): (r["value"], r["gone"], r["reason"]) for r in layers.apply_measurements(items, groups, (1080.0, 1920.0)).collect()}
    assert got == {
        ("common", "size", None): (60.0, False, None), (None, "wide", None): (None, False, "other aspect"), ("common", "share", None): (0.5, False, None), (None, "gone", None): (None, False, "unmeasured"),
        ("group", "size", "F1"): (80.0, False, None), ("group", "size", "F2"): (None, True, None), ("group", "share", "F1"): (0.25, False, None),
    }


# ---------------------------------------------------------------- gate

ROW = "row_id string, check_id string, category string, kind string, status string, required boolean, intended_change boolean, covered_by string"


def gate(spark, rows, production=True, **more):
    return {r["rule"]: (r["severity"], r["n"], r["failing"]) for r in qa.quality_gate(table(spark, rows, ROW), production, **more).collect()}


def test_gate_rules(spark):
    good = [("r0", "audio.sfx.no_event", "sound", "self", "same", True, None, None), ("r1", "text.x", "text", "self", "same", True, None, None)]
    assert gate(spark, good) == {}
    rows = [
        ("r1", "text.a", "text", "self", "different", False, False, None), ("r2", "text.b", "text", "self", "different", False, True, None),
        ("r3", "text.c", "text", "self", "unmeasured", True, None, None), ("r4", "audio.sfx.no_event", "sound", "self", "unmeasured", False, None, "r1"),
        ("r5", "audio.sfx.offset", "sound", "self", "different", False, True, None), ("r6", "text.d", "text", "style_vs_reference", "unmeasured", False, None, None),
        ("r7", "text.e", "text", "self", "unmeasured", False, None, "r3"), ("r8", "text.f", "text", "self", "unmeasured", None, None, "r1"),
    ]
    got = gate(spark, rows, categories=("cut", "sound", "text"))
    assert got == {"G1": ("fail", 1, "r1"), "G2": ("fail", 1, "r3"), "G3": ("fail", 1, "r4"), "G4": ("fail", 1, "r5"), "P2": ("fail", 1, "r6"), "P4": ("fail", 1, "r7"), "W1": ("warn", 1, "cut")}
    assert {k: v[0] for k, v in gate(spark, rows, production=False).items()} == {"G1": "fail", "G2": "fail", "G3": "fail", "G4": "fail", "P2": "warn", "P3": "warn", "P4": "warn"}
    assert gate(spark, [("r", "audio.level", "sound", "self", "same", False, None, None)]) == {"G3": ("fail", 0, "")}
    keys = table(spark, [("a.b",), ("a.c",)], "key string")
    inputs = table(spark, [("x", "1", "1"), ("y", "1", "2"), ("z", None, "3")], "name string, measured string, now string")
    got = gate(spark, good, output=("h1", "h2"), inputs=inputs, reference_problems=["no video"], approval_problems=["not approved"], changed_since_approval=True, unmeasured_keys=keys)
    assert got == {"G5": ("fail", 0, ""), "G6": ("fail", 2, "y,z"), "R1": ("fail", 1, "no video"), "A1": ("fail", 1, "not approved"), "A2": ("warn", 0, ""), "P1": ("fail", 2, "a.b,a.c")}
    assert gate(spark, good, output=("h", None))["G5"] and gate(spark, good, files=("a", "b"))["G5"] and gate(spark, good, inputs_measured=False)["G6"]


def test_rows_that_name_no_row_meet_none(spark):
    """Null keys would meet in one task; a row is covered if any row of that id is measured."""
    rows = [(f"r{i:02}", "text.a", "text", "self", "unmeasured", False, None, None) for i in range(60)]
    rows += [("x", "text.b", "text", "self", "unmeasured", False, None, "y"), ("z", "text.b", "text", "self", "unmeasured", False, None, "none")]
    rows += [("y", "text.c", "text", "self", status, True, None, None) for status in ("unmeasured",) * 20 + ("same",)]
    got = gate(spark, rows)
    assert got["P4"] == ("fail", 61, ",".join(f"r{i:02}" for i in range(50))) and got["G2"][1] == 20
    plan = qa.quality_gate(table(spark, rows, ROW), True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan and "isnotnull(covered_by" in plan


def test_gate_verdicts(spark):
    verdict = lambda rows: tuple(qa.gate_verdict(table(spark, rows, "rule string, severity string, n long, failing string")).head())
    assert verdict([]) == (True, True, "", "")
    assert verdict([("P1", "warn", 1, "k"), ("W1", "warn", 1, "c")]) == (True, False, "", "P1,W1")
    assert verdict([("G2", "fail", 1, "r"), ("G1", "fail", 1, "r")]) == (False, False, "G1,G2", "")


def test_a_count_seen_as_a_lower_bound_only_is_a_warning(spark):
    seen = table(spark, [("k", n, low) for n, low in [(1, False)] * 18 + [(7, True), (9, False)]], "t string, n int, low boolean")
    counts = table(spark, [("k", 1), ("k", 7), ("k", 9), ("k", 5), ("z", 1)], "t string, n int")
    got = {(r["t"], r["n"]): r["verdict"] for r in qa.count_range_verdict(counts, seen, "t", "n", "low").collect()}
    assert got == {("k", 1): "in_range", ("k", 7): "lower_bound", ("k", 9): "observed", ("k", 5): "outside", ("z", 1): "unmeasured"}


# ---------------------------------------------------------------- similarity


def test_similarity_medoid_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 4), [float(v) for v in rng.normal(size=6)]) for i in range(60)] + [(100, 9, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (101, 9, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (102, None, [1.0] * 6)]
    got = {r["g"]: r["medoid"] for r in similarity.similarity_medoid(table(spark, rows, "id int, g int, x array<double>"), "id", "g", "x").collect()}
    want = {9: 100}
    for g in range(4):
        ids = [r[0] for r in rows if r[1] == g]
        u = np.array([r[2] for r in rows if r[1] == g])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want[g] = ids[int(np.round((u @ u.T).sum(1), 9).argmax())]
    assert got == want


def test_listed_terms_in_windows(spark):
    terms = ["Fake Channel", "abc", "명작극장"]
    cases = {"by FAKE-channel!": "Fake Channel", "the fakechanel logo": "Fake Channel", "xx abc yy": "abc", "ab": None, "명작 극장 로고": "명작극장", "nothing here": None, "": None, None: None}
    df = table(spark, [(i, t) for i, t in enumerate(cases)], "id int, t string")
    assert [r["term"] for r in similarity.listed_term(df, "id", "t", terms).orderBy("id").collect()] == list(cases.values())
    assert max(difflib.SequenceMatcher(None, "fakechannel", "thefakechanellogo"[i : i + n]).ratio() for n in (10, 11, 12) for i in range(10)) >= 0.8


def test_shifted_and_threshold_pairs_of_many_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(70, 8))
    df = table(spark, [(i, i % 2, [float(v) for v in x[i]]) for i in range(70)] + [(99, None, [1.0] * 8)], "id long, g int, x array<double>")
    got = {(r["a"], r["b"]) for r in similarity.threshold_graph(df, "id", "g", "x", 0.3, block=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(70) for j in range(i + 1, 70) if i % 2 == j % 2 and u[i] @ u[j] >= 0.3}
    both = matching.shifted_similarity(df.where("g IS NOT NULL"), df.where("g IS NOT NULL"), "id", "g", "x", 2, 0, 0.3)
    c = x.reshape(70, 2, 4)
    c = c / np.linalg.norm(c, axis=2, keepdims=True)
    assert {(r["a"], r["b"]) for r in both.collect()} == {(i, j) for i in range(70) for j in range(70) if i != j and i % 2 == j % 2 and (c[i] * c[j]).sum() / 2 >= 0.3}


def shifted_links_by_hand(x, by, ids):
    c = x.reshape(len(x), 2, 4)
    best = np.full((len(x), len(x)), -1.0)
    for s in (-1, 0, 1):
        u, v = c[:, :, max(0, s) : 4 + min(0, s)], c[:, :, max(0, -s) : 4 + min(0, -s)]
        u, v = (m / np.linalg.norm(m, axis=2, keepdims=True) for m in (u, v))
        best = np.maximum(best, np.einsum("ibk,jbk->ij", u, v) / 2)
    best = np.round(np.where((by[:, None] == by) & (best >= 0.3) & ~np.eye(len(x), dtype=bool), best, -np.inf), 12)
    out = {}
    for i, row in enumerate(best):
        j = min(range(len(x)), key=lambda k: (-row[k], ids[k]))
        copies = [k for k in range(len(x)) if by[k] == by[i] and (x[k] == x[i]).all()]
        n = int((row > -np.inf).sum())
        out[ids[i]] = (min(ids[k] for k in copies), n, ids[j] if n else None)
    return out


def test_shifted_links_are_a_row_for_each_vector_however_many_pairs_link(spark, monkeypatch):
    """Copies, strips and blocks of several sizes, null vectors and groups; the rows that leave tasks are vectors, not pairs."""
    monkeypatch.setattr(matching, "STRIP", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 8))
    x[40], x[41], x[77] = x[2], x[2], x[3]
    ids, by = [i * 7 % 90 for i in range(90)], np.arange(90) % 2
    df = table(spark, [(ids[i], int(by[i]), x[i].tolist()) for i in range(90)] + [(200, None, [1.0] * 8), (201, 1, None)], "id long, g int, x array<double>")
    got = {r["id"]: (r["class_id"], r["n_links"], r["best"]) for r in matching.shifted_links(df, "id", "g", "x", 2, 1, 0.3, block=8).collect()}
    assert got == shifted_links_by_hand(x, by, ids) | {200: (200, 0, None), 201: (201, 0, None)}


@pytest.mark.parametrize("apart", [None, 7])
def test_nearest_links_equal_all_pairs(spark, monkeypatch, apart):
    monkeypatch.setattr(similarity, "STRIP", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    x[50], x[51], x[52], x[90] = x[4], x[4], x[4], x[5]  # ties go to smaller ids
    df = table(spark, [(i, i % 2, x[i].tolist()) for i in range(120)] + [(200, None, [1.0] * 4), (201, 1, None), (202, 1, [0.0] * 4)], "id long, g int, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    links = lambda i: [j for j in range(120) if j % 2 == i % 2 and sim[i, j] >= 0.3 and (i % apart != j % apart if apart else i != j)]
    want = {(i, j) for i in range(120) for j in sorted(links(i), key=lambda j: (-sim[i, j], j))[:3]}
    assert {(r["a"], r["b"]) for r in similarity.nearest_links(df, "id", "g", "x", 0.3, 3, apart, block=8).collect()} == want


def test_what_blocks_send_grows_as_the_vectors_do(spark):
    """Of a group there are eight blocks until these are large, so a vector is sent as often in a large group as in a small one."""
    def sent(n):
        df = spark.range(n).select("id", F.lit(1).alias("g"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
        return similarity.meetings(df, None, "id", "g", "x", 16).select(F.sum(F.size("i") + F.size("j"))).head()[0]

    assert sent(1600) <= 1.3 * 4 * sent(400)


# ---------------------------------------------------------------- stream


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def put(name, rows):
        (source / name).write_text("\n".join(map(json.dumps, rows)))

    run = lambda: {r["k"]: (r["at"], r["v"], r["w"]) for r in stream_upserts(spark, str(source), "k long, at long, v string, w string", "k", "at", state=state).collect()}
    assert run() == {}
    put("1.json", [{"k": 1, "at": 1, "v": "a", "w": "x"}])
    assert run() == {1: (1, "a", "x")}
    put("2.json", [{"k": 2, "at": 1, "v": "b"}, {"k": 1, "at": 2, "w": "y"}])
    assert run() == {1: (2, "a", "y"), 2: (1, "b", None)}
    assert run() == {1: (2, "a", "y"), 2: (1, "b", None)}
    put("3.json", [{"k": 1, "at": 0, "v": "late"}])
    assert run() == {1: (2, "a", "y"), 2: (1, "b", None)}


def plain_linkage(x, groups, least):
    """One best pair at a time, over a list of clusters."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    clusters = [[i] for i in range(len(x))]
    while True:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                if groups[clusters[a][0]] == groups[clusters[b][0]]:
                    s = np.mean([u[i] @ u[j] for i in clusters[a] for j in clusters[b]])
                    if s >= least and (best is None or s > best[0]):
                        best = (s, a, b)
        if best is None:
            return {i: min(c) for c in clusters for i in c}
        clusters[best[1]] += clusters.pop(best[2])


@pytest.mark.parametrize("few", [10, 2000])
def test_average_linkage_equals_merging_one_pair_at_a_time(spark, monkeypatch, few):
    """By rounds until a group is small, and in one task."""
    monkeypatch.setattr(similarity, "FEW_CLUSTERS", few)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 5))
    x = np.array([centers[i % 6] + rng.normal(size=5) * 0.8 for i in range(48)])
    rows = [(i, i % 2, [float(v) for v in x[i]]) for i in range(48)]
    df = table(spark, [*rows, (90, None, [1.0] * 5), (91, 1, [0.0] * 5), (92, 1, None)], "id long, g int, x array<double>")
    got = {r["id"]: r["cluster"] for r in similarity.average_linkage(df, "id", "g", "x", 0.3, block=8).collect()}
    assert got == plain_linkage(x, [i % 2 for i in range(48)], 0.3) | {90: 90, 91: 91, 92: 92}
    assert 2 < len(set(got.values())) < 40


def test_average_linkage_of_a_hub_with_a_thousand_satellites(spark):
    """Most satellites join the hub one by one."""
    rng = np.random.default_rng(9)
    side = rng.normal(size=(1000, 63))
    cos = np.linspace(0.95, 0.85, 1000)
    x = np.vstack([np.eye(1, 64), np.hstack([cos[:, None], side / np.linalg.norm(side, axis=1, keepdims=True) * np.sqrt(1 - cos**2)[:, None]])])
    mean, n, name = x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(1001), np.arange(1001)
    sim = mean @ mean.T - 10 * np.eye(1001)
    while sim.max() >= 0.6:
        a, b = sorted(np.unravel_index(sim.argmax(), sim.shape))
        mean[a], n[a] = (mean[a] * n[a] + mean[b] * n[b]) / (n[a] + n[b]), n[a] + n[b]
        name[name == b] = a
        sim[a] = sim[:, a] = mean @ mean[a] - 10 * (n == 0)
        n[b], sim[b], sim[:, b], sim[a, a] = 0, -10, -10, -10
    df = table(spark, [(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, g int, x array<double>")
    assert {r["id"]: r["cluster"] for r in similarity.average_linkage(df, "id", "g", "x", 0.6).collect()} == dict(enumerate(name.tolist()))


def test_medoid_of_many_blocks(spark):
    """Two blocks meet once, and both get the sums of their pairs; values that are missing on either side count nowhere."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, *[None if rng.random() < 0.3 else float(rng.normal()) for _ in range(3)], float(i % 5)) for i in range(120)]
    df = table(spark, rows, "id long, g int, a double, b double, c double, views double")
    each = [{tuple(r) for r in similarity.medoid(df, "id", "g", ["a", "b", "c"], "views", block=n).collect()} for n in (7, 2048)]
    z = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    z = (z - np.nanmean(z, 0)) / np.nanstd(z, 0)
    want = set()
    for g in (0, 1):
        at, mean = np.flatnonzero(np.arange(120) % 2 == g), {}
        for i in at:
            d = [np.sqrt(np.nanmean((z[i] - z[j]) ** 2)) for j in at if j != i and (~np.isnan(z[i] - z[j])).any()]
            if d:
                mean[i] = round(float(np.mean(d)), 6)
        best = min(mean, key=lambda i: (mean[i], -(i % 5), i))
        want.add((g, int(best), mean[best]))
    assert each[0] == each[1] == want


def test_medoid_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, float(rng.normal()), float(rng.normal()) if i % 4 else None, 5.0, float(i % 7)) for i in range(50)]
    got = {r["g"]: (r["medoid"], r["mean_distance"]) for r in similarity.medoid(table(spark, rows, "id long, g int, a double, b double, c double, views double"), "id", "g", ["a", "b", "c"], "views", block=8).collect()}
    z = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    z = (z - np.nanmean(z, 0)) / np.where(np.nanstd(z, 0) > 1e-9, np.nanstd(z, 0), np.nan)
    for g in range(3):
        ids = [i for i in range(50) if i % 3 == g]
        means = [(round(np.mean([np.sqrt(np.nanmean((z[i] - z[j]) ** 2)) for j in ids if j != i]), 6), -rows[i][5], i) for i in ids]
        assert got[g][0] == min(means)[2] and abs(got[g][1] - min(means)[0]) < 2e-6


def test_large_sides_are_not_broadcast(spark):
    df = spark.range(100)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(stats.small(df, 100)) and not hinted(stats.small(df, 99))


# ---------------------------------------------------------------- documents, sources, catalogs


def test_section_diff_of_nested_documents(spark):
    schema = "k int, d struct<title: string, clips: array<struct<id: string, t: double>>, tags: array<string>, more: map<string,int>>"
    old = table(spark, [(1, ("a", [("x", 1.0), ("y", 2.0)], ["p", "q"], {"m": 1})), (2, ("same", None, None, None)), (3, None)], schema)
    new = table(spark, [(1, ("b", [("y", 2.0), ("z", 3.0), ("x", 1.5)], ["p"], {"m": 1, "n": 2})), (2, ("same", [], None, None)), (3, ("new", None, None, None))], schema)
    got = {(r["k"], r["section"]): (r["n_added"], r["n_removed"], r["n_changed"]) for r in state.section_diff(old, new, "k", "d").collect()}
    assert got == {(1, "title"): (0, 0, 1), (1, "clips"): (2, 0, 1), (1, "tags"): (0, 1, 0), (1, "more"): (1, 0, 0), (3, "title"): (1, 0, 0)}


def test_repeats_of_a_source(spark):
    rows = [(1, "s", 0.0, 5.0, 0.1, 5.1, None, None), (2, "s", 4.0, 8.0, 4.1, 8.0, None, None), (3, "s", 0.0, 2.0, 0.2, 2.0, 1, "joke"), (4, "s", 8.2, 9.0, None, None, None, None), (5, "t", 0.0, 9.0, 0.0, 9.0, None, None), (6, "s", 30.0, 31.0, None, None, None, None), (7, "s", 0.0, 1.0, 2.0, 2.02, 1, " ")]
    df = table(spark, rows, "id int, source string, planned_start double, planned_end double, start double, end double, repeat_of int, reason string")
    got = {(r["first"], r["again"]): (r["verdict"], r["overlap"] and round(r["overlap"], 3)) for r in intervals.repeats_of_source(df).collect()}
    assert got == {(1, 2): ("unmarked", 1.0), (1, 3): ("marked", 1.8), (2, 4): ("unmeasured", None)}


def test_labels_that_count_and_ids_that_stay(spark):
    rows = [("a", "x", "", "yes", "me"), ("b", "x", "i", "YES", "me"), ("c", "y", "", "no", "me"), ("d", "y", "", "yes", " "), ("z", "x", "", "yes", "me"), ("e", "", "", "yes", "me"), ("f", "", "i", "yes", "me"), (None, "x", "", "yes", "me")]
    labels_ = table(spark, rows, "v string, structure string, intro string, watched string, labeled_by string")
    got = {r["v"]: r["reason"] for r in catalog.checked_labels(labels_, table(spark, [("a",), ("b",), ("c",), ("d",), ("f",)], "v string"), "v").collect()}
    assert got == {"a": None, "b": None, "c": "not signed", "d": "not signed", "z": "outside", "f": "not signed"}
    groups = table(spark, [("p", 5), ("q", 9), ("r", 9), ("s", 1)], "structure string, n int")
    old = table(spark, [("p", "F2"), ("gone", "F1")], "structure string, format_id string")
    assert {r["structure"]: r["format_id"] for r in catalog.kept_ids(groups, old, "structure", "n").collect()} == {"p": "F2", "q": "F3", "r": "F4", "s": "F5"}
    assert {r["structure"]: r["format_id"] for r in catalog.kept_ids(groups, old.limit(0), "structure", "n").collect()} == {"q": "F1", "r": "F2", "p": "F3", "s": "F4"}


def test_registry_audit(spark):
    schema = "key string, category string, status string, apply_pending boolean, n_readers int, n_checks int"
    audit = lambda rows, **k: tuple(catalog.registry_audit(table(spark, rows, schema), **k).head())
    good = [("a", "style", "measured", None, 1, 1), ("b", "rule", "measured", False, 2, 0), ("m", "meta", "unmeasured", None, 0, 0), ("n", "style", "not_applicable_given", None, 1, 1)]
    assert audit(good) == (True, 0, 0, 0, 1)
    assert audit([*good, ("u", "style", "unmeasured", None, 1, 1)]) == (False, 1, 0, 0, 1) and audit([*good, ("u", "style", "unmeasured", None, 1, 1)], production=False)[0]
    assert audit([*good, ("p", "style", "measured", True, 0, None)], production=False) == (False, 1, 1, 1, 1)
    assert audit([]) == (True, 0, 0, 0, 0)


def test_items_of_declared_types(spark):
    rows = [("size", "px", "F1", "10", "a", 1), ("size", "px", "F1", "30", "a", 2), ("size", "px", "F2", "40", "b", 3), ("size", "px", "F2", "bad", "b", 4), ("tone", "category", "F1", "warm", "a", 1), ("tone", "category", "F2", "cold", "b", 2), ("tone", "category", "F2", "cold", "c", 3), ("ink", "color", "F1", "#FFFFFF", "a", 1), ("ink", "color", None, "#FEFEFE", "b", 2), ("ink", "color", "F1", "#000000", "c", 3), ("on", "bool", "F1", None, "a", 1)]
    got = {(r["key"], r["grp"]): (r["n"], r["value"]) for r in catalog.typed_items(table(spark, rows, "key string, type string, grp string, value string, v string, pos int"), "v", "pos").collect()}
    assert got == {("size", None): (2, "30.0"), ("size", "F1"): (1, "20.0"), ("size", "F2"): (1, "40.0"), ("tone", None): (3, "cold"), ("tone", "F1"): (1, "warm"), ("tone", "F2"): (2, "cold"), ("ink", None): (2, "#FEFEFE"), ("ink", "F1"): (1, "#FFFFFF")}
