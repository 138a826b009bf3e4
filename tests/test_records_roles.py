"""Noted values, source records, descriptions, seen provenance and role styles, with the values that they must give."""

import statistics

import pytest
from pyspark.sql import functions as F

from tallyline.operators import descriptions, observations, records, roles

SPEC = "key string, type string, allowed array<string>"
KEYS = [("shade", "color", None), ("size", "px", None), ("part", "ratio", None), ("emoji", "bool", None), ("cover", "enum", ["first", "chosen"]), ("odd", "length", None)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


VALUES = [
    ("shade", "##ff00aA", "#FF00AA", None), ("shade", "#fff", None, "not a color"), ("shade", None, None, "empty"), ("size", " 3,5 ", 3.5, None), ("size", "1e2", 100.0, None), ("size", "1d", None, "not a number"),
    ("size", "-1", None, "not a finite number of at least 0"), ("size", "NaN", None, "not a finite number of at least 0"), ("size", "1e999", None, "not a finite number of at least 0"), ("size", "0", 0.0, None), ("part", "0", None, "ratio outside 0 to 2"),
    ("part", "2", 2.0, None), ("part", "2.1", None, "ratio outside 0 to 2"), ("emoji", "예", True, None), ("emoji", "X", False, None), ("emoji", "maybe", None, "not yes or no"), ("cover", "chosen", "chosen", None), ("cover", "Chosen", None, "not an allowed value"),
    ("odd", "1", None, "unknown type"), ("none", "1", None, "unknown key"), (None, "1", None, "unknown key"), ("shade", " \t ", None, "empty"),
]


def test_typed_values(spark):
    rows = table(spark, [(i, k, v, "kept", "clash") for i, (k, v, _, _) in enumerate(VALUES)], "i int, key string, value string, type string, error string")
    got = {r["i"]: r for r in observations.typed_values(rows, table(spark, [*KEYS, KEYS[0]], SPEC)).collect()}
    for i, (_, _, want, error) in enumerate(VALUES):
        r = got[i]
        assert [v for v in (r["number"], r["flag"], r["text"]) if v is not None] == ([] if want is None else [want]), VALUES[i]
        assert (r["error"], r["type"]) == (error, "kept")
    assert len(got) == len(VALUES)
    assert observations.typed_values(rows.limit(0), table(spark, [], SPEC)).count() == 0


ADMITTED = [
    ("a", "1.5", "size", "3", "me", "Yes", None), ("a", "1.5", "size", "3", "me", "no", "not watched"), ("a", "1.5", "size", "3", "me", None, "not watched"), ("a", "1.5", "size", "3", "  ", "y", "no observer"), ("a", "1", "none", "3", "me", "1", "unknown key"),
    ("old", "1", "size", "3", "me", "1", "for reference only"), ("new", "1", "size", "3", "me", "1", "not in the basis"), (None, "1", "size", "3", "me", "1", "not in the basis"), ("long", "1", "size", "3", "me", "1", "long form"),
    ("both", "0", "size", "3", "me", "1", None), ("a", "-1", "size", "3", "me", "1", "no time"), ("a", None, "size", "3", "me", "1", "no time"), ("a", "inf", "size", "3", "me", "1", "no time"), ("a", "2", "size", "x", "me", "1", "not a number"), ("a", "2", "size", "", "me", "1", "empty"),
]


def test_admit(spark):
    rows = table(spark, [(i, *r[:6]) for i, r in enumerate(ADMITTED)], "i int, id string, t string, key string, value string, observed_by string, watched string")
    basis = table(spark, [("a", "short"), ("a", "short"), ("long", "video"), ("both", "video"), ("both", "short"), (None, "short")], "id string, kind string")
    got = {r["i"]: r for r in observations.admit(rows, table(spark, KEYS, SPEC), basis, table(spark, [("old",), ("a",), ("old",)], "id string"), "id").collect()}
    assert [got[i]["reason"] for i in range(len(ADMITTED))] == [r[-1] for r in ADMITTED]
    assert all((r["t"] is None) == (r["number"] is None) == (r["reason"] is not None) for r in got.values())
    wide = observations.admit(rows, table(spark, KEYS, SPEC), basis, table(spark, [], "id string"), "id", ()).where("id = 'long'")
    assert wide.first()["reason"] is None


def test_common_record(spark):
    schema = "id string, url string, original_url string, title string, view_count double, play_count string, like_count long, timestamp double, upload_date string, width int, height int, formats array<struct<width:int,height:int>>, tags array<string>"
    rows = [
        ("a", "u", "", "", 12.0, "x", 5, 1.9, "20240101", 0, 10, [(3, 4), None, (9, 4), (1, None)], [str(i) for i in range(40)]),
        ("b", None, None, "t", None, " 7 ", None, 0.0, "2024-01-01", 2, 3, [(8, 9)], None),
        (None, None, None, None, None, None, 9, None, "20240230", None, None, [], []),
    ]
    a, b, c = (r.asDict() for r in records.common_record(table(spark, rows, schema), "p", ("play_count", "view_count")).collect())
    assert (a["url"], a["title"], a["likes"], a["published_at"], a["published_at_source"]) == ("u", None, 5, "1970-01-01T00:00:01+00:00", "timestamp")
    assert (a["width"], a["height"], len(a["tags"])) == (3, 4, 30)
    assert (b["views"], b["views_field"], b["views_source"], b["published_at"], b["width"], b["height"], b["tags"]) == (7, "play_count", "platform_metadata", None, 2, 3, [])
    assert (c["platform_id"], c["views"], c["views_source"], c["likes"], c["published_at"], c["width"]) == ("", None, "unavailable", 9, "2024-02-30", None)
    assert records.common_record(table(spark, [(1,)], "other int"), "p", ("view_count",)).first()["views_source"] == "unavailable"


def test_threshold_sets(spark):
    items = [("a", 100, "video_metadata"), ("b", 99, "video_metadata"), ("c", 100, "latest100_snapshot"), ("d", 50, "latest100_snapshot"), ("e", None, None), ("f", None, "listing"), ("g", 500, "listing"), ("h", None, "video_metadata"), ("i", 1, "x")]
    listing = table(spark, [("d", 89.0), ("f", 90.0), ("f", 10.0), ("g", None), ("i", 95.0)], "id string, approx double")
    failures = table(spark, [("e", 1, "first"), ("e", 2, "x" * 300), ("i", 1, None)], "id string, pos int, error string")
    out = records.threshold_sets(table(spark, items, "id string, count long, source string"), listing, failures, table(spark, [("e",), ("g",), ("g",)], "id string"), "id", 100)
    got = {r["id"]: (r["state"], r["reason"]) for r in out.collect()}
    assert got == {
        "a": ("above", None), "b": ("below", None), "c": ("above", None), "d": ("below", None), "e": ("unverified", "failed: " + "x" * 200), "f": ("unverified", "only a rounded count"),
        "g": ("unverified", "not asked"), "h": ("below", None), "i": ("unverified", "failed: "),
    }


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("원본: https://www.instagram.com/stories/some.one/3, @Other_1.", {("url", "instagram", "@some.one"), ("account_url", "instagram", "@some.one"), ("account_credit", "instagram", "@Other_1"), ("credit_line", None, "원본: https://www.instagram.com/stories/some.one/3, @Other_1.")}),
        ("mail me@host.org x@y", set()),
        ("틱톡 @ab #영상 #모음집 u/name_1 /r/no", {("account_handle", "tiktok", "@ab"), ("hashtag", None, "모음집"), ("account_reddit", "reddit", "u/name_1")}),
        ("https://old.reddit.com/user/me/ https://x.com/i/1 https://facebook.com/watch/?v=1", {("url", "reddit", "u/me"), ("account_url", "reddit", "u/me"), ("url", "x", None), ("url", "facebook", None)}),
        ("HTTPS://YOUTU.BE/x#@no #mychannel @MyChannel2", {("url", "youtube", None)}),
        ("", set()),
        (None, set()),
    ],
)
def test_descriptions(spark, line, want):
    out = descriptions.read_descriptions(table(spark, [(1, line, "x")], "id int, text string, line string").select("id", "text"), "id", "text", ["mychannel"])
    assert {(r["kind"], r["platform"], r["value"]) for r in out.collect()} == want


def test_lines_and_profiles(spark):
    text = "one\r\n\n  https://www.tiktok.com/@a/video/1!! https://instagram.com/p/x" + "\n@b" * 20000
    out = descriptions.read_descriptions(table(spark, [(1, text)], "id int, text string"), "id", "text", [])
    assert out.where("kind = 'account_url'").select("line", "value", "url").first() == (2, "@a", "https://www.tiktok.com/@a")
    assert out.where("kind = 'url'").count() == 2
    assert out.where("kind = 'account_handle'").count() == 20000


SEEN = "id string, pos int, by string, uploader string, published_at string, original_url string, original_published_at string, original_author string, views long, views_checked_at string"
RECORDS = "id string, uploader string, uploader_source string, published_at string, published_at_source string, original_url string, original_published_at string, views long"


def fold(record: dict, seen: list[dict]) -> dict:
    """One record, one observation at a time."""
    r = dict(record, original_author=None, original_author_url=None, views_manual=None, n_seen=0)
    plain = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    for s in sorted(seen, key=lambda s: s["pos"]):
        src = f"manual_observation:{s['by']}"
        if s["uploader"] and not (r["uploader"] and plain(r["uploader"]) != plain(s["uploader"]) and r["uploader_source"] != "url_path"):
            r["uploader"], r["uploader_source"] = s["uploader"], src
        if s["published_at"] and not (r["published_at"] and r["published_at_source"] and not r["published_at_source"].startswith("manual")):
            r["published_at"], r["published_at_source"] = s["published_at"], src
        for c in ("original_url", "original_published_at"):
            r[c] = s[c] or r[c]
        if s["original_author"]:
            r["original_author"], r["original_author_url"] = s["original_author"], r["original_url"]
        r["views_manual"] = s["views"] if s["views"] is not None else r["views_manual"]
        r["n_seen"] += 1
    return r


def test_apply_observations_equals_one_at_a_time(spark):
    names, days = [None, "Maker One", "maker-one", "Other", "MAKER ONE"], [None, "2024-01-02", "2023-05-06T01:02:03Z"]
    recs = [(f"r{i}", [None, "Maker One", "", "/maker"][i % 4], [None, "url_path", "platform"][i % 3], [None, "2020-01-01"][i % 2], [None, "timestamp"][i // 2 % 2], [None, "https://r"][i % 2], None, i) for i in range(24)]
    seen = []
    for i in range(24):
        for p in range(i % 6):
            k = i * 7 + p * 5
            seen.append((f"r{i}", p, "me" + str(p), names[k % 5], days[k % 3], [None, f"https://o{k}"][k % 2], [None, "2020-02-02"][k // 3 % 2], [None, None, f"author {k}"][k % 3], *([k, "2024-01-01"] if k % 4 else [None, None])))
    as_dict = lambda row, schema: dict(zip([c.split()[0] for c in schema.split(", ")], row, strict=True))
    out = records.apply_observations(table(spark, recs, RECORDS), table(spark, seen, SEEN), "id")
    got = {r["id"]: r.asDict() for r in out.collect()}
    for rec in recs:
        mine = [as_dict(s, SEEN) for s in seen if s[0] == rec[0]]
        mine = [s for s in mine if any(s[c] is not None for c in records.SEEN)]
        want = fold(as_dict(rec, RECORDS), mine)
        assert {c: got[rec[0]][c] for c in want} == want
        assert got[rec[0]]["views"] == rec[-1]


def test_refused_observations(spark):
    base = dict(id="a", pos=1, by="me", uploader=None, published_at=None, original_url=None, original_published_at=None, original_author=None, views=None, views_checked_at=None)
    cases = [({}, "nothing seen"), ({"uploader": " "}, "nothing seen"), ({"uploader": "x", "by": ""}, "no observer"), ({"published_at": "2024-13-01"}, "not a time"), ({"published_at": "2024"}, "not a time"), ({"views": 3}, "views and their date belong together"), ({"views_checked_at": "2024-01-01"}, "views and their date belong together"), ({"views": -1, "views_checked_at": "2024-01-01"}, "views below 0"), ({"views": 0, "views_checked_at": "2024-01-01T00:00:00+09:00"}, None)]
    rows = table(spark, [tuple((base | c).values()) for c, _ in cases], SEEN)
    got = records.checked_observations(rows).coalesce(1).collect()
    assert [r["refused"] for r in got] == [w for _, w in cases]


ITEM = "v string, id int, role string, start double, end double, x double, y double, w double, h double, n_lines int, size double, align string, outline double, outline_visibility string, box string, box_alpha double, highlight string, motion_in string, in_dur double, in_scale double, in_offset double, color string, box_color string"


def items(spark, rows):
    df = table(spark, rows, ITEM).withColumns({"left": F.col("x"), "right": F.col("x") + F.col("w"), "anchor_x": F.col("x") + F.col("w") / 2, "ink_h": F.col("size") / 2, "motion_out": F.lit("unmeasured"), "valign": F.lit("clash")})
    return df.withColumns({c: F.lit(None).cast("double") for c in ("shadow", "pad_x", "pad_y", "line_spacing", "lead", "chars", "in_direction", "out_dur", "out_direction")})


def test_role_styles(spark):
    usual = dict(v="a", id=0, role="title", start=0.0, end=0.0, x=0.0, y=0.0, w=0.0, h=0.0, n_lines=0, size=0.0, align=None, outline=0.0, outline_visibility="visible", box="absent", box_alpha=0.5, highlight=None, motion_in="fade", in_dur=0.0, in_scale=2.0, in_offset=7.0, color="#101010", box_color="#FFFFFF")

    def one(i, x, y, w, h, n, **more):
        return tuple((usual | dict(id=i, start=float(i), end=i + 2.0, x=x, y=y, w=w, h=h, n_lines=n, size=10.0 + i, outline=float(i), in_dur=0.1 * i) | more).values())

    rows = [
        one(1, 100.0, 50.0, 200.0, 40.0, 1), one(2, 100.0, 50.0, 300.0, 80.0, 2, motion_in="pop", outline_visibility="faint"), one(3, 101.0, 51.0, 250.0, 40.0, 1, motion_in="pop", box="present", box_alpha=0.25, color="#E01010"),
        one(4, 5.0, 400.0, 90.0, 30.0, 0, role="speaker", align="right", motion_in="unmeasured", end=14.0), one(5, 5.0, 500.0, 90.0, 30.0, 1, role="speaker", align="unmeasured", motion_in=None, outline_visibility=None), one(6, 0.0, 0.0, 1.0, 1.0, 1, role=None),
    ]
    df = items(spark, rows)
    got = {r["role"]: r.asDict() for r in roles.role_styles(df, table(spark, [("a", 11.0)], "v string, duration double"), "v").collect()}
    t, s = got["title"], got["speaker"]
    assert set(got) == {"title", "speaker"}
    assert (t["n_items"], t["size"], t["align"], t["valign"], t["anchor_x"], t["anchor_y"]) == (3, 12.0, "left", "top", 100.0, 50.0)
    assert (t["outline"], t["outline_visibility"], t["box"], t["box_share"], t["box_alpha"], t["highlight_presence"]) == (2.0, "visible", "present", 0.333, 0.25, "absent")
    assert (t["motion_in"], t["n_motion_in"], t["in_dur"], t["in_scale"], t["in_offset"]) == ("pop", 3, 0.25, 2.0, None)
    assert (t["min_dur"], t["persist"], t["evidence"], t["max_lines"], t["motion_out"], t["n_motion_out"]) == (2.0, "timed", "1,2,3", 2, None, 0)
    assert (s["align"], s["valign"], s["anchor_x"], s["anchor_y"], s["motion_in"], s["n_motion_in"], s["persist"]) == ("right", "unmeasured", 95.0, statistics.median([415.0, 515.0]), None, 0, "whole_video")
    colors = {(r["role"], r["what"]): (r["color"], r["n"]) for r in roles.role_colors(df, "v").collect()}
    assert colors == {("title", "color"): ("#101010", 2), ("speaker", "color"): ("#101010", 2), ("title", "box_color"): ("#FFFFFF", 1)}
    empty = df.limit(0)
    assert roles.role_styles(empty, table(spark, [], "v string, duration double"), "v").count() == 0
    assert roles.role_colors(empty, "v").count() == 0
