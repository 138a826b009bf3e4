"""Listed accounts by all three keys, and the registry of settings, with the values that they must give."""

import fnmatch
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyline.operators import catalog, exclusions


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


LISTED = [
    (1, "youtube", "@Joshua Magazine", "https://www.youtube.com/@JoshuaMagazine/", ["UCabc123"]),
    (2, "youtube", "other.maker", None, ["UCzz", "", None]),
    (3, None, "", "", None),
    (4, "tiktok", "Örtlich", "http://mobile.example.com/P", []),
]


@pytest.mark.parametrize(
    ("platform", "fields", "want"),
    [
        ("youtube", ["channel/UCabc123?x", None], (1, "id", False)),
        ("youtube", ["http://m.youtube.com/@joshuamagazine?si=1#top"], (1, "page", False)),
        ("tiktok", ["joshua_magazine"], (1, "handle", True)),
        (None, ["JOSHUA-MAGAZINE"], (1, "handle", False)),
        ("youtube", ["joshuamagazine", "x UCabc123"], (1, "id", False)),  # an id before a handle of one account
        ("youtube", ["UCzz", "joshuamagazine"], (1, "handle", False)),  # the first account before a better key of a later one
        ("youtube", ["aUCzzb"], (2, "id", False)),
        ("youtube", ["uczz"], None),  # ids are compared as they are
        ("tiktok", ["örtlich"], (4, "handle", False)),
        ("tiktok", ["www.example.com/p/"], (4, "page", False)),
        ("youtube", ["", None, "/", "..."], None),
        ("youtube", [], None),
        ("youtube", None, None),
    ],
)
def test_excluded_accounts(spark, platform, fields, want):
    listed = table(spark, LISTED, "ref int, platform string, handle string, page string, ids array<string>")
    got = exclusions.excluded_accounts(table(spark, [(7, platform, fields)], "id int, platform string, fields array<string>"), listed).collect()
    assert [tuple(r) for r in got] == ([] if want is None else [(7, *want)])


def test_no_listed_account(spark):
    listed = table(spark, [], "ref int, platform string, handle string, page string, ids array<string>")
    assert exclusions.excluded_accounts(table(spark, [(7, "a", ["x"])], "id int, platform string, fields array<string>"), listed).count() == 0


def test_named_checks_equal_fnmatch(spark):
    keys = ["a.b", "a.bc", "a.b.c", "ax", "captions.pos.x", "a+b", "(a)", "a\\b", "z]", ""]
    globs = ["*", "a.*", "a.b", "a.?", "a[.x]*", "a[!.]*", "*.x", "captions.*.x", "a+b", "(a)", "?", "a\\b", "q", "z]"]
    got = {r["key"]: r["n_checks"] for r in catalog.named_checks(table(spark, [(k,) for k in keys], "key string"), table(spark, [*((g, g) for g in globs), ("*", "a*"), ("none", None)], "check string, pattern string")).collect()}
    assert got == {k: n for k in keys if (n := sum(fnmatch.fnmatchcase(k, g) for g in globs))}


def test_named_checks_equal_fnmatch_at_any_place(spark):
    """Letters before and after the signs, signs at both ends, and checks with several patterns."""
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ab.?") for _ in range(rng.randint(0, 6))) for _ in range(150)})
    globs = sorted({"".join(rng.choice(["a", "b", ".", "*", "?", "[ab]", "[!.]", "a", "b"]) for _ in range(rng.randint(0, 6))) for _ in range(150)})
    checks = [(f"c{i % 40}", g) for i, g in enumerate(globs)] + [(f"d{i % 3}", "a*") for i in range(9)] + [(None, "*")]
    got = {r["key"]: r["n_checks"] for r in catalog.named_checks(table(spark, [(k,) for k in keys], "key string"), table(spark, checks, "check string, pattern string")).collect()}
    assert got == {k: n for k in keys if (n := len({c for c, g in checks if c and fnmatch.fnmatchcase(k, g)}))}


def test_named_checks_try_few_patterns(spark):
    """20,000 patterns that begin with a sign meet 20,000 keys by the letters after it, not all of them."""
    keys = spark.range(20_000).select(F.concat(F.lit("k."), (F.col("id") % 7).cast("string"), F.lit("."), F.lpad(F.col("id").cast("string"), 5, "0")).alias("key"))
    checks = spark.range(20_000).select(F.col("id").cast("string").alias("check"), F.concat(F.lit("k.?."), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("*")).alias("pattern"))
    begun = time.monotonic()
    got = catalog.named_checks(keys, checks.unionByName(checks.select(F.concat("check", F.lit("x")).alias("check"), F.lit("k.*").alias("pattern")))).agg(F.count("*"), F.min("n_checks"), F.max("n_checks")).head()
    assert tuple(got) == (20_000, 20_001, 20_001) and time.monotonic() - begun < 60


def test_registry_sync(spark):
    keys = table(spark, [("asked", None, "requested_change", False), ("found", None, "base", True), ("applied", "rule", "measured", False), ("meta", "meta", "base", False), ("rule", "rule", "base", False), ("idle", None, "base", True), ("open", None, None, None)], "key string, category string, origin string, not_given boolean")
    items = table(spark, [("asked", "measured", "v1"), ("found", "measured", ""), ("applied", "measured", "v3"), ("open", "unmeasured", None), ("gone", "measured", "v")], "key string, status string, evidence string")
    links = table(spark, [("found", "f", True), ("found", "f", True), ("found", "g", True), ("open", "f", False), ("open", "g", None)], "key string, reader string, current boolean")
    old = table(spark, [("found", "v0", "seen"), ("asked", "v0", None), ("gone", "v", "n")], "key string, evidence string, note string")
    done = catalog.registry_sync(keys, items, links, table(spark, [("c1", "f*"), ("c1", "found"), ("c2", "?ound")], "check string, pattern string"), old)
    assert {r["key"]: tuple(r)[1:] for r in done.collect()} == {
        "asked": ("style", "requested_change", False, 0, 0, "v1", None),
        "found": ("style", "measured", True, 2, 2, "v0", "seen"),
        "applied": ("rule", "measured", False, 0, 0, "v3", None),
        "meta": ("meta", "not_applicable", False, 0, 0, None, None),
        "rule": ("rule", "fixed_by_rule", False, 0, 0, None, None),
        "idle": ("style", "not_applicable_given", False, 0, 0, None, None),
        "open": ("style", "unmeasured", False, 0, 0, None, None),
    }
    audit = catalog.registry_audit(done).head()
    assert (audit["ok"], audit["unmeasured"], audit["not_applicable"]) == (False, 2, 1)


def test_page_key(spark):
    ask = lambda a: spark.range(1).select(exclusions.page_key(F.lit(a)).alias("k")).head()[0]
    assert [ask(a) for a in (" HTTPS://WWW.m.Example.com/A/?q#f", "mobile.example.com//", "", None)] == ["example.com/a", "example.com", "", None]
