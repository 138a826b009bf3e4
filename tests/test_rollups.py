"""Roll-ups by entity on small cases: nulls, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F

from tallyline.operators import rollups as U


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_times(spark):
    e = spark.createDataFrame([("a", 0.0, 1.0, "m"), ("a", 5.0, 9.0, "x"), ("a", 2.0, None, "m"), ("b", 3.0, 8.0, "x"), ("c", 2.0, 7.0, "m"), (None, 1.0, None, "u")], "v string, t double, end double, k string")
    assert rows(U.tail_after_marks(e, "v", "t", "end", F.col("k") == "m")) == sorted([("a", 3.0, False), ("b", 3.0, True), ("c", 0.0, False), (None, 1.0, True)], key=str)
    f = spark.createDataFrame([("a", 5.0, "m"), ("a", 3.0, "u"), ("b", 5.0, "m"), ("b", 2.9, "u"), ("c", 1.0, "u"), ("d", 1.0, "m"), ("d", None, "u")], "v string, t double, k string")
    assert rows(U.first_known_time(f, "v", "t", F.col("k") == "m", F.col("k") == "u", 2.0)) == [("a", 5.0), ("b", None), ("d", 1.0)]
    assert U.tail_after_marks(e.limit(0), "v", "t", "end", F.lit(True)).count() == 0


def test_longest_and_extremes(spark):
    e = spark.createDataFrame([("a", 1, 5.0, 9.0), ("a", 2, 5.0, 3.0), ("a", 3, None, 1.0), ("a", 4, 7.0, 3.0), ("b", 5, None, 0.0)], "v string, id int, len double, t double")
    assert rows(U.longest_in_order(e, "v", "id", "len", "t", 2)) == [("a", 1, 2), ("a", 4, 1), ("b", 5, 1)]
    assert rows(U.extremes(e, "v", "len", "id")) == [("a", 5.0, 1, 7.0, 4), ("b", None, None, None, None)]


def test_alignment(spark):
    e = spark.createDataFrame([("l", 1.0, 5.0), ("l", 1.0, 9.0), ("n", 1.0, 5.0), ("n", 2.0, 4.0), ("o", 3.0, None), ("e", None, None)], "v string, x double, w double")
    got = {r["v"]: r["alignment"] for r in U.fixed_alignment(e, "v", {"start": F.col("x"), "end": F.col("x") + F.col("w")}).collect()}
    assert got == {"l": "start", "n": "end", "o": "undecided", "e": None}


def test_words_accounts_origins(spark):
    e = spark.createDataFrame([("a", 1, "One two TWO the"), ("a", 2, "one six"), ("a", 3, None), ("b", 1, "")], "v string, turn int, text string")
    assert rows(U.top_words(e, "v", "turn", "text", ["the"], 2).select("word", "n", "first_turn", "rank")) == [("one", 2, 1, 1), ("two", 2, 1, 2)]
    assert U.top_words(e, "v", "turn", "text", [], 9).count() == 4
    m = spark.createDataFrame([("h", i % 30, i == 7) for i in range(60)] + [(None, 1, None)], "host string, id int, ok boolean")
    got = {r["host"]: (r["n_entities"], r["n_mentions"], r["verified"], r["evidence"]) for r in U.account_rollup(m, "host", "id", F.col("ok"), 3).collect()}
    assert got == {"h": (30, 60, True, "0,1,2"), None: (1, 1, None, "1")}
    one = spark.createDataFrame([("k",), ("k",), (None,)], "key string")
    assert rows(U.with_origins({"z": one, "a": one.where("key = 'k'").limit(1)}, "key")) == sorted([("k", "a,z", 3), (None, "z", 1)], key=str)


def test_layers_and_signatures(spark):
    a = spark.createDataFrame([("k", "old", 1, 1), ("k", "first", 3, 5), ("t", "x", None, 1)], "k string, v string, at int, o int")
    b = spark.createDataFrame([("k", "later", 3, 1), ("t", "y", 0, 9), ("n", None, 2, 2)], "k string, v string, at int, o int")
    assert rows(U.freshest([a, b], "k", "v", "at", "o")) == sorted([("k", "first"), ("t", "y"), ("n", None)], key=str)
    sign = lambda df: U.signature(df, "k", "at", "v")
    assert rows(U.staleness(a, a.orderBy(F.desc("at")), "k", sign)) == [("k", "approved"), ("t", "approved")]
    assert rows(U.staleness(a, a.where("at = 1"), "k", sign)) == [("k", "stale"), ("t", "never approved")]
    assert rows(U.staleness(a, a.unionByName(a.where("k = 't'")).withColumn("v", F.nullif("v", F.lit("old"))), "k", sign)) == [("k", "stale"), ("t", "stale")]
    assert sign(a.limit(0)).count() == 0


def test_said_observed_used(spark):
    c = spark.createDataFrame([("a", 1, "the KEY is"), ("a", 2, "none"), ("a", 3, "Key!"), ("b", 1, "x"), ("b", 2, None)], "v string, turn int, text string")
    assert rows(U.said_before(c, "v", "turn", "text", "[A-Za-z]{3,}")) == [("a", 1)]
    assert rows(U.unobserved(c, c.where("v = 'a'"), "v").select("v", "turn")) == [("b", 1), ("b", 2)]
    used = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", False), ("b", "z", True)], "v string, kind string, used boolean")
    policy = spark.createDataFrame([("x", False), ("y", True)], "kind string, present boolean")
    assert rows(U.use_verdict(used, policy, "kind").select("v", "kind", "verdict")) == [("a", "x", "not allowed"), ("a", "y", "unused"), ("b", "x", "ok")]
