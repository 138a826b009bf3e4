"""Queries of windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import rollups as U
from ..operators import stats as S
from ..operators import windows as W
from .base import E, events, read

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


CAND = """c AS (SELECT c_custkey AS id, c_nationkey AS platform, CASE WHEN c_acctbal > 1000 THEN c_acctbal END AS views, c_custkey % 97 AS checked, c_custkey % 13 AS seen FROM customer)"""


def candidates(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("platform"), F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("views"), (k % 97).alias("checked"), (k % 13).alias("seen"))


@query("w1_rank_by_views", f"""WITH {CAND} SELECT id, platform, views, CASE WHEN views IS NOT NULL THEN place END AS rank, place
FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY views IS NOT NULL DESC, views DESC NULLS LAST, checked DESC NULLS LAST, seen, id) AS place FROM c)""")
def w1(spark, d):
    return W.rank_known_first(candidates(spark, d), "platform", "views", "checked", "seen", "id").select("id", "platform", "views", "rank", "place")


@query("w2_top_n_hidden", f"""WITH {CAND}, n AS (SELECT platform, greatest(count(*) - 5, 0) AS hidden FROM c GROUP BY 1)
SELECT platform, id, place, hidden FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY views DESC NULLS LAST, id) AS place FROM c) JOIN n USING (platform) WHERE place <= 5""")
def w2(spark, d):
    return W.top_n(candidates(spark, d), "platform", [F.desc_nulls_last("views"), F.col("id")], 5).select("platform", "id", "place", "hidden")


@query("w3_latest_snapshot", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS day FROM orders)
SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY day DESC, o_orderkey) AS rank FROM o WHERE day IS NOT NULL) WHERE rank <= 100 UNION ALL SELECT o_orderkey, NULL FROM o WHERE day IS NULL""")
def w3(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("day"))
    return W.latest_n(o, "day", "o_orderkey", 100).select("o_orderkey", "rank")


@query("w4_longest_run", f"""WITH {E}, i AS (SELECT video_id, event_id, value > 10 AS f, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY event_id) AS isl FROM e)
SELECT video_id, max(c)::BIGINT AS longest_run FROM (SELECT video_id, isl, sum(f::INT) AS c FROM i GROUP BY 1, 2) GROUP BY 1""")
def w4(spark, d):
    return S.longest_run(events(spark, d).withColumn("f", F.col("value") > 10), "video_id", "event_id", "f")


@query("w5_blink_duty", f"""WITH {E}, a AS (SELECT video_id, event_id, value > 10 AS f FROM e), b AS (SELECT *, lag(f) OVER w AS p, lead(f) OVER w AS n FROM a WINDOW w AS (PARTITION BY video_id ORDER BY event_id)),
c AS (SELECT video_id, event_id, CASE WHEN p = n AND p <> f THEN p ELSE f END AS f FROM b), g AS (SELECT *, CASE WHEN lag(f) OVER w IS NOT DISTINCT FROM f AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY video_id ORDER BY event_id)),
r AS (SELECT video_id, run, any_value(f) AS f, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY event_id) AS run FROM g) GROUP BY 1, 2)
SELECT video_id, count(*) FILTER (f) AS n_on, round(median(n) FILTER (f), 6) AS on_p50, round(sum(n) FILTER (f) / sum(n), 6) AS duty FROM r GROUP BY 1""")
def w5(spark, d):
    a = events(spark, d).select("video_id", "event_id", (F.col("value") > 10).alias("f"))
    r = W.runs(W.without_dropouts(a, "video_id", "event_id", "f"), "video_id", "event_id", "f")
    on = F.when(F.col("f"), F.col("n"))
    return r.groupBy("video_id").agg(F.count(on).alias("n_on"), S.rounded(F.median(on)).alias("on_p50"), S.rounded(F.sum(on) / F.sum("n")).alias("duty"))


@query("w6_gap_lengths", f"""WITH {E}, h AS (SELECT video_id, max(t) AS duration FROM e GROUP BY 1), p AS (SELECT video_id, t FROM e WHERE type = 'click' UNION ALL SELECT video_id, 0.0 FROM h UNION ALL SELECT video_id, duration FROM h)
SELECT video_id, count(*) AS n, round(max(gap), 6) AS longest FROM (SELECT video_id, lead(t) OVER (PARTITION BY video_id ORDER BY t) - t AS gap FROM p) WHERE gap > 1e-3 GROUP BY 1""")
def w6(spark, d):
    e = events(spark, d)
    g = I.gaps(e.where("type = 'click'").select("video_id", "t"), e.groupBy("video_id").agg(F.max("t").alias("duration")), "video_id", "t", "duration")
    return g.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.max("gap")).alias("longest"))


@query("w7_merge_intervals", f"""WITH {E}, b AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY t, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR t > before + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, "end") AS island FROM b)
SELECT video_id, round(start, 6) AS start, round(stop, 6) AS "end", n FROM (SELECT video_id, island, min(t) AS start, max("end") AS stop, count(*) AS n FROM i GROUP BY 1, 2) WHERE stop - start >= 1""")
def w7(spark, d):
    out = I.merge_intervals(events(spark, d).withColumnRenamed("t", "start"), "video_id", "start", "end", gap=0.5, least=1.0)
    return out.select("video_id", S.rounded("start").alias("start"), S.rounded("end").alias("end"), "n")


@query("w8_minimum_spacing", f"""WITH {E} SELECT video_id, type, event_id, round(since, 6) AS since FROM (SELECT *, t - lag(t) OVER (PARTITION BY video_id, type ORDER BY t) AS since FROM e) WHERE since < 5""")
def w8(spark, d):
    return W.too_close(events(spark, d), ["video_id", "type"], "t", 5.0).select("video_id", "type", "event_id", S.rounded("since").alias("since"))


@query("w9_repetition", r"""SELECT conv_id, role, turn, v AS endings FROM (SELECT *, lag(v) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM (SELECT conv_id, role, turn, regexp_replace(text, '[^.!?\n]', '', 'g') AS v FROM conversations)) WHERE v = b""")
def w9(spark, d):
    shape = F.regexp_replace("text", r"[^.!?\n]", "")  # the ends of all its sentences and lines
    return W.repeats(read(spark, d, "conversations"), ["conv_id", "role"], "turn", shape).select("conv_id", "role", "turn", F.col("v").alias("endings"))


@query("w10_transition_twice", f"""WITH {E} SELECT video_id, event_id, type FROM (SELECT *, lag(type) OVER (PARTITION BY video_id ORDER BY event_id) AS b FROM e) WHERE type = b AND type <> 'view'""")
def w10(spark, d):
    return W.repeats(events(spark, d), ["video_id"], "event_id", F.col("type")).where("type <> 'view'").select("video_id", "event_id", "type")


@query("w11_collapsed_sequence", """SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS sequence FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> role GROUP BY 1""")
def w11(spark, d):
    return W.collapsed_sequence(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("w12_reference_order", """WITH j AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 END AS idx FROM conversations),
k AS (SELECT conv_id, bool_or(coalesce(p > idx, false)) AS b FROM (SELECT *, lag(idx) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM j WHERE idx IS NOT NULL) GROUP BY 1)
SELECT conv_id, count(*) FILTER (idx IS NULL) AS n_unknown, NOT coalesce(any_value(b), false) AS in_order FROM j LEFT JOIN k USING (conv_id) GROUP BY 1""")
def w12(spark, d):
    order = spark.createDataFrame([("system", 0), ("user", 1)], "role string, idx int")
    return W.follows_order(read(spark, d, "conversations"), "conv_id", "turn", "role", order)


@query("w13_latest_valid", f"""WITH {E} SELECT video_id, max(event_id) FILTER (value > 30 AND type <> 'error') AS event_id, arg_max(value, event_id) FILTER (value > 30 AND type <> 'error') AS value FROM e GROUP BY 1""")
def w13(spark, d):
    return W.latest_valid(events(spark, d), "video_id", "event_id", (F.col("value") > 30) & (F.col("type") != "error"), "value")


@query("w14_trim_tail", f"""WITH {E}, s AS (SELECT video_id, max(t) AS stop FROM e GROUP BY 1), m AS (SELECT e.video_id, max(least("end", stop)) AS mark FROM e JOIN s USING (video_id) WHERE type IN ('click', 'purchase') GROUP BY 1)
SELECT video_id, round(CASE WHEN mark IS NULL THEN stop ELSE stop - mark END, 6) AS tail, mark IS NULL AS no_mark FROM s LEFT JOIN m USING (video_id)""")
def w14(spark, d):
    return U.tail_after_marks(events(spark, d), "video_id", "t", "end", F.col("type").isin("click", "purchase"))


@query("w16_first_timed", f"""WITH {E}, f AS (SELECT video_id, min(t) AS t0 FROM e WHERE type = 'click' GROUP BY 1), u AS (SELECT DISTINCT e.video_id FROM e JOIN f USING (video_id) WHERE e.type = 'error' AND e.t < f.t0 - 2)
SELECT video_id, CASE WHEN u.video_id IS NULL THEN round(t0, 6) END AS first_t FROM f LEFT JOIN u USING (video_id)""")
def w16(spark, d):
    return U.first_known_time(events(spark, d), "video_id", "t", F.col("type") == "click", F.col("type") == "error", 2.0)


@query("t1_final_ranking", """SELECT id, total, row_number() OVER (ORDER BY total DESC NULLS LAST, id) AS place FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS total FROM customer WHERE c_mktsegment <> 'BUILDING') ORDER BY 3 LIMIT 200""")
def t1(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(k.alias("id"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("total"))
    order = [F.desc_nulls_last("total"), F.col("id")]
    return rows.orderBy(*order).limit(200).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("t2_newest_n", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def t2(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("t3_filtered_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def t3(spark, d):
    from ..operators.catalog import listing

    return listing(read(spark, d, "orders"), {"o_orderpriority": "1-URGENT"}, "o_totalprice > 100000", "value", {"value": [F.desc("o_totalprice"), F.col("o_orderkey")], "date": [F.desc("o_orderdate"), F.col("o_orderkey")]}, 30).select("o_orderkey", "o_totalprice")


@query("t4_longest_intervals", f"""WITH {E} SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY t) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, event_id) AS r FROM e) WHERE r <= 4""")
def t4(spark, d):
    return U.longest_in_order(events(spark, d), "video_id", "event_id", "value", "t", 4)


@query("u1_named_sets", """WITH s AS (SELECT o_custkey AS k, 0 AS p FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_nationkey < 5)
SELECT k, p FROM (SELECT k, min(p) AS p FROM s GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') ORDER BY p, k LIMIT 300""")
def u1(spark, d):
    from ..operators.catalog import named_set

    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return named_set([o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), c.where("c_nationkey < 5").select(F.col("c_custkey").alias("k"))], c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("k")), "k", 300)


@query("u2_distinct_titles", """SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part) WHERE r = 1""")
def u2(spark, d):
    p = read(spark, d, "part").groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.min(F.struct("p_partkey", "p_name")).alias("r"))
    return p.select("r.p_partkey", "r.p_name")


DIFF = """a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 13 <> 0)"""


@query("u3_changed_keys", f"""WITH {DIFF} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL""")
def u3(spark, d):
    from ..operators.state import changed_keys

    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 11 != 0).select(k.alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where(k % 13 != 0).select(k.alias("k"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("v"))
    return changed_keys(old, new, ["k"], ["v"])


@query("u4_section_diff", """WITH a AS (SELECT 'doc.' || doc_id AS k, n_chars AS v FROM documents), b AS (SELECT 'doc.' || doc_id, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END FROM documents WHERE lang <> 'de'), c(k, v) AS (SELECT * FROM b)
SELECT split_part(coalesce(a.k, c.k), '.', 1) AS section, CASE WHEN a.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN c ON a.k = c.k WHERE a.v IS DISTINCT FROM c.v OR a.k IS NULL OR c.k IS NULL GROUP BY 1, 2""")
def u4(spark, d):
    from ..operators.state import changed_keys

    docs = read(spark, d, "documents")
    k = F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("k")
    new = docs.where("lang <> 'de'").select(k, F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("v"))
    diff = changed_keys(docs.select(k, F.col("n_chars").alias("v")), new, ["k"], ["v"])
    return diff.groupBy(F.split_part("k", F.lit("."), F.lit(1)).alias("section"), "change").agg(F.count(F.lit(1)).alias("n"))


@query("u5_idempotent_append", """WITH old AS (SELECT c_custkey AS k, 'old' AS origin FROM customer WHERE c_custkey % 3 = 0), new AS (SELECT o_custkey AS k, min(o_orderkey) AS f FROM orders GROUP BY 1)
SELECT k, origin FROM old UNION ALL SELECT k, 'order ' || f FROM new WHERE k NOT IN (SELECT k FROM old)""")
def u5(spark, d):
    from ..operators.state import append_new

    old = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("origin"), F.lit(0).cast("long").alias("pos"))
    new = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("origin"), F.col("o_orderkey").alias("pos"))
    return append_new(old, new, "k", "pos").select("k", "origin")
