"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import rollups as U
from ..operators import stats as S
from .base import E, dist_sql, events, read

CUTS = ("click", "view", "purchase")
QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("a1_pstats", """SELECT l_returnflag, count(*) AS n, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90
FROM (SELECT l_returnflag, nullif(l_extendedprice, 0) AS x FROM lineitem WHERE l_discount > 0) WHERE x IS NOT NULL GROUP BY 1""")
def a1(spark, d):
    return S.pstats(read(spark, d, "lineitem").where("l_discount > 0").withColumn("x", F.nullif("l_extendedprice", F.lit(0.0))), "x", "l_returnflag")


@query("a2_pstats_by_group", "WITH x AS (SELECT nullif(l_returnflag, 'N') AS g, l_extendedprice AS v FROM lineitem) " + dist_sql("x", "v", "g"))
def a2(spark, d):
    return S.pstats_by_group(read(spark, d, "lineitem").withColumn("g", F.nullif("l_returnflag", F.lit("N"))), "l_extendedprice", "g")


@query("a3_categorical", f"""WITH {E}, c AS (SELECT video_id, type, count(*) AS k, min(event_id) AS f FROM e GROUP BY 1, 2)
SELECT video_id, sum(k)::BIGINT AS n, string_agg(type || ':' || k, ',' ORDER BY type) AS counts, arg_max(type, {{'k': k, 'f': -f}}) AS mode, round(max(k) / sum(k), 6) AS share FROM c GROUP BY 1""")
def a3(spark, d):
    out = S.categorical(events(spark, d), "type", "event_id", "video_id")
    text = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return out.withColumn("counts", text)


@query("a4_tri_state", f"""WITH {E}, o AS (SELECT video_id, type, CASE WHEN value > 40 THEN true WHEN value > 1 THEN false END AS seen FROM e WHERE value > 100 OR value <= 1 OR type IN ('click', 'view'))
SELECT video_id, type, CASE WHEN bool_or(seen) THEN 'present' WHEN bool_or(seen) IS NULL THEN 'unmeasured' ELSE 'absent' END AS state FROM o GROUP BY 1, 2""")
def a4(spark, d):
    seen = F.when(F.col("value") > 40, True).when(F.col("value") > 1, False)
    rows = events(spark, d).where("value > 100 OR value <= 1 OR type IN ('click', 'view')")
    return rows.groupBy("video_id", "type").agg(S.tri_state(seen).alias("state"))


A5 = """SELECT 'price' AS key, s.grp, coalesce(x.n, 0) AS n, x.p10, x.p50, x.p90, x.{rule}::DOUBLE AS value,
CASE WHEN coalesce(x.n, 0) = 0 THEN 'unmeasured' ELSE 'measured' END AS status, CASE WHEN coalesce(x.n, 0) = 0 THEN 'no measured value' END AS blocker,
(SELECT string_agg(video::VARCHAR, ',' ORDER BY pos) FROM (SELECT l_suppkey AS video, min(pos) AS pos FROM v WHERE v IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 5)) AS evidence
FROM (SELECT DISTINCT g AS grp FROM v UNION ALL SELECT NULL) s LEFT JOIN x ON s.grp IS NOT DISTINCT FROM x.grp"""


@query("a5_numeric_item", f"""WITH v AS (SELECT l_suppkey, l_returnflag AS g, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag <> 'R' AND l_quantity > 5 THEN l_quantity END AS v FROM lineitem),
y AS (SELECT DISTINCT l_suppkey, g, v, pos FROM v), x AS ({dist_sql("y", "v", "g")}) {A5.format(rule="p50")}""")
def a5(spark, d):
    v = F.when((F.col("l_returnflag") != "R") & (F.col("l_quantity") > 5), F.col("l_quantity"))
    rows = read(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), v.alias("v")).distinct()
    return S.numeric_item(rows, "price", "v", "g", "l_suppkey", "pos")


@query("a6_categorical_item", f"""WITH {E}, c AS (SELECT format_id AS g, type, count(*) AS k, min(event_id) AS f FROM e GROUP BY 1, 2),
b AS (SELECT NULL AS grp, type, sum(k)::BIGINT AS k, min(f) AS f FROM c GROUP BY 2 UNION ALL SELECT g, type, k, f FROM c)
SELECT grp, sum(k)::BIGINT AS n, arg_max(type, {{'k': k, 'f': -f}}) AS mode, round(max(k) / sum(k), 6) AS share FROM b GROUP BY 1""")
def a6(spark, d):
    return S.categorical_by_group(events(spark, d), "type", "event_id", "format_id")


@query("a8_presence_item", f"""WITH {E}, s AS (SELECT video_id, any_value(format_id) AS g, CASE WHEN bool_or(x) THEN 'present' WHEN bool_or(x) IS NULL THEN 'unmeasured' ELSE 'absent' END AS s
FROM (SELECT *, CASE WHEN value > 150 THEN true WHEN value > 90 THEN false END AS x FROM e) GROUP BY 1),
r AS (SELECT g AS grp, grouping(g) AS o, count(*) AS n, count(*) FILTER (s = 'present') AS n_present, count(*) FILTER (s = 'absent') AS n_absent, count(*) FILTER (s = 'unmeasured') AS n_unmeasured FROM s GROUP BY ROLLUP (g))
SELECT grp, n, n_present, n_absent, n_unmeasured, round(n_present / nullif(n_present + n_absent, 0), 6) AS share FROM r""")
def a8(spark, d):
    x = F.when(F.col("value") > 150, True).when(F.col("value") > 90, False)
    return S.presence_summary(events(spark, d).groupBy("video_id", "format_id").agg(S.tri_state(x).alias("s")), "s", "format_id")


@query("a9_evidence", """WITH f AS (SELECT o_custkey, min(o_orderkey) AS pos FROM orders WHERE o_totalprice > 400000 GROUP BY 1 ORDER BY 2, 1 LIMIT 5)
SELECT string_agg(o_custkey::VARCHAR, ',' ORDER BY pos) AS evidence FROM f""")
def a9(spark, d):
    return S.evidence(read(spark, d, "orders").where("o_totalprice > 400000"), "o_custkey", "o_orderkey", "o_totalprice")


@query("a10_entity_mode", f"""WITH {E}, c AS (SELECT video_id, type, count(*) AS k, min(event_id) AS f FROM e GROUP BY 1, 2)
SELECT video_id, arg_max(type, {{'k': k, 'f': -f}}) AS mode FROM c GROUP BY 1""")
def a10(spark, d):
    return S.entity_mode(events(spark, d), "video_id", "type", "event_id")


@query("a11_native_stats", """SELECT p_type, count(*) AS n, round(quantile_cont(p_size::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(p_size::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(p_size::DOUBLE, 0.9), 6) AS p90 FROM part GROUP BY 1""")
def a11(spark, d):
    return S.pstats(read(spark, d, "part"), "p_size", "p_type")


@query("a12_role_summary", """WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS k, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT l_suppkey, l_returnflag, arg_max(l_linestatus, {'k': k, 'f': -f}) AS mode_status FROM c GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, count(*) AS n, round(median(l_quantity), 6) AS size_p50, round(avg((l_discount > 0.05)::INT), 6) AS share_discounted, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
round(median(l_tax) FILTER (l_discount > 0.05), 6) AS tax_when_discounted, any_value(mode_status) AS mode_status FROM lineitem JOIN m USING (l_suppkey, l_returnflag) GROUP BY 1, 2""")
def a12(spark, d):
    li = read(spark, d, "lineitem")
    mode = S.categorical(li, "l_linestatus", "l_orderkey", "l_suppkey", "l_returnflag").select("l_suppkey", "l_returnflag", F.col("mode").alias("mode_status"))
    low = F.col("l_discount") > 0.05
    out = li.groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), S.rounded(F.median("l_quantity")).alias("size_p50"), S.rounded(F.avg(low.cast("int"))).alias("share_discounted"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), S.rounded(F.median(F.when(low, F.col("l_tax")))).alias("tax_when_discounted"),
    )
    return out.join(mode, ["l_suppkey", "l_returnflag"])


@query("a13_alignment", """SELECT l_suppkey, CASE WHEN least(a, b, c) * 1.02 >= (a + b + c) - least(a, b, c) - greatest(a, b, c) THEN 'undecided' WHEN a = least(a, b, c) THEN 'start' WHEN b = least(a, b, c) THEN 'center' ELSE 'end' END AS alignment,
round(a, 6) AS sd_start, round(b, 6) AS sd_center, round(c, 6) AS sd_end
FROM (SELECT l_suppkey, stddev_pop(l_quantity) AS a, stddev_pop(l_quantity + l_tax * 100) AS b, stddev_pop(l_quantity + l_tax * 200) AS c FROM lineitem GROUP BY 1)""")
def a13(spark, d):
    x, step = F.col("l_quantity"), F.col("l_tax") * 100
    return U.fixed_alignment(read(spark, d, "lineitem"), "l_suppkey", {"start": x, "center": x + step, "end": x + step * 2})


@query("a14_safe_margins", """SELECT l_returnflag, min({'v': l_extendedprice, 'k': l_orderkey, 'n': l_linenumber}).v AS low, min({'v': l_extendedprice, 'k': l_orderkey, 'n': l_linenumber}).k AS low_at,
max({'v': l_extendedprice, 'k': -l_orderkey, 'n': -l_linenumber}).v AS high, -max({'v': l_extendedprice, 'k': -l_orderkey, 'n': -l_linenumber}).k AS high_at FROM lineitem GROUP BY 1""")
def a14(spark, d):
    return U.extremes(read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")


def cut_structure(spark, d):
    """Events of three types as transitions: rate per 10 hours and median gap of each user; users with less than 60 events are partial."""
    from ..operators.intervals import gaps

    e = events(spark, d)
    head = e.groupBy("video_id", "format_id").agg(F.max("t").alias("duration"), F.count(F.lit(1)).alias("n_all"))
    cuts = e.where(F.col("type").isin(*CUTS))
    inner = cuts.join(head, ["video_id", "format_id"]).where("t > 0 AND t < duration")
    lengths = gaps(inner.select("video_id", "t"), head.select("video_id", "duration"), "video_id", "t", "duration")
    per = lengths.groupBy("video_id").agg(S.rounded(F.median("gap")).alias("shot_p50"))
    n = inner.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_cuts"))
    out = head.join(n, "video_id", "left").join(per, "video_id", "left").withColumn("n_cuts", F.coalesce("n_cuts", F.lit(0)))
    partial = F.when(F.col("n_all") < 60, "partial")
    return out.select("video_id", "format_id", "n_cuts", F.when(partial.isNull(), S.rounded(F.col("n_cuts") / F.col("duration") * 10)).alias("rate"), F.when(partial.isNull(), F.col("shot_p50")).alias("shot_p50"), partial.alias("excluded"))


CUT = f"""{E}, h AS (SELECT video_id, format_id, max(t) AS duration, count(*) AS n_all FROM e GROUP BY 1, 2),
i AS (SELECT e.video_id, t FROM e JOIN h USING (video_id) WHERE type IN ('click', 'view', 'purchase') AND t > 0 AND t < duration),
p AS (SELECT video_id, t FROM i UNION ALL SELECT video_id, 0.0 FROM h UNION ALL SELECT video_id, duration FROM h),
g AS (SELECT video_id, lead(t) OVER (PARTITION BY video_id ORDER BY t) - t AS gap FROM p),
m AS (SELECT video_id, round(median(gap), 6) AS shot_p50 FROM g WHERE gap > 1e-3 GROUP BY 1), k AS (SELECT video_id, count(*) AS n_cuts FROM i GROUP BY 1),
s AS (SELECT h.video_id, format_id, coalesce(n_cuts, 0) AS n_cuts, CASE WHEN n_all >= 60 THEN round(coalesce(n_cuts, 0) / duration * 10, 6) END AS rate,
CASE WHEN n_all >= 60 THEN shot_p50 END AS shot_p50, CASE WHEN n_all < 60 THEN 'partial' END AS excluded FROM h LEFT JOIN k USING (video_id) LEFT JOIN m USING (video_id))"""


QUERIES["a15_cut_structure"] = (cut_structure, f"WITH {CUT} SELECT * FROM s")


@query("a16_cut_structure_distribution", f"""WITH {CUT}, r AS ({dist_sql("s", "rate", "format_id")}), q AS ({dist_sql("s", "shot_p50", "format_id")}),
b AS (SELECT 'cuts_per_10' AS k, * FROM r UNION ALL SELECT 'shot_len', * FROM q)
SELECT k || '.' || leaf AS key, grp, value::DOUBLE AS value FROM (SELECT k, grp, n::DOUBLE AS n, p10, p50, p90 FROM b) UNPIVOT INCLUDE NULLS (value FOR leaf IN (n, p10, p50, p90))""")
def a16(spark, d):
    s = cut_structure(spark, d)
    return S.leaf_rows(S.pstats_by_group(s, "rate", "format_id"), "cuts_per_10").unionByName(S.leaf_rows(S.pstats_by_group(s, "shot_p50", "format_id"), "shot_len"))


@query("a17_count_rows", f"""WITH {E}, i AS (SELECT video_id, event_id, type = 'error' AS f, sum(CASE WHEN type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY event_id) AS isl FROM e),
r AS (SELECT video_id, max(c) AS longest_run FROM (SELECT video_id, isl, sum(f::INT) AS c FROM i GROUP BY 1, 2) GROUP BY 1)
SELECT e.video_id, count(*) FILTER (type = 'error') AS n, any_value(longest_run)::BIGINT AS longest_run FROM e JOIN r USING (video_id) GROUP BY 1""")
def a17(spark, d):
    e = events(spark, d).withColumn("f", F.col("type") == "error")
    n = e.groupBy("video_id").agg(F.count(F.when(F.col("f"), 1)).alias("n"))
    return n.join(S.longest_run(e, "video_id", "event_id", "f"), "video_id")


@query("a18_dominant_class", """WITH c AS (SELECT source, lang, count(*) AS k, min(doc_id) AS f FROM documents GROUP BY 1, 2),
m AS (SELECT source, arg_max(lang, {'k': k, 'f': -f}) AS mode, max(k) / sum(k) AS share FROM c GROUP BY 1)
SELECT source, CASE WHEN share >= 0.6 THEN mode ELSE 'mixed' END AS class, round(share, 6) AS share FROM m""")
def a18(spark, d):
    c = S.categorical(read(spark, d, "documents"), "lang", "doc_id", "source")
    return c.select("source", F.when(F.col("share") >= 0.6, F.col("mode")).otherwise("mixed").alias("class"), "share")


@query("a19_quote_marks", r"""WITH t AS (SELECT *, trim(CASE WHEN doc_id % 3 = 0 THEN '«' || text || '»' WHEN doc_id % 7 < 3 THEN '"' || text || '"' ELSE text END) AS t FROM documents),
q AS (SELECT source, doc_id, CASE WHEN t LIKE '«%»' THEN '«»' WHEN t LIKE '"%"' AND length(t) > 1 THEN '""' END AS pair, n_chars < 300 AS part FROM t),
c AS (SELECT source, pair, count(*) AS k, min(doc_id) AS f FROM q WHERE NOT part AND pair IS NOT NULL GROUP BY 1, 2), m AS (SELECT source, arg_max(pair, {'k': k, 'f': -f}) AS mode FROM c GROUP BY 1),
n AS (SELECT source, count(*) FILTER (part) AS excluded FROM q GROUP BY 1) SELECT n.source, mode, excluded FROM n LEFT JOIN m USING (source)""")
def a19(spark, d):
    text, k = F.col("text"), F.col("doc_id")
    quoted = F.when(k % 3 == 0, F.concat(F.lit("«"), text, F.lit("»"))).when(k % 7 < 3, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    q = read(spark, d, "documents").withColumn("pair", X.quote_pair(quoted, {'"': '"', "«": "»"})).withColumn("part", F.col("n_chars") < 300)
    return q.groupBy("source").agg(F.count(F.when(F.col("part"), 1)).alias("excluded")).join(S.entity_mode(q.where("NOT part"), "source", "pair", "doc_id"), "source", "left")


@query("a20_feature_vector", f"""WITH {E} SELECT video_id, round(count(*) FILTER (type = 'click') / max(t) * 10, 6) AS clicks_per_10, round(count(*) FILTER (type = 'view') / count(*), 6) AS share_view,
bool_or(type = 'error' AND value > 200) AS big_error, round(avg(value) FILTER (type = 'purchase'), 6) AS mean_purchase, count(*) AS n FROM e GROUP BY 1""")
def a20(spark, d):
    kind = lambda k: F.count(F.when(F.col("type") == k, 1))
    return events(spark, d).groupBy("video_id").agg(
        S.rounded(kind("click") / F.max("t") * 10).alias("clicks_per_10"), S.rounded(kind("view") / F.count(F.lit(1))).alias("share_view"),
        F.bool_or((F.col("type") == "error") & (F.col("value") > 200)).alias("big_error"),
        S.rounded(F.avg(F.when(F.col("type") == "purchase", F.col("value")))).alias("mean_purchase"), F.count(F.lit(1)).alias("n"),
    )


@query("a21_group_table", """WITH m AS (SELECT doc_id, lang || '-' || quality AS s, toxic FROM labels JOIN documents USING (doc_id)),
g AS (SELECT s, count(*) AS n, min(doc_id) AS f, sum(('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT::HUGEINT)::VARCHAR AS members, count(DISTINCT toxic) AS variants FROM m GROUP BY 1)
SELECT 'F' || row_number() OVER (ORDER BY n DESC, s) AS format_id, s AS structure, n, round(n / sum(n) OVER (), 6) AS share, variants, members,
(SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_unlabeled FROM g""")
def a21(spark, d):
    from ..operators.catalog import group_table

    docs, marks = read(spark, d, "documents"), read(spark, d, "labels")
    m = marks.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.concat_ws("-", "lang", "quality").alias("structure"), "toxic")
    rest = docs.join(marks, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unlabeled"))
    return group_table(m, "doc_id", "structure", "toxic").crossJoin(F.broadcast(rest))


@query("a22_complete_groups", """SELECT source || '/' || doc_id % 100 AS source, count(*) AS n_members, count(quality) AS n_labeled, CASE WHEN count(*) = count(quality) THEN round(avg(quality), 6) END AS value,
CASE WHEN count(*) <> count(quality) AND count(quality) > 0 THEN round(avg(quality), 6) END AS partial_value FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def a22(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").withColumn("source", F.concat_ws("/", "source", (F.col("doc_id") % 100).cast("string")))
    whole, mean = F.count(F.lit(1)) == F.count("quality"), S.rounded(F.avg("quality"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_members"), F.count("quality").alias("n_labeled"), F.when(whole, mean).alias("value"), F.when(~whole & (F.count("quality") > 0), mean).alias("partial_value"))


@query("a23_account_rollup", r"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url LIKE 'https%' AS safe FROM pages)
SELECT host, count(DISTINCT page_id) AS n_entities, count(*) AS n_mentions, bool_or(safe) AS verified, array_to_string(list_sort(list(page_id))[1:20], ',') AS evidence FROM a GROUP BY 1""")
def a23(spark, d):
    a = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").startswith("https").alias("safe"))
    return U.account_rollup(a, "host", "page_id", F.col("safe"))


@query("a24_top_words", r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations),
c AS (SELECT conv_id, word, count(*) AS n, min(turn) AS first_turn FROM w WHERE length(word) >= 3 AND word NOT IN ('the', 'and', 'que', 'der', 'die', 'les', 'des') GROUP BY 1, 2)
SELECT conv_id, word, n, first_turn, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_turn, word) AS r FROM c) WHERE r <= 5""")
def a24(spark, d):
    return U.top_words(read(spark, d, "conversations"), "conv_id", "turn", "text", ["the", "and", "que", "der", "die", "les", "des"], 5)


@query("a25_coverage_matrix", """WITH t AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS channel),
x AS (SELECT o_custkey, channel, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = t.o_custkey AND o.o_orderpriority = channel) AS covered FROM t, k)
SELECT channel, count(*) AS n_targets, count(*) FILTER (covered) AS n_covered, array_to_string(list_sort(list(o_custkey) FILTER (NOT covered))[1:50], ',') AS missing FROM x GROUP BY 1""")
def a25(spark, d):
    o = read(spark, d, "orders")
    got = o.groupBy("o_custkey", F.col("o_orderpriority").alias("channel")).agg(F.count(F.lit(1)).alias("k"))
    kinds = spark.createDataFrame([(c,) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")], "channel string")
    x = S.with_zeros(got, o, kinds, "o_custkey", "channel", "k")
    g = x.groupBy("channel").agg(F.count(F.lit(1)).alias("n_targets"), F.count(F.when(F.col("k") > 0, 1)).alias("n_covered"))
    return g.join(U.first_ids(x.where("k = 0"), "channel", "o_custkey", 50, "missing"), "channel", "left")


@query("a26_step_coverage", """WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderkey % 3 = 0 AS snap, o_orderpriority FROM orders WHERE o_totalprice >= 450000)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_step_done, count(*) FILTER (NOT snap) AS n_outside, round(quantile_cont(o_totalprice, 0.5) FILTER (NOT snap), 6) AS outside_p50 FROM t GROUP BY 1""")
def a26(spark, d):
    t = read(spark, d, "orders").where("o_totalprice >= 450000").withColumn("snap", F.col("o_orderkey") % 3 == 0)
    return t.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_step_done"), F.count(F.when(~F.col("snap"), 1)).alias("n_outside"), S.rounded(F.percentile(F.when(~F.col("snap"), F.col("o_totalprice")), 0.5)).alias("outside_p50"))


@query("a27_threshold_sets", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS exact, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000) * 1000 END AS approx FROM orders)
SELECT o_orderkey, CASE WHEN exact >= 400000 THEN 'above' WHEN exact IS NOT NULL THEN 'below' WHEN approx IS NULL OR approx >= 0.9 * 400000 THEN 'unverified' ELSE 'below' END AS state,
CASE WHEN exact IS NULL AND approx IS NULL THEN 'value unknown' WHEN exact IS NULL AND approx >= 360000 THEN 'not fetched' END AS reason FROM t""")
def a27(spark, d):
    k = F.col("o_orderkey")
    exact = F.when(k % 4 != 0, F.col("o_totalprice"))
    approx = F.when(k % 7 != 0, F.round(F.col("o_totalprice") / 1000) * 1000)
    state = F.when(exact >= 400000, "above").when(exact.isNotNull(), "below").when(approx.isNull() | (approx >= 0.9 * 400000), "unverified").otherwise("below")
    reason = F.when(exact.isNull() & approx.isNull(), "value unknown").when(exact.isNull() & (approx >= 360000), "not fetched")
    return read(spark, d, "orders").select("o_orderkey", state.alias("state"), reason.alias("reason"))


QA = """q AS (SELECT event_id AS row_id, type AS category, CASE WHEN value > 50 THEN 'wide' ELSE 'narrow' END AS kind, CASE WHEN value > 100 THEN 'different' WHEN value < 1 THEN 'unmeasured' ELSE 'same' END AS status,
event_id % 3 = 0 AS required, event_id % 5 = 0 AS intended, video_id, value FROM e)"""


def verdicts(spark, d):
    v = F.col("value")
    return events(spark, d).select(
        F.col("event_id").alias("row_id"), F.col("type").alias("category"), F.when(v > 50, "wide").otherwise("narrow").alias("kind"), F.when(v > 100, "different").when(v < 1, "unmeasured").otherwise("same").alias("status"),
        (F.col("event_id") % 3 == 0).alias("required"), (F.col("event_id") % 5 == 0).alias("intended"), "video_id", "value",
    )


@query("a28_qa_rollup", f"""WITH {E}, {QA} SELECT category, kind, status, count(*) AS n, count(*) FILTER (intended) AS n_intended, grouping(category, kind, status) AS level FROM q GROUP BY GROUPING SETS ((status), (category, status), (kind, status))""")
def a28(spark, d):
    q = verdicts(spark, d)
    c, k, s = F.col("category"), F.col("kind"), F.col("status")
    return q.groupingSets([[s], [c, s], [k, s]], c, k, s).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("intended"), 1)).alias("n_intended"), (F.grouping("category") * 4 + F.grouping("kind") * 2 + F.grouping("status")).cast("long").alias("level"))


@query("a29_error_stats", "WITH m AS (SELECT 'tax' AS chk, abs(l_tax - 0.04) AS err FROM lineitem UNION ALL SELECT 'discount', abs(l_discount - 0.05) FROM lineitem) " + dist_sql("m", "err", "chk"))
def a29(spark, d):
    li = read(spark, d, "lineitem")
    one = lambda name, col, mid: li.select(F.lit(name).alias("chk"), F.abs(F.col(col) - mid).alias("err"))
    return S.pstats_by_group(one("tax", "l_tax", 0.04).unionByName(one("discount", "l_discount", 0.05)), "err", "chk")


@query("a30_gate", f"""WITH {E}, {QA}, r AS (SELECT 'required_unmeasured' AS rule, row_id FROM q WHERE required AND status = 'unmeasured' UNION ALL SELECT 'different_unintended', row_id FROM q WHERE status = 'different' AND NOT intended
UNION ALL SELECT 'intended_unchanged', row_id FROM q WHERE intended AND status = 'same' AND value > 95), n AS (SELECT unnest(['required_unmeasured', 'different_unintended', 'intended_unchanged', 'no_rows']) AS rule)
SELECT n.rule, count(row_id) AS n_failing, count(row_id) = 0 AS passed, md5(coalesce(array_to_string(list_sort(list(row_id) FILTER (row_id IS NOT NULL))[1:50], ','), '')) AS failing FROM n LEFT JOIN r USING (rule) GROUP BY 1""")
def a30(spark, d):
    from ..operators.qa import gate

    rules = {"required_unmeasured": "required AND status = 'unmeasured'", "different_unintended": "status = 'different' AND NOT intended", "intended_unchanged": "intended AND status = 'same' AND value > 95", "no_rows": "false"}
    out = gate(verdicts(spark, d), rules, "row_id")
    return out.withColumn("failing", F.md5("failing"))


@query("a31_registry_audit", """WITH k AS (SELECT p_partkey AS key, p_size > 3 AS measured FROM part), l AS (SELECT DISTINCT l_partkey AS key, l_returnflag AS reader FROM lineitem WHERE l_quantity > 25)
SELECT key, measured, count(reader) AS n_readers, count(reader) = 0 AS without_reader, coalesce(string_agg(reader, ',' ORDER BY reader), '') AS readers FROM k LEFT JOIN l USING (key) GROUP BY 1, 2""")
def a31(spark, d):
    keys = read(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") > 3).alias("measured"))
    links = read(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("reader")).distinct()
    return keys.join(links, "key", "left").groupBy("key", "measured").agg(F.count("reader").alias("n_readers"), (F.count("reader") == 0).alias("without_reader"), F.array_join(F.sort_array(F.collect_list("reader")), ",").alias("readers"))


@query("a32_group_conversion", f"""WITH x AS (SELECT nullif(l_returnflag, 'N') AS g, l_quantity AS v FROM lineitem), t AS ({dist_sql("x", "v", "g")}),
c AS (SELECT x.g, x.v - coalesce(t.p50, (SELECT p50 FROM t WHERE grp IS NULL), 0) AS w FROM x LEFT JOIN t ON x.g = t.grp) {dist_sql("c", "w", "g")}""")
def a32(spark, d):
    x = read(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("g"), F.col("l_quantity").alias("v"))
    t = S.pstats_by_group(x, "v", "g")
    overall = t.where("grp IS NULL").select(F.col("p50").alias("all50"))
    c = x.join(S.small(t.where("grp IS NOT NULL").select(F.col("grp").alias("g"), "p50")), "g", "left").crossJoin(F.broadcast(overall))
    return S.pstats_by_group(c.withColumn("w", F.col("v") - F.coalesce("p50", "all50", F.lit(0.0))), "w", "g")


@query("a33_modal_tuple", """WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS k, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), m AS (SELECT s, p FROM c ORDER BY k DESC, f LIMIT 1)
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90
FROM orders JOIN m ON o_orderstatus = s AND o_orderpriority = p GROUP BY 1, 2""")
def a33(spark, d):
    o = read(spark, d, "orders")
    top = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("k"), F.min("o_orderkey").alias("f")).orderBy(F.desc("k"), "f").limit(1)
    return S.pstats(o.join(F.broadcast(top), ["o_orderstatus", "o_orderpriority"], "left_semi"), "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("a34_majority", """SELECT lang AS grp, count(*) AS n, sum(toxic) > sum(1 - toxic) AS majority FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def a34(spark, d):
    return S.majority(read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "toxic", "lang")


A35 = f"""{E}, v AS (SELECT DISTINCT video_id, format_id FROM e), k AS (SELECT DISTINCT type FROM e WHERE value > 250), c AS (SELECT video_id, type, count(*) AS n FROM e WHERE value > 60 GROUP BY 1, 2),
z AS (SELECT v.video_id, v.format_id, k.type, coalesce(c.n, 0) AS n FROM v CROSS JOIN k LEFT JOIN c USING (video_id, type))"""


def counts_with_zeros(spark, d):
    e = events(spark, d)
    c = e.where("value > 60").groupBy("video_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return S.with_zeros(c, e, e.where("value > 250"), "video_id", "type", "n").join(e.select("video_id", "format_id").distinct(), "video_id")


@query("a35_type_stats", f"""WITH {A35} SELECT type, grp, n, round(p[1], 6) AS p10, round(p[2], 6) AS p50, round(p[3], 6) AS p90, n_used FROM (SELECT type, format_id AS grp, count(*) AS n, quantile_cont(n::DOUBLE, [0.1, 0.5, 0.9]) AS p, count(*) FILTER (n > 0) AS n_used
FROM z GROUP BY GROUPING SETS ((type), (type, format_id)))""")
def a35(spark, d):
    z = counts_with_zeros(spark, d)
    used = z.withColumn("u", F.when(F.col("n") > 0, 1)).rollup("type", "format_id").agg(F.grouping("type").alias("gt"), F.count("u").alias("n_used")).where("gt = 0").select("type", F.col("format_id").alias("grp"), "n_used")
    dist = S.pstats_by_group(z, "n", "format_id", "type")
    return dist.join(used, (dist["type"] == used["type"]) & dist["grp"].eqNullSafe(used["grp"])).drop(used["type"], used["grp"])


@query("a36_column_status", f"""WITH {E} SELECT type, count(*) AS n, count(v) AS n_known, CASE WHEN count(*) = count(v) THEN 'measured' WHEN count(v) > 0 THEN 'partial' ELSE 'unmeasured' END AS column_status
FROM (SELECT type, CASE WHEN type = 'view' OR (type <> 'error' AND value < 100) THEN value END AS v FROM e) GROUP BY 1""")
def a36(spark, d):
    v = F.when((F.col("type") == "view") | ((F.col("type") != "error") & (F.col("value") < 100)), F.col("value"))
    return S.completeness(events(spark, d).withColumn("v", v), "v", "type")


@query("a37_entity_totals", f"WITH {E}, s AS (SELECT video_id, format_id, sum(CASE WHEN type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS n FROM e GROUP BY 1, 2) {dist_sql('s', 'n', 'format_id')}")
def a37(spark, d):
    n = F.sum(F.when(F.col("type").isin("click", "purchase"), 1).otherwise(0))
    return S.pstats_by_group(events(spark, d).groupBy("video_id", "format_id").agg(n.alias("n")), "n", "format_id")


@query("a38_count_range", f"""WITH {A35}, r AS (SELECT type, floor(quantile_cont(n::DOUBLE, 0.1)) AS lo, ceil(quantile_cont(n::DOUBLE, 0.9)) AS hi FROM z WHERE video_id % 2 = 0 GROUP BY 1)
SELECT z.video_id, z.type, z.n, CASE WHEN r.lo IS NULL THEN 'unmeasured' WHEN z.n BETWEEN r.lo AND r.hi THEN 'in_range' WHEN EXISTS (SELECT 1 FROM z o WHERE o.video_id % 2 = 0 AND o.type = z.type AND o.n = z.n) THEN 'observed' ELSE 'outside' END AS verdict
FROM z LEFT JOIN r USING (type) WHERE z.video_id % 2 = 1""")
def a38(spark, d):
    from ..operators.qa import count_range_verdict

    z = counts_with_zeros(spark, d).select("video_id", "type", "n")
    return count_range_verdict(z.where("video_id % 2 = 1"), z.where("video_id % 2 = 0"), "type", "n")


@query("a39_reconcile", f"""WITH x AS ({dist_sql("(SELECT l_returnflag AS g, l_quantity AS v FROM lineitem)", "v", "g")}), y AS ({dist_sql("(SELECT l_returnflag AS g, l_quantity + CASE WHEN l_returnflag = 'A' THEN 0.5 ELSE 0 END AS v FROM lineitem)", "v", "g")})
SELECT x.grp, abs(x.p10 - y.p10) <= 1e-3 AND abs(x.p50 - y.p50) <= 1e-3 AND abs(x.p90 - y.p90) <= 1e-3 AND x.n = y.n AS agrees FROM x JOIN y ON x.grp IS NOT DISTINCT FROM y.grp""")
def a39(spark, d):
    from ..operators.qa import reconcile

    li = read(spark, d, "lineitem")
    stored = S.pstats_by_group(li.withColumn("v", F.col("l_quantity") + F.when(F.col("l_returnflag") == "A", 0.5).otherwise(0.0)), "v", "l_returnflag")
    return reconcile(S.pstats_by_group(li, "l_quantity", "l_returnflag"), stored)


@query("a40_manual_items", """WITH l AS (SELECT doc_id, 'quality' AS key, quality AS v, 'manual' AS origin FROM labels UNION ALL SELECT doc_id, 'quality', CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, 'auto' FROM documents
UNION ALL SELECT doc_id, 'length', n_chars, 'auto' FROM documents),
u AS (SELECT * FROM l WHERE origin = 'manual' OR NOT EXISTS (SELECT 1 FROM labels m WHERE m.doc_id = l.doc_id AND l.key = 'quality'))
SELECT key, count(*) AS n, count(*) FILTER (origin = 'manual') AS n_manual, CASE WHEN key = 'length' THEN round(quantile_cont(v::DOUBLE, 0.5), 6) END AS number, CASE WHEN key = 'quality' THEN sum(v) > sum(1 - v) END AS flag FROM u GROUP BY 1""")
def a40(spark, d):
    from ..operators.layers import manual_first

    docs = read(spark, d, "documents")
    auto = docs.select("doc_id", F.lit("quality").alias("key"), F.when(F.col("n_chars") > 500, 1).otherwise(0).cast("long").alias("v")).unionByName(docs.select("doc_id", F.lit("length").alias("key"), F.col("n_chars").alias("v")))
    manual = read(spark, d, "labels").select("doc_id", F.lit("quality").alias("key"), F.col("quality").cast("long").alias("v"))
    u = manual_first(manual, auto, ["doc_id", "key"])
    number, flag = S.rounded(F.percentile("v", 0.5)), F.sum("v") > F.sum(1 - F.col("v"))
    return u.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("origin") == "manual", 1)).alias("n_manual"), F.when(F.col("key") == "length", number).alias("number"), F.when(F.col("key") == "quality", flag).alias("flag"))


@query("a41_canvas_mode", """WITH c AS (SELECT p_type, p_size, count(*) AS k, min(p_partkey) AS f FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1, 2)
SELECT p_type, arg_max(p_size, {'k': k, 'f': -f}) AS mode, sum(k)::BIGINT AS n, (SELECT count(*) FROM part q WHERE q.p_type = c.p_type AND q.p_partkey % 5 = 0) AS n_censored FROM c GROUP BY 1""")
def a41(spark, d):
    p = read(spark, d, "part").withColumn("censored", F.col("p_partkey") % 5 == 0)
    out = S.categorical(p.where("NOT censored"), "p_size", "p_partkey", "p_type").select("p_type", "mode", "n")
    return out.join(p.groupBy("p_type").agg(F.count(F.when(F.col("censored"), 1)).alias("n_censored")), "p_type")


@query("a42_repeat_use", f"""WITH {E}, p AS (SELECT type, max(value) > 340 AS present FROM e GROUP BY 1), u AS (SELECT video_id, type, bool_or(value > 200) AS used FROM e GROUP BY 1, 2)
SELECT u.video_id, u.type, u.used, p.present, CASE WHEN u.used AND NOT p.present THEN 'not allowed' WHEN NOT u.used AND p.present THEN 'unused' ELSE 'ok' END AS verdict FROM u JOIN p USING (type)""")
def a42(spark, d):
    e = events(spark, d)
    policy = e.groupBy("type").agg((F.max("value") > 340).alias("present"))
    return U.use_verdict(e.groupBy("video_id", "type").agg(F.bool_or(F.col("value") > 200).alias("used")), policy, "type")