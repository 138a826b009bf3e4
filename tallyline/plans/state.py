"""Queries of keyed state and of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import scoring as C
from ..operators import state as M
from ..operators import rollups as U
from ..operators import stats as S
from .base import E, events, read, timestamp

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def versions(spark, d):
    """Customers as the state, their orders as what arrives; tags and history as arrays."""
    k = F.col("c_custkey")
    old = read(spark, d, "customer").where(k % 3 != 0).select(
        k.alias("id"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.col("c_acctbal")).alias("views"), F.array().cast("array<double>").alias("history"), F.array("c_mktsegment").alias("tags"), F.lit(100).cast("long").alias("first_seen"),
    )
    o = F.col("o_orderkey")
    new = read(spark, d, "orders").where(o % 4 == 0).select(
        F.col("o_custkey").alias("id"), o.alias("pos"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("t"), o.cast("string"))).alias("title"), F.when(o % 5 != 0, F.col("o_totalprice")).alias("views"), F.array("o_orderpriority").alias("tags"), (o % 200).alias("seen"),
    )
    return old, new


M1 = """old AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS views, c_mktsegment AS tag FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT o_custkey AS id, max(o_orderkey) AS pos, list(DISTINCT o_orderpriority) AS tags FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1),
n AS (SELECT new.*, CASE WHEN pos % 3 = 0 THEN '' ELSE 't' || pos END AS title, CASE WHEN pos % 5 <> 0 THEN o_totalprice END AS views, pos % 200 AS seen FROM new JOIN orders ON o_orderkey = pos),
u AS (SELECT coalesce(old.id, n.id) AS id, coalesce(nullif(n.title, ''), old.title) AS title, coalesce(n.views, old.views) AS views, CASE WHEN n.views IS NOT NULL AND old.views IS NOT NULL AND n.views <> old.views THEN old.views END AS past,
list_sort(list_distinct(list_concat(CASE WHEN old.id IS NULL THEN [] ELSE [tag] END, coalesce(tags, [])))) AS tags, least(CASE WHEN old.id IS NOT NULL THEN 100 END, seen) AS first_seen, CASE WHEN old.id IS NULL THEN 'new' WHEN n.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS origin FROM old FULL JOIN n ON old.id = n.id)"""


@query("m1_upsert", f"WITH {M1} SELECT id, title, views, past, array_to_string(tags, ',') AS tags, first_seen, origin FROM u")
def m1(spark, d):
    out = M.upsert(*versions(spark, d), keys=["id"], pos="pos", fields=["title"], metric="views")
    return out.select("id", "title", "views", F.try_element_at("history", F.lit(1)).alias("past"), F.array_join("tags", ",").alias("tags"), "first_seen", "origin")


@query("m2_complete_snapshot", """WITH s AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate <= TIMESTAMP '1999-06-01'), r AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 AND o_orderdate <= TIMESTAMP '1999-06-01'),
a AS (SELECT *, 'snapshot' AS origin FROM s UNION ALL SELECT *, 'recovered' FROM r) SELECT o_orderkey, origin, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM a QUALIFY rank <= 100""")
def m2(spark, d):
    from ..operators.windows import latest_n

    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    at = F.lit("1999-06-01").cast("timestamp_ntz")
    snap = o.where((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderdate") <= at)).withColumn("origin", F.lit("snapshot"))
    recovered = o.where((F.col("o_orderkey") % 2 == 1) & (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderdate") <= at)).withColumn("origin", F.lit("recovered"))
    return latest_n(snap.unionByName(recovered), "o_orderdate", "o_orderkey", 100).select("o_orderkey", "origin", "rank")


@query("m3_stable_and_volatile", """SELECT a.o_orderkey, a.o_orderpriority AS title, coalesce(b.o_totalprice + 1, a.o_totalprice) AS views FROM orders a LEFT JOIN orders b ON a.o_orderkey = b.o_orderkey AND b.o_orderkey % 3 = 0 WHERE a.o_orderkey % 2 = 0""")
def m3(spark, d):
    o = read(spark, d, "orders")
    newest = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("fresh"))
    return o.where("o_orderkey % 2 = 0").join(newest, "o_orderkey", "left").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.coalesce("fresh", "o_totalprice").alias("views"))


@query("m4_defect_lifecycle", f"""WITH {E}, s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'fix_submitted' WHEN 2 THEN 'fixed' WHEN 3 THEN 'resolved_without_fix' ELSE 'reopened' END AS st FROM e WHERE event_id % 3 = 0), r AS (SELECT event_id, value > 20 AS failing FROM e WHERE event_id % 4 <> 1),
j AS (SELECT coalesce(s.event_id, r.event_id) AS event_id, st, CASE WHEN st IS NULL THEN CASE WHEN failing THEN 'open' END WHEN failing IS NULL THEN 'superseded' WHEN st = 'fix_submitted' THEN CASE WHEN failing THEN 'reopened' ELSE 'fixed' END
WHEN st IN ('open', 'reopened') AND NOT failing THEN 'resolved_without_fix' WHEN st IN ('fixed', 'resolved_without_fix') AND failing THEN 'reopened' ELSE st END AS af FROM s FULL JOIN r ON s.event_id = r.event_id)
SELECT event_id, af AS status, CASE WHEN st IS NULL THEN af WHEN st = af THEN st ELSE st || '>' || af END AS history FROM j WHERE af IS NOT NULL""")
def m4(spark, d):
    e = events(spark, d)
    k = F.col("event_id") % 5
    status = F.when(k == 0, "open").when(k == 1, "fix_submitted").when(k == 2, "fixed").when(k == 3, "resolved_without_fix").otherwise("reopened")
    state = e.where("event_id % 3 = 0").select("event_id", status.alias("status")).withColumn("history", F.array("status"))
    out = M.lifecycle(state, e.where("event_id % 4 <> 1").select("event_id", (F.col("value") > 20).alias("failing")), "event_id")
    return out.withColumn("history", F.array_join("history", ">"))


@query("m5_guarded_status", """WITH w AS (SELECT o_orderkey, o_orderstatus AS st, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS wanted, o_totalprice FROM orders),
r AS (SELECT *, CASE WHEN NOT ((st = 'O' AND wanted IN ('P', 'F')) OR (st = 'P' AND wanted = 'F')) THEN st || ' to ' || wanted || ' is not allowed' WHEN wanted = 'F' AND o_totalprice < 100000 THEN 'no review' END AS reason FROM w)
SELECT o_orderkey, CASE WHEN reason IS NULL THEN wanted ELSE st END AS after, reason FROM r""")
def m5(spark, d):
    k = F.col("o_orderkey") % 3
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(k == 0, "F").when(k == 1, "O").otherwise("P").alias("wanted"), "o_totalprice")
    allowed = spark.createDataFrame([("O", "P"), ("O", "F"), ("P", "F")], "from string, to string")
    return M.guarded(rows, "status", "wanted", allowed, [((F.col("wanted") == "F") & (F.col("o_totalprice") < 100000), "no review")]).select("o_orderkey", "after", "reason")


@query("m7_manual_beside_platform", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 10) * 10 END) AS views, CASE WHEN o_orderkey % 3 = 0 THEN 'platform' WHEN o_orderkey % 2 = 0 THEN 'manual' END AS origin FROM orders""")
def m7(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    platform, manual = F.when(k % 3 == 0, p), F.when(k % 2 == 0, F.round(p / 10) * 10)
    return read(spark, d, "orders").select(k, F.coalesce(platform, manual).alias("views"), F.when(platform.isNotNull(), "platform").when(manual.isNotNull(), "manual").alias("origin"))


@query("m8_staleness", """WITH n AS (SELECT o_custkey AS k, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS now, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) FILTER (o_orderkey % 17 <> 0)) AS then_ FROM orders GROUP BY 1)
SELECT k, CASE WHEN then_ IS NULL THEN 'never approved' WHEN now = then_ THEN 'approved' ELSE 'stale' END AS state FROM n""")
def m8(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return U.staleness(o, o.where("o_orderkey % 17 <> 0"), "k", lambda rows: U.signature(rows, "k", "o_orderkey", "o_orderstatus"))


@query("m9_pair_links", """WITH l AS (SELECT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_linenumber = 1), p AS (SELECT a, b FROM l UNION SELECT b, a FROM l) SELECT a, b FROM p WHERE a <> b AND a NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500) AND b NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500)""")
def m9(spark, d):
    links = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("p"), (F.col("l_partkey") % 100).alias("q"))
    return M.link_pairs(links, "p", "q", read(spark, d, "supplier").where("s_acctbal < 500"), "s_suppkey")


CHECKED = "TIMESTAMP '2001-08-01'"


def checked():
    return F.lit("2001-08-01").cast("timestamp")


@query("x1_recency", f"""WITH o AS (SELECT o_orderkey, greatest((epoch_us({CHECKED}) - epoch_us(CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL (o_orderkey % 3) DAY END)) / 86.4e9, CASE WHEN o_orderkey % 9 <> 0 THEN 0 END) AS age FROM orders)
SELECT o_orderkey, round(age, 6) AS age_days, CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 30 THEN 'recent' ELSE 'old' END AS label, round(CASE WHEN age IS NOT NULL THEN greatest(0, 1 - age / 90) END, 6) AS score FROM o""")
def x1(spark, d):
    at = F.when(F.col("o_orderkey") % 9 != 0, timestamp("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 3).cast("int")))
    age, label, score = X.recency(at, checked())
    return read(spark, d, "orders").select("o_orderkey", S.rounded(age).alias("age_days"), label.alias("label"), S.rounded(score).alias("score"))


X2 = f"""x AS (SELECT o_orderkey, date_diff('day', o_orderdate, {CHECKED}) <= 400 AS recent, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS ans, CASE WHEN o_orderkey % 5 = 0 THEN 'someone' END AS rep, CASE WHEN o_orderkey % 7 = 0 THEN 'https://o' END AS ou,
CASE WHEN o_orderkey % 11 = 0 THEN 'old' END AS ol FROM orders), y AS (SELECT *, CASE WHEN ans = 'no' THEN 'repost' WHEN ans = 'yes' AND rep IS NULL THEN 'confirmed_original' WHEN rep IS NOT NULL OR ou IS NOT NULL THEN 'repost' ELSE 'unconfirmed' END AS state FROM x)"""


@query("x2_repost_recency", f"""WITH {X2} SELECT o_orderkey, state, coalesce(ol, CASE WHEN state = 'repost' AND recent THEN 'unknown' WHEN state = 'unconfirmed' AND recent THEN 'unknown' WHEN recent THEN 'recent' ELSE 'old' END) AS label FROM y""")
def x2(spark, d):
    k = F.col("o_orderkey")
    state = C.originality(F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no"), F.when(k % 5 == 0, "someone"), F.when(k % 7 == 0, "https://o"), F.lit("https://u"))
    _, label, _ = X.recency(timestamp("o_orderdate"), checked(), 400.0)
    return read(spark, d, "orders").select(k, state.alias("state"), C.repost_aware(label, state, F.when(k % 11 == 0, "old")).alias("label"))


@query("x3_repost_evidence", """WITH u AS (SELECT doc_id, 'ocr' AS origin, '@' || source AS handle FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'overlay', '@' || upper(source) || '.' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'review', '@r' || (doc_id % 7) FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, regexp_replace(lower(handle), '[^0-9a-z]', '', 'g') AS account, string_agg(DISTINCT origin, ',' ORDER BY origin) AS sources, count(*) AS n FROM u GROUP BY 1, 2""")
def x3(spark, d):
    docs = read(spark, d, "documents")
    account = lambda handle: F.regexp_replace(F.lower(handle), "[^0-9a-z]", "").alias("account")
    part = lambda m, handle: docs.where(F.col("doc_id") % m == 0).select("doc_id", account(F.concat(F.lit("@"), handle)))
    return U.with_origins({"ocr": part(2, F.col("source")), "overlay": part(3, F.concat(F.upper("source"), F.lit("."))), "review": part(5, F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string")))}, "doc_id", "account", name="sources")


@query("x4_effective_metric", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 5 = 0 THEN c_custkey * 1.0::DOUBLE END AS views, CASE WHEN c_custkey % 3 = 0 THEN 'platform_metadata' WHEN c_custkey % 5 = 0 THEN 'manual_observation' END AS source FROM customer""")
def x4(spark, d):
    k = F.col("c_custkey")
    platform = F.when(k % 3 == 0, F.struct(F.col("c_acctbal").alias("v"), F.lit("platform_metadata").alias("s")))
    manual = F.when(k % 5 == 0, F.struct(k.cast("double").alias("v"), F.lit("manual_observation").alias("s")))
    best = F.coalesce(platform, manual)
    return read(spark, d, "customer").select(k, best["v"].alias("views"), best["s"].alias("source"))


@query("x5_quality_score", """SELECT p_partkey, round((least(1, p_size * 30 / 1080) + least(1, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 30000 END / 0.05) + least(1, p_partkey % 200 / 150)) / 3 * CASE WHEN p_partkey % 3 = 0 THEN 0.7 ELSE 1 END, 6) AS quality FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 4 = 0""")
def x5(spark, d):
    k = F.col("p_partkey")
    q = C.quality(F.col("p_size") * 30, F.when(k % 4 != 0, F.col("p_retailprice") / 30000), k % 200, F.when(k % 3 == 0, "present"))
    return read(spark, d, "part").select(k, S.rounded(q).alias("quality"))


X6 = """p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 10) / 10.0::DOUBLE END AS recency, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 5) / 4.0::DOUBLE END AS intensity, (c_custkey % 3) / 4.0::DOUBLE AS reversal, CASE WHEN c_custkey % 11 <> 0 THEN 0.5::DOUBLE END AS quality, (c_custkey % 4) / 4.0::DOUBLE AS format_fit FROM customer)"""


def parts():
    k = F.col("c_custkey")
    return {"recency": F.when(k % 6 != 0, k % 10 / 10.0), "intensity": F.when(k % 7 != 0, k % 5 / 4.0), "reversal": k % 3 / 4.0, "quality": F.when(k % 11 != 0, F.lit(0.5)), "format_fit": k % 4 / 4.0}


@query("x6_weighted_total", f"""WITH {X6} SELECT id, round(recency * 0.2 + intensity * 0.25 + reversal * 0.2 + quality * 0.15 + format_fit * 0.2, 6) AS total, concat_ws(',', CASE WHEN intensity IS NULL THEN 'intensity' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN recency IS NULL THEN 'recency' END) AS unmeasured FROM p""")
def x6(spark, d):
    score, missing = C.total(parts())
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.rounded(score).alias("total"), missing.alias("unmeasured"))


@query("x7_blockers", f"""WITH {X6} SELECT id, concat_ws(',', CASE WHEN id % 13 = 0 THEN 'status' END, CASE WHEN id % 17 = 0 THEN 'overlap' END, CASE WHEN intensity IS NULL THEN 'review' END) AS hard, concat_ws(',', CASE WHEN recency IS NULL THEN 'recency' END, CASE WHEN quality IS NULL THEN 'quality' END) AS soft FROM p""")
def x7(spark, d):
    k, p = F.col("c_custkey"), parts()
    hard = C.names_where({"status": k % 13 == 0, "overlap": k % 17 == 0, "review": p["intensity"].isNull()})
    return read(spark, d, "customer").select(k.alias("id"), hard.alias("hard"), C.names_where({"recency": p["recency"].isNull(), "quality": p["quality"].isNull()}).alias("soft"))


@query("x8_enough_length", f"""WITH {E}, s AS (SELECT video_id, format_id, max(t) AS dur FROM e GROUP BY 1, 2), p AS (SELECT quantile_cont(dur, 0.1) AS p10 FROM s WHERE video_id % 2 = 0) SELECT video_id, dur >= p10 AS enough FROM s, p""")
def x8(spark, d):
    s = events(spark, d).groupBy("video_id").agg(F.max("t").alias("dur"))
    p = s.where("video_id % 2 = 0").agg(F.percentile("dur", 0.1).alias("p10"))
    return s.crossJoin(F.broadcast(p)).select("video_id", (F.col("dur") >= F.col("p10")).alias("enough"))


@query("x9_review_problems", """SELECT doc_id, concat_ws(',', CASE WHEN quality = 0 THEN 'watched_by' END, CASE WHEN doc_id % 4 = 0 THEN 'notes' END, CASE WHEN doc_id % 8 NOT BETWEEN 1 AND 5 THEN 'intensity' END, CASE WHEN toxic = 1 THEN 'watermark' END) AS problems FROM labels""")
def x9(spark, d):
    k = F.col("doc_id")
    problems = C.review_problems(F.when(F.col("quality") == 1, "me"), F.when(k % 4 == 0, "  ").otherwise("seen"), {"intensity": k % 8}, F.when(F.col("toxic") == 1, "maybe"))
    return read(spark, d, "labels").select(k, problems.alias("problems"))


@query("x10_query_table", """WITH q AS (SELECT p_name AS query, 'traced' AS origin FROM part WHERE p_size < 4 UNION ALL SELECT lower(p_type), 'account' FROM part UNION ALL SELECT p_name, 'user' FROM part WHERE p_size = 50) SELECT query, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, count(*) AS n FROM q GROUP BY 1""")
def x10(spark, d):
    p = read(spark, d, "part")
    return U.with_origins({"traced": p.where("p_size < 4").select(F.col("p_name").alias("query")), "account": p.select(F.lower("p_type").alias("query")), "user": p.where("p_size = 50").select(F.col("p_name").alias("query"))}, "query")