"""Queries of noted values, source records, descriptions, sets above a threshold, seen provenance and role styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptions as D
from ..operators import observations as O
from ..operators import records as R
from ..operators import roles as L
from .base import E, events, read, timestamp

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


SPEC = [("shade", "color", None), ("size", "px", None), ("part", "ratio", None), ("blink", "hz", None), ("emoji", "bool", None), ("cover", "enum", ["first_frame", "chosen_frame"])]


def spec(spark):
    return spark.createDataFrame(SPEC, "key string, type string, allowed array<string>")


def pick(values: list[str], at):
    """The value of a list at a place counted from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


ERROR = """CASE WHEN key = 'other' THEN 'unknown key' WHEN s = '' THEN 'empty' WHEN key = 'shade' AND NOT regexp_full_match(s, '#[0-9A-Fa-f]{6}') THEN 'not a color'
WHEN key IN ('size', 'part', 'blink') AND x IS NULL THEN 'not a number' WHEN key IN ('size', 'part', 'blink') AND x < 0 THEN 'not a finite number of at least 0' WHEN key = 'part' AND (x <= 0 OR x > 2) THEN 'ratio outside 0 to 2'
WHEN key = 'emoji' AND lower(s) <> 'yes' THEN 'not yes or no' WHEN key = 'cover' AND s <> 'first_frame' THEN 'not an allowed value' END"""
VALUES = """CASE WHEN ok AND key IN ('size', 'part', 'blink') THEN x END AS number, CASE WHEN ok AND key = 'emoji' THEN true END AS flag, CASE WHEN ok AND key = 'shade' THEN upper(s) WHEN ok AND key = 'cover' THEN s END AS text"""


def noted(id_, whole):
    """(key, value) texts from an id and a whole number: each key meets values of its own and of other types."""
    key = pick(["shade", "size", "part", "blink", "emoji", "cover", "other"], id_ % 7)
    hex_ = F.concat(F.lit("#"), F.lpad(F.hex(id_ % 16777216), 6, "0"))
    value = F.when(id_ % 11 == 0, " ").when(id_ % 5 == 0, hex_).when(id_ % 5 == 1, F.concat((whole % 4).cast("string"), F.lit(",5"))).when(id_ % 5 == 2, " Yes ").when(id_ % 5 == 3, "first_frame").otherwise("-3")
    return key.alias("key"), value.alias("value")


def noted_sql(id_: str, whole: str) -> str:
    return f"""['shade', 'size', 'part', 'blink', 'emoji', 'cover', 'other'][{id_} % 7 + 1] AS key, trim(CASE WHEN {id_} % 11 = 0 THEN ' ' WHEN {id_} % 5 = 0 THEN '#' || lpad(hex({id_} % 16777216), 6, '0')
WHEN {id_} % 5 = 1 THEN ({whole}) % 4 || ',5' WHEN {id_} % 5 = 2 THEN ' Yes ' WHEN {id_} % 5 = 3 THEN 'first_frame' ELSE '-3' END) AS s"""


@query("p12_observed_values", f"""WITH r AS (SELECT event_id, {noted_sql("event_id", "floor(value)::BIGINT")} FROM events), n AS (SELECT *, try_cast(replace(s, ',', '.') AS DOUBLE) AS x FROM r), z AS (SELECT *, {ERROR} AS error FROM n),
o AS (SELECT *, error IS NULL AS ok FROM z) SELECT event_id, {VALUES}, error FROM o""")
def p12(spark, d):
    rows = read(spark, d, "events").select("event_id", *noted(F.col("event_id"), F.floor("value")))
    return O.typed_values(rows, spec(spark)).select("event_id", "number", "flag", "text", "error")


@query("p13_admitted_rows", f"""WITH r AS (SELECT doc_id, doc_id % 50 AS moment, {noted_sql("doc_id", "n_chars")}, doc_id % 13 = 0 AS unwatched, doc_id % 17 = 0 AS unsigned, doc_id % 19 = 0 AS timeless, n_chars FROM documents), n AS (SELECT *, try_cast(replace(s, ',', '.') AS DOUBLE) AS x FROM r),
z AS (SELECT *, {ERROR} AS error FROM n), b AS (SELECT doc_id AS id, min(toxic) AS toxic FROM labels WHERE doc_id % 3 <> 0 GROUP BY 1),
q AS (SELECT z.*, CASE WHEN unwatched THEN 'not watched' WHEN unsigned THEN 'no observer' WHEN key = 'other' THEN 'unknown key' WHEN id IS NULL AND n_chars > 500 THEN 'for reference only' WHEN id IS NULL THEN 'not in the basis' WHEN toxic = 1 THEN 'long form' WHEN timeless THEN 'no time' ELSE error END AS reason FROM z LEFT JOIN b ON z.doc_id = b.id),
o AS (SELECT *, reason IS NULL AS ok FROM q) SELECT doc_id, CASE WHEN ok THEN moment::DOUBLE END AS t, {VALUES}, reason FROM o""")
def p13(spark, d):
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    rows = docs.select(
        "doc_id", F.when(k % 19 == 0, "soon").otherwise((k % 50).cast("string")).alias("t"), *noted(k, F.col("n_chars")), F.when(k % 17 == 0, "  ").otherwise("me").alias("observed_by"), F.when(k % 13 == 0, "seen").otherwise("Yes").alias("watched"),
    )
    basis = read(spark, d, "labels").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("toxic") == 1, "video").otherwise("short").alias("kind"))
    return O.admit(rows, spec(spark), basis, docs.where("n_chars > 500"), "doc_id").select("doc_id", "t", "number", "flag", "text", "reason")


@query("p1_source_record", """WITH i AS (SELECT *, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'video' AS platform, k::VARCHAR AS platform_id, CASE WHEN k % 3 = 0 THEN 'https://v/' || k ELSE 'https://o/' || k END AS url, CASE WHEN k % 5 = 0 THEN 'full ' || k ELSE o_orderpriority END AS title, CASE WHEN k % 7 > 0 THEN nullif(left(repeat(c_name || ' ', k % 400), 4000), '') END AS description,
coalesce(CASE WHEN k % 3 = 0 THEN c_name END, c_mktsegment) AS uploader, c_custkey::VARCHAR AS uploader_id, NULL::VARCHAR AS uploader_url, CASE WHEN k % 6 = 0 THEN k WHEN k % 4 > 0 THEN floor(o_totalprice)::BIGINT END AS views,
CASE WHEN k % 6 = 0 OR k % 4 > 0 THEN 'platform_metadata' ELSE 'unavailable' END AS views_source, CASE WHEN k % 6 = 0 THEN 'play_count' WHEN k % 4 > 0 THEN 'view_count' END AS views_field, k * 2 AS likes, NULL::BIGINT AS comments,
CASE WHEN k % 4 = 1 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%S+00:00') WHEN k % 4 = 2 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') END AS published_at, CASE WHEN k % 4 = 1 THEN 'timestamp' WHEN k % 4 = 2 THEN 'upload_date' END AS published_at_source, (k % 90)::DOUBLE AS duration,
CASE WHEN k % 2 = 0 THEN 720 WHEN k % 3 > 0 OR k % 5 > 0 THEN CASE WHEN k % 3 >= k % 5 THEN 100 ELSE 200 END END AS width, CASE WHEN k % 2 = 0 THEN 1280 WHEN k % 3 > 0 OR k % 5 > 0 THEN greatest(k % 3, k % 5) END AS height, o_orderpriority AS tags FROM i""")
def p1(spark, d):
    k = F.col("o_orderkey")
    count = lambda n: n.cast("long")
    infos = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("https://v/"), k)).otherwise("").alias("webpage_url"), F.concat(F.lit("https://o/"), k).alias("original_url"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit("full "), k).alias("fulltitle"), F.when(k % 7 > 0, F.repeat(F.concat("c_name", F.lit(" ")), (k % 400).cast("int"))).alias("description"), F.when(k % 3 == 0, F.col("c_name")).alias("uploader"), F.col("c_mktsegment").alias("channel"),
        F.col("c_custkey").alias("channel_id"), F.when(k % 6 == 0, k.cast("string")).otherwise("n/a").alias("play_count"), F.when(k % 4 > 0, F.floor("o_totalprice")).alias("view_count"), (k * 2).alias("like_count"),
        F.when(k % 4 == 1, F.unix_seconds(timestamp("o_orderdate"))).alias("timestamp"), F.when(k % 4 == 2, F.date_format("o_orderdate", "yyyyMMdd")).alias("upload_date"), (k % 90).alias("duration"),
        F.when(k % 2 == 0, 720).alias("width"), F.when(k % 2 == 0, 1280).otherwise(0).alias("height"),
        F.array(*[F.struct(F.lit(w).alias("width"), count(h).alias("height")) for w, h in ((100, k % 3), (200, k % 5))]).alias("formats"), F.array("o_orderpriority").alias("tags"),
    )
    out = R.common_record(infos, "video", ("play_count", "view_count"))
    return out.withColumn("tags", F.array_join("tags", ","))


LINES = """p AS (SELECT page_id AS i, page_id % 4 AS r FROM pages),
x AS (SELECT i, 0 AS line, 'url' AS kind, 'tiktok' AS platform, '@maker' || i AS value, 'https://www.tiktok.com/@maker' || i || '/video/' || i AS url, true AS credit FROM p
UNION ALL SELECT i, 0, 'account_url', 'tiktok', '@maker' || i, 'https://www.tiktok.com/@maker' || i, true FROM p UNION ALL SELECT i, 0, 'credit_line', NULL, 'Source: https://www.tiktok.com/@maker' || i || '/video/' || i || '.', NULL, true FROM p
UNION ALL SELECT i, 1, 'account_handle', 'instagram', '@pal.' || i, NULL, false FROM p WHERE r = 0 UNION ALL SELECT i, 1, 'account_reddit', 'reddit', 'r/sub' || i, NULL, false FROM p UNION ALL SELECT i, 1, 'hashtag', NULL, 'tag' || i, NULL, false FROM p
UNION ALL SELECT i, 3, 'url', 'youtube', NULL, 'https://youtu.be/abc', true FROM p WHERE r = 1 UNION ALL SELECT i, 3, 'account_credit', 'unknown', '@cam' || i, NULL, true FROM p WHERE r = 1 UNION ALL SELECT i, 3, 'credit_line', NULL, 'via https://youtu.be/abc, @cam' || i, NULL, true FROM p WHERE r = 1
UNION ALL SELECT i, 3, 'url', 'youtube', 'channel/UC' || i, 'https://m.youtube.com/channel/UC' || i || '/videos?x=1', false FROM p WHERE r = 2 UNION ALL SELECT i, 3, 'account_url', 'youtube', 'channel/UC' || i, 'https://m.youtube.com/channel/UC' || i, false FROM p WHERE r = 2
UNION ALL SELECT i, 3, 'url', 'example.org', NULL, 'https://example.org/a' || i, false FROM p WHERE r = 3 UNION ALL SELECT i, 3, 'url', 'x', '@ours' || i, 'http://x.com/ours' || i, false FROM p WHERE r = 3)"""


@query("p10_described_accounts", f"WITH {LINES} SELECT i AS page_id, line::BIGINT AS line, kind, platform, value, url, credit FROM x")
def p10(spark, d):
    i = F.col("page_id").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    r = F.col("page_id") % 4
    last = F.when(r == 1, c("via https://youtu.be/abc, @cam", i)).when(r == 2, c("see https://m.youtube.com/channel/UC", i, "/videos?x=1")).when(r == 3, c("https://example.org/a", i, " (http://x.com/ours", i, ") @OURS.", i)).otherwise("")
    text = c("  Source: https://www.tiktok.com/@maker", i, "/video/", i, ".\r\n", "insta ", F.when(r == 0, c("@pal.", i)).otherwise("a@pal"), " r/sub", i, " #tag", i, " #the #ours", i, "\n\n", last)
    return D.read_descriptions(read(spark, d, "pages").select("page_id", text.alias("text")), "page_id", "text", ["ours"])


@query("a27_high_sets", """WITH i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 > 0 THEN floor(o_totalprice) END AS n, ['video_metadata', 'latest100_snapshot', 'listing'][o_orderkey % 3 + 1] AS src, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice / 50000) * 50000 END AS approx FROM orders),
s AS (SELECT *, CASE WHEN src <> 'listing' AND n >= 300000 THEN 'above' WHEN src = 'video_metadata' OR approx < 0.9 * 300000 THEN 'below' ELSE 'unverified' END AS state FROM i)
SELECT k AS o_orderkey, state, approx, CASE WHEN state = 'unverified' THEN CASE WHEN k % 5 = 0 THEN 'failed: late ' || k WHEN k % 7 = 0 THEN 'not asked' WHEN approx IS NOT NULL THEN 'only a rounded count' ELSE 'no count' END END AS reason FROM s""")
def a27(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    items = o.select(k, F.when(k % 9 > 0, F.floor("o_totalprice")).alias("count"), pick(["video_metadata", "latest100_snapshot", "listing"], k % 3).alias("source"))
    listing = o.where(k % 4 > 0).select(k, (F.round(F.col("o_totalprice") / 50000) * 50000).alias("approx"))
    failed = o.where(k % 5 == 0).select(k, F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.concat(F.lit(f"{w} "), k.cast("string")).alias("error")) for p, w in ((2, "late"), (1, "early"))])).alias("f")).select("o_orderkey", "f.*")
    return R.threshold_sets(items, listing, failed, o.where(k % 7 == 0), "o_orderkey", 300000)


SEEN = """o AS (SELECT o_custkey AS c, o_orderkey AS p, CASE WHEN o_orderkey % 6 > 0 THEN 'me' || o_orderkey % 3 END AS who, CASE o_orderkey % 5 WHEN 0 THEN 'Customer ' || o_custkey WHEN 1 THEN 'other' || o_orderkey % 2 END AS up, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' WHEN o_orderkey % 7 < 3 THEN strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') END AS day,
CASE WHEN o_orderkey % 4 = 0 THEN 'https://o/' || o_orderkey END AS url, CASE WHEN o_orderkey % 11 = 0 THEN '2020-01-01' END AS oday, CASE WHEN o_orderkey % 9 = 0 THEN 'author ' || o_orderkey END AS author, CASE WHEN o_orderkey % 8 < 3 THEN o_orderkey - 40 END AS views, CASE WHEN o_orderkey % 8 < 2 THEN '2024-05-01' END AS seen FROM orders),
u AS (SELECT * FROM o WHERE coalesce(up, day, url, oday, author, views::VARCHAR, seen) IS NOT NULL AND who IS NOT NULL AND coalesce(day, '') <> 'soon' AND (views IS NULL) = (seen IS NULL) AND coalesce(views, 0) >= 0),
r AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 > 0 THEN 'customer-' || c_custkey END AS up, CASE WHEN c_custkey % 3 = 2 THEN 'url_path' END AS src, CASE WHEN c_custkey % 2 = 0 THEN '2019-01-01' END AS day, CASE WHEN c_custkey % 2 = 0 THEN 'timestamp' END AS dsrc, CASE WHEN c_custkey % 5 = 0 THEN 'https://r/' || c_custkey END AS url FROM customer),
b AS (SELECT r.*, CASE WHEN c % 3 = 1 THEN up ELSE coalesce((SELECT arg_min(u.up, u.p) FROM u WHERE u.c = r.c AND u.up IS NOT NULL), up) END AS name, (SELECT max(p) FROM u WHERE u.c = r.c AND author IS NOT NULL) AS ap FROM r),
m AS (SELECT u.*, b.day IS NOT NULL AS dated, ap, regexp_replace(lower(coalesce(u.up, '')), '[^0-9a-z]', '', 'g') = regexp_replace(lower(coalesce(b.name, '')), '[^0-9a-z]', '', 'g') AND u.up IS NOT NULL AS same FROM u JOIN b USING (c)),
f AS (SELECT c, arg_max({'v': up, 's': 'manual_observation:' || who}, p) FILTER (same) AS up, arg_max({'v': day, 's': 'manual_observation:' || who}, p) FILTER (day IS NOT NULL) AS day, arg_max(url, p) FILTER (url IS NOT NULL) AS url, arg_max(oday, p) FILTER (oday IS NOT NULL) AS oday, arg_max(author, p) FILTER (author IS NOT NULL) AS author,
arg_max(url, p) FILTER (url IS NOT NULL AND p <= ap) AS aurl, arg_max({'v': views, 's': seen, 'w': who}, p) FILTER (views IS NOT NULL) AS views, count(*) AS n, count(*) FILTER ((up IS NOT NULL AND NOT same) OR (day IS NOT NULL AND dated)) AS noted FROM m GROUP BY 1)"""


@query("m7_seen_records", f"""WITH {SEEN} SELECT b.c AS c_custkey, coalesce(f.up.v, b.up) AS uploader, coalesce(f.up.s, b.src) AS uploader_source, CASE WHEN b.day IS NULL AND f.day IS NOT NULL THEN f.day.v ELSE b.day END AS published_at, CASE WHEN b.day IS NULL AND f.day IS NOT NULL THEN f.day.s ELSE b.dsrc END AS published_at_source,
coalesce(f.url, b.url) AS original_url, f.oday AS original_published_at, author AS original_author, CASE WHEN author IS NOT NULL THEN coalesce(aurl, b.url) END AS original_author_url, b.c * 10 AS views, f.views.v AS views_manual, f.views.s AS views_checked_at, f.views.w AS views_by, coalesce(n, 0) AS n_seen, coalesce(noted, 0) AS n_noted
FROM b LEFT JOIN f ON b.c = f.c""")
def m7(spark, d):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    records = read(spark, d, "customer").select(
        c, F.when(c % 3 > 0, F.concat(F.lit("customer-"), c)).alias("uploader"), F.when(c % 3 == 2, "url_path").alias("uploader_source"), F.when(c % 2 == 0, "2019-01-01").alias("published_at"), F.when(c % 2 == 0, "timestamp").alias("published_at_source"),
        F.when(c % 5 == 0, F.concat(F.lit("https://r/"), c)).alias("original_url"), none.alias("original_published_at"), (c * 10).alias("views"),
    )
    seen = read(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), k.alias("pos"), F.when(k % 6 > 0, F.concat(F.lit("me"), k % 3)).otherwise(" ").alias("by"), F.when(k % 5 == 0, F.concat(F.lit("Customer "), F.col("o_custkey"))).when(k % 5 == 1, F.concat(F.lit("other"), k % 2)).alias("uploader"),
        F.when(k % 7 == 0, "soon").when(k % 7 < 3, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published_at"), F.when(k % 4 == 0, F.concat(F.lit("https://o/"), k)).otherwise("").alias("original_url"), F.when(k % 11 == 0, "2020-01-01").alias("original_published_at"),
        F.when(k % 9 == 0, F.concat(F.lit("author "), k)).alias("original_author"), F.when(k % 8 < 3, k - 40).alias("views"), F.when(k % 8 < 2, "2024-05-01").alias("views_checked_at"),
    )
    return R.apply_observations(records, seen, "c_custkey")


ITEMS = """i AS (SELECT video_id, event_id AS id, CASE event_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'speaker' WHEN 2 THEN 'reaction' WHEN 3 THEN 'dialogue' END AS role, t AS s, "end" AS e, CASE event_id % 5 WHEN 0 THEN 40 WHEN 1 THEN 300 - w / 2 ELSE event_id % 90 END AS x, CASE WHEN event_id % 5 < 2 THEN 500 ELSE event_id % 600 END AS y, w, CASE WHEN event_id % 2 = 0 THEN 40 ELSE 90 END AS h,
CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n_lines, event_id % 37 AS size, CASE WHEN event_id % 5 = 3 THEN ['left', 'right', 'unmeasured'][event_id % 3 + 1] END AS align, ['visible', 'none', 'faint'][event_id % 3 + 1] AS vis, event_id % 7 AS outline, ['present', 'absent', NULL][event_id % 4 % 3 + 1] AS box, event_id % 10 / 10 AS alpha,
CASE WHEN event_id % 6 = 0 THEN '#fff' END AS hl, event_id % 23 AS chars, ['pop', 'slide_up', 'fade', 'unmeasured'][event_id // 5 % 4 + 1] AS mi, event_id % 9 / 10 AS mid, event_id % 8 / 8 AS scale, event_id % 31 AS off FROM (SELECT *, 80 + event_id % 50 AS w FROM e))"""


def captions(spark, d):
    k = F.col("event_id")
    w = 80 + k % 50
    x = F.when(k % 5 == 0, 40).when(k % 5 == 1, 300 - w / 2).otherwise(k % 90)
    null = F.lit(None).cast("double")
    return events(spark, d).select(
        "video_id", k.alias("id"), F.when(k % 5 < 4, pick(["title", "speaker", "reaction", "dialogue", "-"], k % 5)).alias("role"), F.col("t").alias("start"), "end", x.alias("x"), F.when(k % 5 < 2, 500).otherwise(k % 600).alias("y"), w.alias("w"), F.when(k % 2 == 0, 40).otherwise(90).alias("h"),
        F.when(k % 2 == 0, 1).otherwise(2).alias("n_lines"), (k % 37).alias("size"), (k % 37 / 2).alias("ink_h"), F.when(k % 5 == 3, pick(["left", "right", "unmeasured"], k % 3)).alias("align"), x.alias("left"), (x + w).alias("right"), (x + w / 2).alias("anchor_x"),
        (k % 7).alias("outline"), pick(["visible", "none", "faint"], k % 3).alias("outline_visibility"), null.alias("shadow"), F.nullif(pick(["present", "absent", ""], k % 4 % 3), F.lit("")).alias("box"), (k % 10 / 10).alias("box_alpha"), (k % 4).alias("pad_x"), null.alias("pad_y"),
        null.alias("line_spacing"), null.alias("lead"), (k % 23).alias("chars"), F.when(k % 6 == 0, "#fff").alias("highlight"), pick(["pop", "slide_up", "fade", "unmeasured"], F.floor(k / 5) % 4).alias("motion_in"), (k % 9 / 10).alias("in_dur"), (k % 8 / 8).alias("in_scale"), (k % 31).alias("in_offset"),
        null.alias("in_direction"), F.lit(None).cast("string").alias("motion_out"), null.alias("out_dur"), null.alias("out_direction"), F.concat(F.lit("#"), *[F.lpad(F.hex(k * m % 256), 2, "0") for m in (37, 59, 83)]).alias("color"), F.lit("#102030").alias("box_color"),
    )


def second(*names: str) -> str:
    return f"list_sort([{', '.join(names)}])[2]"


@query("a12_role_styles", f"""WITH {E}, {ITEMS}, j AS (SELECT * FROM i WHERE role IS NOT NULL),
c AS (SELECT video_id, role, 'a' AS what, align AS v, count(*) AS k, min({{'s': s, 'i': id}}) AS first FROM j WHERE align <> 'unmeasured' GROUP BY ALL UNION ALL SELECT video_id, role, 'o', vis, count(*), min({{'s': s, 'i': id}}) FROM j GROUP BY ALL UNION ALL SELECT video_id, role, 'm', mi, count(*), min({{'s': s, 'i': id}}) FROM j WHERE mi <> 'unmeasured' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id, role, what ORDER BY k DESC, first) AS r, sum(k) OVER (PARTITION BY video_id, role, what) AS n FROM c),
m AS (SELECT video_id, role, max(v) FILTER (what = 'a') AS a_mode, max(v) FILTER (what = 'o') AS o_mode, max(v) FILTER (what = 'm') AS m_mode, max(n) FILTER (what = 'm') AS n_m FROM o WHERE r = 1 GROUP BY 1, 2),
w AS (SELECT video_id, role, count(*) AS n, max(w) - min(w) AS ws, stddev_pop(x) AS l, stddev_pop(x + w / 2) AS c, stddev_pop(x + w) AS r FROM j GROUP BY 1, 2),
ww AS (SELECT *, CASE WHEN n >= 2 AND ws >= 8 AND least(l, c, r) <= 4 AND {second("l", "c", "r")} >= 2 * greatest(least(l, c, r), 1) THEN CASE WHEN l = least(l, c, r) THEN 'left' WHEN c = least(l, c, r) THEN 'center' ELSE 'right' END ELSE 'unmeasured' END AS still FROM w),
g AS (SELECT video_id, role, n_lines AS k, median(y) AS t, median(y + h / 2) AS m, median(y + h) AS b, median(h) AS h FROM j GROUP BY 1, 2, 3), d AS (SELECT video_id, role, count(*) AS kinds, arg_min(g, k) AS a, arg_max(g, k) AS z FROM g GROUP BY 1, 2),
dd AS (SELECT video_id, role, kinds, abs(a.t - z.t) AS t, abs(a.m - z.m) AS m, abs(a.b - z.b) AS b, least(a.h, z.h) AS h FROM d),
v AS (SELECT video_id, role, CASE WHEN kinds >= 2 AND least(t, m, b) <= greatest(3, 0.1 * h) AND {second("t", "m", "b")} >= 2 * greatest(least(t, m, b), 1) THEN CASE WHEN t = least(t, m, b) THEN 'top' WHEN m = least(t, m, b) THEN 'middle' ELSE 'bottom' END ELSE 'unmeasured' END AS valign FROM dd),
q AS (SELECT j.*, a_mode, o_mode, m_mode, n_m, valign, coalesce(a_mode, still) AS al, dur FROM j LEFT JOIN m USING (video_id, role) JOIN ww USING (video_id, role) JOIN v USING (video_id, role) JOIN (SELECT video_id, max(t) AS dur FROM e GROUP BY 1) USING (video_id)),
p AS (SELECT video_id, role, string_agg(id, ',' ORDER BY s, id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id, role ORDER BY s, id) AS r FROM j) WHERE r <= 5 GROUP BY 1, 2)
SELECT video_id, role, count(*) AS n_items, round(median(size), 3) AS size, round(median(size / 2), 3) AS ink_h, NULL::DOUBLE AS shadow, NULL::DOUBLE AS line_spacing, NULL::DOUBLE AS lead, any_value(al) AS align, any_value(valign) AS valign,
round(median(CASE al WHEN 'left' THEN x WHEN 'right' THEN x + w ELSE x + w / 2 END), 3) AS anchor_x, round(median(CASE valign WHEN 'top' THEN y WHEN 'bottom' THEN y + h ELSE y + h / 2 END), 3) AS anchor_y, round(median(outline) FILTER (vis IN ('visible', 'none')), 3) AS outline, any_value(o_mode) AS outline_visibility,
CASE WHEN bool_or(hl IS NOT NULL) THEN 'present' ELSE 'absent' END AS highlight_presence, CASE WHEN bool_or(box = 'present') THEN 'present' WHEN count(box) > 0 THEN 'absent' ELSE 'unmeasured' END AS box, round(count(*) FILTER (box = 'present') / count(*), 3) AS box_share, round(median(alpha) FILTER (box = 'present'), 3) AS box_alpha,
round(median(id % 4) FILTER (box = 'present'), 3) AS pad_x, NULL::DOUBLE AS pad_y, max(chars) AS max_chars, max(n_lines) AS max_lines, max(w) AS max_width, any_value(m_mode) AS motion_in, coalesce(any_value(n_m), 0)::BIGINT AS n_motion_in, round(median(mid) FILTER (mi = m_mode), 3) AS in_dur,
round(median(scale) FILTER (mi = m_mode AND mi = 'pop'), 3) AS in_scale, round(median(off) FILTER (mi = m_mode AND mi LIKE 'slide%'), 3) AS in_offset, NULL::DOUBLE AS in_direction, NULL::VARCHAR AS motion_out, 0::BIGINT AS n_motion_out, NULL::DOUBLE AS out_dur, NULL::DOUBLE AS out_direction,
round(min(e - s), 3) AS min_dur, round(median(e - s), 3) AS dur_p50, CASE WHEN bool_or(e - s >= 0.9 * dur) THEN 'whole_video' ELSE 'timed' END AS persist, any_value(evidence) AS evidence FROM q JOIN p USING (video_id, role) GROUP BY 1, 2""")
def a12(spark, d):
    frames = events(spark, d).groupBy("video_id").agg(F.max("t").alias("duration"))
    return L.role_styles(captions(spark, d), frames, "video_id")


@query("a12_role_colors", None)
def a12_colors(spark, d):
    return L.role_colors(captions(spark, d), "video_id")
