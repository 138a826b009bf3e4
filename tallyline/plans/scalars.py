"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import urls as U
from ..operators import stats as S
from ..operators import text as T
from ..sources.files import table
from .base import E, events, read, timestamp
from .joins import URLKEY

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("p1_common_record", """SELECT 'p' || o_orderkey AS platform_id, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN c_name END, ''), o_orderpriority) AS uploader, left(c_mktsegment || ' ' || c_name, 300) AS title,
CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice)::BIGINT END AS views, CASE WHEN o_orderkey % 4 <> 0 THEN 'platform_metadata' ELSE 'unavailable' END AS views_source, array_to_string(string_split(o_orderpriority, '-')[1:30], ',') AS tags FROM orders JOIN customer ON o_custkey = c_custkey""")
def p1(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    views = F.when(k % 4 != 0, F.floor("o_totalprice").cast("long"))
    return j.select(
        F.concat(F.lit("p"), k.cast("string")).alias("platform_id"), F.coalesce(F.nullif(F.when(k % 3 == 0, F.col("c_name")), F.lit("")), F.col("o_orderpriority")).alias("uploader"),
        F.left(F.concat_ws(" ", "c_mktsegment", "c_name"), F.lit(300)).alias("title"), views.alias("views"), F.when(views.isNotNull(), "platform_metadata").otherwise("unavailable").alias("views_source"),
        F.array_join(F.slice(F.split("o_orderpriority", "-"), 1, 30), ",").alias("tags"),
    )


@query("p2_first_count", r"""WITH f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN '-5' END AS a, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_id::VARCHAR END AS b FROM events),
n AS (SELECT event_id, CASE WHEN regexp_full_match(a, '[0-9]+') THEN a::BIGINT END AS a, CASE WHEN regexp_full_match(b, '[0-9]+') THEN b::BIGINT END AS b FROM f) SELECT event_id, coalesce(a, b) AS views, CASE WHEN a IS NOT NULL THEN 'play_count' WHEN b IS NOT NULL THEN 'view_count' END AS field FROM n""")
def p2(spark, d):
    e = F.col("event_id")
    a = F.when(e % 3 == 0, F.get_json_object("props", "$.k")).when(e % 3 == 1, "-5")
    b = F.when(e % 2 == 0, F.col("event_type")).otherwise(e.cast("string"))
    value, field = X.first_count([("play_count", a), ("view_count", b)])
    return read(spark, d, "events").select("event_id", value.alias("views"), field.alias("field"))


@query("p3_published", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN event_id % 3 = 1 THEN epoch_us(date_trunc('day', ts)) END AS at_us, CASE WHEN event_id % 3 = 0 THEN 'timestamp' WHEN event_id % 3 = 1 THEN 'upload_date' END AS source FROM events""")
def p3(spark, d):
    e = F.col("event_id")
    at, source = X.published(F.when(e % 3 == 0, F.unix_seconds(timestamp("ts"))), F.when(e % 3 == 1, F.date_format("ts", "yyyyMMdd")).otherwise("2024"))
    return read(spark, d, "events").select("event_id", F.unix_micros(at.cast("timestamp")).alias("at_us"), source.alias("source"))


@query("p4_best_element", """WITH a AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: abs(x)) AS size FROM embeddings) SELECT vec_id, list_position(size, list_max(size)) AS place, round(embedding[list_position(size, list_max(size))]::DOUBLE, 6) AS best FROM a""")
def p4(spark, d):
    items = F.transform("embedding", lambda x, i: F.struct((i + 1).alias("place"), x.alias("v")))
    best = X.best_by(items, lambda r: F.abs(r["v"]))
    return read(spark, d, "embeddings").select("vec_id", best.alias("b")).select("vec_id", F.col("b.place").alias("place"), S.rounded(F.col("b.v").cast("double")).alias("best"))


@query("p5_iso_duration", r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PT' || event_id || 'H1M1S' WHEN 1 THEN 'PT' || event_id || 'S' WHEN 2 THEN 'P1DT' || event_id || 'M' ELSE 'P' || event_id END AS s FROM events),
p AS (SELECT event_id, regexp_extract(s, '^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$', ['d', 'h', 'm', 's']) AS x, regexp_full_match(s, 'P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?') AS ok FROM t)
SELECT event_id, CASE WHEN ok THEN coalesce(try_cast(x.d AS BIGINT), 0) * 86400 + coalesce(try_cast(x.h AS BIGINT), 0) * 3600 + coalesce(try_cast(x.m AS BIGINT), 0) * 60 + coalesce(try_cast(x.s AS BIGINT), 0) END AS seconds FROM p""")
def p5(spark, d):
    e, k = F.col("event_id"), F.col("event_id").cast("string")
    text = F.when(e % 4 == 0, F.concat(F.lit("PT"), k, F.lit("H1M1S"))).when(e % 4 == 1, F.concat(F.lit("PT"), k, F.lit("S"))).when(e % 4 == 2, F.concat(F.lit("P1DT"), k, F.lit("M"))).otherwise(F.concat(F.lit("P"), k))
    return read(spark, d, "events").select("event_id", X.iso8601_seconds(text).alias("seconds"))


@query("p6_url_key", f"SELECT page_id, {URLKEY} AS key FROM pages")
def p6(spark, d):
    return read(spark, d, "pages").select("page_id", U.url_key(F.col("url")).alias("key"))


P7 = """u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.tiktok.com/@user' || page_id || '/video/' || page_id WHEN 1 THEN 'https://youtube.com/@chan' || page_id WHEN 2 THEN 'https://instagram.com/reel/x' || page_id WHEN 3 THEN 'https://old.reddit.com/user/u' || page_id || '/' WHEN 4 THEN 'https://instagram.com/name' || page_id || '/p/a' ELSE url END AS u FROM pages)"""


def social(spark, d):
    k = F.col("page_id").cast("string")
    of = F.col("page_id") % 6
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    u = F.when(of == 0, c("https://www.tiktok.com/@user", k, "/video/", k)).when(of == 1, c("https://youtube.com/@chan", k)).when(of == 2, c("https://instagram.com/reel/x", k)).when(of == 3, c("https://old.reddit.com/user/u", k, "/")).when(of == 4, c("https://instagram.com/name", k, "/p/a"))
    return read(spark, d, "pages").select("page_id", F.coalesce(u, F.col("url")).alias("u"))


@query("p7_platform_handle", f"""WITH {P7} SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'youtube' WHEN 3 THEN 'reddit' WHEN 5 THEN NULL ELSE 'instagram' END AS platform,
CASE page_id % 6 WHEN 0 THEN '@user' || page_id WHEN 1 THEN '@chan' || page_id WHEN 3 THEN 'u/u' || page_id WHEN 4 THEN '@name' || page_id END AS handle FROM u""")
def p7(spark, d):
    return social(spark, d).select("page_id", U.platform(F.col("u")).alias("platform"), U.handle(F.col("u")).alias("handle"))


@query("p8_profile_url", f"""WITH {P7} SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://tiktok.com/@user' || page_id WHEN 1 THEN 'https://youtube.com/@chan' || page_id WHEN 3 THEN 'https://reddit.com/user/u' || page_id WHEN 4 THEN 'https://instagram.com/name' || page_id END AS profile FROM u""")
def p8(spark, d):
    return social(spark, d).select("page_id", U.profile(F.col("u")).alias("profile"))


def described(spark, d):
    """Texts with a credit line appended to some of them."""
    k = F.col("doc_id").cast("string")
    of = F.col("doc_id") % 6
    line = F.when(of == 0, F.concat(F.lit("\ncredit: @maker"), k)).when(of == 1, F.concat(F.lit("\nvia https://ex.org/v"), k, F.lit("."))).when(of == 2, F.concat(F.lit("\nthanks @pal"), k, F.lit(" and @pal"), k)).when(of == 3, F.concat(F.lit("\nvideo by @maker"), k, F.lit(" @maker"), k, F.lit(" @other"))).otherwise("")
    return read(spark, d, "documents").select("doc_id", "source", F.concat(F.regexp_replace("text", r"@|(?i)\bvia\b|(?i)source", ""), line).alias("text"))


P9 = """c AS (SELECT doc_id, 'credit' AS kind, '@maker' || doc_id AS value, false AS is_url FROM documents WHERE doc_id % 6 IN (0, 3) UNION ALL SELECT doc_id, 'via', 'https://ex.org/v' || doc_id, true FROM documents WHERE doc_id % 6 = 1
UNION ALL SELECT doc_id, 'mention', '@pal' || doc_id, false FROM documents WHERE doc_id % 6 = 2 UNION ALL SELECT doc_id, 'mention', '@other', false FROM documents WHERE doc_id % 6 = 3)"""


@query("p9_credits", f"WITH {P9} SELECT * FROM c")
def p9(spark, d):
    return T.extract_credits(described(spark, d), "doc_id", "text").select("doc_id", "kind", "value", "is_url")


@query("p10_description_lines", f"""WITH {P7}, t AS (SELECT page_id, 'watch ' || u || chr(10) || '#tag' || (page_id % 5) || ' by @me' || chr(10) || 'end' AS text FROM u), l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t)
SELECT page_id, pos, CASE WHEN contains(line, '://') THEN 'url' WHEN contains(line, '#') THEN 'hashtag' END AS kind, CASE WHEN contains(line, '://') THEN substr(line, 7) ELSE '#tag' || (page_id % 5) END AS value FROM l WHERE contains(line, '://') OR contains(line, '#tag')""")
def p10(spark, d):
    text = F.concat(F.lit("watch "), F.col("u"), F.lit("\n#tag"), (F.col("page_id") % 5).cast("string"), F.lit(" by @me\nend"))
    lines = social(spark, d).select("page_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    address = F.nullif(F.regexp_extract("line", r"(https?://\S+)", 1), F.lit(""))
    tag = F.when(address.isNull(), F.nullif(F.regexp_extract("line", r"(?:^|\s)(#\w+)", 1), F.lit("")))
    out = lines.select("page_id", F.col("pos").cast("long").alias("pos"), F.when(address.isNotNull(), "url").when(tag.isNotNull(), "hashtag").alias("kind"), F.coalesce(address, tag).alias("value"))
    return out.where("kind IS NOT NULL")


@query("p11_authorship", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '@maker' || doc_id WHEN 3 THEN '@maker' || doc_id WHEN 2 THEN '@pal' || doc_id ELSE source END AS author,
CASE doc_id % 6 WHEN 0 THEN 'description_credit' WHEN 3 THEN 'description_credit' WHEN 2 THEN 'description_mention' ELSE 'uploader' END AS basis, CASE WHEN doc_id % 6 = 1 THEN 'https://ex.org/v' || doc_id END AS original_url,
CASE WHEN doc_id % 6 IN (0, 2, 3) THEN source END AS reposter FROM documents""")
def p11(spark, d):
    docs = described(spark, d)
    return T.authorship(docs.select("doc_id", "source"), T.extract_credits(docs, "doc_id", "text"), "doc_id", "source")


@query("p12_typed_parse", r"""WITH r AS (SELECT event_id, event_type AS key, CASE WHEN event_id % 4 = 0 THEN 'abc' WHEN event_id % 4 = 1 THEN value::VARCHAR ELSE json_extract_string(props, '$.k') END AS raw FROM events)
SELECT event_id, CASE WHEN key IN ('click', 'view') THEN try_cast(raw AS DOUBLE) END AS number, CASE WHEN key = 'signup' THEN 'unknown key' WHEN key IN ('click', 'view') AND try_cast(raw AS DOUBLE) IS NULL THEN 'not a number'
WHEN key IN ('error', 'purchase') AND NOT regexp_full_match(raw, '[a-z]+') THEN 'not a word' END AS reason FROM r""")
def p12(spark, d):
    spec = spark.createDataFrame([("click", "number"), ("view", "number"), ("error", "word"), ("purchase", "word")], "key string, kind string")
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, "abc").when(e % 4 == 1, F.col("value").cast("string")).otherwise(F.get_json_object("props", "$.k"))
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("key"), raw.alias("raw")).join(F.broadcast(spec), "key", "left")
    number = F.when(F.col("kind") == "number", F.col("raw").try_cast("double"))
    reason = F.when(F.col("kind").isNull(), "unknown key").when((F.col("kind") == "number") & number.isNull(), "not a number").when((F.col("kind") == "word") & ~F.rlike("raw", F.lit("^[a-z]+$")), "not a word")
    return rows.select("event_id", number.alias("number"), reason.alias("reason"))


@query("p13_admission", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN quality = 0 THEN 'not watched' WHEN toxic = 1 THEN 'no signer' WHEN lang NOT IN ('en', 'fr') THEN 'outside the basis' WHEN n_chars < 300 THEN 'time out of range' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p13(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "no label").when(F.col("quality") == 0, "not watched").when(F.col("toxic") == 1, "no signer").when(~F.col("lang").isin("en", "fr"), "outside the basis").when(F.col("n_chars") < 300, "time out of range")
    return j.select("doc_id", reason.alias("reason"))


@query("p14_sequence_labels", """WITH s AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'ask' WHEN 'assistant' THEN 'answer' END, '>' ORDER BY turn) AS labels, bool_or(role NOT IN ('user', 'assistant')) AS unknown FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN NOT unknown THEN labels END AS labels, CASE WHEN unknown THEN 'unknown token' END AS reason FROM s""")
def p14(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), " > ").alias("raw"))
    alias = F.create_map(F.lit("user"), F.lit("ask"), F.lit("assistant"), F.lit("answer"))
    tokens = F.transform(F.split("raw", r"\s*>\s*"), lambda t: F.try_element_at(alias, t))
    unknown = F.exists(tokens, lambda t: t.isNull())
    return c.select("conv_id", F.when(~unknown, F.array_join(tokens, ">")).alias("labels"), F.when(unknown, "unknown token").alias("reason"))


@query("p15_ending_class", r"""WITH x AS (SELECT lang, CASE WHEN regexp_matches(w, '(ing|ung|tion|ción)$') THEN 'noun' WHEN regexp_matches(w, '(ly|ment|lich|mente)$') THEN 'adverb' WHEN regexp_matches(w, '(ed|er|en)$') THEN 'verb' ELSE 'other' END AS class
FROM (SELECT lang, regexp_extract(lower(text), '([\p{L}]+)[^\p{L}]*$', 1) AS w FROM documents)) SELECT lang, class, count(*) AS n FROM x GROUP BY 1, 2""")
def p15(spark, d):
    rules = [("noun", "(ing|ung|tion|ción)$"), ("adverb", "(ly|ment|lich|mente)$"), ("verb", "(ed|er|en)$")]
    last = F.regexp_extract(F.lower("text"), r"([\p{L}]+)[^\p{L}]*$", 1)
    return read(spark, d, "documents").select("lang", X.first_rule(last, rules, "other").alias("class")).groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))


@query("p16_script_share", r"""SELECT doc_id, round(length(regexp_replace(text, '[^éèêàçñóíáúäöüß]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 6) AS share FROM documents""")
def p16(spark, d):
    return read(spark, d, "documents").select("doc_id", S.rounded(X.script_share(F.col("text"), "éèêàçñóíáúäöüß")).alias("share"))


@query("p17_quote_pair", """WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN '«' || text || '»' WHEN 2 THEN '"' || text ELSE text END AS t FROM documents)
SELECT doc_id, nullif(regexp_extract(trim(t), '(?s)^(["«“]).*(["»”])$', 1) || regexp_extract(trim(t), '(?s)^(["«“]).*(["»”])$', 2), '') AS pair FROM q""")
def p17(spark, d):
    k, head = F.col("doc_id") % 4, F.col("text")
    t = F.when(k == 0, F.concat(F.lit('"'), head, F.lit('"'))).when(k == 1, F.concat(F.lit("«"), head, F.lit("»"))).when(k == 2, F.concat(F.lit('"'), head)).otherwise(head)
    return read(spark, d, "documents").select("doc_id", X.quote_pair(t, {'"': '"', "«": "»", "“": "”"}).alias("pair"))


@query("p18_rescale", """SELECT p_partkey, CASE WHEN abs((p_size * 9) / (p_size * h) - 0.5625) <= 0.01 THEN round(p_retailprice * 1080 / (p_size * 9), 6) END AS px, CASE WHEN abs((p_size * 9) / (p_size * h) - 0.5625) > 0.01 THEN 'other aspect' END AS reason FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 12 ELSE 16 END AS h FROM part)""")
def p18(spark, d):
    size = F.col("p_size").cast("double")
    value, reason = X.rescale(F.col("p_retailprice"), size * 9, size * F.when(F.col("p_partkey") % 3 == 0, 12).otherwise(16), 1080.0, 1920.0)
    return read(spark, d, "part").select("p_partkey", S.rounded(value).alias("px"), reason.alias("reason"))


@query("p19_aspect", """SELECT p_partkey, (w // gcd(w, h)) || ':' || (h // gcd(w, h)) AS aspect, CASE WHEN h / w > 1.1 THEN 'vertical' WHEN h / w < 0.9 THEN 'horizontal' ELSE 'square' END AS orientation FROM (SELECT p_partkey, p_size AS w, 1 + p_partkey % 60 AS h FROM part)""")
def p19(spark, d):
    w, h = F.col("p_size").cast("long"), 1 + F.col("p_partkey") % 60
    return read(spark, d, "part").select("p_partkey", X.aspect(w, h).alias("aspect"), X.orientation(w, h).alias("orientation"))


@query("p20_censored", r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 AND l_quantity >= 40 THEN 'cap 40 binds' END AS excluded FROM lineitem""")
def p20(spark, d):
    asked = F.when(F.col("l_linenumber") % 3 == 0, "best[height<=40]").otherwise("best")
    cap = F.array_max(F.transform(F.regexp_extract_all(asked, F.lit(r"height<=?([0-9]+)"), F.lit(1)), lambda x: x.cast("int")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") >= cap, F.concat(F.lit("cap "), cap.cast("string"), F.lit(" binds"))).alias("excluded"))


@query("p21_digests", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS digest, 'c' || left(sha256(o_orderstatus || ':' || o_orderkey), 12) AS short FROM orders""")
def p21(spark, d):
    return read(spark, d, "orders").select("o_orderkey", X.digest("o_orderkey", "o_custkey", "o_orderstatus").alias("digest"), X.short_id("o_orderstatus", F.col("o_orderkey").cast("string")).alias("short"))


@query("p22_flatten", """SELECT event_id, 'props.k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events""")
def p22(spark, d):
    e = read(spark, d, "events")
    open_ = F.map_entries(F.from_json("props", "map<string,string>"))
    leaves = F.concat(F.transform(open_, lambda x: F.struct(F.concat(F.lit("props."), x["key"]).alias("key"), x["value"].alias("value"))), F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").alias("value"))))
    return e.select("event_id", F.explode(leaves).alias("x")).select("event_id", "x.key", "x.value")


@query("p23_error_class", r"""WITH m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN chr(27) || '[31mSign in to confirm' || chr(27) || '[0m HTTP Error 403 ' || lang WHEN 1 THEN 'x: HTTP Error 403 ' || lang WHEN 2 THEN 'timeout ' || lang WHEN 3 THEN 'login required ' || lang WHEN 4 THEN '403 for ' || lang || ': Forbidden' END AS t FROM documents)
SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN contains(lower(t), 'sign in to confirm') OR contains(t, 'login required') THEN 'login_required' WHEN contains(t, '403') THEN 'blocked' ELSE 'error' END AS class FROM m""")
def p23(spark, d):
    k, lang = F.col("doc_id") % 6, F.col("lang")
    m = F.when(k == 0, F.concat(F.lit("\x1b[31mSign in to confirm\x1b[0m HTTP Error 403 "), lang)).when(k == 1, F.concat(F.lit("x: HTTP Error 403 "), lang)).when(k == 2, F.concat(F.lit("timeout "), lang))
    m = m.when(k == 3, F.concat(F.lit("login required "), lang)).when(k == 4, F.concat(F.lit("403 for "), lang, F.lit(": Forbidden")))
    return read(spark, d, "documents").select("doc_id", X.error_class(m).alias("class"))


@query("p24_scrub", r"""WITH t AS (SELECT 'at /home/me/x' || doc_id || ' and /tmp/a/b' || doc_id || ' ' || lang || ' C:\Users\me\y ' || text AS t, doc_id FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(replace(t, 'C:\Users\me', '~'), '/home/[a-z]+', '~', 'g'), '/tmp/[^ ]*', '<tmp>', 'g') AS scrubbed FROM t""")
def p24(spark, d):
    t = F.concat(F.lit("at /home/me/x"), F.col("doc_id").cast("string"), F.lit(" and /tmp/a/b"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit(" C:\\Users\\me\\y "), F.col("text"))
    return read(spark, d, "documents").select("doc_id", X.scrub(t).alias("scrubbed"))


@query("p25_color_distance", """WITH c AS (SELECT doc_id, doc_id * 37 % 256 AS r, doc_id * 59 % 256 AS g, doc_id * 83 % 256 AS b FROM documents) SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN round(sqrt((r - 16) * (r - 16) + (g - 32) * (g - 32) + (b - 48) * (b - 48)), 6) END AS dist,
CASE WHEN doc_id % 10 <> 0 THEN sqrt((r - 16) * (r - 16) + (g - 32) * (g - 32) + (b - 48) * (b - 48)) <= 128 END AS near FROM c""")
def p25(spark, d):
    k = F.col("doc_id")
    color = F.when(k % 10 != 0, F.concat(F.lit("#"), *[F.lpad(F.hex(k * m % 256), 2, "0") for m in (37, 59, 83)]))
    dist = X.color_distance(color, F.lit("#102030"))
    return read(spark, d, "documents").select("doc_id", S.rounded(dist).alias("dist"), (dist <= 128).alias("near"))


@query("p26_within_observed", """WITH o AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS lo, quantile_cont(l_quantity, 0.9) AS hi FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN lo IS NOT NULL THEN l_quantity BETWEEN lo AND hi END AS inside FROM lineitem l LEFT JOIN o USING (l_returnflag)""")
def p26(spark, d):
    li = read(spark, d, "lineitem")
    o = S.pstats(li.where("l_returnflag <> 'N'"), "l_quantity", "l_returnflag")
    return li.join(S.small(o), "l_returnflag", "left").select("l_orderkey", "l_linenumber", X.within(F.col("l_quantity"), F.col("p10"), F.col("p90")).alias("inside"))


@query("p27_three_valued_and", """SELECT event_id, CASE WHEN value < 1 THEN NULL ELSE value > 5 END AND CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type <> 'error' END AS holds FROM events""")
def p27(spark, d):
    a = F.when(F.col("value") >= 1, F.col("value") > 5)
    b = F.when(F.col("event_id") % 7 != 0, F.col("event_type") != "error")
    return read(spark, d, "events").select("event_id", (a & b).alias("holds"))


@query("p28_identity_rule", """SELECT a.o_orderkey, CASE WHEN a.o_orderkey % 5 = 0 THEN NULL ELSE a.o_orderstatus = b.o_orderstatus END AND abs(a.o_totalprice - b.o_totalprice) <= 150000 AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def p28(spark, d):
    o = read(spark, d, "orders")
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == F.col("s"))
    return o.join(b, "o_orderkey").select("o_orderkey", (status & (F.abs(F.col("o_totalprice") - F.col("p")) <= 150000)).alias("same"))


@query("p29_persist", f"""WITH {E}, s AS (SELECT video_id, max(t) AS dur FROM e GROUP BY 1) SELECT video_id, type, max(("end" - t) / dur) >= 0.02 AS persists FROM e JOIN s USING (video_id) GROUP BY 1, 2""")
def p29(spark, d):
    e = events(spark, d)
    share = (F.col("end") - F.col("t")) / F.col("dur")
    return e.join(e.groupBy("video_id").agg(F.max("t").alias("dur")), "video_id").groupBy("video_id", "type").agg((F.max(share) >= 0.02).alias("persists"))


ROLES = """i AS (SELECT video_id, event_id AS id, t AS s, CASE WHEN type = 'purchase' THEN t ELSE "end" END AS e, (event_id % 300)::DOUBLE AS x, (event_id * 37 % 1000)::DOUBLE AS y, (100 + event_id % 200)::DOUBLE AS w, (20 + event_id % 5 * 10)::DOUBLE AS h,
CASE WHEN event_id % 11 > 0 THEN (10 + event_id % 30)::DOUBLE END AS ink_h, event_id % 4 = 0 AS boxed, CASE WHEN type = 'purchase' THEN '#E02010' END AS color,
CASE WHEN event_id % 10 = 0 THEN 'The Channel!' WHEN type = 'click' AND event_id % 3 = 0 THEN '“quoted words”' WHEN event_id % 3 = 1 THEN 'wow!' ELSE 'some caption text' END AS text FROM e WHERE type <> 'view'),
f AS (SELECT video_id, max("end" - t) AS duration FROM e GROUP BY 1)"""


@query("p30_roles", f"""WITH {E}, {ROLES}, a AS (SELECT *, e - s >= 0.6 * duration AS long, (y + h / 2) / 1000 AS mid, text LIKE '%Channel%' AS mark FROM i JOIN f USING (video_id)),
t AS (SELECT video_id, arg_min(struct_pack(id := id, s := s, x := x, y := y, w := w, h := h, ink := coalesce(ink_h, 0)), struct_pack(a := -coalesce(ink_h, 0), b := y, c := id)) AS t FROM a WHERE NOT mark AND long AND mid < 0.4 GROUP BY 1),
b AS (SELECT a.*, CASE WHEN mark THEN 'identity_mark' WHEN id = t.t.id THEN 'title' WHEN y - (t.t.y + t.t.h) BETWEEN -0.2 * t.t.h AND 2.5 * t.t.h AND least(t.t.x + t.t.w, x + w) > greatest(t.t.x, x) AND coalesce(ink_h, 1e9) < t.t.ink AND (long OR s <= t.t.s + 2) THEN 'description' END AS r FROM a LEFT JOIN t USING (video_id)),
m AS (SELECT video_id, median(ink_h) AS med FROM b WHERE r IS NULL GROUP BY 1), k AS (SELECT *, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS chars FROM b LEFT JOIN m USING (video_id)),
c AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN boxed AND (ink_h <= 0.85 * med OR med IS NULL) AND chars BETWEEN 1 AND 10 THEN 'speaker' WHEN ink_h >= 1.15 * med AND chars BETWEEN 1 AND 6 AND color IS NOT NULL THEN 'reaction' END AS q FROM k),
n AS (SELECT video_id, mid, count(*) OVER (PARTITION BY video_id ORDER BY mid RANGE BETWEEN 0.06 PRECEDING AND 0.06 FOLLOWING) AS near FROM c WHERE q IS NULL), z AS (SELECT video_id, arg_min(mid, struct_pack(a := -near, b := mid)) AS band FROM n GROUP BY 1),
l AS (SELECT c.id, sum(least(c.e, o."end") - greatest(c.s, o.t)) AS lap FROM c JOIN e o ON c.video_id = o.video_id AND o.type = 'view' AND c.s < o."end" AND c.e > o.t GROUP BY 1)
SELECT c.id, coalesce(q, CASE WHEN mid BETWEEN band - 0.06 AND band + 0.06 THEN CASE WHEN text LIKE '“%' OR coalesce(lap, 0) >= 0.5 * greatest(1e-6, e - s) THEN 'dialogue' ELSE 'situation' END END, 'unknown') AS role FROM c LEFT JOIN z USING (video_id) LEFT JOIN l USING (id)""")
def p30(spark, d):
    from ..operators import captions as C

    # items, frames and speech are made of the events: read from a table, so that no task makes them anew for each
    e, k = table(events(spark, d).select("video_id", "event_id", "type", "t", "end"), "events"), F.col("event_id")
    text = F.when(k % 10 == 0, "The Channel!").when((F.col("type") == "click") & (k % 3 == 0), "“quoted words”").when(k % 3 == 1, "wow!").otherwise("some caption text")
    items = e.where("type <> 'view'").select(
        "video_id", k.alias("id"), F.col("t").alias("start"), F.when(F.col("type") == "purchase", F.col("t")).otherwise(F.col("end")).alias("end"), (k % 300).alias("x"), (k * 37 % 1000).alias("y"), (100 + k % 200).alias("w"), (20 + k % 5 * 10).alias("h"),
        F.when(k % 11 > 0, 10 + k % 30).alias("ink_h"), (k % 4 == 0).alias("boxed"), F.when(F.col("type") == "purchase", "#E02010").alias("color"), text.alias("text"),
    )
    frames = e.groupBy("video_id").agg(F.max(F.col("end") - F.col("t")).alias("duration")).withColumn("height", F.lit(1000.0))
    speech = e.where("type = 'view'").select("video_id", k.alias("id"), F.col("t").alias("start"), "end")
    return C.assign_roles(items, frames, speech, "video_id", ["The Channel", "it"])


@query("p31_drop_known_old", """SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate < TIMESTAMP '2001-01-01' END IS NOT TRUE""")
def p31(spark, d):
    published = F.when(F.col("o_orderkey") % 9 != 0, timestamp("o_orderdate"))
    _, label, _ = X.recency(published, F.lit("2001-08-01").cast("timestamp"), 212.0)
    return read(spark, d, "orders").where(label != "old").select("o_orderkey")
