"""Queries of features, labels, registers, gates and applied measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import endings as N
from ..operators import features as V
from ..operators import labels as B
from ..operators import layers as L
from ..operators import qa as Q
from ..operators import similarity as M
from ..operators import stats as S
from ..operators import text as T
from ..sources.files import table
from .aggregates import QA, verdicts
from .base import E, events, read

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


ROLES = "CASE event_id % 6 WHEN 0 THEN 'situation' WHEN 1 THEN 'dialogue' WHEN 2 THEN 'reaction' WHEN 3 THEN 'speaker' WHEN 4 THEN 'title' ELSE 'unknown' END"


@query("a20_entity_features", f"""WITH {E}, n AS (SELECT video_id AS v, CASE WHEN video_id % 6 <> 0 THEN max(t) END AS d, video_id % 4 <> 1 AS s, video_id % 5 <> 2 AS c, video_id % 7 <> 3 AS m, video_id % 3 <> 0 AS a,
count(*) FILTER (type = 'click' AND value > 40) AS cuts, count(*) FILTER (type = 'click' AND value <= 40) AS flashes, count(*) FILTER (type = 'error' AND value > 30) AS zooms, count(*) FILTER (type = 'error' AND value <= 30) AS freezes, count(*) FILTER (type = 'signup') AS sounds FROM e GROUP BY 1),
k AS (SELECT video_id AS v, {ROLES} AS role, "end" - t AS size FROM e WHERE type IN ('view', 'purchase')),
r AS (SELECT v, count(*) FILTER (role IN ('title', 'unknown')) AS other, count(*) FILTER (role NOT IN ('title', 'unknown')) AS timed, avg(size) FILTER (role NOT IN ('title', 'unknown')) AS mean, count(*) FILTER (role = 'title') AS titles,
count(*) FILTER (role = 'situation') AS r1, count(*) FILTER (role = 'dialogue') AS r2, count(*) FILTER (role = 'reaction') AS r3, count(*) FILTER (role = 'speaker') AS r4 FROM k GROUP BY 1)
SELECT v AS video_id, CASE WHEN d > 0 THEN d END AS duration_s, CASE WHEN s AND d > 0 THEN round(10 * cuts / d, 4) END AS cuts_per_10s, CASE WHEN s AND d > 0 THEN round(10 * flashes / d, 4) END AS flash_per_10s, CASE WHEN s AND d > 0 THEN 0.0::DOUBLE END AS crossfade_per_10s,
CASE WHEN c AND d > 0 THEN round(10 * coalesce(timed, 0) / d, 4) END AS captions_per_10s, CASE WHEN c THEN coalesce(round(mean, 3), 0) END AS caption_mean_dur_s, CASE WHEN c THEN coalesce(round(r1 / nullif(timed, 0), 4), 0) END AS share_situation,
CASE WHEN c THEN coalesce(round(r2 / nullif(timed, 0), 4), 0) END AS share_dialogue, CASE WHEN c THEN coalesce(round(r3 / nullif(timed, 0), 4), 0) END AS share_reaction, CASE WHEN c THEN coalesce(round(r4 / nullif(timed, 0), 4), 0) END AS share_speaker,
CASE WHEN c THEN (coalesce(titles, 0) > 0)::INT::DOUBLE END AS has_title, CASE WHEN c THEN 0.0::DOUBLE END AS has_description, CASE WHEN m AND d > 0 THEN round(10 * zooms / d, 4) END AS zoom_per_10s, CASE WHEN m AND d > 0 THEN round(10 * freezes / d, 4) END AS freeze_per_10s,
CASE WHEN m THEN 0.0::DOUBLE END AS speed_events, CASE WHEN a AND d > 0 THEN round(10 * sounds / d, 4) END AS sfx_per_10s FROM n LEFT JOIN r USING (v) WHERE s OR c OR m""")  # fmt: skip
def a20(spark, d):
    # five sources are made of the events: read from a table, so that no task makes them five times
    e = table(events(spark, d).select("video_id", "event_id", "type", "value", "t", "end"), "events")
    v, k = F.col("video_id"), F.col("event_id") % 6
    analysed = e.groupBy("video_id").agg(F.max("t").alias("t")).select(v, F.when(v % 6 != 0, F.col("t")).alias("duration"), (v % 4 != 1).alias("has_shots"), (v % 5 != 2).alias("has_captions"), (v % 7 != 3).alias("has_motion"), (v % 3 != 0).alias("has_sounds"))
    shots = e.where("type = 'click'").select("video_id", F.when(F.col("value") > 40, "cut").otherwise("flash").alias("type"))
    role = F.when(k == 0, "situation").when(k == 1, "dialogue").when(k == 2, "reaction").when(k == 3, "speaker").when(k == 4, "title").otherwise("unknown")
    captions = e.where("type IN ('view', 'purchase')").select("video_id", role.alias("role"), F.col("t").alias("start"), "end")
    motion = e.where("type = 'error'").select("video_id", F.when(F.col("value") > 30, "zoom_in").otherwise("freeze").alias("type"))
    return V.entity_features(analysed, shots, captions, motion, e.where("type = 'signup'"), "video_id")


#: Lines of documents, each with an ending of some register.
LINES = """l AS (SELECT doc_id, source, lang, text || ' ' || CASE doc_id % 8 WHEN 0 THEN '있음' WHEN 1 THEN '감사합니다.' WHEN 2 THEN '왔어요?' WHEN 3 THEN '모여 있다' WHEN 4 THEN '영상 모음' WHEN 5 THEN '들킴!!' WHEN 6 THEN '간다' ELSE '' END AS line FROM documents),
w AS (SELECT *, list_last(regexp_split_to_array(regexp_replace(trim(line), '[\\s"''.,!?~…·]+$', ''), '\\s+')) AS word FROM l),
c AS (SELECT *, CASE WHEN regexp_matches(word, '니다$') THEN '합쇼체' WHEN regexp_matches(word, '(요|죠)$') THEN '해요체' WHEN regexp_matches(word, '(있음|들킴)$') THEN '음슴체' WHEN regexp_matches(word, '다$') THEN '반말' ELSE '명사형/기타' END AS register FROM w)"""


def lines(spark, d):
    k = F.col("doc_id") % 8
    ends = ["있음", "감사합니다.", "왔어요?", "모여 있다", "영상 모음", "들킴!!", "간다", ""]
    end = F.element_at(F.array(*map(F.lit, ends)), (k + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", "source", "lang", F.concat("text", F.lit(" "), end).alias("line"))


@query("p15_register", f"WITH {LINES} SELECT lang, register, count(*) AS n FROM c GROUP BY 1, 2")
def p15(spark, d):
    return lines(spark, d).select("lang", N.ending_class(F.col("line"))["register"].alias("register")).where("register IS NOT NULL").groupBy("lang", "register").agg(F.count(F.lit(1)).alias("n"))


@query("a18_entity_register", f"""WITH {LINES}, k AS (SELECT source, register, count(*) AS n, min(doc_id) AS f FROM c WHERE register <> '명사형/기타' GROUP BY 1, 2)
SELECT source, CASE WHEN max(n) / sum(n) >= 0.3 THEN arg_max(register, {{'n': n, 'f': -f}}) ELSE '혼합' END AS register FROM k GROUP BY 1""")
def a18(spark, d):
    return N.entity_register(lines(spark, d), "source", "line", "doc_id", share=0.3)


@query("a18_top_endings", f"""WITH {LINES}, k AS (SELECT right(word, 2) AS ending, count(*) AS n, min(doc_id) AS f FROM c WHERE register <> '명사형/기타' GROUP BY 1) SELECT ending, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM k QUALIFY rank <= 4""")
def a18b(spark, d):
    return N.top_endings(lines(spark, d), "line", "doc_id", 4)


@query("p14_disclosure", """WITH l AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'hook' ELSE '반전' END, ' > ' ORDER BY turn) AS parts, bool_or(role <> 'user') AS has, count(*)::DOUBLE AS d, max(turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN has THEN 'a reveal part, but no reveal' END WHEN NOT has THEN 'a reveal, but no reveal part' WHEN t > d + 1e-6 THEN 'reveal after the end' END AS reason, CASE WHEN conv_id % 3 <> 0 AND has AND t <= d + 1e-6 THEN round(t / d, 6) END AS fraction FROM l""")
def p14(spark, d):
    name = F.when(F.col("role") == "user", "hook").otherwise("반전")
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", name.alias("p")))), lambda s: s["p"]), " > ").alias("parts"), F.count(F.lit(1)).cast("double").alias("d"), F.max("turn").alias("t"))
    at = F.when(F.col("conv_id") % 3 == 0, "none").otherwise(F.col("t").cast("string"))
    x = c.select("conv_id", B.disclosure(F.col("parts"), at, F.col("d")).alias("x"))
    return x.select("conv_id", F.col("x.reason").alias("reason"), S.rounded(F.col("x.fraction")).alias("fraction"))


@query("p11_authorship_hint", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang WHEN doc_id % 5 = 1 THEN NULL ELSE source END AS author, CASE doc_id % 5 WHEN 0 THEN 'metadata' WHEN 1 THEN 'external_link' ELSE 'uploader' END AS basis,
CASE WHEN doc_id % 5 = 1 THEN 'https://ex.org/' || doc_id END AS original_url, CASE WHEN doc_id % 5 <= 1 THEN source END AS reposter FROM documents""")
def p11(spark, d):
    k = F.col("doc_id") % 5
    items = read(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("id_"), "source").alias("uploader_id"), F.when(k == 0, F.col("lang")).alias("hint"), F.lit(None).cast("string").alias("basis_hint"), F.when(k == 1, F.concat(F.lit("https://ex.org/"), F.col("doc_id").cast("string"))).alias("link"))
    own = items.select("doc_id", F.lit("mention").alias("kind"), F.concat(F.lit("@"), "uploader_id").alias("value"), F.lit(False).alias("is_url"), F.lit(1).cast("long").alias("pos"))
    return T.authorship(items, own, "doc_id", "source", "uploader_id", "hint", "basis_hint", "link")


@query("a5_mode_item", """WITH r AS (SELECT l_suppkey AS e, l_returnflag AS g, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS v FROM lineitem), c AS (SELECT g, v, count(*) AS k, min(pos) AS f FROM r GROUP BY 1, 2),
b AS (SELECT NULL AS grp, v, sum(k)::BIGINT AS k, min(f) AS f FROM c GROUP BY 2 UNION ALL SELECT g, v, k, f FROM c) SELECT grp, sum(k)::BIGINT AS n, arg_max(v, {'k': k, 'f': -f})::DOUBLE AS value FROM b GROUP BY 1""")
def a5(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("v"))
    return S.numeric_item(rows, "quantity", "v", "g", "l_suppkey", "pos", rule="mode").select("grp", "n", "value")


@query("a5_native_stats", """SELECT p_size || 'x' || (p_size * 2) AS resolution, count(*) AS n, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part WHERE p_size > 5 GROUP BY 1""")
def a5b(spark, d):
    res = F.when(F.col("p_size") > 5, F.concat(F.col("p_size").cast("string"), F.lit("x"), (F.col("p_size") * 2).cast("string")))
    return S.native_stats(read(spark, d, "part").withColumn("resolution", res), "p_retailprice", "resolution")


@query("a8_presence_evidence", f"""WITH {E}, s AS (SELECT video_id, CASE WHEN bool_or(value > 150) THEN 'present' ELSE 'absent' END AS state FROM e GROUP BY 1) SELECT video_id, state FROM s WHERE state = (SELECT max(state) FROM s) ORDER BY video_id LIMIT 5""")
def a8(spark, d):
    s = events(spark, d).groupBy("video_id").agg(S.tri_state(F.col("value") > 150).alias("state"))
    return S.presence_evidence(s, "video_id", "video_id", "state")


@query("a35_category_columns", f"""WITH {E}, x AS (SELECT type, event_id, CASE WHEN value > 20 THEN format_id END AS c FROM e), k AS (SELECT type, c, count(*) AS n, min(event_id) AS f FROM x WHERE c IS NOT NULL GROUP BY 1, 2),
m AS (SELECT type, sum(n)::BIGINT AS n, arg_max(c, {{'n': n, 'f': -f}}) AS mode, round(max(n) / sum(n), 6) AS share FROM k GROUP BY 1), t AS (SELECT type, count(*) AS n_events, count(*) - count(c) AS n_missing FROM x GROUP BY 1)
SELECT type, coalesce(n, 0) AS n, mode, share, n_events, n_missing, CASE WHEN n_missing = n_events THEN 'unmeasured' WHEN n_missing > 0 THEN 'partial' ELSE 'measured' END AS status FROM t LEFT JOIN m USING (type)""")
def a35(spark, d):
    return S.category_column(events(spark, d).withColumn("c", F.when(F.col("value") > 20, F.col("format_id"))), "type", "c", "event_id")


@query("a35_type_examples", f"""WITH {E}, f AS (SELECT type, video_id, min(t) AS t FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY video_id) AS place FROM f) SELECT type, video_id, round(t, 6) AS t, place FROM r WHERE place <= 3""")
def a35b(spark, d):
    return S.type_examples(events(spark, d), "type", "video_id", "t").withColumn("t", S.rounded("t"))


@query("a38_lower_bound", f"""WITH {E}, c AS (SELECT video_id, type, count(*) AS n FROM e WHERE value > 60 GROUP BY 1, 2), o AS (SELECT *, video_id % 3 = 0 AS low FROM c WHERE video_id % 2 = 0), r AS (SELECT type, floor(quantile_cont(n::DOUBLE, 0.1) + 1e-9) AS lo, ceil(quantile_cont(n::DOUBLE, 0.9) - 1e-9) AS hi FROM o GROUP BY 1)
SELECT c.video_id, c.type, c.n, CASE WHEN r.lo IS NULL THEN 'unmeasured' WHEN c.n BETWEEN r.lo AND r.hi THEN 'in_range' WHEN EXISTS (SELECT 1 FROM o WHERE o.type = c.type AND o.n = c.n AND NOT o.low) THEN 'observed' WHEN EXISTS (SELECT 1 FROM o WHERE o.type = c.type AND o.n = c.n) THEN 'lower_bound' ELSE 'outside' END AS verdict
FROM c LEFT JOIN r USING (type) WHERE c.video_id % 2 = 1""")
def a38(spark, d):
    c = events(spark, d).where("value > 60").groupBy("video_id", "type").agg(F.count(F.lit(1)).alias("n"))
    seen = c.where("video_id % 2 = 0").withColumn("low", F.col("video_id") % 3 == 0)
    return Q.count_range_verdict(c.where("video_id % 2 = 1"), seen, "type", "n", "low")


IDS = "array_to_string(list_sort(list(row_id))[1:50], ',')"


@query("a30_quality_gate", f"""WITH {E}, {QA}, x AS (SELECT *, CASE WHEN category = 'click' THEN 'audio.sfx.no_event' WHEN category = 'view' THEN 'audio.sfx.offset' ELSE category END AS check_id, kind = 'wide' AS style, row_id % 4 = 0 AND EXISTS (SELECT 1 FROM q o WHERE o.row_id = q.row_id + 1 AND o.status <> 'unmeasured') AS covered FROM q),
h AS (SELECT 'G1' AS rule, row_id FROM x WHERE status = 'different' AND NOT intended UNION ALL SELECT 'G2', row_id FROM x WHERE status = 'unmeasured' AND required UNION ALL SELECT 'G3', row_id FROM x WHERE check_id = 'audio.sfx.no_event' AND status <> 'same'
UNION ALL SELECT 'G4', row_id FROM x WHERE check_id = 'audio.sfx.offset' AND status <> 'same' UNION ALL SELECT 'P2', row_id FROM x WHERE status = 'unmeasured' AND style UNION ALL SELECT 'P4', row_id FROM x WHERE status = 'unmeasured' AND NOT style AND NOT required AND NOT covered)
SELECT rule, 'fail' AS severity, count(*) AS n, {IDS} AS failing FROM h GROUP BY 1 UNION ALL SELECT 'G5', 'fail', 0, '' UNION ALL SELECT 'A2', 'warn', 0, '' UNION ALL SELECT 'W1', 'warn', 1, 'loudness'""")
def a30(spark, d):
    q = verdicts(spark, d)
    check = F.when(F.col("category") == "click", Q.NO_EVENT).when(F.col("category") == "view", Q.OFFSET).otherwise(F.col("category"))
    rows = q.select("row_id", check.alias("check_id"), "category", F.when(F.col("kind") == "wide", Q.STYLE).otherwise("self").alias("kind"), "status", "required", F.col("intended").alias("intended_change"), F.when(F.col("row_id") % 4 == 0, F.col("row_id") + 1).alias("covered_by"))
    return Q.quality_gate(rows, True, output=("a", "b"), changed_since_approval=True, categories=("click", "view", "loudness"))


@query("j20_refused_items", """WITH i AS (SELECT o_custkey AS key, o_orderkey AS pos, o_totalprice AS v, CASE o_orderstatus WHEN 'F' THEN 's1' WHEN 'O' THEN 's0' END AS s, o_orderkey % 6 = 0 AS m FROM orders),
g AS (SELECT key, count(*) FILTER (m AND s = 's1') AS n, arg_min(v, pos) FILTER (m AND s = 's1') AS value FROM i GROUP BY 1) SELECT key, CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'measured' ELSE 'unmeasured' END AS status, CASE WHEN n = 1 THEN value END AS value, n AS n_measured FROM g""")
def j20(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "s1").when(F.col("o_orderstatus") == "O", "s0")
    items = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 6 == 0, "measured").otherwise("unmeasured").alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("pos"), s.alias("snapshot"))
    return L.resolve_items(items, "key", "status", "value", "pos", "snapshot", "s1")


@query("j21_applied_by_group", """WITH i AS (SELECT p_partkey AS key, p_retailprice AS v, p_size % 4 <> 0 AS ok, p_size % 2 = 0 AS px, CASE WHEN p_size % 3 = 0 THEN 720.0 ELSE 540.0 END AS w, CASE WHEN p_size % 7 = 0 THEN 540.0 WHEN p_size % 3 = 0 THEN 1280.0 ELSE 960.0 END AS h FROM part),
j AS (SELECT *, CASE WHEN NOT ok THEN 'unmeasured' WHEN px AND abs(w / h - 0.5625) > 0.01 THEN 'other aspect' END AS reason, CASE WHEN px THEN 1080 / w ELSE 1 END AS f FROM i)
SELECT CASE WHEN reason IS NULL THEN 'common' END AS layer, key, NULL AS grp, CASE WHEN reason IS NULL THEN round(v * f, 6) END AS value, false AS gone, reason FROM j
UNION ALL SELECT 'group', key, 'F' || (key % 3), CASE WHEN key % 5 <> 0 THEN round(v * 2 * f, 6) END, key % 5 = 0, NULL FROM j WHERE reason IS NULL""")
def j21(spark, d):
    s = F.col("p_size")
    p = read(spark, d, "part")
    w = F.when(s % 3 == 0, 720.0).otherwise(540.0)
    h = F.when(s % 7 == 0, 540.0).when(s % 3 == 0, 1280.0).otherwise(960.0)
    items = p.select(F.col("p_partkey").alias("key"), F.when(s % 4 != 0, "measured").otherwise("unmeasured").alias("status"), F.when(s % 4 != 0, F.col("p_retailprice")).alias("value"), F.when(s % 2 == 0, "px").otherwise("s").alias("unit"), w.alias("width"), h.alias("height"))
    groups = p.select(F.col("p_partkey").alias("key"), F.concat(F.lit("F"), (F.col("p_partkey") % 3).cast("string")).alias("grp"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") * 2).alias("value"))
    return L.apply_measurements(items, groups, (1080.0, 1920.0)).withColumn("value", S.rounded("value"))


@query("c6_similarity_medoid", """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
s AS (SELECT a.vec_id, a.label, round(sum(list_dot_product(a.u, b.u)), 9) AS near FROM u a JOIN u b USING (label) GROUP BY 1, 2) SELECT label, arg_max(vec_id, {'n': near, 'v': -vec_id}) AS medoid FROM s GROUP BY 1""")
def c6(spark, d):
    return M.similarity_medoid(read(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("j15_listed_term", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'The Listed Shop' WHEN s_suppkey % 3 = 1 THEN 'other name' END AS term FROM supplier""")
def j15(spark, d):
    k = F.col("s_suppkey") % 3
    shown = F.when(k == 0, F.concat("s_name", F.lit(" THE-LISTD shop "), "s_name")).when(k == 1, F.concat(F.lit("my Other Name, "), "s_name")).otherwise(F.col("s_name"))
    return M.listed_term(read(spark, d, "supplier").select("s_suppkey", shown.alias("t")), "s_suppkey", "t", ["The Listed Shop", "other name"])


@query("u4_nested_diff", """WITH o AS (SELECT doc_id, lang, doc_id % 5 = 0 AS gone, lang = 'fr' AS more, doc_id % 2 = 0 AS cut FROM documents),
r AS (SELECT doc_id, 'title' AS section, 0 AS n_added, 1 AS n_removed, 0 AS n_changed FROM o WHERE gone UNION ALL SELECT doc_id, 'meta', 0, 2, 0 FROM o WHERE gone UNION ALL SELECT doc_id, 'meta', 0, cut::INT, more::INT FROM o WHERE NOT gone AND (cut OR more)) SELECT * FROM r""")
def u4(spark, d):
    from ..operators.state import section_diff

    docs = read(spark, d, "documents")
    document = lambda n, s: F.struct(F.col("lang").alias("title"), F.struct(n.alias("n"), s.alias("s")).alias("meta")).alias("d")
    old = docs.select("doc_id", document(F.col("n_chars"), F.col("source")))
    new = docs.where("doc_id % 5 <> 0").select("doc_id", document(F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.when(F.col("doc_id") % 2 != 0, F.col("source"))))
    return section_diff(old, new, "doc_id", "d")


@query("j8_source_repeats", f"""WITH {E}, c AS (SELECT event_id AS id, video_id || '/' || type AS source, t AS ps, "end" AS pe, CASE WHEN event_id % 5 <> 0 THEN t + 0.1 END AS s, CASE WHEN event_id % 5 <> 0 THEN "end" END AS e FROM e),
p AS (SELECT a.id AS first, b.id AS again, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM c a JOIN c b ON a.source = b.source AND a.id < b.id AND a.s < b.e AND a.e > b.s)
SELECT first, again, round(overlap, 6) AS overlap, CASE WHEN again % 2 = 0 THEN 'marked' ELSE 'unmarked' END AS verdict FROM p WHERE overlap > 0.05
UNION ALL SELECT a.id, b.id, NULL, 'unmeasured' FROM c a JOIN c b ON a.source = b.source AND a.id < b.id AND (a.s IS NULL OR b.s IS NULL) AND a.ps - 0.25 < b.pe + 0.25 AND a.pe + 0.25 > b.ps - 0.25""")
def j8(spark, d):
    from ..operators.intervals import repeats_of_source

    e, k = events(spark, d), F.col("event_id")
    measured = k % 5 != 0
    clips = e.select(k.alias("id"), F.concat_ws("/", "video_id", "type").alias("source"), F.col("t").alias("planned_start"), F.col("end").alias("planned_end"), F.when(measured, F.col("t") + 0.1).alias("start"), F.when(measured, F.col("end")).alias("end"), F.lit(None).cast("long").alias("repeat_of"), F.lit("").alias("reason"))
    found = repeats_of_source(clips)
    # clips with an even id are meant to repeat
    verdict = F.when((F.col("verdict") == "unmarked") & (F.col("again") % 2 == 0), "marked").otherwise(F.col("verdict"))
    return found.select("first", "again", S.rounded("overlap").alias("overlap"), verdict.alias("verdict"))


@query("a31_audit", """WITH e AS (SELECT *, CASE p_size % 5 WHEN 0 THEN 'meta' WHEN 1 THEN 'rule' ELSE 'style' END AS c, p_size > 45 AS un, p_partkey % 3 AS readers, p_partkey % 2 AS checks FROM part WHERE p_size % 5 <> 0)
SELECT count(*) FILTER (readers = 0) = 0 AND count(*) FILTER (checks = 0 AND c <> 'rule') = 0 AND count(*) FILTER (un) = 0 AS ok, count(*) FILTER (un) AS unmeasured, count(*) FILTER (readers = 0) AS no_code, count(*) FILTER (checks = 0 AND c <> 'rule') AS no_check, 0 AS not_applicable FROM e""")
def a31(spark, d):
    from ..operators.catalog import registry_audit

    c = F.when(F.col("p_size") % 5 == 0, "meta").when(F.col("p_size") % 5 == 1, "rule").otherwise("style")
    status = F.when(F.col("p_size") > 45, "unmeasured").otherwise("measured")
    return registry_audit(read(spark, d, "part").select(F.col("p_partkey").alias("key"), c.alias("category"), status.alias("status"), F.lit(False).alias("apply_pending"), (F.col("p_partkey") % 3).alias("n_readers"), (F.col("p_partkey") % 2).alias("n_checks")))


@query("a31_registry_sync", """WITH k AS (SELECT 'part.' || p_size || '.' || p_partkey AS key, p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'meta' WHEN 1 THEN 'rule' END AS category, CASE p_partkey % 5 WHEN 0 THEN 'requested_change' WHEN 1 THEN 'measured' ELSE 'base' END AS origin, p_size % 11 = 3 AS not_given FROM part),
i AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'measured' ELSE 'refused' END AS status, CASE WHEN id % 2 = 0 THEN 'e' || id ELSE '' END AS evidence FROM k WHERE id % 4 < 3),
l AS (SELECT ps_partkey AS id, count(DISTINCT ps_suppkey % 10) AS n FROM (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, l_linenumber FROM lineitem) WHERE l_linenumber < 3 GROUP BY 1),
c AS (SELECT 'c' || s_suppkey AS c, CASE s_suppkey % 4 WHEN 0 THEN 'part.' || (s_suppkey % 50) || '.*' WHEN 1 THEN 'part.?.' || s_suppkey || '*' WHEN 2 THEN 'part.[1-3]?.*' || (s_suppkey % 1000) ELSE 'part.1.' || s_suppkey END AS g FROM supplier),
n AS (SELECT key, count(DISTINCT c) AS n FROM k JOIN c ON key GLOB g GROUP BY 1),
s AS (SELECT k.*, i.evidence AS ev, CASE WHEN origin = 'requested_change' THEN 'requested_change' WHEN i.status = 'measured' THEN 'measured' WHEN category = 'meta' THEN 'not_applicable' WHEN category = 'rule' THEN 'fixed_by_rule' WHEN category IS NULL AND not_given THEN 'not_applicable_given' ELSE 'unmeasured' END AS status FROM k LEFT JOIN i USING (id))
SELECT key, coalesce(category, 'style') AS category, status, status = 'measured' AND origin <> 'measured' AS apply_pending, coalesce(l.n, 0) AS n_readers, coalesce(n.n, 0) AS n_checks, coalesce(nullif(ev, ''), CASE WHEN id % 6 = 1 THEN 'old' END) AS evidence, CASE WHEN id % 6 = 1 THEN 'note' || id END AS note
FROM s LEFT JOIN l USING (id) LEFT JOIN n USING (key)""")
def a31_sync(spark, d):
    from ..operators.catalog import registry_sync

    number = lambda size, k: F.concat(F.lit("part."), F.col(size).cast("string"), F.lit("."), F.col(k).cast("string")).alias("key")
    part, id_ = read(spark, d, "part"), F.col("p_partkey")
    category = F.when(F.col("p_size") % 7 == 0, "meta").when(F.col("p_size") % 7 == 1, "rule").alias("category")
    origin = F.when(id_ % 5 == 0, "requested_change").when(id_ % 5 == 1, "measured").otherwise("base").alias("origin")
    keys = part.select(number("p_size", "p_partkey"), category, origin, (F.col("p_size") % 11 == 3).alias("not_given"))
    items = part.where("p_partkey % 4 < 3").select(number("p_size", "p_partkey"), F.when(id_ % 3 == 0, "measured").otherwise("refused").alias("status"), F.when(id_ % 2 == 0, F.concat(F.lit("e"), id_.cast("string"))).otherwise("").alias("evidence"))
    links = read(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").select(number("p_size", "l_partkey"), (F.col("l_suppkey") % 10).alias("reader"), (F.col("l_linenumber") < 3).alias("current"))
    k = F.col("s_suppkey")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    glob = F.when(k % 4 == 0, of("part.", k % 50, ".*")).when(k % 4 == 1, of("part.?.", k, "*")).when(k % 4 == 2, of("part.[1-3]?.*", k % 1000)).otherwise(of("part.1.", k))
    checks = read(spark, d, "supplier").select(of("c", k).alias("check"), glob.alias("pattern"))
    old = part.where("p_partkey % 6 = 1").select(number("p_size", "p_partkey"), F.lit("old").alias("evidence"), of("note", id_).alias("note"))
    return registry_sync(keys, items, links, checks, old)


@query("j11_account_keys", r"""WITH l AS (SELECT s_suppkey AS ref, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS platform, s_suppkey % 4 = 0 AS by_id, s_suppkey % 4 = 1 AS by_page, s_suppkey % 4 < 3 AS by_handle, lpad(s_suppkey::VARCHAR, 6, '0') AS k FROM supplier),
c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS platform, c_custkey % 5 AS f, lpad((c_custkey % 997)::VARCHAR, 6, '0') AS k FROM customer),
m AS (SELECT id, ref, CASE WHEN by_id AND f IN (0, 3) THEN 0 WHEN by_page AND f = 1 THEN 1 WHEN by_handle AND f IN (2, 3) THEN 2 END AS p, c.platform AS cp, l.platform AS lp FROM c JOIN l USING (k))
SELECT id, arg_min(ref, ref) AS ref, arg_min(CASE p WHEN 0 THEN 'id' WHEN 1 THEN 'page' ELSE 'handle' END, ref) AS reason, arg_min(p = 2 AND lp IS NOT NULL AND lp <> cp, ref) AS other_platform FROM m WHERE p IS NOT NULL GROUP BY 1""")
def j11_keys(spark, d):
    from ..operators.exclusions import excluded_accounts

    s, c = F.col("s_suppkey"), F.col("c_custkey")
    of = lambda before, key, after="": F.concat(F.lit(before), F.lpad(key.cast("string"), 6, "0"), F.lit(after))
    listed = read(spark, d, "supplier").select(
        s.alias("ref"), F.when(s % 3 == 0, "a").when(s % 3 == 1, "b").alias("platform"), F.when(s % 4 < 3, of("@Maker-", s)).alias("handle"),
        F.when(s % 4 == 1, of("http://m.clips.example/User/", s, "/")).alias("page"), F.array(F.when(s % 4 == 0, of("UC", s, "x"))).alias("ids"),
    )
    k = c % 997
    fields = F.array(F.when((c % 5).isin(0, 3), of("https://clips.example/c/UC", k, "x/about")), F.when(c % 5 == 1, of("https://www.Clips.example/user/", k, "?tab=1")), F.when((c % 5).isin(2, 3), of("maker_", k)))
    return excluded_accounts(read(spark, d, "customer").select(c.alias("id"), F.when(c % 2 == 0, "a").otherwise("b").alias("platform"), fields.alias("fields")), listed)
