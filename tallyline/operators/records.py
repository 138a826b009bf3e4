"""Records of sources in one form, sets above a threshold, and provenance that people saw beside what a platform states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .observations import stripped

#: Longest description, most tags, and what a rounded count may miss of the threshold.
DESCRIPTION, TAGS, MARGIN = 4000, 30, 0.9
EXACT = ("video_metadata", "latest100_snapshot")


def common_record(infos: DataFrame, platform: str, view_fields: tuple[str, ...]) -> DataFrame:
    """Metadata of a downloader in one form, one row for each row of infos.

    Columns that infos lacks are null; of fields that mean the same the first that isn't empty counts. Views come from
    view_fields alone, never from likes, with the field they come from. Times before days; a time is written in UTC. Width and
    height that are missing or 0 come from the tallest of formats, the first of equal ones.
    """
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in infos.columns else none
    text = lambda *names: F.coalesce(*[F.nullif(col(n).cast("string"), F.lit("")) for n in names])
    count = lambda c: X.first_count([(c, F.regexp_replace(col(c).cast("string"), r"\.[0-9]+$", ""))])[0]
    views, field = X.first_count([(f, col(f).cast("string")) for f in view_fields])

    def moment(c: str) -> Column:
        seconds = F.floor(col(c).cast("string").try_cast("double"))
        utc = F.to_utc_timestamp(F.timestamp_seconds(F.when(seconds > 0, seconds)), F.current_timezone())
        return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")

    day = lambda c: F.when(F.rlike(col(c).cast("string"), F.lit("^[0-9]{8}$")), F.regexp_replace(col(c).cast("string"), "^(....)(..)(..)$", "$1-$2-$3"))
    dates = {c: moment(c) for c in ("timestamp", "release_timestamp")} | {c: day(c) for c in ("upload_date", "release_date")}
    width, height = (F.when(count(c) > 0, count(c)) for c in ("width", "height"))
    if "formats" in infos.columns:
        best = X.best_by(F.filter("formats", lambda f: f["height"] > 0), lambda f: f["height"])
        whole = width.isNotNull() & height.isNotNull()
        width, height = (F.when(whole | best.isNull(), c).otherwise(best[n].cast("long")) for c, n in ((width, "width"), (height, "height")))
    tags = F.slice("tags", 1, TAGS) if "tags" in infos.columns else F.lit(None).cast("array<string>")
    return infos.select(
        F.lit(platform).alias("platform"), F.coalesce(col("id").cast("string"), F.lit("")).alias("platform_id"), text("webpage_url", "original_url", "url").alias("url"),
        text("title", "fulltitle").alias("title"), F.left(text("description"), F.lit(DESCRIPTION)).alias("description"), text("uploader", "channel", "creator").alias("uploader"),
        text("uploader_id", "channel_id").alias("uploader_id"), text("uploader_url", "channel_url").alias("uploader_url"), views.alias("views"),
        F.when(views.isNotNull(), "platform_metadata").otherwise("unavailable").alias("views_source"), field.alias("views_field"), count("like_count").alias("likes"), count("comment_count").alias("comments"),
        F.coalesce(*dates.values()).alias("published_at"), F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for c, v in dates.items()]).alias("published_at_source"),
        col("duration").cast("string").try_cast("double").alias("duration"), width.alias("width"), height.alias("height"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
    )


def threshold_sets(items: DataFrame, listing: DataFrame, failures: DataFrame, skipped: DataFrame, id_: str, threshold: float, margin: float = MARGIN, exact: tuple[str, ...] = EXACT) -> DataFrame:
    """(id, state, approx, reason): above (an exact count reaches the threshold), below, or unverified with the reason.

    items: (id, count, source); a count is exact if its source is one of exact, and only the first of them also shows that it is below,
    as counts rise. listing: (id, approx), rounded counts: under margin * threshold is below. failures: (id, pos, error): the last
    by pos is the reason; skipped: (id) was never asked. An id of several listings has the largest; each table meets the items by id.
    """
    shown = listing.groupBy(id_).agg(F.max("approx").alias("approx"))
    failed = failures.groupBy(id_).agg(F.max_by("error", "pos").alias("error"), F.lit(True).alias("_failed"))
    j = items.select(id_, "count", "source").join(shown, id_, "left").join(failed, id_, "left").join(skipped.select(id_).distinct().withColumn("_skipped", F.lit(True)), id_, "left")
    above = F.coalesce(F.col("source").isin(*exact) & (F.col("count") >= threshold), F.lit(False))
    below = F.coalesce(F.col("source") == exact[0], F.lit(False)) | F.coalesce(F.col("approx") < margin * threshold, F.lit(False))
    state = F.when(above, "above").when(below, "below").otherwise("unverified")
    reason = (
        F.when(F.col("_failed"), F.concat(F.lit("failed: "), F.left(F.coalesce("error", F.lit("")), F.lit(200))))
        .when(F.col("_skipped"), "not asked")
        .when(F.col("approx").isNotNull(), "only a rounded count")
        .otherwise("no count")
    )
    return j.withColumn("state", state).select(id_, "state", "approx", F.when(F.col("state") == "unverified", reason).alias("reason"))


def _alnum(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^0-9a-z가-힣]", "")


def _is_time(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$")) & text.try_cast("timestamp").isNotNull()


SEEN = ("uploader", "published_at", "original_url", "original_published_at", "original_author", "views", "views_checked_at")


def checked_observations(seen: DataFrame) -> DataFrame:
    """seen with refused: null, or why an observation of a page can't be used; empty texts are null.

    seen: (by, uploader, published_at, original_url, original_published_at, original_author, views_checked_at: text, views: long).
    nothing seen, no observer, not a time, views without a date (or a date without views), views below 0.
    """
    rows = seen.withColumns({c: F.nullif(stripped(F.col(c)), F.lit("")) for c in ("by", *SEEN) if c != "views"})
    times = [F.col(c).isNotNull() & ~F.coalesce(_is_time(F.col(c)), F.lit(False)) for c in ("published_at", "original_published_at", "views_checked_at")]
    refused = (
        F.when(F.coalesce(*[F.col(c).cast("string") for c in SEEN]).isNull(), "nothing seen")
        .when(F.col("by").isNull(), "no observer")
        .when(times[0] | times[1] | times[2], "not a time")
        .when(F.col("views").isNull() != F.col("views_checked_at").isNull(), "views and their date belong together")
        .when(F.col("views") < 0, "views below 0")
    )
    return rows.withColumn("refused", refused)


def apply_observations(records: DataFrame, seen: DataFrame, id_: str) -> DataFrame:
    """Records with what people saw on their pages, in the order of pos, beside what the platform states.

    records: one row for each id, (id, uploader, uploader_source, published_at, published_at_source, original_url, original_published_at, views);
    seen: (id, pos, and the columns of checked_observations); refused ones change nothing. The platform's uploader stays (its
    spelling may be corrected), unless it was read from an address (url_path) or is missing: then the first name seen stands.
    The platform's date stays, a missing one is the last seen. Original address, date and author are the last seen; the author's
    address is the one known when it was noted. Views seen never replace views: they are views_manual, with date and observer.
    n_seen counts the observations used, n_noted those whose uploader or date was only noted.
    Two aggregations by id and joins on it; nothing of an id is gathered.
    """
    use = checked_observations(seen).where("refused IS NULL").select(id_, "pos", "by", *SEEN)
    last = lambda c, value=None: F.max_by(F.col(c) if value is None else value, F.when(F.col(c).isNotNull(), F.col("pos")))
    heads = use.groupBy(id_).agg(F.min_by("uploader", F.when(F.col("uploader").isNotNull(), F.col("pos"))).alias("_first"), F.max(F.when(F.col("original_author").isNotNull(), F.col("pos"))).alias("_author_pos"))
    stated = (F.coalesce("uploader", F.lit("")) != "") & ~F.coalesce(F.col("uploader_source") == "url_path", F.lit(False))
    dated = (F.coalesce("published_at", F.lit("")) != "") & (F.coalesce("published_at_source", F.lit("")) != "") & ~F.coalesce(F.col("published_at_source").startswith("manual_observation"), F.lit(False))
    base = records.join(heads, id_, "left").withColumn("_name", F.when(stated, F.col("uploader")).otherwise(F.coalesce("_first", "uploader"))).withColumn("_dated", dated)
    match = use.join(base.select(id_, F.col("_name"), "_author_pos", "_dated"), id_)
    same = F.col("uploader").isNotNull() & (_alnum(F.col("uploader")) == _alnum(F.col("_name")))
    noted = (F.col("uploader").isNotNull() & ~same) | (F.col("published_at").isNotNull() & F.col("_dated"))
    given = lambda c: F.struct(F.col(c).alias("v"), F.concat(F.lit("manual_observation:"), F.col("by")).alias("src"))
    found = match.groupBy(id_).agg(
        F.max_by(given("uploader"), F.when(same, F.col("pos"))).alias("_up"), last("published_at", given("published_at")).alias("_pub"),
        last("original_url").alias("_url"), last("original_published_at", given("original_published_at")).alias("_opub"), last("original_author", given("original_author")).alias("_author"),
        F.max_by("original_url", F.when(F.col("original_url").isNotNull() & (F.col("pos") <= F.col("_author_pos")), F.col("pos"))).alias("_author_url"),
        last("views", F.struct("views", "views_checked_at", "by")).alias("_views"), F.count(F.lit(1)).alias("_n"), F.count(F.when(noted, 1)).alias("_noted"),
    )
    j = base.join(found, id_, "left")
    pub = F.when(F.col("_dated") | F.col("_pub").isNull(), F.struct(F.col("published_at").alias("v"), F.col("published_at_source").alias("src"))).otherwise(F.col("_pub"))
    return j.withColumn("_p", pub).select(
        id_, F.coalesce("_up.v", "uploader").alias("uploader"), F.coalesce("_up.src", "uploader_source").alias("uploader_source"), F.col("_p.v").alias("published_at"), F.col("_p.src").alias("published_at_source"),
        F.coalesce("_url", "original_url").alias("original_url"), F.coalesce("_opub.v", "original_published_at").alias("original_published_at"), F.col("_author.v").alias("original_author"),
        F.when(F.col("_author").isNotNull(), F.coalesce("_author_url", "original_url")).alias("original_author_url"), "views", F.col("_views.views").alias("views_manual"),
        F.col("_views.views_checked_at").alias("views_checked_at"), F.col("_views.by").alias("views_by"), F.coalesce("_n", F.lit(0)).alias("n_seen"), F.coalesce("_noted", F.lit(0)).alias("n_noted"),
    )
