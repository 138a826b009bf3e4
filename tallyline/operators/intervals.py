"""Time on the axis of an entity: gaps, islands, overlaps, nearest and as-of joins. A cell of time is always part of the join key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import table


def gaps(times: DataFrame, spans: DataFrame, entity: str, t: str, duration: str, least: float = 1e-3) -> DataFrame:
    """(entity, gap): lengths between consecutive times, with the edges 0 and duration of each entity; shorter than `least` is none."""
    edges = spans.select(entity, F.explode(F.array(F.lit(0.0), F.col(duration))).alias(t))
    w = Window.partitionBy(entity).orderBy(t)
    return times.select(entity, t).unionByName(edges).withColumn("gap", F.lead(t).over(w) - F.col(t)).where(F.col("gap") > least).select(entity, "gap")


def merge_intervals(rows: DataFrame, entity: str, start: str, end: str, gap: float = 0.0, least: float = 0.0) -> DataFrame:
    """Intervals of an entity that overlap or lie within `gap` as one; results shorter than `least` are dropped."""
    w = Window.partitionBy(entity).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    island = new.withColumn("island", F.sum("new").over(w))
    out = island.groupBy(entity, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))
    return out.where(F.col(end) - F.col(start) >= least).drop("island")


def bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def nearest(left: DataFrame, right: DataFrame, entity: str, t: str, window: float, left_id: str, right_cols: list[str]) -> DataFrame:
    """Each left row with its nearest right row within ±window (dist, right_cols), null if there is none; ties to the smaller right_cols.

    Right rows fall in one bucket of the window's width, left rows look into three: an equi-join whatever the data.
    """
    look = left.withColumn("bucket", F.explode(F.array(*[bucket(F.col(t), window) + k for k in (-1, 0, 1)])))
    r = right.select(F.col(entity).alias("r_entity"), F.col(t).alias("r_t"), *[F.col(c).alias(f"r_{c}") for c in right_cols]).withColumn("r_bucket", bucket(F.col("r_t"), window))
    hits = look.join(r, (look[entity] == r["r_entity"]) & (look["bucket"] == r["r_bucket"])).withColumn("dist", F.abs(F.col("r_t") - F.col(t))).where(F.col("dist") <= window)
    best = hits.groupBy(left_id).agg(F.min(F.struct("dist", *[f"r_{c}" for c in right_cols])).alias("best"))
    return left.join(best, left_id, "left").select(left["*"], F.col("best.dist").alias("dist"), *[F.col(f"best.r_{c}").alias(f"near_{c}") for c in right_cols])


def as_of(left: DataFrame, right: DataFrame, entity: str, t: str, value: str, left_id: str, slack: float = 0.0) -> DataFrame:
    """Each left row with the value of the latest right row at or before t + slack: a union and one window, no join."""
    both = left.select(entity, (F.col(t) + slack).alias("at"), F.lit(1).alias("side"), F.col(left_id).alias("id"), F.lit(None).cast(dict(right.dtypes)[value]).alias("v")).unionByName(
        right.select(entity, F.col(t).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(dict(left.dtypes)[left_id]).alias("id"), F.col(value).alias("v"))
    )
    w = Window.partitionBy(entity).orderBy("at", "side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select(F.col("id").alias(left_id), F.col("v").alias(value))


def _level(start: str, end: str, width: float) -> Column:
    """How often the width must be doubled to hold an interval."""
    return F.when(F.col(end) - F.col(start) <= width, 0).otherwise(F.ceil(F.log2((F.col(end) - F.col(start)) / width))).cast("int")


def _cells(start: str, end: str, level: Column, width: float) -> Column:
    """The cells of a level that an interval touches, as (level, cell)."""
    size = F.lit(width) * F.pow(F.lit(2.0), level)
    return F.transform(F.sequence(F.floor(F.col(start) / size).cast("long"), F.floor(F.col(end) / size).cast("long")), lambda c: F.struct(level.alias("level"), c.alias("cell")))


def _above(start: str, end: str, first: Column, top: Column, width: float) -> Column:
    """The cells of all levels from first to top; none if first is above."""
    return F.when(first <= top, F.flatten(F.transform(F.sequence(first, F.greatest(first, top)), lambda k: _cells(start, end, k, width)))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def _top(width: float, *sides: tuple[DataFrame, str, str]) -> DataFrame:
    """One row: the level of the longest interval."""
    levels = [df.agg(F.max(_level(start, end, width)).alias("top")) for df, start, end in sides]
    both = levels[0] if len(levels) == 1 else levels[0].unionByName(levels[1])
    return F.broadcast(both.agg(F.coalesce(F.max("top"), F.lit(0)).cast("int").alias("top")))


def overlaps(left: DataFrame, right: DataFrame, entity: str, width: float, more: Column | None = None) -> DataFrame:
    """Pairs of intervals of an entity that overlap, with the overlap's length. Columns start, end, id on both sides, as a_ and b_.

    Time is a grid for each doubling of the width. An interval belongs to the level whose cells are as long as it is, where it touches two or three, and is
    listed in the cells of all higher levels that occur, so its rows grow with the logarithm of the longest length and never with its own. A pair
    meets on the level of its longer interval, and is kept in the cell where the overlap starts.
    """
    named = lambda df, p: df.select(entity, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != entity]).where(F.col(f"{p}_start") <= F.col(f"{p}_end")).withColumn(f"{p}_level", _level(f"{p}_start", f"{p}_end", width))
    a, b = named(left, "a"), named(right, "b")
    top = _top(width, (a, "a_start", "a_end"), (b, "b_start", "b_end"))
    # the left side at its own level meets the right side at that level or, coming from below, above its own; and the other way about
    listed = lambda xs, by_left: F.transform(xs, lambda x: F.struct(x["level"].alias("level"), x["cell"].alias("cell"), F.lit(by_left).alias("by_left")))
    own = lambda p: _cells(f"{p}_start", f"{p}_end", F.col(f"{p}_level"), width)
    over = lambda p: _above(f"{p}_start", f"{p}_end", F.col(f"{p}_level") + 1, F.col("top"), width)
    cut = lambda df, p, *lists: df.crossJoin(top).withColumn("at", F.explode(F.concat(*lists))).select(entity, *[c for c in df.columns if c not in (entity, f"{p}_level")], "at.level", "at.cell", "at.by_left")
    met = cut(a, "a", listed(own("a"), True), listed(over("a"), False)).join(cut(b, "b", listed(F.concat(own("b"), over("b")), True), listed(own("b"), False)), [entity, "level", "cell", "by_left"])
    low = F.greatest("a_start", "b_start")
    hit = met.where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.col("cell") == F.floor(low / (F.lit(width) * F.pow(F.lit(2.0), F.col("level"))))))
    if more is not None:
        hit = hit.where(more)
    return hit.withColumn("overlap", F.least("a_end", "b_end") - low).drop("level", "cell", "by_left")


def points_in(points: DataFrame, spans: DataFrame, entity: str, width: float, margin: float = 0.0) -> DataFrame:
    """Points (t, id) strictly inside intervals (start, end, id) of the entity, by more than `margin` from both ends, as p_ and s_. Levels are those of `overlaps`; a point is listed once on each that occurs."""
    s = spans.select(entity, F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("id").alias("s_id")).where("s_start <= s_end").withColumn("level", _level("s_start", "s_end", width))
    p = points.select(entity, F.col("t").alias("p_t"), F.col("id").alias("p_id")).where("p_t IS NOT NULL").crossJoin(_top(width, (s, "s_start", "s_end")))
    p = p.withColumn("at", F.explode(_above("p_t", "p_t", F.lit(0), F.col("top"), width))).select(entity, "p_t", "p_id", "at.level", "at.cell")
    s = s.withColumn("at", F.explode(_cells("s_start", "s_end", F.col("level"), width))).select(entity, "s_start", "s_end", "s_id", "level", "at.cell")
    return p.join(s, [entity, "level", "cell"]).where((F.col("p_t") > F.col("s_start") + margin) & (F.col("p_t") < F.col("s_end") - margin)).drop("level", "cell")


#: Operations on an overlay for which its time is cut once more.
PER_CUT = 64


def covered_volume(box: np.ndarray, ops: np.ndarray) -> float:
    """How much of (t1, t2, x1, x2, y1, y2) the union of ops of that form covers.

    Time is swept by the ops' ends. In each slice x is swept by the edges of the active ops, which count up and down the
    segments of y that they hold; a segment counts as covered while its count is above 0.
    """
    ops = np.clip(ops, box[[0, 0, 2, 2, 4, 4]], box[[1, 1, 3, 3, 5, 5]])
    ops = ops[(ops[:, 0] < ops[:, 1]) & (ops[:, 2] < ops[:, 3]) & (ops[:, 4] < ops[:, 5])]
    total = 0.0
    ts = np.unique(ops[:, :2])
    for low, high in zip(ts, ts[1:], strict=False):
        now = ops[(ops[:, 0] <= low) & (ops[:, 1] >= high)]
        if not len(now):
            continue
        ys = np.unique(now[:, 4:])
        length, count = np.diff(ys), np.zeros(len(ys) - 1, np.int64)
        first, last = np.searchsorted(ys, now[:, 4]), np.searchsorted(ys, now[:, 5])
        edges = np.concatenate((now[:, 2], now[:, 3]))
        area, held, at = 0.0, 0.0, 0.0
        for k in np.argsort(edges, kind="stable"):
            area += held * (edges[k] - at)
            at, op, step = edges[k], k % len(now), 1 if k < len(now) else -1
            part = count[first[op] : last[op]]
            before = part > 0
            part += step
            held += float(((part > 0).astype(float) - before) @ length[first[op] : last[op]])
        total += area * (high - low)
    return total


def rectangle_coverage(overlays: DataFrame, ops: DataFrame, entity: str, width: float = 24.0, per_cut: int = PER_CUT) -> DataFrame:
    """(id, covered, share): is each overlay's rectangle covered by active rectangles over its whole span, and the share of its span times area.

    Both: entity, id, start, end, x, y, w, h. Both results are null for an overlay without span or area. Ops that touch an overlay are dealt over equal
    parts of its time, one for each `per_cut` of them, so that many ops on one overlay are many tasks; a part is swept by `covered_volume`, whose
    work is the square of the ops active in it.
    """
    touch = (F.col("a_x") < F.col("b_x") + F.col("b_w")) & (F.col("b_x") < F.col("a_x") + F.col("a_w")) & (F.col("a_y") < F.col("b_y") + F.col("b_h")) & (F.col("b_y") < F.col("a_y") + F.col("a_h"))
    num = lambda df: df.select(entity, "id", *[F.col(c).cast("double").alias(c) for c in ("start", "end", "x", "y", "w", "h")])
    hits = table(overlaps(num(overlays).where("start < end AND w > 0 AND h > 0"), num(ops), entity, width, touch), "hits")
    cuts = hits.groupBy("a_id").agg(F.ceil(F.count(F.lit(1)) / per_cut).cast("int").alias("cuts"))
    part = (F.col("a_end") - F.col("a_start")) / F.col("cuts")
    place = lambda t: F.least(F.greatest(F.floor((F.col(t) - F.col("a_start")) / part).cast("int"), F.lit(0)), F.col("cuts") - 1)
    dealt = hits.join(cuts, "a_id").withColumn("cut", F.explode(F.sequence(place("b_start"), place("b_end"))))
    edge = lambda k: F.when(k == F.col("cuts"), F.col("a_end")).otherwise(F.col("a_start") + part * k)
    sides = lambda p: [F.col(f"{p}_x"), F.col(f"{p}_x") + F.col(f"{p}_w"), F.col(f"{p}_y"), F.col(f"{p}_y") + F.col(f"{p}_h")]
    rows = dealt.select("a_id", "cut", F.array(edge(F.col("cut")), edge(F.col("cut") + 1), *sides("a")).alias("box"), F.array("b_start", "b_end", *sides("b")).alias("op"))

    @F.pandas_udf("double")
    def swept(boxes: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([covered_volume(np.array(b, float), np.array(list(o), float)) for b, o in zip(boxes, many, strict=True)], dtype=float)

    parts = rows.groupBy("a_id", "cut").agg(F.first("box").alias("box"), F.collect_list("op").alias("ops"))
    volume = parts.select("a_id", swept("box", "ops").alias("v")).groupBy("a_id").agg(F.sum("v").alias("v"))
    j = overlays.join(volume, overlays["id"] == volume["a_id"], "left")
    share = F.coalesce("v", F.lit(0.0)) / F.nullif((F.col("end") - F.col("start")) * F.col("w") * F.col("h"), F.lit(0.0))
    return j.select("id", (share >= 1 - 1e-9).alias("covered"), F.round(share, 6).alias("share"))


def repeats_of_source(clips: DataFrame, cell: float = 24.0, least: float = 0.05, near: float = 0.5) -> DataFrame:
    """(first, again, overlap, verdict): clips of one source that show the same stretch of it twice.

    clips: (id, source, planned_start, planned_end, start, end, repeat_of, reason); start and end are null where the stretch was
    not measured. A measured overlap above `least` is marked, if the later clip (by id) names the first one and a reason, else
    unmarked; a pair with a clip that was not measured is unmeasured, if the plan brings the two within `near` of each other.
    """
    known = clips.where("start IS NOT NULL AND end IS NOT NULL").select("source", "start", "end", "id", "repeat_of", "reason")
    marked = F.coalesce((F.col("b_repeat_of") == F.col("a_id")) & (F.trim("b_reason") != ""), F.lit(False))
    pairs = overlaps(known, known, "source", cell, F.col("a_id") < F.col("b_id")).where(F.col("overlap") > least)
    seen = pairs.select(F.col("a_id").alias("first"), F.col("b_id").alias("again"), "overlap", F.when(marked, "marked").otherwise("unmarked").alias("verdict"))
    planned = clips.select("source", (F.col("planned_start") - near / 2).alias("start"), (F.col("planned_end") + near / 2).alias("end"), "id", (F.col("start").isNull() | F.col("end").isNull()).alias("blind"))
    blind = overlaps(planned, planned, "source", cell, (F.col("a_id") < F.col("b_id")) & (F.col("a_blind") | F.col("b_blind")))
    return seen.unionByName(blind.select(F.col("a_id").alias("first"), F.col("b_id").alias("again"), F.lit(None).cast("double").alias("overlap"), F.lit("unmeasured").alias("verdict")))
