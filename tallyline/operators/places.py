"""Rectangles in the same place: groups around first members, what speaks against a group, and decisions that are kept."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import table
from .intervals import overlaps
from .stats import rounded

#: Two rectangles are in one place from this intersection over union, and look alike from this product of their (unit) vectors.
IOU, ALIKE = 0.5, 0.6
#: So many open rectangles or fewer are ended by a loop over them in their order, instead of by further rounds.
FEW = 20_000
#: Where a mark of its own is expected: centres within these shares of the frame from an edge of each axis, up to this area.
CORNER_X, CORNER_Y, LARGEST = 0.3, 0.2, 0.02
#: A member whose rectangle a caption covers by more than this share, at a common time, may be a caption.
COVERED = 0.3


def _span(a: str, b: str, p: str, s: str) -> Column:
    """Length that two intervals p, p + s share on an axis; the columns' names have prefixes."""
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}{p}") + F.col(f"{a}{s}"), F.col(f"{b}{p}") + F.col(f"{b}{s}")) - F.greatest(F.col(f"{a}{p}"), F.col(f"{b}{p}")))


def shared_area(a: str, b: str) -> Column:
    return _span(a, b, "x", "w") * _span(a, b, "y", "h")


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection over union of two rectangles x, y, w, h whose columns have prefixes."""
    both = shared_area(a, b)
    return both / (F.col(f"{a}w") * F.col(f"{a}h") + F.col(f"{b}w") * F.col(f"{b}h") - both)


def _level(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def home(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """The cell of a rectangle: its levels, by powers of two of its sides, and the cell of its centre in a grid of twice that size."""
    at = lambda p, s: F.floor((F.col(p) + F.col(s) / 2) / F.pow(F.lit(2.0), _level(F.col(s)) + 1)).cast("long")
    return F.struct(_level(F.col(w)).alias("lw"), _level(F.col(h)).alias("lh"), at(x, w).alias("cx"), at(y, h).alias("cy"))


def reach(iou: float, x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """The cells in which rectangles of at least that intersection over union can lie, as an array.

    The ratio is at most that of the sides, which bounds the levels; and centres are apart by at most (1 - iou) times the larger side.
    """
    more = math.ceil(-math.log2(iou) - 1e-9)

    def axis(p: str, s: str) -> Column:
        def cells(d: int) -> Column:
            size = F.pow(F.lit(2.0), _level(F.col(s)) + 1 + d)
            far = (1 - iou) * F.greatest(F.col(s), size) * (1 + 1e-9)
            centre = F.col(p) + F.col(s) / 2
            span = F.sequence(F.floor((centre - far) / size).cast("long"), F.floor((centre + far) / size).cast("long"))
            return F.transform(span, lambda c: F.struct((_level(F.col(s)) + d).alias("l"), c.alias("c")))

        return F.flatten(F.array(*[cells(d) for d in range(-more, more + 1)]))

    return F.flatten(F.transform(axis(x, w), lambda a: F.transform(axis(y, h), lambda b: F.struct(a["l"].alias("lw"), b["l"].alias("lh"), a["c"].alias("cx"), b["c"].alias("cy")))))


def _alike(a: str, b: str, iou: float, look: str | None, alike: float) -> Column:
    near = overlap_ratio(a, b) >= iou
    if look is None:
        return near
    dot = F.aggregate(F.zip_with(F.col(f"{a}look"), F.col(f"{b}look"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return near & (F.col(f"{a}named") | F.coalesce(dot >= alike, F.lit(False)))


def _in_order(iou: float, alike: float | None):
    """A function of pandas rows: those that begin a group, when they come one by one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        box = rows[["x", "y", "w", "h"]].to_numpy(float)
        look = rows["look"].tolist() if alike is not None else []
        first, begun = np.empty_like(box), []
        for k, (x, y, w, h) in enumerate(box):
            f = first[: len(begun)]
            both = np.maximum(0.0, np.minimum(x + w, f[:, 0] + f[:, 2]) - np.maximum(x, f[:, 0])) * np.maximum(0.0, np.minimum(y + h, f[:, 1] + f[:, 3]) - np.maximum(y, f[:, 1]))
            near = np.flatnonzero(both / (w * h + f[:, 2] * f[:, 3] - both) >= iou)
            if alike is not None and not rows["named"].iat[k]:
                near = [i for i in near if look[begun[i]] is not None and float(np.dot(look[k], look[begun[i]])) >= alike]
            if not len(near):
                first[len(begun)] = box[k]
                begun.append(k)
        return rows[["node"]].iloc[begun]

    return run


def first_members(boxes: DataFrame, id_: str, by: list[str] | None = None, iou: float = IOU, look: str | None = None, named: str | None = None, alike: float = ALIKE) -> DataFrame:
    """(id, place): rectangles x, y, w, h, in the order of their ids, join the first group whose first member is in the same place, or begin one; place is the first member's id.

    Groups have equal `by` (null is a value). With a column `look` of unit vectors the first member must look alike too, but
    for rows that have a name in `named`, which must be equal. Rectangles without area, and unnamed ones without a look, are alone.
    Ids are distinct and can be ordered.

    A rectangle begins a group if no earlier one that is still open lies in the cells it reaches; what such a first member
    attracts is closed, and so on until nothing is open, or few are. So rows meet first members only, never one another, however many lie in one place.
    """
    keys = [*(by or []), *([named] if named else [])]
    rows = boxes.select(F.col(id_).alias("node"), F.to_json(F.struct(*keys)).alias("k") if keys else F.lit("").alias("k"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")],
                        *([F.col(look).cast("array<double>").alias("look"), (F.col(named).isNotNull() if named else F.lit(False)).alias("named")] if look else []))
    rows = table(rows, "boxes")
    sized = rows.where("w > 0 AND h > 0")
    shape = ["k", "x", "y", "w", "h"]
    if look:
        nodes = sized.where("named OR look IS NOT NULL")
        more = ["look", "named"]
    else:  # equal rectangles are one, so a common place is no large group
        nodes, more = sized.groupBy(*shape).agg(F.min("node").alias("node")), []
    nodes = table(nodes.select("node", *shape, *more), "nodes")
    looking = lambda df: df.withColumn("home", F.explode(reach(iou)))
    first_of = lambda df: df.select("k", home().alias("home"), *[F.col(c).alias(f"f_{c}") for c in ("node", "x", "y", "w", "h", *more)])
    link = _alike("", "f_", iou, look, alike) & (F.col("f_node") <= F.col("node"))
    firsts, still = None, nodes
    while left := still.limit(FEW + 1).count():
        if left <= FEW:
            begin = still.groupBy("k").applyInPandas(_in_order(iou, alike if look else None), nodes.select("node").schema)
            new = table(still.join(begin, "node", "left_semi"), "firsts")
            firsts = new if firsts is None else firsts.unionByName(new)
            break
        least = still.groupBy("k", home().alias("home")).agg(F.min("node").alias("least"))
        low = looking(still.select("node", *shape)).join(least, ["k", "home"]).groupBy("node").agg(F.min("least").alias("low")).where("low = node").select("node")
        new = table(still.join(low, "node", "left_semi"), "firsts")
        firsts = new if firsts is None else firsts.unionByName(new)
        closed = looking(still).join(first_of(new), ["k", "home"]).where(link).select("node").distinct()
        still = table(still.join(closed, "node", "left_anti"), "open")
    if firsts is None:
        return rows.select(F.col("node").alias(id_), F.col("node").alias("place"))
    joined = table(looking(nodes).join(first_of(firsts), ["k", "home"]).where(link).groupBy("node").agg(F.min("f_node").alias("place")), "joined")
    if look:
        placed = rows.join(joined, "node", "left")
    else:
        own = nodes.join(joined, "node").select(*[F.col(c).alias(f"n_{c}") for c in shape], "place")
        placed = rows.join(own, [F.col(c) == F.col(f"n_{c}") for c in shape], "left")
    return placed.select(F.col("node").alias(id_), F.coalesce("place", "node").alias("place"))


def place_groups(boxes: DataFrame, entity: str, id_: str, iou: float = IOU, least: int = 2, share: float = 0.2, by: list[str] | None = None, look: str | None = None, named: str | None = None) -> DataFrame:
    """(place, n, n_entities, share, recurs): the groups of `first_members` over entities; recurs: at least `least` entities and that share of all entities."""
    total = boxes.agg(F.count_distinct(entity).alias("total"))
    g = boxes.select(id_, entity).join(first_members(boxes, id_, by, iou, look, named), id_)
    g = g.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("n_entities")).crossJoin(F.broadcast(total))
    return g.select("place", "n", "n_entities", rounded(F.col("n_entities") / F.col("total")).alias("share"), ((F.col("n_entities") >= least) & (F.col("n_entities") >= share * F.col("total"))).alias("recurs"))


def same_place(members: DataFrame, entity: str, iou: float = IOU, by: list[str] | None = None) -> DataFrame:
    """(place, into): groups in one place that share an entity are one mark seen in two ways; each goes to the first such group that goes to no other.

    members: (place, id, entity, x, y, w, h and `by`); a group's rectangle is that of its first member, whose id is the place.
    """
    heads = members.where("id = place").select("place", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], (F.to_json(F.struct(*by)) if by else F.lit("")).alias("k"))
    a = heads.where("w > 0 AND h > 0").withColumn("home", F.explode(reach(iou)))
    b = heads.where("w > 0 AND h > 0").select("k", home().alias("home"), *[F.col(c).alias(f"f_{c}") for c in ("place", "x", "y", "w", "h")])
    near = a.join(b, ["k", "home"]).where((F.col("f_place") < F.col("place")) & (overlap_ratio("", "f_") >= iou)).select("place", F.col("f_place").alias("before"))
    seen = members.select("place", entity).distinct()
    links = table(near.join(seen, "place").join(seen.select(F.col("place").alias("before"), entity), ["before", entity]).select("place", "before").distinct(), "links")
    # a group whose earlier partners all go elsewhere stays; one with an earlier partner that stays goes
    known = table(heads.select("place").join(links.select("place"), "place", "left_anti").withColumn("stays", F.lit(True)), "known")
    while True:
        before = links.join(known.withColumnRenamed("place", "before"), "before", "left").join(known.select("place"), "place", "left_anti")
        verdict = before.groupBy("place").agg(F.bool_or(F.coalesce("stays", F.lit(False))).alias("goes"), F.bool_and(F.coalesce(~F.col("stays"), F.lit(False))).alias("free")).where("goes OR free")
        new = table(verdict.select("place", (~F.col("goes")).alias("stays")), "verdict")
        if new.limit(1).count() == 0:
            break
        known = known.unionByName(new)
    into = links.join(known.where("stays").select(F.col("place").alias("before")), "before").join(known.where("NOT stays").select("place"), "place", "left_semi").groupBy("place").agg(F.min("before").alias("into"))
    return heads.select("place").join(into, "place", "left").select("place", F.coalesce("into", "place").alias("into"))


def recurrence_doubt(members: DataFrame, captions: DataFrame, looked: DataFrame, entity: str, cell: float = 24.0) -> DataFrame:
    """(place, doubt): why a group is not taken for a mark by itself, null if nothing speaks against it.

    caption: a member is covered by a caption of its entity by more than COVERED, while both are shown; no captions: one of its entities was not
    looked at; position: the first member lies in no corner, or is too large. members: (place, id, entity, start, end, x, y, w, h) as shares
    of the frame; an unknown start or end is open. captions: (id, entity, start, end, x, y, w, h); looked: the entities with captions read.
    """
    span = [F.coalesce(F.col("start").cast("double"), F.lit(0.0)).alias("start"), F.coalesce(F.col("end").cast("double"), F.lit(1e9)).alias("end")]
    side = lambda df, *more: df.select(entity, "id", *more, *span, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    covered = shared_area("a_", "b_") / F.greatest(F.lit(1e-9), F.col("a_w") * F.col("a_h")) > COVERED
    over = overlaps(side(members, "place"), side(captions), entity, cell, covered).select(F.col("a_place").alias("place")).distinct().withColumn("over", F.lit(True))
    blind = members.select("place", entity).distinct().join(looked.select(entity).distinct(), entity, "left_anti").select("place").distinct().withColumn("blind", F.lit(True))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    corner = ((cx < CORNER_X) | (cx > 1 - CORNER_X)) & ((cy < CORNER_Y) | (cy > 1 - CORNER_Y)) & (F.col("w") * F.col("h") <= LARGEST)
    heads = members.where("id = place").select("place", corner.alias("corner"))
    return heads.join(over, "place", "left").join(blind, "place", "left").select("place", F.when(F.col("over"), "caption").when(F.col("blind"), "no captions").when(~F.col("corner"), "position").alias("doubt"))


def kept_decisions(groups: DataFrame, decisions: DataFrame, by: list[str], iou: float = IOU) -> DataFrame:
    """(place, decision, signer): the latest decision about a group of equal `by` in the same place, null without one.

    groups: (place, x, y, w, h and `by`); decisions: (at, decision, signer, x, y, w, h and `by`); of one time the larger decision and signer.
    Equal rectangles meet as one, and a decision is a number in their order, so pairs are folded by a hash aggregation as they come.
    """
    box = ["x", "y", "w", "h"]
    sized = lambda df, *more: df.where("w > 0 AND h > 0").select(*by, *[F.col(c).cast("double").alias(c) for c in box], *more)
    shapes = sized(groups).distinct().withColumn("home", home())
    newest = sized(decisions, F.struct("at", "decision", "signer").alias("d")).groupBy(*by, *box).agg(F.max("d").alias("d"))
    made = table(newest.orderBy("d").withColumn("rank", F.monotonically_increasing_id()), "decisions")
    b = made.select(*by, F.explode(reach(iou)).alias("home"), *[F.col(c).alias(f"f_{c}") for c in box], "rank")
    last = shapes.join(b, [*by, "home"]).where(overlap_ratio("", "f_") >= iou).groupBy(*by, *box).agg(F.max("rank").alias("rank"))
    known = last.join(made.select("rank", "d"), "rank").select(*[F.col(c).alias(f"n_{c}") for c in (*by, *box)], "d")
    return groups.join(known, [F.col(c) == F.col(f"n_{c}") for c in (*by, *box)], "left").select("place", F.col("d.decision").alias("decision"), F.col("d.signer").alias("signer"))
