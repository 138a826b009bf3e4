"""Lines and items of text on a screen: tracks that broke, lines that are one item, and the role of each item."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import color_distance, rgb
from ..sources.files import table
from .colors import color_mode
from .intervals import overlaps
from .matching import chained

#: Characters of quotations.
QUOTES = "\"“”„‟'‘’「」『』《》"
#: Seconds below which times count as equal.
SLACK = 1e-6


def letters(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z가-힣]", "")


def same_line() -> Column:
    """Whether a line and the one that follows it (b_) are one: on one row (70 % of the lower), one above the other (half of the narrower), of one ink height (20 %), of one colour (40), and of one reading the letters within the other."""
    shared = lambda p, s: F.least(F.col(p) + F.col(s), F.col(f"b_{p}") + F.col(f"b_{s}")) - F.greatest(F.col(p), F.col(f"b_{p}"))
    ink, b_ink = F.col("ink_h"), F.col("b_ink_h")
    a, b = letters(F.col("text")), letters(F.col("b_text"))
    rows = (shared("y", "h") >= 0.7 * F.least("h", "b_h")) & (shared("x", "w") >= 0.5 * F.least("w", "b_w"))
    sizes = (ink > 0) & (b_ink > 0) & (F.greatest(ink, b_ink) <= 1.2 * F.least(ink, b_ink))
    return F.coalesce(rows & sizes & (color_distance(F.col("color"), F.col("b_color")) <= 40) & (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def merge_split_lines(lines: DataFrame, by: list[str], dt: float) -> DataFrame:
    """The lines of each entity, broken tracks joined: (id, n_tracks, n_samples, start, end, x, y, w, h, text, ink_h, color and `by`).

    Lines that follow each other within 1.5 samples and are `same_line` are chained, in whatever order they come. A chain has the id,
    and the reading, height and colour, of its longest reading (of equal ones the earliest, then the smallest id), the union of
    the boxes, and its whole time. lines: those columns but n_tracks, with ids that can be ordered.
    """
    cols = [*by, "id", "start", "end", "x", "y", "w", "h", "text", "ink_h", "color", "n_samples"]
    rows = lines.select(*cols)
    chain = chained(rows.drop("n_samples"), by, 1.5 * dt + SLACK, same_line())
    best = F.min(F.struct((-F.length(letters(F.col("text")))).alias("n"), "start", "id", "text", "ink_h", "color")).alias("best")
    g = rows.join(chain, "id").groupBy(*by, "track").agg(
        best, F.count(F.lit(1)).alias("n_tracks"), F.sum("n_samples").alias("n_samples"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
    )
    return g.select(*by, "best.id", "n_tracks", "n_samples", "start", "end", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "best.text", "best.ink_h", "best.color")


def group_items(lines: DataFrame, entity: str, dt: float) -> DataFrame:
    """(id, item, place): lines shown together as items, in the order of start, y and id; item is the id of an item's first line, place a line's number in it from the top.

    A line joins the first item whose first line starts and ends within 1.5 samples of it, if it is no further above or below
    the item's box than 0.8 of the larger height (its own and the median of the item's), shares some of its width, and the heights differ by
    1.6 times at most; else it begins an item. Rows are read in order as a stream: what is held are the items that a later line
    can still join. An entity is cut where no line starts for longer than that, so a large one is many tasks.
    """
    tol = 1.5 * dt + SLACK
    rows = lines.select(F.col(entity).alias("e"), "id", *[F.col(c).cast("double").alias(c) for c in ("start", "end", "x", "y", "w", "h")]).withColumn("cell", F.floor(F.col("start") / tol).cast("long"))
    cells = rows.select("e", "cell").distinct()
    w = Window.partitionBy("e").orderBy("cell")
    runs = cells.withColumn("stretch", F.sum(F.when(F.col("cell") - F.lag("cell").over(w) <= 1, 0).otherwise(1)).over(w))
    ordered = rows.join(runs, ["e", "cell"]).select("e", "stretch", "id", "start", "end", "x", "y", "w", "h")
    ordered = ordered.repartition(F.xxhash64("e", "stretch")).sortWithinPartitions("e", "stretch", "start", "y", "id")
    schema = ordered.select("id", F.col("id").alias("item"), "y").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, open_ = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["e"], r["stretch"]) != key:
                    key, open_ = (r["e"], r["stretch"]), []
                open_ = [i for i in open_ if r["start"] - i["start"] <= tol]
                for i in open_:
                    if abs(i["end"] - r["end"]) > tol:
                        continue
                    heights = sorted(i["heights"])
                    n = len(heights)
                    middle = (heights[(n - 1) // 2] + heights[n // 2]) / 2
                    tall, low = max(r["h"], middle), min(r["h"], middle)
                    apart = max(r["y"] - i["y2"], i["y1"] - (r["y"] + r["h"]))
                    if apart <= 0.8 * tall and min(i["x2"], r["x"] + r["w"]) > max(i["x1"], r["x"]) and tall <= 1.6 * low:
                        break
                else:
                    i = {"item": r["id"], "start": r["start"], "end": r["end"], "heights": [], "x1": r["x"], "x2": r["x"] + r["w"], "y1": r["y"], "y2": r["y"] + r["h"]}
                    open_.append(i)
                i["heights"].append(r["h"])
                i["x1"], i["x2"], i["y1"], i["y2"] = min(i["x1"], r["x"]), max(i["x2"], r["x"] + r["w"]), min(i["y1"], r["y"]), max(i["y2"], r["y"] + r["h"])
                out.append({"id": r["id"], "item": i["item"], "y": r["y"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = ordered.mapInArrow(run, schema)
    return found.select("id", "item", F.row_number().over(Window.partitionBy("item").orderBy("y", "id")).alias("place"))


def saturation(color: Column) -> Column:
    r, g, b = rgb(color)
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(F.when(top.isNotNull(), 0.0))


def assign_roles(items: DataFrame, frames: DataFrame, speech: DataFrame, entity: str, marks: list[str], cell: float = 24.0) -> DataFrame:
    """(id, role): identity_mark, title, description, speaker, reaction, dialogue, situation or unknown for each item of an entity.

    items: entity, id, start, end, text, x, y, w, h, ink_h, color, boxed (all but the first four may be null); frames: entity, duration, height; speech:
    entity, id, start, end. In this order: a text that holds a listed mark (three letters or more); of the items shown for 60 % of the time with
    their centre in the upper 40 % the one with the largest ink (then the higher, then the smaller id) is the title; what lies close below it and is
    smaller describes it; of the rest a small boxed label of up to 10 letters is a speaker, a large one of up to 6 in a saturated colour a
    reaction, by the median ink of the rest. What is left and lies in the band that holds most of it (centres within 6 % of the height; of equal bands the
    upper one) is dialogue if it is quoted or half of it is spoken, else situation; if the dialogue has a colour of its own, items of the band in that colour are dialogue too.
    """
    plain = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^0-9a-z가-힣]", "")
    known = [m for m in ("".join(c for c in x.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz" or "가" <= c <= "힣") for x in marks) if len(m) >= 3]
    marked = F.exists(F.array(*map(F.lit, known)), lambda m: F.contains(plain(F.col("text")), m)) if known else F.lit(False)
    rows = items.select(entity, "id", *[F.col(c).cast("double").alias(c) for c in ("start", "end", "x", "y", "w", "h", "ink_h")], "text", "color", F.coalesce("boxed", F.lit(False)).alias("boxed")).join(frames.select(entity, "duration", "height"), entity)
    rows = rows.withColumn("long", F.col("end") - F.col("start") >= 0.6 * F.col("duration")).withColumn("mid", (F.col("y") + F.col("h") / 2) / F.col("height")).withColumn("mark", marked)
    ink = F.coalesce("ink_h", F.lit(0.0))
    # what an entity's items are compared with is found where they lie, in one sort, not by joins of the items with themselves
    own = Window.partitionBy(entity)
    upper = F.expr("NOT mark AND long AND mid < 0.4")
    rows = rows.withColumn("t", F.min(F.when(upper, F.struct((-ink).alias("ink"), F.col("y"), "id", "start", "x", "w", "h"))).over(own))
    below = F.col("y") - (F.col("t.y") + F.col("t.h"))
    beside = F.least(F.col("t.x") + F.col("t.w"), F.col("x") + F.col("w")) - F.greatest("t.x", "x")
    smaller = F.coalesce(F.nullif("ink_h", F.lit(0.0)), F.lit(1e9)) < -F.col("t.ink")
    describes = F.coalesce(below.between(-0.2 * F.col("t.h"), 2.5 * F.col("t.h")) & (beside > 0) & smaller & (F.col("long") | (F.col("start") <= F.col("t.start") + 2.0)), F.lit(False))
    rows = rows.withColumn("role", F.when(F.col("mark"), "identity_mark").when(F.col("id") == F.col("t.id"), "title").when(describes, "description")).drop("t")
    rows = rows.withColumn("med", F.median(F.when(F.expr("role IS NULL AND ink_h <> 0"), F.col("ink_h"))).over(own))
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\W_]", ""))
    size = F.coalesce(F.nullif("ink_h", F.lit(0.0)) / F.col("med"), F.lit(1.0))
    speaker = F.col("boxed") & ((size <= 0.85) | F.col("med").isNull()) & chars.between(1, 10)
    reaction = (size >= 1.15) & chars.between(1, 6) & F.coalesce(saturation(F.col("color")) >= 0.35, F.lit(False))
    rows = rows.withColumn("role", F.when(F.col("role").isNotNull(), F.col("role")).when(speaker, "speaker").when(reaction, "reaction"))
    rows = table(rows, "roles")
    rest = rows.where("role IS NULL AND mid IS NOT NULL")
    near = F.expr(f"count(1) OVER (PARTITION BY `{entity}` ORDER BY mid RANGE BETWEEN 0.06D PRECEDING AND 0.06D FOLLOWING)")
    band = rest.select(entity, "mid", near.alias("near")).groupBy(entity).agg(F.min(F.struct((-F.col("near")).alias("near"), "mid")).alias("band")).select(entity, F.col("band.mid").alias("band"))
    inside = rest.join(band, entity).where(F.col("mid").between(F.col("band") - 0.06, F.col("band") + 0.06))
    spoken = overlaps(inside.select(entity, "start", "end", "id"), speech.select(entity, "start", "end", "id"), entity, cell).groupBy(F.col("a_id").alias("id")).agg(F.sum("overlap").alias("lap"))
    quoted = F.rlike(F.coalesce("text", F.lit("")), F.lit(f"[{QUOTES}]"))
    heard = F.coalesce(F.col("lap") >= 0.5 * F.greatest(F.lit(1e-6), F.col("end") - F.col("start")), F.lit(False))
    said = table(inside.join(spoken, "id", "left").select(entity, "id", "color", F.when(quoted | heard, "dialogue").otherwise("situation").alias("line")), "said")
    modes = [color_mode(said.where(F.col("line") == k), entity, "color", "id").select(entity, F.col("color").alias(k)) for k in ("dialogue", "situation")]
    both = said.join(modes[0], entity, "left").join(modes[1], entity, "left").withColumn("as_said", color_distance(F.col("color"), F.col("dialogue")) < 30)
    share = both.where("line = 'situation' AND color IS NOT NULL").groupBy(entity).agg(F.avg(F.coalesce("as_said", F.lit(False)).cast("int")).alias("share"))
    apart = F.coalesce((color_distance(F.col("situation"), F.col("dialogue")) > 60) & (F.col("share") < 0.5) & F.col("as_said"), F.lit(False))
    lines = both.join(share, entity, "left").select("id", F.when(apart, "dialogue").otherwise(F.col("line")).alias("line"))
    return rows.join(lines, "id", "left").select("id", F.coalesce("role", "line", F.lit("unknown")).alias("role"))
