"""The dominant colour of a group: greedy clusters in the order of arrival."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rgb

RADIUS = 28.0


def color_mode(rows: DataFrame, group: str, color: str, pos: str, radius: float = RADIUS) -> DataFrame:
    """(group, color, n, share): the largest cluster of each group's colours, as the median of each channel.

    In the order of pos a colour joins the first cluster whose present median is within the radius (half a step is rounded
    to the even number), so each depends on all before it: a group is read in one task, a row at a time, and what is held
    are its clusters, not its rows. Of equal clusters the older one wins. Unreadable colours are left out.
    """
    r, g, b = rgb(F.col(color))
    named = rows.select(F.col(group).alias("grp"), F.col(pos).alias("pos"), r.alias("r"), g.alias("g"), b.alias("b")).where("r IS NOT NULL")
    # many rows are few bytes: without a number all groups would meet in one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartition(parts, "grp").sortWithinPartitions("grp", "pos", "r", "g", "b")

    # what tasks call is defined here, so that it travels with them
    class Channel:
        """The values 0 to 255 of a channel as counts, and the lower median of them, which a new value moves by a step or none."""

        def __init__(self) -> None:
            self.counts, self.n, self.low, self.below = [0] * 256, 0, 0, 0

        def add(self, v: int) -> int:
            """The median, half a step rounded to the even number."""
            counts, low, below = self.counts, self.low, self.below
            counts[v] += 1
            below += v < low
            k = self.n // 2  # of n + 1 values the lower middle one has this place
            self.n += 1
            while below > k:
                low -= 1
                below -= counts[low]
            while below + counts[low] <= k:
                below += counts[low]
                low += 1
            self.low, self.below = low, below
            high = low
            if self.n % 2 == 0 and below + counts[low] <= k + 1:
                high += 1
                while not counts[high]:
                    high += 1
            return round((low + high) / 2)

    class Cluster:
        """Colours as counts of each channel's values, so its size does not grow with its members."""

        def __init__(self) -> None:
            self.channels, self.n, self.center = (Channel(), Channel(), Channel()), 0, (0, 0, 0)

        def add(self, color: tuple[int, int, int]) -> None:
            self.n += 1
            self.center = tuple(c.add(v) for c, v in zip(self.channels, color, strict=True))

    def cluster(clusters: list[Cluster], color: tuple[int, int, int]) -> None:
        """Add a colour to the first cluster whose median is within the radius, else to a new one."""
        r, g, b = color
        for c in clusters:
            x, y, z = c.center
            if (r - x) ** 2 + (g - y) ** 2 + (b - z) ** 2 <= radius * radius:
                break
        else:
            clusters.append(c := Cluster())
        c.add(color)

    def run(frames):
        key, clusters, begun = None, [], False

        def close() -> tuple:
            best = max(clusters, key=lambda c: c.n)  # of equal ones max() takes the first
            return key, "#%02X%02X%02X" % best.center, best.n, best.n / sum(c.n for c in clusters)

        for frame in frames:
            done = []  # a frame for each group would cost more than its clusters
            names = frame["grp"].astype(object).where(frame["grp"].notna(), None)
            for row in zip(names, frame["r"].tolist(), frame["g"].tolist(), frame["b"].tolist(), strict=True):
                if not begun or row[0] != key:
                    if begun:
                        done.append(close())
                    key, clusters, begun = row[0], [], True
                cluster(clusters, row[1:])
            if done:
                yield pd.DataFrame(done, columns=["grp", "color", "n", "share"])
        if begun:
            yield pd.DataFrame([close()], columns=["grp", "color", "n", "share"])

    kind = dict(rows.dtypes)[group]
    return ordered.select("grp", "r", "g", "b").mapInPandas(run, f"grp {kind}, color string, n long, share double").withColumnRenamed("grp", group)
