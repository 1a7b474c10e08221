"""All pairs of two tables of places within a distance, by cells of a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import EARTH_KM, haversine_km
from .dedupe import saved

#: Rows of a cell that one task takes at once; more are dealt to several.
SPLIT = 4096
#: Left rows of one place that meet the right rows as one, at most.
TOGETHER = 64
#: Cells known to be crowded are broadcast up to so many.
BROADCAST_ROWS = 500_000


def within_km(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lng: str = "lng", split: int = SPLIT) -> DataFrame:
    """Columns of left, those of right with ``near_`` before their names, and distance_km, of all pairs up to ``km`` apart.

    Bands of latitude are as high as the distance, and a band's cells as wide as a distance
    reaches at its end towards the pole.  A left row is in its own cell, a right row is sent
    to the cells that its circle touches, at most three in each of three bands but near the
    poles, where a band has few cells; so pairs meet by equality, once, and their exact
    distance decides.  Cells go around the date line.  Left rows of a crowded cell are dealt
    to as many parts as they need, to each of which the cell's right rows go.  Left rows of one
    place meet them as one, and follow each other in the result, so that a distance is worked
    out once for them and a file of all pairs packs well.  Rows without a
    latitude from -90 to 90 and a longitude from -180 to 180 are near nothing; repeated rows
    are paired as often as they are there.
    """
    if not 0 < km < math.pi * EARTH_KM:
        raise ValueError(f"no distance between places: {km}")
    reach = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9  # more than doubles are off
    bands = max(1, math.floor(180 / reach))
    high = 180 / bands

    def sound(df: DataFrame) -> DataFrame:
        return df.where(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180))

    def band(at: Column) -> Column:
        return F.least(F.floor((at + 90) / high), F.lit(bands - 1)).cast("int")

    def widest(number: Column) -> Column:
        """How far in longitude a circle may reach whose centre or other end is in the band, in degrees."""
        outer = F.least(F.greatest(F.abs(number * high - 90), F.abs((number + 1) * high - 90)) + F.lit(reach), F.lit(90.0))
        ratio = F.lit(math.sin(math.radians(reach))) / F.cos(F.radians(outer))
        return F.when((outer >= 90) | (ratio >= 1) | F.lit(reach >= 90), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))

    def cells(number: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(360 / widest(number))).cast("int")

    def column(at: Column, number: Column) -> Column:
        return F.floor((at + 180) / 360 * cells(number)).cast("int")

    rows = sound(left).withColumn("__band", band(F.col(lat)))
    rows = saved(rows.withColumn("__cell", F.pmod(column(F.col(lng), F.col("__band")), cells(F.col("__band")))))
    crowded = saved(rows.groupBy("__band", "__cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("__band", "__cell", F.ceil(F.col("n") / split).cast("int").alias("__parts")))
    few = crowded.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def parted(df: DataFrame) -> DataFrame:
        known = df.join(F.broadcast(crowded) if few else crowded, ["__band", "__cell"], "left")
        return known.withColumn("__parts", F.coalesce("__parts", F.lit(1)))

    # the rows of one place are numbered in one task, but in several where a cell has very many
    salt = F.pmod(F.xxhash64(*[c for c, kind in left.dtypes if not kind.startswith("map")]), F.ceil(F.col("__parts") / TOGETHER))
    place = ["__band", "__cell", "__parts", lat, lng, "__salt"]
    rows = parted(rows).withColumn("__salt", salt)
    rows = rows.withColumn("__turn", F.floor((F.row_number().over(Window.partitionBy(*place).orderBy(lat)) - 1) / TOGETHER))
    rows = rows.groupBy(*place, "__turn").agg(F.collect_list(F.struct(*left.columns)).alias("__rows"))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(lat, lng, "__salt", "__turn"), F.col("__parts")).cast("int")).drop("__parts", "__salt", "__turn")

    near = sound(right).select(*[F.col(c).alias(f"near_{c}") for c in right.columns])
    own = band(F.col(f"near_{lat}"))
    near = near.withColumn("__band", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(bands - 1)))))
    ends = [column(F.col(f"near_{lng}") + sign * widest(F.col("__band")), F.col("__band")) for sign in (-1, 1)]
    touched = F.transform(F.sequence(ends[0], F.least(ends[1], ends[0] + cells(F.col("__band")) - 1)), lambda c: F.pmod(c, cells(F.col("__band"))))
    near = parted(near.withColumn("__cell", F.explode(F.array_distinct(touched))))
    near = near.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")

    pairs = rows.join(near, ["__band", "__cell", "__part"])
    pairs = pairs.withColumn("distance_km", haversine_km(F.col(lat), F.col(lng), F.col(f"near_{lat}"), F.col(f"near_{lng}")))
    return pairs.where(F.col("distance_km") <= km).select(F.inline("__rows"), *[f"near_{c}" for c in right.columns], "distance_km")
