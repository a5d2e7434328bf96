"""Rows whose bounds meet, found by equi-joins on grid cells of any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meeting(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, cell: float | None = None) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose bounds ``a`` and ``b`` touch, once each.

    Other columns than the keys must have different names on both sides.  Every
    row has a level: cells of side 2^level are no smaller than its bounds, so it
    lies in four of them at most.  A pair meets on the larger of its two levels;
    for this a row is also dealt to those coarser levels that the other side
    has under its keys.  So the unit of the coordinates doesn't matter, and one
    large mask among small boxes costs a few cells.  With a fixed ``cell`` there
    is one level of that side instead.

    A pair is taken in the cell that holds the lower corner of what its bounds
    share.
    """
    if cell is None:
        left, right = (df.withColumn(f"__l{c}", _level(F.col(c))) for df, c in ((left, a), (right, b)))
        one, two = _dealt(left, _levels(right, keys, b), keys, a), _dealt(right, _levels(left, keys, a), keys, b)
        here = F.col("__level") == F.greatest(f"__l{a}", f"__l{b}")
        side: Column = F.pow(F.lit(2.0), F.col("__level"))
    else:
        one, two = (_spread(df.withColumn("__level", F.lit(0)), c, F.lit(float(cell))) for df, c in ((left, a), (right, b)))
        here, side = F.lit(True), F.lit(float(cell))
    x, y = F.greatest(f"{a}.x0", f"{b}.x0"), F.greatest(f"{a}.y0", f"{b}.y0")
    meets = (x <= F.least(f"{a}.x1", f"{b}.x1")) & (y <= F.least(f"{a}.y1", f"{b}.y1"))
    here &= (F.col("__cx") == F.floor(x / side)) & (F.col("__cy") == F.floor(y / side))
    both = one.join(two, [*keys, "__level", "__cx", "__cy"]).where(meets & here)
    return both.drop("__level", "__cx", "__cy", f"__l{a}", f"__l{b}")


def _level(b: Column) -> Column:
    """The least level whose cells are no smaller than the bounds; points count as very small."""
    most = F.greatest(*[F.abs(b[k]) for k in ("x0", "y0", "x1", "y1")], F.lit(2.0**-30))
    return F.ceil(F.log2(F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], most * 2.0**-30))).cast("int")


def _levels(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """The levels of each key: a few dozen at most."""
    return df.groupBy(*keys).agg(F.collect_set(f"__l{c}").alias("__levels"))


def _dealt(df: DataFrame, levels: DataFrame, keys: list[str], c: str) -> DataFrame:
    own = F.col(f"__l{c}")
    coarser = F.filter("__levels", lambda v: v > own)
    # a key that the other side lacks has no pair
    on = df.join(levels, keys).withColumn("__level", F.explode(F.concat(F.array(own), coarser))).drop("__levels")
    return _spread(on, c, F.pow(F.lit(2.0), F.col("__level")))


def _spread(df: DataFrame, c: str, side: Column) -> DataFrame:
    cells = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{c}.{axis}0") / side), F.floor(F.col(f"{c}.{axis}1") / side)))
    return df.withColumn("__cx", cells("x")).withColumn("__cy", cells("y"))
