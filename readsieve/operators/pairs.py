"""Mate pairing and the construction of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readsieve import functions as R

CARRIED = ["idx", "first_of_pair", "tid", "coord", "rev", "score", "tile", "x", "y"]


def build_pairs(ends: DataFrame) -> DataFrame:
    """Pairs of the first and second, third and fourth ... end of a name, in file order; a name's odd last end has none.

    One shuffle, on the name. The window needs no buffer but the next row, so a name that very many reads share costs sorting alone."""
    extra = ["library"] if "library" in ends.columns else []
    named = Window.partitionBy("qname").orderBy("idx")
    carried = F.struct(*CARRIED)
    rows = ends.where("has_mate").select("qname", *extra, carried.alias("a"), F.row_number().over(named).alias("n"), F.lead(carried).over(named).alias("b"))
    rows = rows.where((F.col("n") % 2 == 1) & F.col("b").isNotNull())
    a, b = F.col("a"), F.col("b")
    seen = R.orientation(F.when(b["first_of_pair"], b["rev"]).otherwise(a["rev"]), F.when(b["first_of_pair"], a["rev"]).otherwise(b["rev"]))
    ordered = (b["tid"] > a["tid"]) | ((b["tid"] == a["tid"]) & (b["coord"] >= a["coord"]))
    same_place = (a["tid"] == b["tid"]) & (a["coord"] == b["coord"])
    forward, swapped = R.orientation(a["rev"], b["rev"]), R.orientation(b["rev"], a["rev"])
    orient = F.when(ordered, F.when(same_place & (forward == R.RF), R.FR).otherwise(forward)).otherwise(swapped)
    one = lambda field: F.when(ordered, a[field]).otherwise(b[field])
    two = lambda field: F.when(ordered, b[field]).otherwise(a[field])
    return rows.select(
        "qname", *extra, F.expr("(n - 1) div 2").alias("slot"),
        one("tid").alias("tid1"), one("coord").alias("coord1"), one("idx").alias("idx1"), two("tid").alias("tid2"), two("coord").alias("coord2"), two("idx").alias("idx2"),
        orient.alias("orient"), seen.alias("opt_orient"), (a["score"] + b["score"]).alias("score"), a["tile"].alias("tile"), a["x"].alias("x"), a["y"].alias("y"),
    )
