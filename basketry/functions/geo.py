"""Coordinate to region rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def region_of(lat: Column, lon: Column) -> Column:
    """West / Midwest by longitude, then South / Northeast by latitude.

    Unknown when either coordinate is missing (the reference's Python path;
    its Spark path disagreed when only lat was null).
    """
    return (F.when(lat.isNull() | lon.isNull(), F.lit("Unknown"))
            .when(lon <= -105, F.lit("West"))
            .when(lon <= -87, F.lit("Midwest"))
            .when(lat < 37, F.lit("South"))
            .otherwise(F.lit("Northeast")))
