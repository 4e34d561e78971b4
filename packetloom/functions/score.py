"""Score bands.

Fixed values: the alert table bands are >100 critical, 51-100 high, 21-50
medium, <=20 low; the console bands are >100 red, 51-100 yellow, else green.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(score: Column) -> Column:
    """NULL scores stay in no band."""
    return (
        F.when(score > 100, "critical")
        .when(score > 50, "high")
        .when(score > 20, "medium")
        .when(score <= 20, "low")
    )


def display_colour(score: Column) -> Column:
    """A missing score counts as 0."""
    known = F.coalesce(score, F.lit(0))
    return F.when(known > 100, "red").when(known > 50, "yellow").otherwise("green")


def traffic_tier(tile: Column) -> Column:
    """Name of a byte tertile, 1 being the lowest."""
    return F.when(tile == 3, "high").when(tile == 2, "medium").otherwise("low")
