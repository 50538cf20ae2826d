"""Scalar rules of the query catalogue as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exchange rate; the grid's corner, its cell sizes in degrees, and its side.
RATE = 0.85
WEST, NORTH = -74.913585, 41.474937
EAST_STEP, SOUTH_STEP = 0.005986, 0.004489
SIDE = 300
ROUTE_FACTOR = 90600


def converted(price: Column) -> Column:
    """Price in the other currency, cut towards zero."""
    return (price.cast("double") * RATE).cast("long")


def cell_id(longitude: Column, latitude: Column) -> Column:
    """Number of the grid cell, null outside the grid."""
    east = F.floor((longitude - F.lit(WEST)) / F.lit(EAST_STEP)) + 1
    south = F.floor((F.lit(NORTH) - latitude) / F.lit(SOUTH_STEP)) + 1
    return F.when(east.between(1, SIDE) & south.between(1, SIDE), south * (SIDE + 1) + east)


def route_id(start_cell: Column, end_cell: Column) -> Column:
    return start_cell * ROUTE_FACTOR + end_cell


def loyalty(engagement: Column, watch: Column, n: Column) -> Column:
    return (engagement * 0.4 + watch * 0.3 + n * 0.3) / 100
