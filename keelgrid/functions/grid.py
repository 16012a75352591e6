"""The world's 1 km equal-area grid: projection in closed form (cylindrical equal-area, standard parallel 30 degrees, on
the WGS84 ellipsoid), cell numbers, and the cells that a segment crosses.

Column 0 is the westernmost, row 0 the southernmost; grid_id = row * COLS + col + 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extent in metres, cell size, columns and rows of the grid.
XMIN, XMAX, YMIN, YMAX, CELL = -17367530.45, 17367530.45, -7342699.72, 7342699.72, 1000.0
COLS, ROWS = 34735, 14685
#: WGS84.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)


def project_x(lon: Column) -> Column:
    return F.lit(SEMI_MAJOR * K0) * F.radians(lon)


def project_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = F.lit(1 - E2) * (s / (1 - F.lit(E2) * s * s) - F.lit(1 / (2 * ECC)) * F.log((1 - F.lit(ECC) * s) / (1 + F.lit(ECC) * s)))
    return F.lit(SEMI_MAJOR / (2 * K0)) * q


def longitude(x: Column) -> Column:
    return F.degrees(x / F.lit(SEMI_MAJOR * K0))


#: What is added to the authalic latitude b: multiples of sin 2b, sin 4b and sin 6b.
AUTHALIC = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
Q_POLE = (1 - E2) * (1 / (1 - E2) - 1 / (2 * ECC) * math.log((1 - ECC) / (1 + ECC)))


def latitude(y: Column) -> Column:
    """The inverse of project_y, to about 1e-9 degrees, by the series in the authalic latitude."""
    b = F.asin(F.least(F.greatest(y * F.lit(2 * K0 / SEMI_MAJOR / Q_POLE), F.lit(-1.0)), F.lit(1.0)))
    return F.degrees(b + F.lit(AUTHALIC[0]) * F.sin(2 * b) + F.lit(AUTHALIC[1]) * F.sin(4 * b) + F.lit(AUTHALIC[2]) * F.sin(6 * b))


def column_of(x: Column) -> Column:
    return F.floor((x - F.lit(XMIN)) / F.lit(CELL)).cast("long")


def row_of(y: Column) -> Column:
    return F.floor((y - F.lit(YMIN)) / F.lit(CELL)).cast("long")


def grid_id(row: Column, col: Column) -> Column:
    """Null outside the grid."""
    return F.when(row.between(0, ROWS - 1) & col.between(0, COLS - 1), row * F.lit(COLS) + col + 1)


def column_in(cell: Column) -> Column:
    return F.pmod(cell - 1, F.lit(COLS))


def row_in(cell: Column) -> Column:
    return F.floor((cell - 1) / F.lit(COLS)).cast("long")


def centre_x(col: Column) -> Column:
    return F.lit(XMIN) + (col + F.lit(0.5)) * F.lit(CELL)


def centre_y(row: Column) -> Column:
    return F.lit(YMIN) + (row + F.lit(0.5)) * F.lit(CELL)


def crossings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Array of (col, row, length) over the cells that the segment crosses; the lengths sum to the segment's length. A
    stretch on a cell's edge counts for one cell. The segment's shares at which it meets grid lines are sorted, and
    each stretch between two of them lies in the cell of its middle. Give columns, not expressions: they are used often."""
    u0, u1 = (x0 - F.lit(XMIN)) / F.lit(CELL), (x1 - F.lit(XMIN)) / F.lit(CELL)
    v0, v1 = (y0 - F.lit(YMIN)) / F.lit(CELL), (y1 - F.lit(YMIN)) / F.lit(CELL)

    def met(a: Column, b: Column) -> Column:
        first, last = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
        return F.when(first <= last, F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda c: (c - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    shares = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), met(u0, u1), met(v0, v1))))
    line = F.struct(u0.alias("u"), (u1 - u0).alias("du"), v0.alias("v"), (v1 - v0).alias("dv"), length.alias("l"), shares.alias("t"))
    return F.transform(
        F.array(line),
        lambda s: F.transform(
            F.slice(s["t"], 1, F.size(s["t"]) - 1),
            lambda t, i: F.struct(
                F.floor(s["u"] + (t + s["t"][i + 1]) / 2 * s["du"]).cast("long").alias("col"),
                F.floor(s["v"] + (t + s["t"][i + 1]) / 2 * s["dv"]).cast("long").alias("row"),
                ((s["t"][i + 1] - t) * s["l"]).alias("length_m"),
            ),
        ),
    )[0]
