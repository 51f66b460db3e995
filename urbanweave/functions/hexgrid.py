"""Hexagonal cells of resolution 9: encode, distance, centre and boundary.

Spark has no cell functions, so these are Arrow-batched numpy expressions. They
were measured against the same arithmetic as staged column expressions: for two
points per row the generated method outgrows what the JVM compiles and runs
about 20 times slower than this.

Cells are computed on the one icosahedron face that holds the service area, in
the base cell that covers it. Points elsewhere get NULL, never a guess. Inside,
a cell is a pair of axial lattice coordinates (a, b): the unit steps are (1, 0),
(0, 1), (1, 1) and their opposites.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the public grid definition.
RESOLUTION = 9
BASE_CELL = 19
FACE_CENTRE_LAT = 1.054751253523952054
FACE_CENTRE_LNG = -1.347517358900396623
FACE_AXIS_AZIMUTH = 0.780213654393430055
ODD_RESOLUTION_ROTATION = 0.333473172251832115336
GNOMONIC_UNIT = 0.38196601125010500003
BASE_CELL_AXIAL = (-1, 0)
# Half the angle between neighbouring face centres (41.81 degrees): closer
# points have this face as their nearest one.
FACE_REACH_COS = math.cos(math.radians(20.9))

_EMPTY_CELL = (1 << 59) | (RESOLUTION << 52) | (BASE_CELL << 45) | ((1 << 3 * (15 - RESOLUTION)) - 1)
_LOW_BITS = 3 * (15 - RESOLUTION)
_SCALE = math.sqrt(7) ** RESOLUTION / GNOMONIC_UNIT
_AXIS = FACE_AXIS_AZIMUTH - (ODD_RESOLUTION_ROTATION if RESOLUTION % 2 else 0.0)
_SIN0, _COS0 = math.sin(FACE_CENTRE_LAT), math.cos(FACE_CENTRE_LAT)
_SQRT3 = math.sqrt(3)

_LAT_LON = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_TRIP_NUMBERS = T.StructType(
    [
        T.StructField("pickup", T.LongType()),
        T.StructField("dropoff", T.LongType()),
        T.StructField("steps", T.IntegerType()),
    ]
)


def _seventh(value: np.ndarray) -> np.ndarray:
    return np.rint(value * (1 / 7))


def _point_axial(lat: np.ndarray, lng: np.ndarray):
    """Nearest cell centre of each point, and whether the point is on the face."""
    phi, dlam = np.radians(lat), np.radians(lng) - FACE_CENTRE_LNG
    sin, cos, cosl = np.sin(phi), np.cos(phi), np.cos(dlam)
    closeness = sin * _SIN0 + cos * _COS0 * cosl
    on_face = closeness > FACE_REACH_COS
    with np.errstate(divide="ignore", invalid="ignore"):
        east = cos * np.sin(dlam) / closeness * _SCALE
        north = (sin * _COS0 - cos * _SIN0 * cosl) / closeness * _SCALE
        x = north * math.cos(_AXIS) + east * math.sin(_AXIS)
        y = north * math.sin(_AXIS) - east * math.cos(_AXIS)
        a, b = x + y / _SQRT3, 2 * y / _SQRT3
        c = b - a
        ra, rb, rc = np.rint(a), np.rint(b), np.rint(c)
        ea, eb, ec = np.abs(ra - a), np.abs(rb - b), np.abs(rc - c)
        a = np.where((ea > eb) & (ea > ec), rb - rc, ra)
        b = np.where((eb >= ea) & (eb > ec), ra + rc, rb)
    return a, b, on_face


def _axial_cell(a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Cell number, or -1 where the pair is not in the covered base cell.

    Each level takes the residue that tells the seven children apart, then the
    coordinates of the parent.
    """
    digits = np.zeros(len(a))
    for level in range(RESOLUTION, 0, -1):
        if level % 2:
            pa, pb = _seventh(3 * a - b), _seventh(a + 2 * b)
            residue = 4 * a + 2 * b - 6 * pa - 3 * pb
        else:
            pa, pb = _seventh(2 * a + b), _seventh(3 * b - a)
            residue = 4 * a + 2 * b
        digits += (residue - 7 * _seventh(residue - 3)) * 8.0 ** (RESOLUTION - level)
        a, b = pa, pb
    known = known & (a == BASE_CELL_AXIAL[0]) & (b == BASE_CELL_AXIAL[1])
    cells = np.full(len(known), -1, dtype=np.int64)
    cells[known] = (digits[known].astype(np.int64) << _LOW_BITS) + _EMPTY_CELL
    return cells


def _cell_axial(cells: pd.Series):
    """Axial pair of each cell number, and whether it is a cell of the covered area."""
    numbers = cells.to_numpy(dtype=np.int64)
    fixed = ~((1 << 45) - 1) | ((1 << _LOW_BITS) - 1)
    known = (numbers & fixed) == (_EMPTY_CELL & fixed)
    a = np.full(len(numbers), float(BASE_CELL_AXIAL[0]))
    b = np.full(len(numbers), float(BASE_CELL_AXIAL[1]))
    for level in range(1, RESOLUTION + 1):
        digit = (numbers >> 3 * (15 - level)) & 7
        known &= digit != 7
        i, j, k = digit >> 2, (digit >> 1) & 1, digit & 1
        a, b = (2 * a + b, 3 * b - a) if level % 2 else (3 * a - b, a + 2 * b)
        a, b = a + i - k, b + j - k
    return a, b, known


def _axial_distance(da: np.ndarray, db: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(np.abs(da), np.abs(db)), np.abs(da - db))


def _axial_point(a: np.ndarray, b: np.ndarray):
    """Latitude and longitude in degrees of lattice positions (fractions allowed)."""
    x, y = a - b / 2, b * _SQRT3 / 2
    reach = np.arctan(np.hypot(x, y) / _SCALE)
    azimuth = _AXIS - np.arctan2(y, x)
    sin_lat = _SIN0 * np.cos(reach) + _COS0 * np.sin(reach) * np.cos(azimuth)
    dlam = np.arctan2(
        np.sin(azimuth) * np.sin(reach) * _COS0, np.cos(reach) - _SIN0 * sin_lat
    )
    return np.degrees(np.arcsin(sin_lat)), np.degrees(FACE_CENTRE_LNG + dlam)


def _once(udf):
    """Marked as not repeatable, so that Spark never copies the call into a pushed
    filter and computes the cells of each row a second time there."""
    return udf.asNondeterministic()


@_once
@F.pandas_udf(T.LongType())
def _point_number(lat: pd.Series, lng: pd.Series) -> pd.Series:
    a, b, known = _point_axial(lat.to_numpy(float), lng.to_numpy(float))
    return pd.Series(_axial_cell(a, b, known))


@_once
@F.pandas_udf(_TRIP_NUMBERS)
def _trip_numbers(plat: pd.Series, plng: pd.Series, dlat: pd.Series, dlng: pd.Series) -> pd.DataFrame:
    pa, pb, pknown = _point_axial(plat.to_numpy(float), plng.to_numpy(float))
    da, db, dknown = _point_axial(dlat.to_numpy(float), dlng.to_numpy(float))
    pickup, dropoff = _axial_cell(pa, pb, pknown), _axial_cell(da, db, dknown)
    both = (pickup >= 0) & (dropoff >= 0)
    steps = np.where(both, _axial_distance(pa - da, pb - db), -1).astype(np.int32)
    return pd.DataFrame({"pickup": pickup, "dropoff": dropoff, "steps": steps})


@_once
@F.pandas_udf(T.IntegerType())
def _cell_steps(first: pd.Series, second: pd.Series) -> pd.Series:
    a1, b1, known1 = _cell_axial(first)
    a2, b2, known2 = _cell_axial(second)
    return pd.Series(np.where(known1 & known2, _axial_distance(a1 - a2, b1 - b2), -1).astype(np.int32))


@_once
@F.pandas_udf(_LAT_LON)
def _cell_centre(cells: pd.Series) -> pd.DataFrame:
    a, b, known = _cell_axial(cells)
    lat, lng = _axial_point(a, b)
    return pd.DataFrame({"lat": np.where(known, lat, np.nan), "lon": np.where(known, lng, np.nan)})


@_once
@F.pandas_udf(T.ArrayType(_LAT_LON))
def _cell_corners(cells: pd.Series) -> pd.Series:
    a, b, known = _cell_axial(cells)
    corners = []
    # Counter-clockwise corner offsets, in thirds of a unit step.
    for ca, cb in ((2, 1), (1, 2), (-1, 1), (-2, -1), (-1, -2), (1, -1)):
        lat, lng = _axial_point(a + ca / 3, b + cb / 3)
        corners.append((lat, lng))
    return pd.Series(
        [
            [{"lat": lat[row], "lon": lng[row]} for lat, lng in corners] if known[row] else None
            for row in range(len(cells))
        ]
    )


def _text(number: Column) -> Column:
    """15 hex digits, NULL for -1; the number is used once."""
    return F.lower(F.hex(_non_negative(number)))


def _non_negative(number: Column) -> Column:
    return F.nullif(number, F.lit(-1).cast("long"))


def _number(cell: Column) -> Column:
    """The number that a cell's hex digits spell, -1 for other texts and NULL."""
    spelled = F.when(cell.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(cell, 16, 10).try_cast("bigint"))
    return F.coalesce(spelled, F.lit(-1).cast("bigint"))


def point_cell(lat: Column, lng: Column) -> Column:
    """Cell of a point as 15 hex digits; NULL on NULL or outside the covered area."""
    return _text(_point_number(lat, lng))


def cell_distance(first: Column, second: Column) -> Column:
    """Grid steps between two cells: 0 for equal texts, NULL when either is no known cell."""
    return F.when(first == second, F.lit(0)).otherwise(_non_negative(_cell_steps(_number(first), _number(second))))


def cell_centre(cell: Column) -> Column:
    """struct(lat, lon) of the cell centre."""
    return _cell_centre(_number(cell))


def cell_boundary(cell: Column) -> Column:
    """The six corners as array of struct(lat, lon), counter-clockwise."""
    return _cell_corners(_number(cell))


def add_cells(df: DataFrame) -> DataFrame:
    """pickup_h3, dropoff_h3 and h3_distance, in one batched pass over both points."""
    found = _trip_numbers(
        "pickup_centroid_latitude",
        "pickup_centroid_longitude",
        "dropoff_centroid_latitude",
        "dropoff_centroid_longitude",
    )
    return (
        df.withColumn("_cells", found)
        .withColumns(
            {
                "pickup_h3": _text(F.col("_cells.pickup")),
                "dropoff_h3": _text(F.col("_cells.dropoff")),
                "h3_distance": _non_negative(F.col("_cells.steps")).cast("double"),
            }
        )
        .drop("_cells")
    )
