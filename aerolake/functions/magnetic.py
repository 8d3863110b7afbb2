"""The earth's magnetic field from a spherical harmonic model.

The model's coefficients are a published file and a parameter here: `coefficients` reads the file's
own format. A model of degree 12 has 90 rows, so every task holds all of them; points are evaluated
in Arrow batches, all at once for each coefficient.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

# The reference ellipsoid and the model's sphere, in kilometres.
ELLIPSOID_KM = 6378.137
FLATTENING = 1 / 298.257223563
SPHERE_KM = 6371.2
KM_PER_FT = 0.0003048
#: A colatitude never comes closer to a pole, where east is not defined.
POLE = 1e-10

FIELD = (
    "declinationDeg double, inclinationDeg double, horizontalIntensityNt double, northIntensityNt double, eastIntensityNt double, "
    "downIntensityNt double, totalIntensityNt double"
)


def coefficients(spark: SparkSession, path: str) -> tuple[float, list[tuple[int, int, float, float, float, float]]]:
    """(epoch, rows of n, m, g, h and their yearly change) of a coefficient file.

    The file's first line names the epoch, others hold six numbers; it is small by its definition.
    """
    lines = [r.value.split() for r in spark.read.text(path).collect()]
    return float(lines[0][0]), [(int(p[0]), int(p[1]), *map(float, p[2:6])) for p in lines[1:] if len(p) == 6]


def _spherical(lat: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radius, colatitude and the difference between geodetic and geocentric latitude."""
    squared = FLATTENING * (2 - FLATTENING)
    across = ELLIPSOID_KM / np.sqrt(1 - squared * np.sin(lat) ** 2)
    flat, up = (across + km) * np.cos(lat), (across * (1 - squared) + km) * np.sin(lat)
    radius = np.hypot(flat, up)
    centric = np.arcsin(up / radius)
    return radius, np.clip(np.pi / 2 - centric, POLE, np.pi - POLE), lat - centric


def _legendre(degree: int, theta: np.ndarray) -> tuple[dict, dict]:
    """Schmidt quasi-normalised functions of each (n, m) and their derivatives by theta."""
    c, s = np.cos(theta), np.sin(theta)
    zero = np.zeros_like(c)
    p, d = {(0, 0): zero + 1}, {(0, 0): zero}
    for n in range(1, degree + 1):
        k = np.sqrt((2 * n - 1) / (2 * n)) if n > 1 else 1.0
        p[n, n], d[n, n] = k * s * p[n - 1, n - 1], k * (c * p[n - 1, n - 1] + s * d[n - 1, n - 1])
        for m in range(n):
            below, slope = p.get((n - 2, m), zero), d.get((n - 2, m), zero)
            a, b, whole = 2 * n - 1, np.sqrt(max((n - 1) ** 2 - m * m, 0)), np.sqrt(n * n - m * m)
            p[n, m] = (a * c * p[n - 1, m] - b * below) / whole
            d[n, m] = (a * (c * d[n - 1, m] - s * p[n - 1, m]) - b * slope) / whole
    return p, d


def components(lat: np.ndarray, lon: np.ndarray, km: np.ndarray, year: np.ndarray, epoch: float, rows: list[tuple]) -> pd.DataFrame:
    """The field's parts at points in degrees, kilometres and decimal years."""
    radius, theta, tilt = _spherical(np.radians(lat), km)
    phi, ratio, passed = np.radians(lon), SPHERE_KM / radius, year - epoch
    p, d = _legendre(max(r[0] for r in rows), theta)
    outward, south, east = (np.zeros_like(radius) for _ in range(3))
    for n, m, g, h, g_year, h_year in rows:
        g, h, scale = g + g_year * passed, h + h_year * passed, ratio ** (n + 2)
        along, across = g * np.cos(m * phi) + h * np.sin(m * phi), h * np.cos(m * phi) - g * np.sin(m * phi)
        outward += (n + 1) * scale * along * p[n, m]
        south -= scale * along * d[n, m]
        east -= scale * m * across * p[n, m] / np.sin(theta)
    north, down = -south * np.cos(tilt) - outward * np.sin(tilt), south * np.sin(tilt) - outward * np.cos(tilt)
    level = np.hypot(north, east)
    parts = [np.degrees(np.arctan2(east, north)), np.degrees(np.arctan2(down, level)), level, north, east, down, np.hypot(level, down)]
    return pd.DataFrame(dict(zip([f.split()[0] for f in FIELD.split(", ")], parts)))


def with_field(points: DataFrame, epoch: float, rows: list[tuple], lat: str = "lat", lon: str = "lon", altitude_ft: str | None = None, year: str | None = None, name: str = "field") -> DataFrame:
    """points with the struct `name` of the field's parts; without an altitude at sea level, without a year at the epoch.

    Null where a coordinate is null.
    """

    @F.pandas_udf(FIELD)
    def field(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [x.to_numpy(np.float64) for x in batch]
            yield components(values[0], values[1], values[2] * KM_PER_FT, values[3], epoch, rows)

    given = [F.col(lat), F.col(lon), F.col(altitude_ft) if altitude_ft else F.lit(0.0), F.col(year) if year else F.lit(float(epoch))]
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return points.withColumn(name, F.when(known, field(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in given])))


def _turned(deg: Column) -> Column:
    return deg - 360 * F.floor(deg / 360)


def to_magnetic(true_deg: Column, declination_deg: Column) -> Column:
    """A true direction as a magnetic one, 0 to below 360."""
    return _turned(true_deg - declination_deg)


def to_true(magnetic_deg: Column, declination_deg: Column) -> Column:
    return _turned(magnetic_deg + declination_deg)
