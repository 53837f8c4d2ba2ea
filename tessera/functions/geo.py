"""Geographic expressions, all within whole-stage code generation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EARTH_RADIUS_KM


def sphere_vector(lon: Column, lat: Column, latitude: str = "reference") -> tuple[Column, Column, Column]:
    """A unit vector. latitude: 'reference' measures the angle from the pole, which is what the sampler's graphs are
    built on; 'geodetic' measures it from the equator."""
    lon, lat = F.radians(lon), F.radians(lat)
    if latitude == "geodetic":
        lat = F.lit(math.pi / 2) - lat
    return F.cos(lon) * F.sin(lat), F.sin(lon) * F.sin(lat), F.cos(lat)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    half = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(half))


def interaction(dist_sq: Column, var1: Column, var2: Column, pop1: Column, pop2: Column, sigma_km: float) -> Column:
    """Population-weighted decay with distance, spread by both units' variances and twice sigma squared."""
    spread = var1 + var2 + 2.0 * sigma_km**2
    return pop1 * pop2 * F.exp(-0.5 * dist_sq / spread) / (2.0 * math.pi * F.sqrt(spread))


@dataclass(frozen=True)
class Lambert:
    """Lambert conformal conic projection on a unit sphere, its standard parallels at the bounds' latitudes."""

    ref_lon: float
    ref_lat: float
    n: float
    f: float
    rho_ref: float

    @classmethod
    def of_bounds(cls, min_lon: float, max_lon: float, min_lat: float, max_lat: float) -> "Lambert":
        """Bounds beyond a pole, whose cosines differ in sign, have no such cone: its numbers, and what it projects, are NaN."""
        west, east, south, north = (np.radians(np.float64(x)) for x in (min_lon, max_lon, min_lat, max_lat))
        cone = lambda lat: np.tan(np.pi / 4 + lat / 2)
        mid = (south + north) / 2
        with np.errstate(all="ignore"):  # as SQL has it
            n = np.log(np.cos(north) / np.cos(south)) / np.log(cone(south) / cone(north))
            f = np.cos(north) * cone(north) ** n / n
            return cls(*(float(x) for x in ((west + east) / 2, mid, n, f, f / cone(mid) ** n)))

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = self.f * F.pow(F.cot(math.pi / 4 + F.radians(lat) / 2), F.lit(self.n))
        angle = self.n * (F.radians(lon) - self.ref_lon)
        return rho * F.sin(angle), self.rho_ref - rho * F.cos(angle)
