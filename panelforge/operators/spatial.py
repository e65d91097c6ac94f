"""Nearest sites, sites within a radius, and inverse-distance weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import haversine_km
from ..sources.shared import cut_lineage

#: Kilometres of a degree of latitude on a sphere of 6371 km, rounded down.
KM_PER_DEGREE = 111.19
#: No two positions are further apart.
HALF_ROUND_KM = 20_016


def _sites(sites: DataFrame) -> DataFrame:
    return sites.dropna(subset=["latitude", "longitude"]).select(F.col("site").alias("site"), F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"))


def _km() -> Column:
    return haversine_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))


def pairs(places: DataFrame, sites: DataFrame, within_km: float) -> DataFrame:
    """place, site, km: all pairs within a distance.

    places: place, latitude, longitude; sites: site, latitude, longitude. Sites join on latitude bands and longitude
    cells of a grid wide enough for the distance, each site going to its own and the neighbouring cells, so that the
    join is an equi join at every size.
    """
    p = places.dropna(subset=["latitude", "longitude"]).select("place", "latitude", "longitude")
    return grid_pairs(p, _sites(sites), within_km).select("place", "site", _km().alias("km")).where(F.col("km") <= within_km)


def grid_pairs(p: DataFrame, s: DataFrame, within_km: float) -> DataFrame:
    """Pairs that share or neighbour a grid cell as wide as the distance; a superset of those within it.

    Longitude cells of a band are as wide as the distance at the band's far edge; near the poles a band is one cell.
    Latitudes beyond a pole count as the position that they lead to.
    """
    step = within_km / KM_PER_DEGREE
    band = lambda lat: F.floor((lat + 90) / step)
    far = lambda b: F.least(F.greatest(F.abs((b - 1) * step - 90), F.abs((b + 2) * step - 90)), F.lit(90.0))
    cells = lambda b: F.greatest(F.floor(360 * F.cos(F.radians(far(b))) / step), F.lit(1)).cast("long")
    cell = lambda lon, b: F.pmod(F.floor((lon + 180) / 360 * cells(b)), cells(b))
    north = lambda lat: F.when(F.abs(lat) > 90, F.degrees(F.asin(F.sin(F.radians(lat))))).otherwise(lat)
    east = lambda lat, lon: F.when(F.cos(F.radians(lat)) < 0, lon + 180).otherwise(lon)
    left = p.withColumn("b", band(north(F.col("latitude")))).withColumn("c", cell(east(F.col("latitude"), F.col("longitude")), F.col("b")))
    right = s.withColumn("b", F.explode(F.array(*[band(north(F.col("s_lat"))) + i for i in (-1, 0, 1)])))
    near = F.array_distinct(F.array(*[F.pmod(cell(east(F.col("s_lat"), F.col("s_lon")), F.col("b")) + i, cells(F.col("b"))) for i in (-1, 0, 1)]))
    right = right.withColumn("c", F.explode(near))
    return left.join(right, ["b", "c"]).drop("b", "c")


def nearest_site(places: DataFrame, sites: DataFrame, radii: tuple = (50, 100), uncovered_km: float = 100) -> DataFrame:
    """Per place: the nearest site (ties: the smallest), its distance to two digits, sites within each radius, and whether none covers it.

    Places and sites of one position are one row in the joins. A join on grid cells as wide as the largest radius gives
    all counts and the nearest sites within it; positions without any repeat alone with cells of three times the width, until
    each has a site, so a position far from all sites meets more of them.
    """
    at, counts = ["latitude", "longitude"], [f"n_within_{r}km" for r in radii]
    p = places.dropna(subset=at).select("place", *at)
    spots = cut_lineage(p.select(*at).distinct())
    s = cut_lineage(_sites(sites).groupBy("s_lat", "s_lon").agg(F.min(F.struct("site")).alias("one"), F.count(F.lit(1)).alias("n")).select("s_lat", "s_lon", "one.site", "n"))

    def near(some: DataFrame, width: float) -> DataFrame:
        met = grid_pairs(some, s, width).withColumn("km", _km()).where(F.col("km") <= width)
        within = [F.sum(F.when(F.col("km") <= r, F.col("n")).otherwise(0)).alias(c) for r, c in zip(radii, counts, strict=True)]
        return cut_lineage(met.groupBy(*at).agg(F.min(F.struct("km", "site")).alias("best"), *within))

    width = max(1.0, uncovered_km, *radii)
    found = near(spots, width)
    rest = cut_lineage(spots.join(found, at, "left_anti"))
    some = not s.isEmpty()
    while some and width < HALF_ROUND_KM and not rest.isEmpty():
        width *= 3
        more = near(rest, width)
        found, rest = found.unionByName(more), cut_lineage(rest.join(more, at, "left_anti"))
    out = p.join(found, at).groupBy("place").agg(F.min("best").alias("best"), *[F.sum(c).alias(c) for c in counts])
    km = F.round("best.km", 2)
    return out.select("place", F.col("best.site").alias("site"), km.alias("distance_km"), *counts, (km > uncovered_km).alias("uncovered"))


def nearest_values(mapping: DataFrame, readings: DataFrame) -> DataFrame:
    """readings (by site) for each place of its nearest site."""
    return mapping.select("place", "site").join(readings, "site")


def inverse_distance(places: DataFrame, sites: DataFrame, readings: DataFrame, periods: list[str], values: list[str], within_km: float = 50, power: float = 2) -> DataFrame:
    """Mean of the readings of all sites within a distance, weighted by 1 / distance ** power (a metre at least).

    Places and sites of one position are one row in the join of positions: its sites' readings are summed and counted by
    period before, its places get the sums after.
    """
    at, site_at, n = ["latitude", "longitude"], ["s_lat", "s_lon"], range(len(values))
    p, s = places.dropna(subset=at).select("place", *at), _sites(sites)
    known = [x for i, v in enumerate(values) for x in (F.sum(F.col(v).cast("double")).alias(f"__s{i}"), F.count(v).alias(f"__n{i}"))]
    read = s.join(readings, "site").groupBy(*site_at, *periods).agg(*known)
    near = grid_pairs(p.select(*at).distinct(), s.select(*site_at).distinct(), within_km).withColumn("__km", _km()).where(F.col("__km") <= within_km)
    w = F.lit(1.0) / F.pow(F.greatest("__km", F.lit(0.001)), F.lit(float(power)))
    weighed = [x for i in n for x in (F.sum(F.col(f"__s{i}") * F.col("__w")).alias(f"__s{i}"), F.sum(F.when(F.col(f"__n{i}") > 0, F.col(f"__n{i}") * F.col("__w"))).alias(f"__n{i}"))]
    spots = near.withColumn("__w", w).join(read, site_at).groupBy(*at, *periods).agg(*weighed)
    means = [F.try_divide(F.sum(f"__s{i}"), F.sum(f"__n{i}")).alias(v) for i, v in enumerate(values)]
    return p.join(spots, at).groupBy("place", *periods).agg(*means)
