"""Geography helpers: great-circle distance (K1) and region-pair route type (K2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Region groups used to infer a route type.
ASIA = ["east_asia", "sea_asia", "south_asia"]
EUROPE = ["n_europe", "med_europe"]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """K1: great-circle distance in km (R = 6371)."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    s_dphi = F.sin(F.radians(lat2 - lat1) / 2)
    s_dlam = F.sin(F.radians(lon2 - lon1) / 2)
    a = s_dphi * s_dphi + F.cos(phi1) * F.cos(phi2) * (s_dlam * s_dlam)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def infer_route_type(r1: Column, r2: Column) -> Column:
    """K2: symmetric region-pair rule; unknown region -> Commodity."""
    a1, a2 = r1.isin(ASIA), r2.isin(ASIA)
    e1, e2 = r1.isin(EUROPE), r2.isin(EUROPE)
    w1, w2 = r1 == "us_west", r2 == "us_west"
    u1, u2 = r1 == "us_east", r2 == "us_east"
    me = (r1 == "middle_east") | (r2 == "middle_east")
    return (F.when(r1.isNull() | r2.isNull(), "Commodity")
            .when((r1 == r2) & a1, "Intra-Asia")
            .when((a1 & e2) | (a2 & e1), "Suez")
            .when((a1 & w2) | (a2 & w1), "Pacific")
            .when((e1 & u2) | (e2 & u1), "Atlantic")
            .when(me & (e1 | e2 | a1 | a2), "Suez")
            .otherwise("Commodity"))
