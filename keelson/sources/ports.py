"""Port dimension (A2): 31 ports with coordinates, region tag and region label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Port name, latitude, longitude, region tag (order gives port_idx 0..30).
PORTS = [
    ("Shanghai, CN", 31.23, 121.47, "east_asia"),
    ("Los Angeles, US", 34.05, -118.24, "us_west"),
    ("Tokyo, JP", 35.68, 139.69, "east_asia"),
    ("Singapore, SG", 1.35, 103.82, "sea_asia"),
    ("Shenzhen, CN", 22.54, 114.06, "east_asia"),
    ("Rotterdam, NL", 51.92, 4.48, "n_europe"),
    ("Santos, BR", -23.96, -46.33, "latam"),
    ("Hamburg, DE", 53.55, 9.99, "n_europe"),
    ("New York, US", 40.71, -74.01, "us_east"),
    ("Mumbai, IN", 19.08, 72.88, "south_asia"),
    ("Felixstowe, UK", 51.96, 1.35, "n_europe"),
    ("Ningbo-Zhoushan, CN", 29.87, 121.54, "east_asia"),
    ("Busan, KR", 35.10, 129.04, "east_asia"),
    ("Hong Kong, HK", 22.32, 114.17, "east_asia"),
    ("Port Klang, MY", 3.00, 101.39, "sea_asia"),
    ("Jebel Ali, AE", 25.01, 55.06, "middle_east"),
    ("Piraeus, GR", 37.94, 23.65, "med_europe"),
    ("Antwerp, BE", 51.22, 4.40, "n_europe"),
    ("Le Havre, FR", 49.49, 0.10, "n_europe"),
    ("Valencia, ES", 39.47, -0.38, "med_europe"),
    ("Algeciras, ES", 36.13, -5.45, "med_europe"),
    ("Colombo, LK", 6.93, 79.85, "south_asia"),
    ("Jakarta, ID", -6.10, 106.88, "sea_asia"),
    ("Ho Chi Minh City, VN", 10.76, 106.70, "sea_asia"),
    ("Laem Chabang, TH", 13.08, 100.88, "sea_asia"),
    ("Durban, ZA", -29.87, 31.02, "africa"),
    ("Lagos, NG", 6.45, 3.39, "africa"),
    ("Callao, PE", -12.05, -77.15, "latam"),
    ("Vancouver, CA", 49.28, -123.12, "us_west"),
    ("Savannah, US", 32.08, -81.09, "us_east"),
    ("Karachi, PK", 24.85, 66.99, "south_asia"),
]

# Region tag -> display label.
REGION_LABELS = {
    "east_asia": "East Asia", "sea_asia": "Southeast Asia", "south_asia": "South Asia",
    "middle_east": "Middle East", "n_europe": "Northern Europe", "med_europe": "Mediterranean Europe",
    "us_east": "US East Coast", "us_west": "US West Coast", "latam": "Latin America", "africa": "Africa",
}

UNKNOWN_REGION = "Unknown region"

PORT_SCHEMA = T.StructType([
    T.StructField("port_idx", T.IntegerType(), False),
    T.StructField("port", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("region", T.StringType(), True),
    T.StructField("region_label", T.StringType(), False),
])


def ports(spark: SparkSession) -> DataFrame:
    """31-row port dimension; small by construction, so joins broadcast it."""
    rows = [(i, p, lat, lon, reg, REGION_LABELS.get(reg, UNKNOWN_REGION))
            for i, (p, lat, lon, reg) in enumerate(PORTS)]
    return spark.createDataFrame(rows, PORT_SCHEMA)


def ports_values_sql() -> str:
    """The same dimension as a SQL VALUES list (for oracle queries)."""
    rows = ",\n    ".join(
        f"({i}, '{p}', {lat!r}e0, {lon!r}e0, '{reg}', '{REGION_LABELS.get(reg, UNKNOWN_REGION)}')"
        for i, (p, lat, lon, reg) in enumerate(PORTS))
    return ("SELECT * FROM (VALUES\n    " + rows +
            "\n) AS t(port_idx, port, lat, lon, region, region_label)")
