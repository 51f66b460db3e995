"""Community area number to neighbourhood name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.functions.casting import lenient_doubles

# The city's 77 community areas, numbered from 1 in this order.
AREA_NAMES = [
    "Rogers Park", "West Ridge", "Uptown", "Lincoln Square", "North Center",
    "Lake View", "Lincoln Park", "Near North Side", "Edison Park", "Norwood Park",
    "Jefferson Park", "Forest Glen", "North Park", "Albany Park", "Portage Park",
    "Irving Park", "Dunning", "Montclare", "Belmont Cragin", "Hermosa",
    "Avondale", "Logan Square", "Humboldt Park", "West Town", "Austin",
    "West Garfield Park", "East Garfield Park", "Near West Side", "North Lawndale", "South Lawndale",
    "Lower West Side", "Loop", "Near South Side", "Armour Square", "Douglas",
    "Oakland", "Fuller Park", "Grand Boulevard", "Kenwood", "Washington Park",
    "Hyde Park", "Woodlawn", "South Shore", "Chatham", "Avalon Park",
    "South Chicago", "Burnside", "Calumet Heights", "Roseland", "Pullman",
    "South Deering", "East Side", "West Pullman", "Riverdale", "Hegewisch",
    "Garfield Ridge", "Archer Heights", "Brighton Park", "McKinley Park", "Bridgeport",
    "New City", "West Elsdon", "Gage Park", "Clearing", "West Lawn",
    "Chicago Lawn", "West Englewood", "Englewood", "Greater Grand Crossing", "Ashburn",
    "Auburn Gresham", "Beverly", "Washington Heights", "Mount Greenwood", "Morgan Park",
    "O'Hare", "Edgewater",
]


def neighborhood_of(area: str) -> str:
    """Name of an area number; NULL when it is missing, unknown or not whole.

    An array lookup: the list is fixed, so no join is needed.
    """
    names = ", ".join('"' + name + '"' for name in AREA_NAMES)
    return f"""CASE WHEN {area} BETWEEN 1 AND {len(AREA_NAMES)} AND {area} = floor({area})
        THEN element_at(array({names}), cast({area} AS int)) END"""


def add_neighborhood(df: DataFrame) -> DataFrame:
    """Neighbourhood of the pickup; NULL for all rows when the area column is absent."""
    area = lenient_doubles(df, ["pickup_community_area"]).get("pickup_community_area")
    name = F.expr(neighborhood_of(area)) if area else F.lit(None).cast("string")
    return df.withColumn("neighborhood", name)
