"""Speed, fare and tip measures of a trip."""

from __future__ import annotations

from pyspark.sql import DataFrame

from urbanweave.functions.casting import as_columns, lenient_doubles


def add_fare_features(df: DataFrame) -> DataFrame:
    """speed_mph, fare_per_mile, tip_percentage, total_amount; NULL where undefined.

    Without a ``tips`` column the tip share is NULL and the total is the fare.
    """
    amounts = lenient_doubles(df, ["trip_miles", "trip_seconds", "fare", "tips"])
    tips = "tips" in amounts
    return df.withColumns(as_columns(amounts)).withColumns(
        as_columns(
            {
                "speed_mph": "CASE WHEN trip_seconds > 0 THEN trip_miles / (trip_seconds / 3600) END",
                "fare_per_mile": "CASE WHEN trip_miles > 0 THEN fare / trip_miles END",
                "tip_percentage": "CASE WHEN fare > 0 THEN tips / fare * 100 END" if tips else "cast(NULL AS double)",
                "total_amount": "fare + tips" if tips else "fare",
            }
        )
    )
