"""Calendar attributes of a trip's start time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from urbanweave.functions.casting import as_columns

# Peak hours (inclusive) and the months of each season.
RUSH_HOURS = [(7, 9), (17, 19)]
SEASON_MONTHS = {
    "Winter": [12, 1, 2],
    "Spring": [3, 4, 5],
    "Summer": [6, 7, 8],
    "Fall": [9, 10, 11],
}
UNKNOWN_SEASON = "Unknown"


def _flag(condition: str) -> str:
    """1 when true, 0 when false or NULL."""
    return f"cast(coalesce({condition}, false) AS int)"


def rush_flag(hour: str) -> str:
    return _flag(" OR ".join(f"{hour} BETWEEN {first} AND {last}" for first, last in RUSH_HOURS))


def season_of(month: str) -> str:
    cases = " ".join(
        f"WHEN {month} IN ({', '.join(map(str, months))}) THEN '{season}'" for season, months in SEASON_MONTHS.items()
    )
    return f"CASE {cases} ELSE '{UNKNOWN_SEASON}' END"


def _fixed_date_holiday(day: str) -> str:
    """New Year, Juneteenth (since 2021), Independence, Veterans and Christmas Day."""
    month_day = f"month({day}) * 100 + dayofmonth({day})"
    return f"({month_day} IN (101, 704, 1111, 1225) OR ({month_day} = 619 AND year({day}) >= 2021))"


def _weekday_holiday(day: str) -> str:
    """Holidays set as the n-th weekday of a month (a Monday, but a Thursday in November)."""
    return f"""CASE weekday({day})
        WHEN 0 THEN CASE month({day})
            WHEN 1 THEN dayofmonth({day}) BETWEEN 15 AND 21
            WHEN 2 THEN dayofmonth({day}) BETWEEN 15 AND 21
            WHEN 5 THEN dayofmonth({day}) >= 25
            WHEN 9 THEN dayofmonth({day}) <= 7
            WHEN 10 THEN dayofmonth({day}) BETWEEN 8 AND 14
        END
        WHEN 3 THEN month({day}) = 11 AND dayofmonth({day}) BETWEEN 22 AND 28
    END"""


def holiday_flag(day: str) -> str:
    """1 on a US federal holiday or its observed day (Saturday to Friday, Sunday to Monday).

    Computed from the rules, so no calendar table has to cover the data's years.
    """
    return _flag(
        f"""{_fixed_date_holiday(day)}
        OR (weekday({day}) = 4 AND {_fixed_date_holiday(f"date_add({day}, 1)")})
        OR (weekday({day}) = 0 AND {_fixed_date_holiday(f"date_sub({day}, 1)")})
        OR coalesce({_weekday_holiday(day)}, false)"""
    )


def add_calendar_features(df: DataFrame) -> DataFrame:
    """hour, day_of_week (0 = Monday), month, is_weekend, is_rush_hour, season, is_holiday."""
    ts = "trip_start_timestamp"
    return df.withColumns(
        as_columns(
            {
                "hour": f"hour({ts})",
                "day_of_week": f"weekday({ts})",
                "month": f"month({ts})",
                "is_weekend": _flag(f"weekday({ts}) IN (5, 6)"),
                "is_rush_hour": rush_flag(f"hour({ts})"),
                "season": season_of(f"month({ts})"),
                "is_holiday": holiday_flag(f"cast({ts} AS date)"),
            }
        )
    )
