"""Values a map or dashboard shows: colours, labels and screen positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour above each threshold, checked from the top; the last is the rest.
FLOW_COLORS = [
    (0.8, "#800026"),
    (0.6, "#BD0026"),
    (0.4, "#E31A1C"),
    (0.2, "#FC4E2A"),
    (0.1, "#FD8D3C"),
    (0.05, "#FEB24C"),
]
FLOW_REST = "#FFEDA0"
PAGERANK_COLORS = [
    (0.8, "#003566"),
    (0.6, "#0077B6"),
    (0.4, "#0096C7"),
    (0.2, "#00B4D8"),
    (0.05, "#90E0EF"),
]
PAGERANK_REST = "#CAF0F8"
COMMUNITY_COLORS = [
    "#E63946", "#457B9D", "#2A9D8F", "#E9C46A", "#F4A261",
    "#264653", "#A8DADC", "#F1FAEE", "#6A4C93", "#1982C4",
]
# Labels of the days from Monday on, and of the peak flag 0 and 1.
DAY_LABELS = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]
RUSH_LABELS = ["Fora do Pico", "Rush Hour"]
# Corners of the mapped cells.
MAP_BOUNDS = {"lat_min": 41.6596, "lat_max": 42.0222, "lon_min": -87.8807, "lon_max": -87.5279}


def _color(level: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    chain = F
    for threshold, color in steps:
        chain = chain.when(level > threshold, color)
    return chain.otherwise(rest)


def flow_color(level: Column) -> Column:
    return _color(level, FLOW_COLORS, FLOW_REST)


def pagerank_color(level: Column) -> Column:
    return _color(level, PAGERANK_COLORS, PAGERANK_REST)


def opacity(level: Column) -> Column:
    return level * 0.7 + 0.2


def community_color(community: Column) -> Column:
    palette = F.array(*[F.lit(c) for c in COMMUNITY_COLORS])
    return F.element_at(palette, (community % len(COMMUNITY_COLORS) + 1).cast("int"))


def day_label(day_of_week: Column) -> Column:
    """Label of a weekday; a number outside the week is shown as it is."""
    known = F.get(F.array(*[F.lit(d) for d in DAY_LABELS]), day_of_week)
    return F.coalesce(known, day_of_week.cast("string"))


def rush_label(is_rush_hour: Column) -> Column:
    off_peak, peak = RUSH_LABELS
    return F.when(is_rush_hour == 1, peak).otherwise(off_peak)


def cell_label(neighborhood: Column, cell: Column) -> Column:
    """Neighbourhood name, or the start of the cell id when it is missing or empty."""
    return F.coalesce(F.nullif(neighborhood, F.lit("")), F.concat(F.substring(cell, 1, 12), F.lit("...")))


def in_thousands(value: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.round(value / 1e3, 0)), F.lit("k"))


def in_millions(value: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(value / 1e6, digits)), F.lit("M"))


def four_digits(value: Column) -> Column:
    return F.format_string("%.4f", F.round(value, 4))


def to_viewport(
    lat: Column, lon: Column, width: float, height: float, left: float = 0.0, top: float = 0.0, bounds: dict | None = None
) -> Column:
    """struct(x, y): linear position in a rectangle; north is at the top."""
    b = bounds or MAP_BOUNDS
    x = left + (lon - b["lon_min"]) / (b["lon_max"] - b["lon_min"]) * width
    y = top + (b["lat_max"] - lat) / (b["lat_max"] - b["lat_min"]) * height
    return F.struct(x.alias("x"), y.alias("y"))
