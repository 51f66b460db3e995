"""Casts that turn bad values into NULL instead of failing.

The casts are SQL texts, to be used inside larger expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text accepted as a number. Spark's own cast also takes '12d', which is not one.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def lenient_doubles(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """SQL per column of ``names`` that ``df`` has: its value as double.

    Text that is no number and NaN become NULL.
    """
    kinds = dict(df.dtypes)
    texts = {}
    for name in names:
        if kinds.get(name) == "string":
            texts[name] = f"CASE WHEN {name} RLIKE r'{NUMBER_TEXT}' THEN try_cast(trim({name}) AS double) END"
        elif name in kinds:
            texts[name] = f"nanvl(cast({name} AS double), cast(NULL AS double))"
    return texts


def as_columns(texts: dict[str, str]) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in texts.items()}


def lenient_timestamp(name: str) -> str:
    """SQL for column ``name`` as zone-less timestamp; unreadable text becomes NULL."""
    return f"try_cast({name} AS timestamp_ntz)"


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, returned as double."""
    return F.round(value.try_cast("decimal(38,10)"), digits).cast("double")


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the decimal value, returned as double."""
    return F.bround(value.try_cast("decimal(38,10)"), digits).cast("double")


def share_pct(part: Column, whole: Column) -> Column:
    """``part`` as percentage of ``whole``; 0 when ``whole`` is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
