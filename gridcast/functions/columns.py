"""Keys, casts and min-max scaling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_from_path() -> Column:
    """The entity of a one-file-per-entity source: the file's stem."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.csv$", 1)


def day_key(entity: Column, day: Column, *more: Column) -> Column:
    """`<entity>_<yyyy-mm-dd>[_<hour>…]`; null where a part is null."""
    parts = [entity.cast("string"), day.cast("string"), *(m.cast("string") for m in more)]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("_"), p)
    return out


def minute_slot(ts: Column) -> Column:
    """Ten-minute slot within the hour, 0 to 5."""
    return F.floor(F.minute(ts) / 10).cast("int")


def normalised_entity(raw: Column, missing: int = 30) -> Column:
    """An entity read as a number: null becomes `missing`, fractions are cut off, then text.

    Ids past a short stay as they are, as wrapping would merge entities. Integers never pass through a double, which is
    for text such as "30.0"; a number that no long can hold is an error.
    """
    number = F.coalesce(raw.cast("double"), F.lit(float(missing))).cast("bigint")
    return F.coalesce(raw.try_cast("bigint"), number).cast("string")


def zero_filled(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def scaled(x: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Min-max transform without clipping; a constant series (low = high) becomes the lower end."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    unit = (x - low) / span
    return unit if to == (0.0, 1.0) else unit * (to[1] - to[0]) + to[0]


def unscaled(x: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Inverse of scaled()."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    unit = x if to == (0.0, 1.0) else (x - to[0]) / (to[1] - to[0])
    return unit * span + low
