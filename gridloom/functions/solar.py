"""The sun's place in the sky by the low-precision formulas of the Astronomical Almanac, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mod(x: Column, by: float) -> Column:
    return x - F.floor(x / by) * by


def position(seconds: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """azimuth (degrees from north by east), altitude, refraction, elevation (altitude with refraction), declination, right
    ascension (hours) and distance (astronomical units) at an epoch second, for degrees north and east."""
    days = seconds / 86400.0 - 10957.5
    anomaly = F.radians(_mod(357.528 + 0.9856003 * days, 360))
    mean = _mod(280.460 + 0.9856474 * days, 360)
    ecliptic = F.radians(_mod(mean + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly), 360))
    tilt = F.radians(23.439 - 0.0000004 * days)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    greenwich = _mod(18.697374558 + 24.06570982441908 * days, 24)
    hour = F.radians(_mod(greenwich * 15 + longitude - F.degrees(ascension) + 180, 360) - 180)
    lat = F.radians(latitude)
    altitude = F.asin(F.sin(declination) * F.sin(lat) + F.cos(declination) * F.cos(lat) * F.cos(hour))
    azimuth = F.atan2(-F.cos(declination) * F.sin(hour), F.sin(declination) * F.cos(lat) - F.cos(declination) * F.cos(hour) * F.sin(lat))
    degrees = F.degrees(altitude)
    bent = F.when(degrees >= 19.225, 0.00452 * 3.51561 / F.tan(altitude)).when(
        degrees > -0.766, 3.51561 * (0.1594 + 0.0196 * degrees + 0.00002 * degrees * degrees) / (1 + 0.505 * degrees + 0.0845 * degrees * degrees)
    ).otherwise(F.lit(0.0))
    return {
        "azimuth": _mod(F.degrees(azimuth), 360),
        "altitude": degrees,
        "refraction": bent,
        "elevation": degrees + bent,
        "declination": F.degrees(declination),
        "right_ascension": _mod(F.degrees(ascension) / 15, 24),
        "distance": 1.00014 - 0.01671 * F.cos(anomaly) - 0.00014 * F.cos(2 * anomaly),
    }
