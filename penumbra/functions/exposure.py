"""Heat, sun dose, rain and travel-cost rules as Column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: Felt temperature and score anchors; fixed values.
SCORE_ANCHORS = [(9.0, 0.0), (26.0, 40.0), (32.0, 60.0), (38.0, 80.0), (46.0, 100.0)]
#: Least score of each heat band above the first; fixed values.
HEAT_BANDS = [(40, "moderate heat stress"), (60, "strong heat stress"), (80, "very strong heat stress"), (100, "extreme heat stress")]
#: Felt degrees a W/m2 of sun and their cap; fixed values.
SUN_FELT_PER_WM2, SUN_FELT_MAX = 0.005, 6.5
#: Erythemal dose a minute and UV index, and the share of it in shade; fixed values.
SED_PER_MINUTE, SHADE_UV = 0.015, (0.2, 0.6)
#: Falling speed of rain in m/s and the limits of its angle above the horizon; fixed values.
RAIN_SPEED, RAIN_LOW, RAIN_HIGH = 9.0, 10.0, 89.5
#: Eight compass points; fixed values.
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
#: Speed, metres added for steps and for rough surfaces, and cycleway discount by mode; fixed values.
MODES = {"walk": (1.4, 0.0, 0.0, 0.0), "bike": (4.5, 500.0, 75.0, 40.0), "scoot": (3.0, 0.0, 1000.0, 0.0)}
SCOOT_BAD = ["bad", "very_bad", "horrible", "very_horrible", "impassable"]
#: Base confidence by shade source; fixed values.
CONFIDENCE = {"tiles": 0.8, "overpass": 0.7, "static": 0.75, "canopy": 0.35, "raster": 0.45, "shed": 0.3}


def felt_score(felt: Column) -> Column:
    """Piecewise-linear score through the anchors, flat outside."""
    out = F.when(felt <= SCORE_ANCHORS[0][0], F.lit(SCORE_ANCHORS[0][1]))
    for (x0, y0), (x1, y1) in zip(SCORE_ANCHORS, SCORE_ANCHORS[1:], strict=False):
        out = out.when(felt <= x1, F.lit(y0) + (felt - x0) / (x1 - x0) * (y1 - y0))
    return out.when(felt.isNotNull(), F.lit(SCORE_ANCHORS[-1][1]))


def heat_band(score: Column) -> Column:
    out = F.when(score < HEAT_BANDS[0][0], "no heat stress")
    for (_, name), (limit, _) in zip(HEAT_BANDS, HEAT_BANDS[1:], strict=False):
        out = out.when(score < limit, name)
    return out.when(score.isNotNull(), HEAT_BANDS[-1][1])


def felt_temperature(shade_felt: Column, sun_share: Column, sun_wm2: Column) -> Column:
    """Felt temperature in shade plus the sunlit share of a capped penalty."""
    return shade_felt + sun_share * F.least(F.lit(SUN_FELT_MAX), sun_wm2 * SUN_FELT_PER_WM2)


def sun_dose(uv: Column, sun_minutes: Column, shade_minutes: Column) -> Column:
    """Struct (low, high, uncertainty) of the standard erythemal dose; null where the UV index is unknown or negative."""
    sun, shade = F.greatest(F.lit(0.0), sun_minutes), F.greatest(F.lit(0.0), shade_minutes)
    low, high = (uv * SED_PER_MINUTE * (sun + shade * share) for share in SHADE_UV)
    ratio = F.when(high == 0, F.lit(1.0)).otherwise(high / F.nullif(low, F.lit(0.0)))
    word = F.when(ratio <= 1.6, "low").when(ratio <= 2.6, "medium").otherwise("high")
    return F.when(uv >= 0, F.struct(low.alias("low"), high.alias("high"), word.alias("uncertainty")))


def rain_angle(wind: Column) -> Column:
    """Angle of rain above the horizon for a wind speed; unknown wind is calm."""
    calm = F.greatest(F.lit(0.0), F.coalesce(wind, F.lit(0.0)))
    return F.greatest(F.lit(RAIN_LOW), F.least(F.lit(RAIN_HIGH), F.lit(90.0) - F.degrees(F.atan(calm / RAIN_SPEED))))


def compass(degrees: Column) -> Column:
    point = F.floor(F.pmod(degrees, F.lit(360.0)) / 45.0 + 0.5) % 8
    return F.element_at(F.array(*map(F.lit, COMPASS)), (point + 1).cast("int"))


def rain_opacity(light: Column) -> Column:
    """Opacity to rain: light opacity 0.3 to 0.9 maps to 0.1 to 0.4; without a light opacity, opaque."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (light - 0.3) / 0.6))
    return F.when(light.isNull(), F.lit(1.0)).otherwise(F.lit(0.1) + share * 0.3)


def mode_metres(mode: str, metres: Column, highway: Column, rough: Column, smoothness: Column, cycleway: Column) -> Column:
    """Cost in metres of an edge for a mode, at least one metre; ``rough`` and ``cycleway`` are conditions."""
    _, steps, surface, discount = MODES[mode]
    if mode == "walk":
        return metres
    cost = metres + F.when(highway == "steps", F.lit(steps)).otherwise(F.lit(0.0))
    if mode == "scoot":
        known = F.lower(F.trim(smoothness))
        cost = cost + (
            F.when(known.isin("excellent", "good"), F.lit(0.0))
            .when(known == "intermediate", F.lit(50.0))
            .when(known.isin(*SCOOT_BAD) | rough, F.lit(surface))
            .otherwise(F.lit(0.0))
        )
    else:
        cost = cost + F.when(rough, F.lit(surface)).otherwise(F.lit(0.0))
        cost = cost - F.when(cycleway, F.least(F.lit(discount), metres * 0.5)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1.0), cost)


def mode_seconds(mode: str, metres: Column, highway: Column) -> Column:
    speed, steps, _, _ = MODES[mode]
    return (metres + F.when(highway == "steps", F.lit(steps)).otherwise(F.lit(0.0))) / speed


def confidence(source: Column, altitude: Column, prisms: Column, completeness: Column) -> Column:
    """Confidence of a shade reading: by source, lower for a sun below 10 degrees and without geometry."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), source)
    horizon = F.when(altitude >= 10, F.lit(1.0)).otherwise(F.lit(0.3) + F.greatest(F.lit(0.0), altitude / 10.0) * 0.7)
    return base * horizon * F.when(prisms > 0, F.lit(1.0)).otherwise(F.lit(0.4)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), completeness))


def leaf_on(month: Column, lat: Column) -> Column:
    """Crowns bear leaves from April to October in the north, the other months in the south, always in the tropics."""
    summer = (month >= 4) & (month <= 10)
    return F.when(F.abs(lat) < 23.5, F.lit(True)).when(lat > 0, summer).otherwise(~summer)


def crown_opacity(month: Column, lat: Column) -> Column:
    return F.when(leaf_on(month, lat), F.lit(0.9)).otherwise(F.lit(0.3))


def point_shade(building: Column, shed: Column, crown: Column, raster: Column) -> Column:
    """A building or shed over a point shades it fully; otherwise the denser of crown and raster."""
    return F.when(building | shed, F.lit(1.0)).otherwise(F.greatest(F.coalesce(crown, F.lit(0.0)), F.coalesce(raster, F.lit(0.0))))


def sun_position(instant: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Azimuth from north and altitude of the sun in degrees, by the low-precision almanac formulas."""
    return sun_position_at(F.unix_micros(instant.cast("timestamp")) / 86400e6 - 10957.5, lon, lat)


def sun_position_at(days: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """``sun_position`` for days since noon of the first of January 2000, fractions of a microsecond included."""
    g = F.radians(F.pmod(days * 0.98560028 + 357.528, F.lit(360.0)))
    ecliptic = F.radians(F.pmod(days * 0.9856474 + 280.460, F.lit(360.0)) + F.sin(g) * 1.915 + F.sin(g * 2) * 0.020)
    tilt = F.radians(F.lit(23.439) - days * 4e-7)
    right = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.radians(F.pmod(days * 360.98564736629 + 280.46061837 + lon, F.lit(360.0)))
    hour = sidereal - right
    phi = F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    azimuth = F.atan2(-F.sin(hour), F.tan(declination) * F.cos(phi) - F.sin(phi) * F.cos(hour))
    return F.pmod(F.degrees(azimuth), F.lit(360.0)), F.degrees(altitude)


def solar_intensity(altitude: Column) -> Column:
    return F.greatest(F.lit(0.0), F.sin(F.radians(altitude)))


def effective_sun(sun: Column, tree: Column, rho: float) -> Column:
    """Sun metres with tree metres counted by the share that still feels sunny."""
    return sun + tree * rho


def chosen_logit(sun_gap: Column, shade_gap: Column, alpha: float, tau: float = 1.0) -> Column:
    """Utility gap of a pick against a rejected route, in hundreds of metres."""
    return -(sun_gap / 100.0 * alpha + shade_gap / 100.0) / tau
