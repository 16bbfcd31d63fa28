"""The FAO-56 formulas as column functions.

Temperatures in degrees Celsius unless said otherwise, pressures in kPa,
radiation in MJ per square metre and day, angles in radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLAR_CONSTANT = 0.0820
STEFAN_BOLTZMANN = 0.000000004903
#: Ventilated (Asmann), natural ventilated, and non-ventilated indoor psychrometers.
PSYCHROMETERS = {1: 0.000662, 2: 0.000800, 3: 0.001200}


def declination(doy: Column) -> Column:
    return 0.409 * F.sin(2.0 * math.pi / 365.0 * doy - 1.39)


def sunset_hour_angle(lat: Column, dec: Column) -> Column:
    return F.acos(F.least(F.greatest(-F.tan(lat) * F.tan(dec), F.lit(-1.0)), F.lit(1.0)))


def inverse_distance(doy: Column) -> Column:
    return 1 + 0.033 * F.cos(2.0 * math.pi / 365.0 * doy)


def daylight_hours(sha: Column) -> Column:
    return 24.0 / math.pi * sha


def extraterrestrial(lat: Column, dec: Column, sha: Column, ird: Column) -> Column:
    return 24.0 * 60.0 / math.pi * SOLAR_CONSTANT * ird * (sha * F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.sin(sha))


def saturation(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def mean_saturation(tmin: Column, tmax: Column) -> Column:
    return (saturation(tmin) + saturation(tmax)) / 2.0


def saturation_slope(t: Column) -> Column:
    return 4098 * saturation(t) / ((t + 237.3) * (t + 237.3))


def vapour_from_tmin(tmin: Column) -> Column:
    return 0.611 * F.exp(17.27 * tmin / (tmin + 237.3))


def vapour_from_humidities(svp_tmin: Column, svp_tmax: Column, rh_min: Column, rh_max: Column) -> Column:
    return (svp_tmin * rh_max / 100.0 + svp_tmax * rh_min / 100.0) / 2.0


def vapour_from_max_humidity(svp_tmin: Column, rh_max: Column) -> Column:
    return svp_tmin * rh_max / 100.0


def vapour_from_mean_humidity(svp_tmin: Column, svp_tmax: Column, rh_mean: Column) -> Column:
    return rh_mean / 100.0 * (svp_tmax + svp_tmin) / 2.0


def vapour_from_dew(tdew: Column) -> Column:
    return saturation(tdew)


def vapour_from_wet_bulb(twet: Column, tdry: Column, svp_twet: Column, psy: Column) -> Column:
    return svp_twet - psy * (tdry - twet)


def relative_humidity(avp: Column, svp: Column) -> Column:
    return 100.0 * avp / svp


def air_pressure(altitude: Column) -> Column:
    return F.pow((293.0 - 0.0065 * altitude) / 293.0, F.lit(5.26)) * 101.3


def psychrometric(pressure: Column) -> Column:
    return 0.000665 * pressure


def psychrometric_of(kind: Column, pressure: Column) -> Column:
    """By the kind of psychrometer; another kind is an error."""
    out = F.raise_error(F.concat(F.lit("no psychrometer of kind "), kind.cast("string"))).cast("double")
    for k, c in PSYCHROMETERS.items():
        out = F.when(kind == k, F.lit(c)).otherwise(out)
    return out * pressure


def clear_sky(altitude: Column, et_rad: Column) -> Column:
    return (0.00002 * altitude + 0.75) * et_rad


def net_shortwave(rs: Column, albedo: float = 0.23) -> Column:
    return (1 - albedo) * rs


def net_longwave(tmin_k: Column, tmax_k: Column, rs: Column, cs: Column, avp: Column) -> Column:
    """Temperatures in kelvin."""
    fourth = lambda x: x * x * x * x
    return STEFAN_BOLTZMANN * (fourth(tmax_k) + fourth(tmin_k)) / 2 * (0.34 - 0.14 * F.sqrt(avp)) * (1.35 * F.try_divide(rs, cs) - 0.35)


def evaporation_of(energy: Column) -> Column:
    return 0.408 * energy


def radiation_from_sun_hours(daylight: Column, sun: Column, et_rad: Column) -> Column:
    return (0.5 * F.try_divide(sun, daylight) + 0.25) * et_rad


def radiation_from_temperature(et_rad: Column, cs: Column, tmin: Column, tmax: Column, coastal: Column) -> Column:
    return F.least(F.when(coastal, 0.19).otherwise(0.16) * F.sqrt(tmax - tmin) * et_rad, cs)


def radiation_of_island(et_rad: Column) -> Column:
    return 0.7 * et_rad - 4.0


def wind_at_2m(speed: Column, height: Column) -> Column:
    return speed * (4.87 / F.ln(67.8 * height - 5.42))


def hargreaves(tmin: Column, tmax: Column, et_rad: Column) -> Column:
    """Null where `tmax` is under `tmin`, which simulated days can have."""
    span = F.when(tmax >= tmin, tmax - tmin)
    return 0.0023 * ((tmin + tmax) / 2 + 17.8) * F.sqrt(span) * 0.408 * et_rad


def penman_monteith(net: Column, t_k: Column, wind: Column, svp: Column, avp: Column, slope: Column, psy: Column, shf: float = 0.0) -> Column:
    """Mean temperature in kelvin."""
    bottom = slope + psy * (1 + 0.34 * wind)
    return 0.408 * (net - shf) * slope / bottom + 900 * wind / t_k * (svp - avp) * psy / bottom
