"""Column expressions for the drought index: daylight hours, Thornthwaite PET, water
balance and days in a month. Everything is a built-in expression (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.constants import HEAT_A_COEF, HEAT_EXP, MID_MONTH_DOY, PET_HOT_COEF, PET_HOT_T


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def days_in_month(year: Column | str, month: Column | str) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(_c(year), _c(month), F.lit(1))))


def daylight_hours(lat: Column | str, month: Column | str) -> Column:
    """Mean daylight hours of a month (FAO): mid-month day, solar declination, sunset
    hour angle; the tan product is clipped to [-1, 1]."""
    doy = F.element_at(F.array(*[F.lit(d) for d in MID_MONTH_DOY]), _c(month).cast("int"))
    decl = F.lit(0.409) * F.sin(F.lit(2.0) * F.pi() * doy / 365 - 1.39)
    x = -F.tan(F.radians(_c(lat))) * F.tan(decl)
    x = F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    return F.lit(24.0) / F.pi() * F.acos(x)


def heat_exponent(heat_index: Column | str) -> Column:
    """Thornthwaite exponent a(I) = c3 I^3 + c2 I^2 + c1 I + c0."""
    i = _c(heat_index)
    c3, c2, c1, c0 = HEAT_A_COEF
    return F.lit(c3) * F.pow(i, 3) + F.lit(c2) * F.pow(i, 2) + F.lit(c1) * i + F.lit(c0)


def heat_term(normal_temp: Column | str) -> Column:
    """(T/5)^1.514 for a positive monthly normal, else 0 (summed into the heat index)."""
    t = _c(normal_temp)
    return F.when(t > 0, F.pow(t / 5, F.lit(HEAT_EXP))).otherwise(F.lit(0.0))


def pet_thornthwaite(temp: Column | str, heat_index: Column | str, a: Column | str,
                     lat: Column | str, year: Column | str, month: Column | str) -> Column:
    """Potential evapotranspiration: 0 when T is missing or <= 0; 16 (10T/I)^a below 26.5;
    quadratic above; floored at 0 and scaled by (daylight/12) (days/30)."""
    t = _c(temp)
    k0, k1, k2 = PET_HOT_COEF
    raw = (F.when(t.isNull() | (t <= 0), F.lit(0.0))
           .when(t < PET_HOT_T, F.lit(16.0) * F.pow(F.try_divide(10 * t, _c(heat_index)), _c(a)))
           .otherwise(F.lit(k0) + F.lit(k1) * t + F.lit(k2) * t * t))
    return (F.greatest(raw, F.lit(0.0)) * (daylight_hours(lat, month) / 12)
            * (days_in_month(year, month) / 30))


def water_balance(precip: Column | str, pet: Column | str) -> Column:
    return _c(precip) - _c(pet)
