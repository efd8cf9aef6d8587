"""Calendar, cyclical and holiday expressions on a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mastwire.functions.numeric import any_of


def parse_date(text: Column, *formats: str) -> Column:
    """The first format that fits, else missing; never an error."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def weekend(date: Column, days=(5, 6)) -> Column:
    """Saturday and Sunday unless told otherwise; Friday and Saturday are (4, 5)."""
    return F.weekday(date).isin(*days).cast("int")


def wave(value: Column, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi * harmonic / period)
    return F.sin(angle), F.cos(angle)


def damped_trend(days: Column, phi: float = 0.4) -> Column:
    return (1.0 - F.exp(days / 365.25 * -phi)) / phi


def holiday(date: Column) -> Column:
    """Fixed days, then the Monday and Thursday holidays, as 1.0 or 0.0."""
    month, day, dow = F.month(date), F.dayofmonth(date), F.weekday(date)
    # Fixed values: (month, day) of the fixed holidays.
    fixed = [(1, 1), (7, 4), (12, 24), (12, 25), (12, 31)]
    rules = [(month == m) & (day == d) for m, d in fixed] + [
        (month == 5) & (dow == 0) & (day >= 25),
        (month == 9) & (dow == 0) & (day <= 7),
        (month == 11) & (dow == 3) & day.between(22, 28),
    ]
    return any_of(rules).cast("double")


def calendar_features(date: Column) -> dict[str, Column]:
    dow, doy = F.weekday(date), F.dayofyear(date)
    sin_dow, cos_dow = wave(dow, 7.0)
    sin_doy, cos_doy = wave(doy, 365.25)
    return {
        "day_of_week": dow,
        "is_weekend": weekend(date),
        "month": F.month(date),
        "day_of_month": F.dayofmonth(date),
        "day_of_year": doy,
        "week_of_year": F.weekofyear(date),
        "sin_dow": sin_dow,
        "cos_dow": cos_dow,
        "sin_doy": sin_doy,
        "cos_doy": cos_doy,
    }


def harmonic_features(date: Column, origin: Column) -> dict[str, Column]:
    """Damped trend plus annual and weekly harmonics, counted from one phase origin."""
    t = F.datediff(date, origin).cast("double")
    out = {"trend_damped": damped_trend(t)}
    for period, name, count in ((365.25, "annual", 3), (7.0, "weekly", 2)):
        for k in range(1, count + 1):
            out[f"{name}_sin_k{k}"], out[f"{name}_cos_k{k}"] = wave(t, period, k)
    out["month_sin"], out["month_cos"] = wave(F.month(date), 12.0)
    dow = F.weekday(date)
    out["is_weekend"] = (dow >= 5).cast("double")
    out["midweek_peak"] = dow.between(1, 3).cast("double")
    out["is_holiday"] = holiday(date)
    return out
