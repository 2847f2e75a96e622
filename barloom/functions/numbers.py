"""Rounding, cleaning and small array mathematics as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as true and as false.
TRUE_TEXTS = ["true", "1", "yes", "y"]
FALSE_TEXTS = ["false", "0", "no", "n"]


def half_even(value: Column, digits: int) -> Column:
    """Scaled rounding to the nearest even, as array libraries round."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def clean_number(value: Column, allow_zero: bool = True, allow_negative: bool = False) -> Column:
    """A finite number or NULL."""
    x = value.try_cast("double")
    ok = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    if not allow_negative:
        ok = ok & (x >= 0)
    if not allow_zero:
        ok = ok & (x != 0)
    return F.when(ok, x)


def clean_text(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def clean_flag(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)


def clean_symbol(value: Column) -> Column:
    """Trimmed upper-case symbol without leading dollar signs; NULL when malformed."""
    s = F.regexp_replace(F.upper(F.trim(value)), r"^\$+", "")
    return F.when(s.rlike(r"^[A-Z0-9][A-Z0-9.\-#]{0,14}$"), s)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays from one pass of sums; NULL when either is constant."""
    names = ("x", "y", "xx", "yy", "xy")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    sums = F.aggregate(
        F.arrays_zip(a.alias("x"), b.alias("y")),
        zero,
        lambda s, p: F.struct(
            (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"),
            (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"),
            (s["xy"] + p["x"] * p["y"]).alias("xy"),
        ),
        lambda s: F.try_divide(
            F.size(a) * s["xy"] - s["x"] * s["y"],
            F.sqrt(F.greatest((F.size(a) * s["xx"] - s["x"] * s["x"]) * (F.size(a) * s["yy"] - s["y"] * s["y"]), F.lit(0.0))),
        ),
    )
    return sums


def similarity(live: Column, mean: Column) -> Column:
    """Correlation mapped to 0..100 with one decimal; 0 for constant or too short series."""
    n = F.least(F.size(live), F.size(mean))
    a, b = F.slice(live, -n, n), F.slice(mean, -n, n)
    r = F.when(n >= 3, pearson(a, b))
    varies = (F.array_max(a) > F.array_min(a)) & (F.array_max(b) > F.array_min(b))
    return F.coalesce(F.when(varies, half_even((r + 1) / 2 * 100, 1)), F.lit(0.0))
