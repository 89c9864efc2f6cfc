"""Colour conversions as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_rgb(c: Column) -> Column:
    at = lambda k: F.conv(F.substring(F.replace(c, F.lit("#")), k, 2), 16, 10).cast("int")
    return F.struct(at(1).alias("r"), at(3).alias("g"), at(5).alias("b"))


def rgb_to_hsl(rgb: Column) -> Column:
    """Hue in degrees, saturation and lightness in percent."""
    r, g, b = (rgb[k] / 255 for k in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    turn = F.when(top == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    hue = F.when(d == 0, F.lit(0.0)).otherwise(turn * 60)
    sat = F.when(d == 0, F.lit(0.0)).when(light > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
    return F.struct(hue.alias("h"), (sat * 100).alias("s"), (light * 100).alias("l"))


def hsl_to_hex(hsl: Column) -> Column:
    h, s, light = hsl["h"], hsl["s"] / 100, hsl["l"] / 100
    a = s * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(n) + h / 30, F.lit(12))
        v = light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(v * 255 + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))
