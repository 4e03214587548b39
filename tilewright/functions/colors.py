"""Colours in texts: #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba(), hsl() and hsla(), as columns.

A colour is four numbers from 0 to 1 (r, g, b, a), multiplied by its opacity. What is no colour is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = r"#([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
RGB = rf"(?i)rgb(a?)\(\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*(?:,\s*({NUMBER})\s*)?\)"
HSL = rf"(?i)hsl(a?)\(\s*({NUMBER})\s*,\s*({NUMBER})%\s*,\s*({NUMBER})%\s*(?:,\s*({NUMBER})\s*)?\)"


def is_color(text: str) -> bool:
    """Whether a text has a colour's form; ranges are not looked at."""
    return any(re.fullmatch(p.replace("(?i)", ""), text, re.IGNORECASE) for p in (HEX, RGB, HSL))


def _part(text: Column, pattern: str, k: int) -> Column:
    """A group of a pattern as a number, or null."""
    return F.regexp_extract(text, f"^{pattern}$", k).try_cast("double")


def _struct(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct((r * a).alias("r"), (g * a).alias("g"), (b * a).alias("b"), a.alias("a"))


def _hex(text: Column, opaque: bool) -> Column:
    digits = F.when(F.length(text) <= 5, 1).otherwise(2)
    most = F.when(digits == 1, 15.0).otherwise(255.0)
    at = lambda k: F.conv(F.substring(text, 2 + k * digits, digits), 16, 10).cast("double") / most
    has = F.length(text) == 1 + 4 * digits
    return _struct(at(0), at(1), at(2), F.lit(1.0) if opaque else F.when(has, at(3)).otherwise(1.0))


def parse_color(text: Column, *, opaque: bool = False) -> Column:
    """struct<r,g,b,a>; opaque: without its opacity."""
    name = lambda p: text.rlike(f"^{p}$")
    alpha = lambda p: F.when(F.length(_text(text, p, 1)) > 0, _part(text, p, 5)).otherwise(1.0)
    # An alpha is there if, and only if, the name says so.
    fits = lambda p: (F.length(_text(text, p, 1)) > 0) == (F.length(_text(text, p, 5)) > 0)

    def scaled(p: str, r: Column, g: Column, b: Column, ok: Column) -> Column:
        a = alpha(p)
        return F.when(fits(p) & ok & a.between(0, 1), _struct(r, g, b, F.lit(1.0) if opaque else a))

    r, g, b = (_part(text, RGB, k) for k in (2, 3, 4))
    rgb = scaled(RGB, r / 255, g / 255, b / 255, r.between(0, 255) & g.between(0, 255) & b.between(0, 255))
    h, s, v = F.pmod(_part(text, HSL, 2), F.lit(360.0)) / 60, _part(text, HSL, 3) / 100, _part(text, HSL, 4) / 100
    chroma = (1 - F.abs(2 * v - 1)) * s
    second, base = chroma * (1 - F.abs(F.pmod(h, F.lit(2.0)) - 1)), v - chroma / 2

    def channel(*of: Column) -> Column:
        """What a channel is in each sixth of the circle of hues."""
        out = of[-1]
        for k in range(len(of) - 2, -1, -1):
            out = F.when(h < k + 1, of[k]).otherwise(out)
        return out + base

    zero = F.lit(0.0)
    hsl = scaled(HSL, channel(chroma, second, zero, zero, second, chroma), channel(second, chroma, chroma, second, zero, zero), channel(zero, zero, second, chroma, chroma, second), s.between(0, 1) & v.between(0, 1))
    return F.when(name(HEX), _hex(text, opaque)).when(name(RGB), rgb).when(name(HSL), hsl)


def _text(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, f"^{pattern}$", k)


def color_text(c: Column) -> Column:
    """#RRGGBBAA of a colour, its opacity taken out of its channels; halves go to the even number."""
    a = F.least(F.greatest(c["a"], F.lit(0.0)), F.lit(1.0))
    two = lambda v: F.lpad(F.hex(F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")), 2, "0")
    channel = lambda k: two(F.coalesce(c[k] / F.nullif(a, F.lit(0.0)), F.lit(0.0)))
    return F.when(c.isNotNull(), F.concat(F.lit("#"), channel("r"), channel("g"), channel("b"), two(a)))


def lerp_color(one: Column, other: Column, t: Column) -> Column:
    """The text of the colour at t from one to the other, channels and opacity alike; null if either is no colour."""
    a, b = parse_color(one), parse_color(other)
    mixed = F.struct(*[(a[k] + (b[k] - a[k]) * t).alias(k) for k in "rgba"])
    return F.when(a.isNotNull() & b.isNotNull(), color_text(mixed))
