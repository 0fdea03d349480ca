"""Colour expressions: hexadecimal forms, luminance, Lab, the nearest of a palette."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: sRGB to XYZ (D65), the reference white, and the weights of luminance; below, the standard's curves of
# brightness and of Lab, and the weights of colour difference
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)
LUMINANCE = (0.2126, 0.7152, 0.0722)


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("int")), 2, "0")) for c in (r, g, b)])


def from_hex(text: Column) -> Column:
    """Struct of r, g, b of ``#rrggbb`` or ``#rgb``; null for other texts."""
    short = F.rlike(text, F.lit("^#[0-9A-Fa-f]{3}$"))
    full = F.when(short, F.regexp_replace(text, "([0-9A-Fa-f])", "$1$1")).otherwise(text)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    return F.when(short | F.rlike(text, F.lit("^#[0-9A-Fa-f]{6}$")), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def parse_colour(text: Column) -> Column:
    """Struct of r, g, b of ``#rrggbb``, ``#rgb`` or ``rgb(r, g, b)`` and ``rgba(r, g, b, a)``; null for other texts."""
    form = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    by_name = F.when(F.rlike(text, F.lit(form)), F.struct(*[F.regexp_extract(text, form, i + 1).cast("int").alias(n) for i, n in enumerate("rgb")]))
    return F.coalesce(from_hex(text), by_name)


def luminance(r: Column, g: Column, b: Column) -> Column:
    def straight(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return sum((straight(c) * w for c, w in zip((r, g, b), LUMINANCE, strict=True)), F.lit(0.0))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of a colour in bytes."""

    def straight(c: Column) -> Column:
        v = c / 255
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    def curve(v: Column) -> Column:
        return F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16 / 116)

    rgb = [straight(c) for c in (r, g, b)]
    x, y, z = (curve(sum((c * w for c, w in zip(rgb, row, strict=True)), F.lit(0.0)) / white) for row, white in zip(TO_XYZ, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """How far two colours in Lab lie apart, lightness, chroma and hue weighed by the first one's chroma."""
    c1, c2 = (F.sqrt(x[1] * x[1] + x[2] * x[2]) for x in (a, b))
    hue2 = F.greatest(F.pow(a[1] - b[1], 2) + F.pow(a[2] - b[2], 2) - F.pow(c1 - c2, 2), F.lit(0.0))
    return F.sqrt(F.pow(a[0] - b[0], 2) + F.pow((c1 - c2) / (1 + 0.045 * c1), 2) + hue2 / F.pow(1 + 0.015 * c1, 2))


def nearest_palette(r: Column, g: Column, b: Column, palette: list[tuple[str, int, int, int]]) -> Column:
    """The name of the palette's colour (name, r, g, b) nearest to a cell's; the one listed first of equally near ones."""
    own = lab(r, g, b)
    ranked = [F.struct(delta_e(own, lab(*map(F.lit, rgb))).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, *rgb) in enumerate(palette)]
    return F.array_min(F.array(*ranked))["name"]
