"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldmark.functions.text import _col


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _col(x)))


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Angle of two vectors; the cosine is held within [-1, 1]; null if one is zero."""
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    size = F.sqrt(sum(x * x for x in a)) * F.sqrt(sum(x * x for x in b))
    return F.acos(clamp(F.try_divide(dot, size), -1.0, 1.0))


def to_byte_range(x, lo: float, hi: float) -> Column:
    """Clamped to [lo, hi] and scaled to 0..255, truncated."""
    return ((clamp(x, lo, hi) - lo) / (hi - lo) * 255).cast("int")


def normalised(x, lo, hi) -> Column:
    return (_col(x) - lo) / (hi - lo + 1)


def surface(i, j) -> Column:
    """Height of a wavy surface."""
    return F.pow(F.sin(_col(i) / F.pi()) + 1, 2) + 2 * (F.sin(_col(j) / F.pi()) + 1)


def hue_saturation_brightness(red, green, blue) -> Column:
    """Of channels 0..255: each from 0 to 1; grey has hue and saturation 0."""
    r, g, b = (_col(c).cast("double") for c in (red, green, blue))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    part = lambda c: (top - c) / span
    sector = F.when(r == top, part(b) - part(g)).when(g == top, 2 + part(r) - part(b)).otherwise(4 + part(g) - part(r)) / 6
    hue = F.when(span == 0, 0.0).when(sector < 0, sector + 1).otherwise(sector)
    return F.struct(hue.alias("hue"), F.when(top == 0, 0.0).otherwise(span / top).alias("saturation"), (top / 255).alias("brightness"))


def gamma(c, exponent: float) -> Column:
    """A channel value 0..255 raised to an exponent through its logarithm; 0 stays 0."""
    return F.when(_col(c) <= 0, 0.0).otherwise(clamp(F.exp(exponent * F.ln(_col(c) / 255)) * 255, 0.0, 255.0))


def argb(alpha, red, green, blue) -> Column:
    """Channels packed into a signed 32-bit integer."""
    value = _col(alpha).cast("long") * (1 << 24) + _col(red).cast("long") * (1 << 16) + _col(green).cast("long") * (1 << 8) + _col(blue).cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def channel(packed, k: int) -> Column:
    """Channel k of packed colour: 0 blue, 1 green, 2 red, 3 alpha."""
    return F.shiftright(_col(packed), 8 * k).bitwiseAND(F.lit(255))


def deinterleave(values, channels: int) -> Column:
    """An array for each channel."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.filter(_col(values), lambda x, i: i % channels == c))


def to_unsigned(values) -> Column:
    """Shifted so that the least value is 0, if it is negative."""
    low = F.array_min(_col(values))
    return F.when(low < 0, F.transform(_col(values), lambda x: x - low)).otherwise(_col(values))


def reverse_bytes(x) -> Column:
    """The eight bytes of a long in the opposite order."""
    text = F.lpad(F.hex(_col(x).cast("long")), 16, "0")
    return F.conv(F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("long")


def grid_position(index, width: int) -> Column:
    """(x, y) of the cell with this index, row by row."""
    return F.struct(F.pmod(_col(index), F.lit(width)).cast("long").alias("x"), F.floor(_col(index) / width).alias("y"))


def grid_index(x, y, width: int) -> Column:
    return _col(y) * width + _col(x)


def is_prime(n) -> Column:
    """Trial division by 2, 3 and 6k - 1, 6k + 1 up to the root."""
    n = _col(n).cast("long")
    last = F.floor(F.sqrt(n))
    small = (n == 2) | (n == 3)
    tries = F.when(last >= 5, F.sequence(F.lit(5).cast("long"), F.greatest(last, F.lit(5).cast("long")), F.lit(6).cast("long"))).otherwise(F.array().cast("array<long>"))
    return small | ((n > 3) & (n % 2 != 0) & (n % 3 != 0) & F.forall(tries, lambda k: (n % k != 0) & ((k + 2 > last) | (n % (k + 2) != 0))))
