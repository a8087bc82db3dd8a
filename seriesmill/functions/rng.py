"""Random draws as column expressions of a seed and a key: the same on any partitioning, on retry, and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


TRIES = 8  # candidates of a Gamma draw


def _bits(seed: int, salt: str, keys: tuple[Column, ...]) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")


def uniform(seed: int, salt: str, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return _bits(seed, salt, keys) / F.lit(2.0**32)


def normal(seed: int, salt: str, *keys: Column) -> Column:
    """A standard normal draw from two uniforms (Box and Muller)."""
    u = (_bits(seed, salt + "a", keys) + 1) / F.lit(2.0**32 + 1)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * uniform(seed, salt + "b", *keys))


def exponential(seed: int, salt: str, *keys: Column) -> Column:
    return -F.ln((_bits(seed, salt, keys) + 1) / F.lit(2.0**32 + 1))


def gamma(seed: int, salt: str, alpha: float, *keys: Column) -> Column:
    """A Gamma(alpha, 1) draw by Marsaglia and Tsang's method, from the first of TRIES candidates that it accepts.

    Each is accepted with a chance above 0.95, so none is once in 10^10 draws,
    and then the last one stands. Below 1 the draw for alpha + 1 is scaled by a
    power of a uniform.
    """
    d = (alpha if alpha >= 1 else alpha + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    found = []
    for i in range(TRIES):
        x = normal(seed, f"{salt}x{i}", *keys)
        v = (1 + c * x) * (1 + c * x) * (1 + c * x)
        u = (_bits(seed, f"{salt}u{i}", keys) + 1) / F.lit(2.0**32 + 1)
        good = (v > 0) & (F.ln(u) < 0.5 * x * x + d - d * v + d * F.ln(F.when(v > 0, v)))
        found.append(F.when(good | F.lit(i == TRIES - 1), d * F.greatest(v, F.lit(0.0))))
    drawn = F.coalesce(*found)
    return drawn if alpha >= 1 else drawn * F.pow((_bits(seed, f"{salt}p", keys) + 1) / F.lit(2.0**32 + 1), F.lit(1 / alpha))


def randint(seed: int, salt: str, low: Column, high: Column, *keys: Column) -> Column:
    """An integer between low and high, both included."""
    return (low + F.floor(uniform(seed, salt, *keys) * (high - low + 1))).cast("int")
