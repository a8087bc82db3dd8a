"""Expert losses and their gradients as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (loss(f, y), gradient(f, y, fc)); f a member's forecast, fc the mixture's.
LOSSES: dict[str, tuple[Callable[..., Column], Callable[..., Column]]] = {
    "square": (lambda f, y: (f - y) * (f - y), lambda f, y, fc: 2 * (fc - y) * f),
    "absolute": (lambda f, y: F.abs(f - y), lambda f, y, fc: F.signum(fc - y) * f),
    "percentage": (lambda f, y: F.try_divide(F.abs(f - y), y), lambda f, y, fc: F.try_divide(F.signum(fc - y) * f, y)),
    "log": (lambda f, y: -F.ln(f), lambda f, y, fc: F.try_divide(-f, fc)),
}


def pinball(tau: float) -> tuple[Callable[..., Column], Callable[..., Column]]:
    side = lambda y, f: F.when(y < f, F.lit(1.0 - tau)).otherwise(F.lit(-tau))
    return (lambda f, y: side(y, f) * (f - y), lambda f, y, fc: side(y, fc) * f)


def expert_loss(kind: str, gradient: bool, tau: float = 0.5) -> Callable[[Column, Column, Column], Column]:
    """(f, y, fc) -> loss of f, or its linearised loss at the mixture's forecast.

    Percentage loss divides by the signed value and is null at zero; log loss
    is null at forecasts that are not positive.
    """
    if kind not in (*LOSSES, "pinball"):
        raise ValueError(f"unknown loss {kind!r}: {', '.join((*LOSSES, 'pinball'))}")
    loss, slope = pinball(tau) if kind == "pinball" else LOSSES[kind]
    return (lambda f, y, fc: slope(f, y, fc)) if gradient else (lambda f, y, fc: loss(f, y))
