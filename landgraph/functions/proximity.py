"""Proximity functions of distance, as column, as numpy function and with their derivative."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exponential:
    """exp(-d / scale)"""

    scale: float

    def column(self, d: Column) -> Column:
        return F.exp(-d / self.scale)

    def value(self, d: np.ndarray) -> np.ndarray:
        return np.exp(-d / self.scale)

    def derivative(self, d: np.ndarray) -> np.ndarray:
        return -self.value(d) / self.scale


@dataclass(frozen=True)
class Threshold:
    """1 for d < limit, else 0"""

    limit: float

    def column(self, d: Column) -> Column:
        return (d < self.limit).cast("double")

    def value(self, d: np.ndarray) -> np.ndarray:
        return (d < self.limit).astype(float)

    def derivative(self, d: np.ndarray) -> np.ndarray:
        return np.zeros_like(d)


@dataclass(frozen=True)
class Power:
    """d to the power of -exponent"""

    exponent: float

    def column(self, d: Column) -> Column:
        return F.when(d > 0, F.pow(d, F.lit(-self.exponent)))

    def value(self, d: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.power(d, -self.exponent)

    def derivative(self, d: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -self.exponent * np.power(d, -self.exponent - 1)


@dataclass(frozen=True)
class TruncatedExponential:
    """exp(-d / scale) for d < limit, else 0"""

    scale: float
    limit: float

    def column(self, d: Column) -> Column:
        return F.when(d < self.limit, F.exp(-d / self.scale)).otherwise(0.0)

    def value(self, d: np.ndarray) -> np.ndarray:
        return np.where(d < self.limit, np.exp(-d / self.scale), 0.0)

    def derivative(self, d: np.ndarray) -> np.ndarray:
        return -self.value(d) / self.scale


@dataclass(frozen=True)
class Custom:
    """Any numpy function; without a derivative, central differences are taken."""

    function: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray] | None = None

    def value(self, d: np.ndarray) -> np.ndarray:
        return self.function(d)

    def derivative(self, d: np.ndarray) -> np.ndarray:
        if self.slope is not None:
            return self.slope(d)
        h = 1e-6 * np.maximum(1.0, np.where(np.isfinite(d), d, 1.0))
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(d), (self.function(d + h) - self.function(d - h)) / (2 * h), 0.0)
