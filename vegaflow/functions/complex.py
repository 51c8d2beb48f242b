"""Complex arithmetic on pairs of double columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Complex:
    re: Column
    im: Column

    def __add__(self, o: Complex) -> Complex:
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Complex) -> Complex:
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Complex) -> Complex:
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: Complex) -> Complex:
        size = o.re * o.re + o.im * o.im
        return Complex((self.re * o.re + self.im * o.im) / size, (self.im * o.re - self.re * o.im) / size)

    def times(self, x: Column) -> Complex:
        return Complex(self.re * x, self.im * x)

    def exp(self) -> Complex:
        return Complex(F.exp(self.re) * F.cos(self.im), F.exp(self.re) * F.sin(self.im))

    def log(self) -> Complex:
        return Complex(F.log(self.re * self.re + self.im * self.im) / 2, F.atan2(self.im, self.re))

    def sqrt(self) -> Complex:
        """The root with a real part that is not negative."""
        size = F.sqrt(self.re * self.re + self.im * self.im)
        up = F.sqrt(F.greatest(size + self.re, F.lit(0.0)) / 2)
        return Complex(up, F.when(self.im < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.sqrt(F.greatest(size - self.re, F.lit(0.0)) / 2))


def one() -> Complex:
    return Complex(F.lit(1.0), F.lit(0.0))


def staged(df: DataFrame, name: str, z: Complex) -> tuple[DataFrame, Complex]:
    """The pair as two columns of the frame, so that what uses it does not repeat its expression."""
    df = df.withColumns({f"{name}_re": z.re, f"{name}_im": z.im})
    return df, Complex(F.col(f"{name}_re"), F.col(f"{name}_im"))
