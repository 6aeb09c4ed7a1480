"""Score columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function of ``x`` held within plus or minus ten."""
    x = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def normalised_margin(top: Column, margin: Column) -> Column:
    return margin / F.greatest(F.abs(top), F.lit(1.0))


def effective_margin(top: Column, margin: Column, is_sigmoid: Column) -> Column:
    """The margin itself for bounded scores, else relative to the score."""
    return F.when(is_sigmoid, margin).otherwise(normalised_margin(top, margin))


def confidence(top: Column, margin: Column, scale: Column, is_sigmoid: Column) -> Column:
    return sigmoid(effective_margin(top, margin, is_sigmoid) * scale - F.lit(1.5))


def similarity(top: Column, is_sigmoid: Column) -> Column:
    return F.when(is_sigmoid, top).otherwise(sigmoid(top / F.lit(5.0)))


def unit(vector: Column) -> Column:
    """The vector divided by its length, in double precision; zero vectors stay."""
    doubles = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm)).otherwise(doubles)
