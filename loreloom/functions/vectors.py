"""Vector expressions for single pairs; whole batches go through operators.topk."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances equal to this many decimals are ties and ordered by id, because the
# last digits of a float sum depend on the order the engine adds in.
DISTANCE_DECIMALS = 9


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def has_dimensions(vector: Column, dimensions: int) -> Column:
    return F.size(vector) == dimensions


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cos, in double; NaN when either vector has no direction."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - _dot(left, right) / F.nullif(norms, F.lit(0.0)))


def similarity_from_distance(distance: Column) -> Column:
    """Clamp 1 - distance into [0, 1]; null is 0 and NaN is 1."""
    return F.when(distance.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))
    )


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(_dot(vector, vector))
    return F.transform(
        F.arrays_zip(vector.alias("x"), F.array_repeat(norm, F.size(vector)).alias("n")),
        lambda pair: F.when(pair["n"] == 0, pair["x"]).otherwise(
            (pair["x"] / F.nullif(pair["n"], F.lit(0.0))).cast("float")
        ),
    )
