"""Vector arithmetic on ``ARRAY<FLOAT|DOUBLE>`` columns as higher-order functions.

Spark has no built-in vector distance or dot product for arrays, so these are
``aggregate(zip_with(...))`` expressions: JVM-side and codegen-friendly, no
Python on the row path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of element-wise products, in double."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def sq_distance(a, b) -> Column:
    """Squared Euclidean distance, in double."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda s, d: s + d * d)


def round_array(a, places: int = 6) -> Column:
    return F.transform(_col(a), lambda x: F.round(x.cast("double"), places))
