"""Array-to-rows helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column | str, keep: Sequence[str | Column] = (), pos: str | None = None,
                 value: str = "value") -> DataFrame:
    """One row per array element (null and empty arrays give none), with the
    element's position when ``pos`` is named.

    Built on ``posexplode_outer`` plus a filter on the position: for a plain
    ``explode`` Spark infers a ``size(array) > 0`` filter and pushes it below
    the projection that computes the array, which inlines the array's whole
    expression (a tokenizer regex, say) into every lambda that reads it and
    makes the work quadratic in the row length.  The filter here sits above
    the generator and cannot be pushed into the producer.
    """
    arr = F.col(array) if isinstance(array, str) else array
    p = pos or "_xpos"
    out = df.select(*keep, F.posexplode_outer(arr).alias(p, value)).filter(F.col(p).isNotNull())
    return out if pos else out.drop(p)
