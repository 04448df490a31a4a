"""Text functions: letters without marks, tails of distributions. What Spark has no builtin for runs
as an Arrow-batched function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tails(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else 1.0 if v <= 0 else math.erfc(math.sqrt(v / 2)))


# Arrow functions are made where they are used: workers import this module without a session
def chi_squared_p(x: Column | str) -> Column:
    """Upper tail at one degree of freedom: erfc(sqrt(x / 2)); 1 for x <= 0."""
    return F.pandas_udf(_tails, "double")(x)


def strip_diacritics(text: Column) -> Column:
    """Letters without marks, for accented Latin letters, in the JVM; ``greek.strip_diacritics`` does all."""
    marked = "àáâäãåèéêëìíîïòóôöõùúûüçñýÿÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜÇÑÝ"
    plain = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
    return F.translate(text, marked, plain)
