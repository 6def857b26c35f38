"""Distribution functions Spark SQL lacks. Applied to one row per feature, never to data rows."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these functions with the task; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi2_upper_tail(x: float, dof: int) -> float:
    """P(X > x) for integer degrees of freedom, by the finite closed forms."""
    if x is None or dof is None or math.isnan(x):
        return float("nan")
    h = x / 2.0
    if h <= 0.0:
        return 1.0
    if math.isinf(h):
        return 0.0
    even = dof % 2 == 0
    terms = dof // 2 if even else (dof - 1) // 2
    start = 0.0 if even else 0.5
    tail = 0.0 if even else math.erfc(math.sqrt(h))
    if terms:
        # log of h**(start+i) / Gamma(start+i+1), i = 0..terms-1
        powers = start + np.arange(terms)
        log_gamma = math.lgamma(start + 1.0) + np.concatenate(([0.0], np.cumsum(np.log(powers[1:]))))
        tail += float(np.exp(powers * math.log(h) - log_gamma - h).sum())
    return min(max(tail, 0.0), 1.0)


@F.pandas_udf(DoubleType())
def chi2_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper_tail(x, int(k)) for x, k in zip(statistic, dof)], dtype="float64")
