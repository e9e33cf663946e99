"""Functions that may fail for a row without failing the job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType, StructField, StructType


def isolated(f: Callable, kind: DataType):
    """A column function like ``f`` that gives a struct of ok, value and error: what is raised for a row becomes its error."""
    told = StructType([StructField("ok", BooleanType()), StructField("value", kind), StructField("error", StringType())])

    def one(x) -> tuple:
        try:
            return True, f(x), None
        except Exception as e:  # noqa: BLE001 - whatever it is, it is this row's
            return False, None, f"{type(e).__name__}: {e}"[:200]

    @F.pandas_udf(told)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(None if x is None or x is pd.NA else x) for x in values], columns=["ok", "value", "error"])

    return run
