"""Numbers as a JSON client can take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.contract import decimals_to_double

NOT_FINITE = (float("nan"), float("inf"), float("-inf"))


def sanitize_numeric(df: DataFrame) -> DataFrame:
    """Decimals become double; NaN and both infinities become null."""
    df = decimals_to_double(df)
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~df[c].isin(*NOT_FINITE), df[c]) for c in floating})
