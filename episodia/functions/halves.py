"""The upper 16 bits of 32-bit floats: the short format with the long one's range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import FloatType, IntegerType


@pandas_udf(IntegerType())
def upper_half_bits(x: pd.Series) -> pd.Series:
    """The bits, rounded half to even; null for null."""
    bits = np.ascontiguousarray(x.to_numpy(np.float32, na_value=np.nan)).view(np.uint32).astype(np.int64)
    kept = np.where(np.isnan(x), 0x7FC0, (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16)
    return pd.Series(kept).astype("Int32").mask(x.isna().to_numpy())


@pandas_udf(FloatType())
def upper_half_float(bits: pd.Series) -> pd.Series:
    """The number that the bits stand for."""
    wide = bits.fillna(0).to_numpy(np.uint32) << np.uint32(16)
    return pd.Series(wide.view(np.float32)).mask(bits.isna().to_numpy())
