"""Raw I/Q samples as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numpy type, what full scale is, and where zero lies, of each format.
FORMATS = {"u8_iq": ("u1", 127.5, 127.5), "s8_iq": ("i1", 128.0, 0.0), "s16_iq": ("<i2", 32768.0, 0.0), "cf32_iq": ("<f4", 1.0, 0.0)}


def iq(payload: Column, format: str, full_scale: float | None = None) -> Column:
    """The samples of a block: an array of i and q, in full scale. A null block has null samples; a block whose values do
    not pair fails the query."""
    kind, scale, zero = FORMATS[format]
    scale = full_scale or scale
    size = np.dtype(kind).itemsize * 2

    def run(blocks: pd.Series) -> pd.Series:
        out = []
        for b in blocks:
            if b is not None and len(b) % size:
                raise ValueError(f"{len(b)} bytes: I and Q must pair")
            values = None if b is None else ((np.frombuffer(b, kind).astype(np.float32) - np.float32(zero)) / np.float32(scale)).reshape(-1, 2)
            out.append(None if values is None else [{"i": float(i), "q": float(q)} for i, q in values])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<i:float,q:float>>")(payload)


def samples(blocks: DataFrame, payload: str, format: str, full_scale: float | None = None) -> DataFrame:
    """A row for each sample: the block's other columns, n (from 0), i and q."""
    rest = [F.col(f"`{c}`") for c in blocks.columns if c != payload]
    return blocks.select(*rest, F.posexplode(iq(F.col(payload), format, full_scale)).alias("n", "_s")).select(*rest, "n", "_s.i", "_s.q")
