"""Output batches of Arrow functions."""

from __future__ import annotations

import pandas as pd


def frame(columns: list[str], rows: list[tuple]) -> pd.DataFrame:
    """A batch of rows; every column keeps Python objects, so nulls and empty batches convert as the schema says."""
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="object") for i, c in enumerate(columns)}, columns=columns)
