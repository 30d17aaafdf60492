"""Paths as text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s), na_action="ignore")


def same_path(path: Column) -> Column:
    """The path in composed normal form, without redundant '//' and '/./'."""
    compose = F.pandas_udf(_composed, "string")
    return compose(F.regexp_replace(path, r"/(?:\.?/)+", "/"))
